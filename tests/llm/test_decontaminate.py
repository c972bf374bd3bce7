import random
import re

import duckdb
import pytest

from quernel.llm import decontaminate as C
from quernel.llm import oracles

P = C.Params()


def tokens(text):
    return [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]


def verified(a, b, x, y):
    """Whether the alignment of a[x] and b[y], whose seeds agree, holds up around y."""
    span, least = len(P.masks[0]), min(P.least, len(b))
    same = lambda low, high: sum(a[x - y + k] == b[k] for k in range(low, high))
    start, end = max(0, y - x), min(len(b), len(a) - x + y)
    low, high = max(start, y - P.reach), min(end, y + span + P.reach)
    if high - low >= least and 100 * same(low, high) >= P.percent * (high - low):
        return True
    return any(100 * same(k, k + least) >= P.stretch_percent * least for k in range(max(start, y + span - least), min(y, end - least) + 1))


def brute(docs, items):
    """All (doc, item) with an alignment whose seed matches under a mask and whose surroundings agree; short items whole."""
    found, span = set(), len(P.masks[0])
    for d, text in docs:
        a = tokens(text)
        for i, item in items:
            b = tokens(item)
            if 0 < len(b) < span and any(a[x : x + len(b)] == b for x in range(len(a))):
                found.add((d, i))
            for x in range(len(a) - span + 1):
                for y in range(len(b) - span + 1):
                    if any(all(a[x + k] == b[y + k] for k, bit in enumerate(m) if bit == "1") for m in P.masks) and verified(a, b, x, y):
                        found.add((d, i))
    return found


def setup(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(8)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(60)]
        if i % 2:
            passage = items[i % 8][1].split()
            for k in range(len(passage)):
                if rng.random() < (i % 5) / 12:
                    passage[k] = word()
            w[20:20] = passage
        docs.append((i, " ".join(w).title()))
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 0, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id int, tokens string, pos int"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_equals_brute_force(spark, seed):
    docs, items = setup(seed)
    docs += [(100, "lead in " + " ".join(items[3][1].split()[2:17]) + " and out " * 20), (101, "q " * 30 + items[5][1])]
    items += [(20, "w1 w2"), (21, " ".join(docs[1][1].split()[20:27])), (22, ".")]
    a, b = frames(spark, docs + docs[:3], items)
    rows = C.overlaps(a, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(docs, items) and len(got) == len(rows) >= 10
    once = C.overlaps(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, once))  # repeated rows count once
    kept = C.without_overlaps(a, b)
    assert kept.columns == a.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in got}


def test_sql_says_the_same(spark):
    docs, items = setup(3)
    items += [(20, "w1"), (21, " ".join(docs[1][1].split()[20:25]))]
    db = duckdb.connect()
    db.execute("create table documents(doc_id bigint, text varchar)").executemany("insert into documents values (?, ?)", docs)
    db.execute("create table benchmark(item_id bigint, text varchar)").executemany("insert into benchmark values (?, ?)", items)
    got = C.overlaps(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(oracles.decontamination_sql()).fetchall())


def test_very_long_text(spark):
    item = " ".join(f"t{i}" for i in range(30))
    docs = [(1, " ".join(f"x{i % 9999}" for i in range(300_000)) + " " + item), (2, "z" * 2_000_000)]
    assert {(r.doc_id, r.matched) for r in C.overlaps(*frames(spark, docs, [(1, item)])).collect()} == {(1, 24)}


def test_exact_passages_are_found_and_odd_rows_pass(spark):
    item = "The quick brown fox jumps over a lazy dog, while Émile's 3 cats sleep on."
    docs = [(1, "x " * 500 + item + " y" * 500), (2, None), (3, ""), (4, "the quick brown fox"), (None, "so: " + item.upper()), (5, "!!"), (1, "another row")]
    a, b = frames(spark, docs, [(7, item), (8, None), (9, ""), (10, "too short")])
    got = {(r.doc_id, r.item_id) for r in C.overlaps(a, b).collect()}
    assert got == {(1, 7), (None, 7)}
    assert {r.doc_id for r in C.without_overlaps(a, b).collect()} == {2, 3, 4, 5}
    assert C.overlaps(a.limit(0), b).collect() == [] and C.overlaps(a, b.limit(0)).collect() == []
    assert C.without_overlaps(a, b.limit(0)).count() == len(docs)


def test_substitutions_do_not_hide_a_passage(spark):
    item = " ".join(f"t{i}" for i in range(40))
    docs = []
    for i in range(40):
        w = item.split()
        w[i] = "zz"
        docs.append((i, "a b c " + " ".join(w) + " d e f"))
    a, b = frames(spark, docs, [(1, item)])
    assert {r.doc_id for r in C.overlaps(a, b).collect()} == set(range(40))
