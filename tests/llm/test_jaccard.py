import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from quernel.llm import jaccard as J


def brute(docs, n, num, den=100):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}) if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def corpus(seed, n=150, words=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, words))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        docs.append((i, " ".join(w).title() if rng.random() < 0.3 else "\t".join(w)))
    return docs


@pytest.mark.parametrize(("seed", "shingle", "num", "tile"), [(1, 3, 90, 4096), (2, 5, 80, 8), (3, 1, 50, 4096)])
def test_equals_brute_force(spark, seed, shingle, num, tile):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = J.components(df, J.Params(shingle=shingle, num=num, tile_rows=tile, tile_shingles=30 * tile, small_tile=2 if tile < 100 else 16)).collect()
    assert sorted(map(tuple, got)) == brute(docs, shingle, num)


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (3, "A b c\nd e"), (4, None), (5, ""), (6, " \t"), (7, "x y"), (8, "X  y"), (8, "X  y"), (9, "É y"), (10, "é y"), (None, "only null ids here"), (None, "only null ids here")]
    df = spark.createDataFrame([(i, t, 1, b"", 2, "k") for i, t in rows], "doc_id bigint, text string, n int, node binary, block int, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.components(df).collect()), key=repr)
    want = [(None, 3, 3), (3, 3, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (8, 1, 7), (9, 1, 9), (10, 1, 10), (None, 2, None), (None, 2, None)]
    assert got == sorted(want, key=repr)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (3, 4, 5, 6, 7, 9, 10)]
    assert J.components(df.limit(0)).collect() == [] and J.one_of_each(df.limit(0)).collect() == []


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.component_id for r in J.components(df, J.Params(tile_rows=50, tile_shingles=4000)).collect()} == {0}


def test_bitmaps_never_rule_out_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2 + 1), rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]))
        x, y = (np.frombuffer(J.bitmap(s, 256), np.uint64) for s in (a, b))
        width = min(len(x), len(y))
        assert J.most_overlap(J.fold(x, width), len(a), J.fold(y, width), len(b)) >= len(np.intersect1d(a, b))


def test_connected(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, 200 + i) for i in range(1, 30)]
    pack = lambda i: i.to_bytes(4, "big")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in J.connected(spark.createDataFrame([(pack(a), pack(b)) for a, b in edges if a != b], "u binary, v binary")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_sql_says_the_same(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = J.components(spark.read.parquet(path)).collect()
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{path}'")
    assert sorted(map(tuple, got)) == sorted(db.sql(J.COMPONENTS_SQL).fetchall())


def test_look_alikes_in_many_components(spark, monkeypatch):
    """Tiles that hold several components, dealt in blocks; some of the look-alikes link and some do not."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([1, 3, 4, 5])):
            w[at] = f"n{rng.randrange(6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute(docs, 1, 90)
    assert 3 < len({c for _, _, c in want}) < 120
    monkeypatch.setattr(J, "LOOK", 5)
    for p in (J.Params(shingle=1, num=90, tile_rows=10, tile_shingles=600, small_tile=2), J.Params(shingle=1, num=90), J.Params(shingle=1, num=90, hot_rows=20, tile_rows=30, small_tile=4)):
        assert sorted(map(tuple, J.components(df, p).collect())) == want


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    other = words[:60_000] + ["new"] + words[60_000:]
    docs = [(1, " ".join(words)), (2, "\t".join(other)), (3, " ".join(words[:50_000])), (4, "x" * 3_000_000), (5, "X" * 3_000_000)]
    rows = J.components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {r.doc_id: r.n_shingles for r in rows}[1] > 119_000
