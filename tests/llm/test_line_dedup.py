import random

from quernel.llm import line_dedup as D

P = D.Params()


def within_one(a, b):
    """Edit distance of one at most, by its definition."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs):
    """{id: kept text} by comparing each line with every earlier one."""
    lines = []
    for i, text in docs:
        for n, raw in enumerate((text or "").split("\n") if text is not None else []):
            norm = lower(" ".join(raw.strip(" \t\x0b\x0c\r").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")))
            lines.append(((i is not None, i or 0, n), " ".join(x for x in norm.split(" ") if x), raw))
    out = {}
    for place, norm, raw in lines:
        long = len(norm) >= P.least_chars
        late = norm and any(p < place and (m == norm or long and len(m) >= P.least_chars and within_one(m, norm)) for p, m, _ in lines)
        if not late:
            out.setdefault(place[:2], []).append(raw)
    return {k: "\n".join(v) for k, v in out.items()}


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in docs], "doc_id bigint, text string, n_lines int, gone string")
    want = brute(docs)
    rows = D.dedup_lines(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.text is not None:
            assert r.text == want.get((r.doc_id is not None, r.doc_id or 0), ""), r.doc_id
            assert r.n_dropped == r.n_lines - (len(r.text.split("\n")) if r.n_lines != r.n_dropped else 0)
        else:
            assert r.n_lines == 0
    kept = D.without_repeats(df)
    assert kept.columns == df.columns
    return rows


def test_planted_edits_at_every_place(spark):
    base = "Thé quick brown fox jumps over the lazy dog again and again"
    docs = [(0, base)]
    for i in range(len(base)):
        docs.append((100 + i, base[:i] + "Z" + base[i + 1 :]))
        docs.append((300 + i, base[:i] + base[i + 1 :]))
        docs.append((500 + i, base[:i] + "é" + base[i:]))
    docs.append((900, base[:10] + "ZZ" + base[12:]))
    rows = check(spark, docs)
    by = {r.doc_id: r.n_dropped for r in rows}
    assert by[0] == 0 and by[900] <= 1 and sum(by[100 + i] for i in range(len(base))) == len(base)


def test_random_lines(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randint(20, 34))) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            s = list(rng.choice(pool))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "X"])
            lines.append("".join(s))
        docs.append((i, "\n".join(lines)))
    check(spark, docs)


def test_odd_rows(spark):
    long = "a line that is long enough to count as one"
    docs = [(None, long), (1, None), (2, ""), (3, f"{long}\n\n  {long.upper()} \nshort\nshort"), (4, "short\r\n" + long + "\t")]
    check(spark, docs)
    df = spark.createDataFrame([(7, long), (7, long), (8, long)], "doc_id bigint, text string")
    rows = sorted((r.doc_id, r.text) for r in D.dedup_lines(df).collect())
    assert rows == [(7, long), (7, long), (8, "")]  # equal places do not drop each other
    assert {r.doc_id for r in D.without_repeats(df).collect()} == {7}
    assert D.dedup_lines(df.limit(0)).collect() == [] and D.without_repeats(df.limit(0)).collect() == []


def test_a_very_long_line_and_a_very_frequent_one(spark):
    long = "x".join(str(i) for i in range(20_000))
    often = "this line stands in every document there is"
    docs = [(i, often) for i in range(400)] + [(1000, long), (1001, long[:50_000] + "!" + long[50_001:])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id for r in D.dedup_lines(df).filter("n_dropped = 0").collect()} == {0, 1000}


def test_variant_hashes():
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("ab\U0001f600é") for _ in range(rng.randint(0, 12)))
        got = D.variant_hashes(s, 77)
        assert len(got) == len(s) + 1 and all(got[i + 1] == D.variant_hashes(s[:i] + s[i + 1 :], 77)[0] for i in range(len(s)))
    many = {t: D.variant_hashes(t, 5)[0] for t in ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(20000))}
    assert len(set(many.values())) == len(many) and D.variant_hashes("ab", 5)[0] != D.variant_hashes("ab", 6)[0]


def test_lines_of_millions_of_characters(spark):
    rng = random.Random(8)
    docs = []
    for k, n in enumerate((1_000_000, 5_000_000)):
        line = "".join(rng.choices("abcdefgh ", k=n)).strip()
        docs += [(10 * k, line), (10 * k + 1, line[: n // 3] + "!" + line[n // 3 :]), (10 * k + 2, line[: n // 2] + "??" + line[n // 2 :])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: r.n_dropped for r in D.dedup_lines(df).select("doc_id", "n_dropped").collect()} == {0: 0, 1: 1, 2: 0, 10: 0, 11: 1, 12: 0}


def test_short_lines_go_by_exact_copies(spark):
    long = "a line that is long enough to count as one"
    docs = [(1, f"All rights reserved.\n\n{long}\nab"), (2, f"all  RIGHTS reserved.\n \nAll rights reserved!\n{long}s"), (3, "ab\nab\nac\n"), (4, None), (5, "AB")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in D.dedup_lines(df).collect()}
    assert got == {1: (docs[0][1], 0), 2: (" \nAll rights reserved!", 2), 3: ("ac\n", 2), 4: (None, 0), 5: ("", 1)}
    assert {r.doc_id for r in D.without_repeats(df).collect()} == {1, 2, 3, 4}
