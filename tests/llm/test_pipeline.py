import hashlib
import random

import test_bpe
import test_decontaminate
import test_jaccard
import test_language_id
import test_line_dedup

import __spark_entry__
import corpus_pipeline as pipeline
from quernel.llm import bpe, decontaminate, jaccard, language_id, line_dedup
from quernel.llm.shared import spread

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, texts = docs.columns, {r.doc_id for r in docs.collect()}, None
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        now = {r.doc_id for r in out.collect()}
        assert now <= before, name
        docs, before = spark.createDataFrame(out.collect(), out.schema), now
    texts = {r.doc_id: r.text for r in docs.collect()}
    coder = bpe.load(*bpe._vocabulary(None, None))
    rows = pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: coder.digest(t) for i, t in texts.items()}
    assert len(rows) > 100


def test_stages_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "word " * 20, "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, frame, SF).count() <= frame.count()


def test_stages_take_a_very_long_text(spark):
    rng = random.Random(1)
    text = "\n".join(" ".join(f"word{rng.randrange(9999)}" for _ in range(300)) for _ in range(800)) + "\n" + "y" * 1_000_000
    docs = spark.createDataFrame([(i, f"the and of to in number {i} that with this {i}", "en") for i in range(9)] + [(50, text, "en")], "doc_id bigint, text string, lang string")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert {r.doc_id: r.text for r in docs.collect()}[50] == text
    row = pipeline.STAGES[-1][1](spark, docs, SF).filter("doc_id = 50").first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert pipeline.NEAR.shingle == 5 and pipeline.NEAR.num == 80
    assert all((jaccard, line_dedup, language_id, decontaminate))


def fixture():
    """Documents of two languages with repeated lines, copies, benchmark passages, foreign and empty texts."""
    rng = random.Random(11)
    words = {"en": "the and of to in that with this from have which would there their".split(), "de": "der die und nicht mit auch für ist eine werden haben einen über".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + (str(rng.randrange(90)) if rng.random() < 0.5 else "") for _ in range(n))
    items = [(i, text("en", 24)) for i in range(4)] + [(9, "tiny und exact")]
    docs = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        lines = [text(lang, rng.randint(4, 14)) for _ in range(rng.randint(2, 5))]
        if i % 7 == 0:
            lines.insert(1, "All rights are reserved by the owner of this page")
        if i % 14 == 0:
            lines.append("All rights are reserved by the owner of this page!")
        if i % 11 == 5:
            w = items[i % 4][1].split()
            w[5] = "zz"
            lines.append("so: " + " ".join(w) + " end")
        docs.append((i, "\n".join(lines), lang if i % 5 else None, "s", 0))
    for k, i in enumerate((3, 8, 17)):
        w = docs[i][1].split(" ")
        docs.append((100 + k, " ".join(w[: len(w) // 2] + ["extra"] + w[len(w) // 2 :]).replace("\n", " "), docs[i][2], "s", 0))
    docs += [(200, None, "en", "s", 0), (201, "123 456", "en", "s", 0), (202, "привет как дела мой друг", None, "s", 0), (203, docs[4][1], "en", "s", 0), (204, "nothing but tiny und exact words the and of to", "en", "s", 0)]
    return docs, items


def test_equals_a_brute_force_version(spark, tmp_path):
    docs, items = fixture()
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs_df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_id.fit(docs_df.filter(~language_id.held_out(docs_df["doc_id"])))

    def told(text):
        if not any(c.isalpha() for c in text or ""):
            return False
        x = test_language_id.plain_features(text, model.params.dims)
        evidence = [abs(sum(k * model.weights[f, bit] for f, k in x.items())) / sum(x.values()) for bit in range(model.weights.shape[1])]
        return max(evidence) >= model.params.least_evidence

    left = [(d, t) for d, t, *_ in docs if told(t)]
    texts = test_line_dedup.brute(left)
    left = [(d, texts.get((True, d), "")) for d, t in left]
    left = [(d, t) for d, t in left if t.split()]
    roots = {i: r for i, _, r in test_jaccard.brute(left, 5, 80)}
    left = [(d, t) for d, t in left if roots[d] == d]
    leaked = {d for d, _ in test_decontaminate.brute(left, items)}
    left = [(d, t) for d, t in left if d not in leaked]
    plain = test_bpe.PLAIN
    want = {}
    for d, t in left:
        ids = plain.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.decode_bytes(ids)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    gone = {d for d, *_ in docs} - set(got)
    assert {200, 201, 202, 203, 204} <= gone and len(leaked) >= 4 and 40 <= len(got)


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spread(spark.read.parquet(f"{tmp_path}/one"))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == 100
    many = spark.range(0, 100, 1, 9)
    assert spread(many) is many
