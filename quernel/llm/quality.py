"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

The rules are cutoffs of four features, in one fixed ladder from mild to strict: each step lowers the cutoff of one
feature, so what a step rejects the next one rejects too. For each stratum (language), labelled good documents that pass
the base rule show how many of them a step would reject wrongly. A step is certified when the exact binomial probability
of so few false rejections, were the true rate `risk` or more, is at most `delta` divided by the number of strata
(Bonferroni). The steps of a stratum are tested in order, up to the first that fails; in such a fixed sequence of nested
rules each may be tested at the same level. So with probability 1 - delta the verdict rejects less than `risk` of the good
documents of every stratum, over all features together. A stratum without a certified step rejects nothing beyond the
base rule; with s strata it takes log(delta / s) / log(1 - risk) labelled good documents to certify one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.shared import SPACE, let, written

WINDOW = 5  #: words of a repeat window


@dataclass(frozen=True)
class Params:
    risk: float = 0.025  #: bound on the rate of good documents that the verdict rejects, per stratum
    delta: float = 0.05  #: chance that any of the bounds fails
    min_words: int = 10
    repeat_percent: int = 20
    #: (feature, cutoff in thousandths) from mild to strict; a document with more is rejected.
    ladder: tuple[tuple[str, int], ...] = ()

    def steps(self) -> tuple[tuple[str, int], ...]:
        """The ladder: symbols first, as junk is full of them and prose has none; then the others in turn, up to what prose
        with a refrain or a long compound still stays below."""
        symbols = (400, 300, 200, 150, 100, 80, 60, 40, 20, 10)
        others = {"long_word": (50000, 30000, 20000, 16000, 14000, 12000, 11000, 10000), "dup_line_rate": (900, 800, 700, 600, 500, 450, 400, 350), "repeat_rate": (195, 190, 185, 180, 170, 160, 150, 140)}
        return self.ladder or (*(("symbol_rate", c) for c in symbols), *((f, cs[i]) for i in range(8) for f, cs in others.items()))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of text, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \x09-\x0D]+"))


def _covered(hashes: Column, width: int) -> Column:
    """Positions covered by windows whose hash occurs twice or more, from the window hashes in order."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twin = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == e["h"])))
        return F.sort_array(F.transform(twin, lambda e: e["p"]))

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(let(pairs, starts), begin, step, lambda acc: acc["n"])


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """The number of words in windows of `width` words found twice or more, the first one included.

    Windows are compared by 64-bit hashes of their words' hashes. The longer work on positions is only done where an
    equal pair exists.
    """

    def count(wh: Column) -> Column:
        hashes = F.when(F.size(wh) < width, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(wh) - width), lambda i: F.xxhash64(*(F.get(wh, i + k) for k in range(width)))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_covered(h, width)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for every row, over whole texts.

    Null text has no words and zeros; null lang is the stratum `und`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    numbers = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    return docs.select(
        "doc_id",
        stratum.alias("stratum"),
        numbers.alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
    ).select("doc_id", "stratum", "w.n_words", "w.word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"))


def _rates() -> dict[str, Column]:
    per_mille = lambda a, b: F.coalesce(F.expr(f"(1000 * {a}) div nullif({b}, 0)"), F.lit(0).cast("bigint"))
    return {
        "symbol_rate": per_mille("n_symbols", "word_chars"),
        "dup_line_rate": per_mille("n_dup_lines", "n_lines"),
        "repeat_rate": per_mille("n_repeat_words", "n_words"),
        "long_word": per_mille("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial in n and p, summed in logarithms so that no term underflows; 1 where k >= n*p."""
    import math

    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    state = F.struct(first.alias("term"), first.alias("total"))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), state, step, lambda acc: F.exp(acc["total"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), summed))


def rejecting_step(p: Params) -> Column:
    """The first step of the ladder (from 1) that rejects a row with the four rates; null if none does."""
    return F.array_min(F.array(*(F.when(F.col(f) > c, k) for k, (f, c) in enumerate(p.steps(), 1))))


def certified(holdout: DataFrame, p: Params = Params()) -> DataFrame:
    """stratum and cut, the last certified step of its ladder, for the strata that have one.

    holdout has stratum and step (rejecting_step) of labelled good documents.
    """
    tall = holdout.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("k"))  # strata x steps at most
    sizes = tall.groupBy("stratum").agg(F.sum("k").alias("n"), F.collect_list(F.struct("step", "k")).alias("by_step"))
    sizes = sizes.withColumn("strata", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    # fewer false rejections have a smaller tail, so the steps that pass are the first ones up to the one that fails
    each = sizes.select("stratum", "n", "strata", "by_step", F.explode(F.sequence(F.lit(1), F.lit(len(p.steps())))).alias("cut"))
    wrong = F.aggregate(F.filter("by_step", lambda x: x["step"] <= F.col("cut")), F.lit(0).cast("bigint"), lambda acc, x: acc + x["k"])
    return each.filter(binomial_tail(F.col("n"), wrong, p.risk) <= p.delta / F.col("strata")).groupBy("stratum").agg(F.max("cut").alias("cut"))


def quality_rules(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, step, cut for every row of
    docs: step is the first of the ladder that rejects it (null if none), cut the stratum's last certified one (null: none).

    labels has doc_id and quality (1: good); other values, nulls and ids without a document teach nothing, repeated
    labels count once. Null text has no words, null lang is a stratum of its own; empty tables give empty ones or no cut.
    Very long texts count whole. Repeated documents give repeated rows, judged alike. The features are written to the
    shared folder once, so whole texts are read a single time.
    """
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words"))
    base = written(features(docs), "quality").select("*", *(v.alias(k) for k, v in _rates().items()))
    base = base.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rejecting_step(params).alias("step"))
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    cut = certified(base.filter("not base_failed").join(good, "doc_id", "left_semi"), params)
    over = F.coalesce(F.col("step") <= F.col("cut"), F.lit(False))
    return base.join(cut, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), "step", "cut")
