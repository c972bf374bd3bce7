"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a mask over a span of tokens; the tokens under its zeros are ignored, so a substitution there does not hide a
match. Hashes of all masked spans of the benchmark items are joined with those of the documents. Each hit gives an
alignment of document and item; every seed that hits on it is verified: the tokens around it must be equal in enough
places, or some stretch of `least` tokens that holds it in nearly all. An item shorter than a span is its own seed,
without zeros, and must be found whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import let, small, written


@dataclass(frozen=True)
class Params:
    masks: tuple[str, ...] = ("11011011", "11100111")
    reach: int = 8  #: tokens compared on either side of a seed
    percent: int = 75  #: of the compared tokens that must be equal
    least: int = 14  #: compared tokens at least, or all of a shorter item; also the tokens of a stretch
    stretch_percent: int = 90  #: of a stretch's tokens that must be equal


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; none for null."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return let(cut, lambda t: F.filter(t, lambda x: x != ""))


def seed_hashes(tokens: Column, masks: tuple[str, ...]) -> Column:
    """For each position, an array with one hash per mask, null for those that reach beyond the last token."""
    shortest = min(map(len, masks))

    def at(th: Column) -> Column:
        one = lambda i, m: F.xxhash64(F.lit(m), *(F.get(th, i + j) for j, bit in enumerate(m) if bit == "1"))
        each = lambda i: F.array(*(one(i, m) if len(m) == shortest else F.when(i + len(m) <= F.size(th), one(i, m)) for m in masks))
        return F.when(F.size(th) < shortest, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(th) - shortest), each))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), at)


def _seeds(rows: DataFrame, key: str, masks) -> DataFrame:
    each = rows.select(key, F.posexplode(seed_hashes(F.col("tokens"), masks)).alias("pos", "hashes"))
    return each.select(key, "pos", F.explode("hashes").alias("seed")).filter("seed is not null")


def _best(equal: Column, n_item: Column, p: Params) -> Column:
    """The best verified window of an alignment, (matched, -compared), or null; equal has 1 or 0 for each aligned token."""
    span = len(p.masks[0])
    least = F.least(F.lit(p.least), n_item)

    def windows(e: Column) -> Column:
        n = F.size(e)
        hit = lambda y: F.array_contains(F.array(*(F.forall(F.array(*(F.get(e, y + j) == 1 for j, bit in enumerate(m) if bit == "1")), lambda x: x) for m in p.masks)), True)
        hits = F.filter(F.sequence(F.lit(0), n - span), hit)
        around = lambda y: F.struct(F.greatest(F.lit(0), y - p.reach).alias("low"), F.least(n, y + span + p.reach).alias("high"), F.lit(p.percent).alias("percent"))
        first, last = lambda y: F.greatest(F.lit(0), y + span - least), lambda y: F.least(y, n - least)
        stretch = lambda a: F.struct(a.alias("low"), (a + least).alias("high"), F.lit(p.stretch_percent).alias("percent"))
        stretches = lambda y: F.when(first(y) <= last(y), F.transform(F.sequence(first(y), F.greatest(first(y), last(y))), stretch)).otherwise(F.array().cast("array<struct<low:int,high:int,percent:int>>"))
        return F.array_distinct(F.flatten(F.transform(hits, lambda y: F.concat(F.array(around(y)), stretches(y)))))

    def judged(e: Column) -> Column:
        total = lambda x: F.aggregate(F.slice(e, x["low"] + 1, x["high"] - x["low"]), F.lit(0), lambda acc, v: acc + v)
        of = F.transform(windows(e), lambda x: F.struct(total(x).alias("matched"), (x["low"] - x["high"]).alias("less"), x["percent"].alias("percent")))
        enough = F.filter(of, lambda x: (100 * x["matched"] >= -x["less"] * x["percent"]) & (-x["less"] >= least))
        return F.array_max(F.transform(enough, lambda x: F.struct(x["matched"], x["less"])))

    whole = lambda e: F.when(~F.array_contains(e, 0) & (F.size(e) == n_item), F.struct(n_item.alias("matched"), (-n_item).alias("less")))
    return let(equal, lambda e: F.when(n_item < span, whole(e)).when(F.size(e) >= span, judged(e)))


def overlaps(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id, n_places, matched, compared of every document that holds a passage of a benchmark item.

    One row per document and item: the number of verified alignments, and the tokens equal and compared in the window
    with most equal ones (the shortest of such). Null and empty texts, and empty tables, give no row. Repeated ids are
    taken together, and a repeated row counts once; null ids are one id. Very long texts are searched whole. The items
    are broadcast only while their measured size is small; else the join is shuffled.
    """
    p, span = params, len(params.masks[0])
    items = benchmark.select("item_id", tokens_of(F.col("text")).alias("tokens"))
    n, chars = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    size = F.size("tokens")
    short = sorted(r[0] for r in items.filter((size > 0) & (size < span)).select(size).distinct().collect())  # below a span: a few numbers
    seeds = _seeds(items, "item_id", p.masks).select("item_id", "pos", "seed")
    for m in short:
        seeds = seeds.unionByName(_seeds(items.filter(size == m), "item_id", ("1" * m,)))
    seeds = seeds.withColumnRenamed("pos", "item_pos")
    words = docs.select("doc_id", tokens_of(F.col("text")).alias("tokens"))
    hits = _seeds(words, "doc_id", (*p.masks, *("1" * m for m in short))).join(small(seeds, chars, 8 * len(p.masks)), "seed")
    places = written(hits.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "seed-hits")
    with_hits = small(places.select("doc_id").distinct(), places.count(), 16)
    wanted = docs.select("doc_id", "text").join(with_hits, docs["doc_id"].eqNullSafe(with_hits["doc_id"]), "left_semi").select(F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("tokens"))
    found = places.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    found = found.join(small(items.withColumnRenamed("tokens", "item_tokens").withColumnRenamed("item_id", "item"), n * 64 + 2 * chars, 1), F.col("item_id").eqNullSafe(F.col("item")))
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item_tokens"), F.size("tokens") - F.col("shift"))
    part = lambda x, start: F.slice(F.col(x), start + 1, F.greatest(F.lit(0), high - low))
    equal = F.zip_with(part("tokens", low + F.col("shift")), part("item_tokens", low), lambda a, b: F.when(a == b, 1).otherwise(0))
    judged = found.select("doc_id", "item_id", "shift", _best(equal, F.size("item_tokens"), p).alias("best")).filter("best is not null")
    places = judged.groupBy("doc_id", "item_id", "shift").agg(F.max("best").alias("best"))
    return places.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_places"), F.max("best").alias("best")).select("doc_id", "item_id", "n_places", F.col("best.matched").cast("bigint").alias("matched"), (-F.col("best.less")).cast("bigint").alias("compared"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs, with their own columns, whose id has no overlap with a benchmark item."""
    found = written(overlaps(docs, benchmark, params).select(F.col("doc_id").alias("__leaked")).distinct(), "leaks")
    return docs.join(small(found, found.count(), 16), docs["doc_id"].eqNullSafe(F.col("__leaked")), "left_anti")
