"""Counts, distinct, percentiles and the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.operators.constraints import written
from quernel.operators.listing import where


def count(df: DataFrame, filters=()) -> DataFrame:
    """One row, n: without filters the scan reads no column."""
    return where(df, filters).agg(F.count(F.lit(1)).alias("n"))


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """entity and record_count of each table."""
    return reduce(DataFrame.unionByName, (count(df).select(F.lit(name).alias("entity"), F.col("n").alias("record_count")) for name, df in sorted(tables.items())))


def first_by(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in this order, by a partial minimum."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row")).select(*keys, *(F.col("__row")[c].alias(c) for c in others))


def distinct_union(parts, key: str) -> DataFrame:
    """The union of parts with one row per key, from the first part that has it.

    One aggregation with partial sums of first rows, so a key that many parts hold does not gather in a task.
    """
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged)
    others = [c for c in rows.columns if c not in (key, "__part")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), "__part").alias("__row")).select(key, *(F.col("__row")[c].alias(c) for c in others))


def percentile_floor(df: DataFrame, field: str, percents) -> DataFrame:
    """percent and value: the element at floor(n * p / 100), the last at most, of the sorted values.

    Exact without collecting the values in one row: ranks come from counts of distinct values, whose running sum is
    taken over range partitions' totals.
    """
    counts = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    part = written(counts.repartitionByRange(field).withColumn("__part", F.spark_partition_id()), "percentile")
    within = part.withColumn("upto", F.sum("n").over(W.partitionBy("__part").orderBy(field)))
    before = part.groupBy("__part").agg(F.sum("n").alias("part_n"))
    starts = before.withColumn("start", F.coalesce(F.sum("part_n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = within.join(F.broadcast(starts.select("__part", "start")), "__part").select(field, (F.col("upto") + F.col("start")).alias("upto"), "n")  # a row a partition
    wanted = before.agg(F.sum("part_n").alias("total")).select(F.explode(F.array(*map(F.lit, percents))).alias("percent"), "total")
    wanted = wanted.select("percent", F.least(F.floor(F.col("total") * F.col("percent") / 100), F.col("total") - 1).alias("at"))
    hit = (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))
    return ranked.join(F.broadcast(wanted), hit).select("percent", F.col(field).alias("value"))  # a row a percent


def counters(df: DataFrame, ok: Column) -> DataFrame:
    """n_ok and n_failed."""
    return df.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def duplicates(df: DataFrame, keys) -> DataFrame:
    """The values of keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
