"""Writes as functions of frames: a new state and the events that lead to it. Time is always given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.scalars import with_defaults
from quernel.operators.constraints import written
from quernel.plans.model import Conflict, Schema


def create(state: DataFrame, incoming: DataFrame, id_col: str = "id", schema: Schema | None = None, now=None, ttl: str = "ttl_secs", strict: bool = False) -> DataFrame:
    """state with incoming put in: defaults filled, _version 1, _expires_at from ttl; an existing id is overwritten.

    strict: an existing id is a conflict. incoming holds an id once; state's columns that it lacks are null.
    """
    if strict and incoming.join(state, id_col, "left_semi").take(1):
        raise Conflict("the id already exists")
    rows = with_defaults(incoming, schema) if schema else incoming
    if ttl in rows.columns:
        until = F.when(F.col(ttl).isNotNull(), F.lit(now).cast("bigint") + F.col(ttl).cast("bigint"))
        rows = rows.withColumn("_expires_at", until).drop(ttl)
    rows = rows.withColumn("_version", F.lit(1).cast("bigint"))
    return state.join(rows.select(id_col), id_col, "left_anti").unionByName(rows, allowMissingColumns=True)


def update(state: DataFrame, changes: DataFrame, id_col: str = "id", given=None, expected: str | None = None) -> DataFrame:
    """state with changes merged in, top level only, and _version one higher; changes to absent ids do nothing.

    given(name): where a change names the field, so that an explicit null overwrites; without it a null leaves the old
    value. expected: a column of changes with the version they were made against; others do nothing.
    """
    fields = [c for c in changes.columns if c not in (id_col, expected)]
    side = changes.select(id_col, F.struct(*fields).alias("__new"), F.lit(True).alias("__hit"), *([F.col(expected).alias("__expected")] if expected else []))
    joined = state.join(side, id_col, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    if expected:
        hit = hit & F.coalesce(F.col("__expected") == F.col("_version"), F.lit(False))
    new = {}
    for c in fields:
        has = given(F.col("__new"), c) if given else F.col("__new")[c].isNotNull()
        new[c] = F.when(hit & has, F.col("__new")[c]).otherwise(F.col(c) if c in state.columns else F.lit(None))
    if "_version" in state.columns:
        new["_version"] = F.col("_version") + F.when(hit, 1).otherwise(0)
    return joined.withColumns(new).select(*state.columns, *(c for c in fields if c not in state.columns))


def delete(state: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return state.join(ids.select(id_col), id_col, "left_anti")


def set_null(state: DataFrame, field: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    marked = state.join(ids.select(F.col("id").alias("__id"), F.lit(True).alias("__hit")), F.col(id_col).cast("string") == F.col("__id"), "left")
    return marked.withColumn(field, F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(field))).select(*state.columns)


def changes(old: DataFrame, new: DataFrame, entity: str, id_col: str = "id") -> DataFrame:
    """entity, id, operation, data (JSON): the events between two states. Updates carry the new row, deletes the old one.

    A null is written as null, so that a field set to null differs from an absent one. Rows are compared as they are and
    only those that differ are written as JSON; states with different columns are compared as JSON.
    """
    alike = old.schema.simpleString() == new.schema.simpleString()
    said = lambda row: F.to_json(row, {"ignoreNullFields": "false"})
    row = lambda df: F.struct(*df.columns) if alike else said(F.struct(*df.columns))
    pack = lambda df, name: df.select(F.col(id_col).cast("string").alias("id"), row(df).alias(name))
    both = pack(old, "before").join(pack(new, "after"), "id", "full")
    operation = F.when(F.col("before").isNull(), "Create").when(F.col("after").isNull(), "Delete").otherwise("Update")
    moved = both.filter(~F.col("before").eqNullSafe(F.col("after")))
    last = F.coalesce("after", "before")
    return moved.select(F.lit(entity).alias("entity"), "id", operation.alias("operation"), (said(last) if alike else last).alias("data"))


def batch(state: DataFrame, id_col: str = "id", puts: DataFrame | None = None, removes: DataFrame | None = None, equal: DataFrame | None = None, absent: DataFrame | None = None) -> DataFrame:
    """state after a batch of puts (whole rows) and removes (ids), if its preconditions hold; else Conflict, and nothing.

    equal has the id and other columns with the values that the row must have (null for null); absent has ids that must
    not exist. Both are checked against the state before the batch, with one join each.
    """
    if equal is not None:
        fields = [c for c in equal.columns if c != id_col]
        want = equal.select(id_col, *(F.col(c).alias(f"__want_{c}") for c in fields))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__want_{c}")) for c in fields), F.col("__there").isNotNull())
        if want.join(state.select(id_col, *fields, F.lit(True).alias("__there")), id_col, "left").filter(~same).take(1):
            raise Conflict("a row is not what the batch expects")
    if absent is not None and absent.select(id_col).join(state.select(id_col), id_col, "left_semi").take(1):
        raise Conflict("a row that the batch expects to be absent exists")
    gone = [x.select(id_col) for x in (puts, removes) if x is not None]
    out = state.join(union_all(gone).distinct(), id_col, "left_anti") if gone else state
    return out.unionByName(puts, allowMissingColumns=True) if puts is not None else out


def sequenced(events: DataFrame, order, after: int = 0, per=()) -> DataFrame:
    """events with sequence, from after + 1, in this order; per: columns whose groups have a sequence of their own each.

    Neither all events nor a large group are ranked in one task: events are dealt by ranges of (per, order), ranked
    within a range, and the counts of the ranges before (a row a range and group) are added.
    """
    per = list(per)
    part = written(events.repartitionByRange(*per, *order).withColumn("__part", F.spark_partition_id()), "sequence")
    within = part.withColumn("__at", F.row_number().over(W.partitionBy("__part", *per).orderBy(*order)))
    sizes = part.groupBy("__part", *per).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*per).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", *per, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    if per:
        starts = starts.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(per)), "__start")
        joined = within.join(starts, [F.col("__part") == F.col("__p"), *(F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(per))])
        joined = joined.drop("__p", *(f"__k{i}" for i in range(len(per))))
    else:
        joined = within.join(F.broadcast(starts), "__part")  # a row a range
    return joined.withColumn("sequence", (F.col("__at") + F.col("__start") + after).cast("bigint")).drop("__part", "__at", "__start")


def gaps(events: DataFrame, per, sequence: str = "sequence") -> DataFrame:
    """per, after, next, missing: where a sequence skips."""
    rows = events.withColumn("__prev", F.lag(sequence).over(W.partitionBy(*per).orderBy(sequence)))
    return rows.filter(F.col(sequence) > F.col("__prev") + 1).select(*per, F.col("__prev").alias("after"), F.col(sequence).alias("next"), (F.col(sequence) - F.col("__prev") - 1).alias("missing"))


def union_all(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
