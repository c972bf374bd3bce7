"""Schema, not-null, unique and foreign-key checks as violation frames, and what a delete entails."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.scalars import VARIANT_KINDS, is_kind
from quernel.plans.model import MAX_CASCADE_DEPTH, ForeignKey, ForeignKeyViolation, LimitExceeded, NotNull, OnDelete, QuernelError, Schema, SchemaViolation, Unique


#: Folders that this driver has written, until clear() deletes them.
_MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read back, so that a lost executor changes nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that all executors see, until clear()."""
    _MADE.append(f"{shared_folder(spark)}/quernel/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Deletes what written() has written so far and returns the number of folders; frames that read them end with that."""
    made, _MADE[:] = list(_MADE), []
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(made)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without it there is no place that all executors see."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise QuernelError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def schema_violations(df: DataFrame, schema: Schema, id_col: str = "id") -> DataFrame:
    """id, field, violation (required or type) of typed columns; a column of the wrong type fails where it has a value."""
    rules = []
    for name, f in schema.fields.items():
        if name not in df.columns:
            if f.required and f.default is None:
                rules.append(F.struct(F.lit(name).alias("field"), F.lit("required").alias("violation"), F.lit(True).alias("bad")))
            continue
        if f.required and f.default is None:
            rules.append(F.struct(F.lit(name).alias("field"), F.lit("required").alias("violation"), F.col(name).isNull().alias("bad")))
        if not is_kind(df.schema[name].dataType, f.type):
            rules.append(F.struct(F.lit(name).alias("field"), F.lit("type").alias("violation"), F.col(name).isNotNull().alias("bad")))
    if not rules:
        return df.select(F.col(id_col), F.lit("").alias("field"), F.lit("").alias("violation")).limit(0)
    return df.select(id_col, F.explode(F.array(*rules)).alias("r")).filter("r.bad").select(id_col, "r.field", "r.violation")


def document_violations(df: DataFrame, schema: Schema, data: str = "data", id_col: str = "id") -> DataFrame:
    """As schema_violations() for VARIANT documents: an explicit null in a typed field is a type error."""
    rules = []
    for name, f in schema.fields.items():
        value = F.variant_get(F.col(data), f"$['{name}']", "variant")
        if f.required and f.default is None:
            rules.append(F.struct(F.lit(name).alias("field"), F.lit("required").alias("violation"), value.isNull().alias("bad")))
        wrong = value.isNotNull() & ~F.coalesce(F.schema_of_variant(value), F.lit("")).rlike(VARIANT_KINDS[f.type])
        rules.append(F.struct(F.lit(name).alias("field"), F.lit("type").alias("violation"), wrong.alias("bad")))
    return df.select(id_col, F.explode(F.array(*rules)).alias("r")).filter("r.bad").select(id_col, "r.field", "r.violation")


def null_violations(df: DataFrame, rule: NotNull, id_col: str = "id") -> DataFrame:
    return df.filter(F.col(rule.field).isNull()).select(id_col, F.lit(rule.field).alias("field"))


def unique_violations(df: DataFrame, rule: Unique) -> DataFrame:
    """Values held more than once. each=True: field, value, n per field, null included; else the tuple's columns and n."""
    if not rule.each:
        whole = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in rule.fields))
        return df.filter(whole).groupBy(*rule.fields).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in rule.fields)))
    return df.select(values.alias("v")).groupBy("v.field", "v.value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_violations_of(state: DataFrame, rows: DataFrame, rule: Unique) -> DataFrame:
    """Of the values that rows hold, those that state holds more than once: only rows of state with such values are counted."""
    if not rule.each:
        return unique_violations(state.join(rows.select(*rule.fields).distinct(), list(rule.fields), "left_semi"), rule)
    parts = []
    for f in rule.fields:
        mine = rows.select(F.col(f).alias("__mine")).distinct()
        parts.append(unique_violations(state.join(mine, F.col(f).eqNullSafe(F.col("__mine")), "left_semi"), Unique(rule.entity, (f,))))
    return reduce(DataFrame.unionByName, parts)


def first_claims(df: DataFrame, value: str, order) -> DataFrame:
    """df with won: whether the row is the first in this order (which has no ties) to claim its value.

    The first is found by a partial minimum and joined back, so a value that many rows claim is not ranked in one task.
    """
    best = df.groupBy(F.col(value).alias("__value")).agg(F.min(F.struct(*order)).alias("__best"))
    joined = df.join(best, F.col(value).eqNullSafe(F.col("__value")))
    return joined.withColumn("won", F.struct(*order).eqNullSafe(F.col("__best"))).drop("__value", "__best")


def reserve(claims: DataFrame, requests: DataFrame, now: int, order=("request_id",)) -> tuple[DataFrame, DataFrame]:
    """(claims, outcomes) after reservations of unique values that expire.

    claims has value, record_id, request_id, state (reserved or committed) and expires_at, one row a value; requests has
    value, record_id, request_id, ttl. Of the requests for a value the first in order counts, the others conflict with it.
    An outcome is conflict (committed, or held by another request that has not expired), held (by the same request
    already) or reserved. The first is found by a partial minimum, so a value that many ask for is not ranked in one task.
    """
    first = requests.groupBy("value").agg(F.min(F.struct(*order, "request_id")).alias("__first"))
    held = claims.select("value", F.col("request_id").alias("__by"), F.col("state").alias("__state"), F.col("expires_at").alias("__until"))
    rows = requests.join(first, "value").join(held, "value", "left")
    same, open_ = F.col("__by") == F.col("request_id"), F.col("__by").isNull() | (F.col("__until") <= now)
    chosen = F.struct(*order, "request_id") == F.col("__first")
    outcome = F.when(F.col("__state") == "committed", "conflict").when(F.coalesce(same, F.lit(False)), "held").when(open_ & chosen, "reserved").otherwise("conflict")
    judged = rows.select(*requests.columns, outcome.alias("outcome"))
    new = judged.filter("outcome = 'reserved'").select("value", "record_id", "request_id", F.lit("reserved").alias("state"), (F.lit(now) + F.col("ttl")).cast("bigint").alias("expires_at"))
    return claims.join(new.select("value"), "value", "left_anti").unionByName(new), judged.select("value", "request_id", "outcome")


def commit_claims(claims: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, outcomes) after requests (value, request_id) to commit: committed, already_committed, wrong_request, not_found."""
    asked = requests.select("value", F.col("request_id").alias("__by"))
    joined = asked.join(claims, "value", "left")
    outcome = F.when(F.col("state").isNull(), "not_found").when(F.col("state") == "committed", "already_committed").when(F.col("request_id") != F.col("__by"), "wrong_request").otherwise("committed")
    outcomes = joined.select("value", F.col("__by").alias("request_id"), outcome.alias("outcome"))
    done = outcomes.filter("outcome = 'committed'").select("value", F.lit(True).alias("__done")).distinct()
    state = F.when(F.col("__done"), "committed").otherwise(F.col("state"))
    return claims.join(done, "value", "left").withColumn("state", state).select(*claims.columns), outcomes


def release_claims(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """claims without those that requests (value, request_id) give up: a reserved one by its request, a committed one by
    its record."""
    asked = requests.select("value", F.col("request_id").alias("__by")).distinct()
    own = F.when(F.col("state") == "committed", F.col("record_id")).otherwise(F.col("request_id"))
    return claims.withColumn("__by", own).join(asked, ["value", "__by"], "left_anti").select(*claims.columns)


def reconcile_claims(records: DataFrame, claims: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """id, value and the state of each record's claim.

    claims has value, claim_id, state (committed or reserved). established: no claim yet; already_committed: its own;
    repaired: reserved by itself; pending: reserved by another; conflict: committed by another.
    """
    own = F.col("claim_id") == F.col(id_col)
    state = F.when(F.col("claim_id").isNull(), "established").when(own & (F.col("state") == "committed"), "already_committed").when(own, "repaired").when(F.col("state") == "reserved", "pending").otherwise("conflict")
    return records.join(claims.select(value, "claim_id", "state"), value, "left").select(id_col, value, state.alias("outcome"))


def missing_targets(source: DataFrame, target: DataFrame, rule: ForeignKey) -> DataFrame:
    """The rows of source whose non-null key has no target row."""
    keys = target.select(F.col(rule.target_field).alias("__target"))
    return source.filter(F.col(rule.field).isNotNull()).join(keys, F.col(rule.field) == F.col("__target"), "left_anti")


def referencing(source: DataFrame, deleted: DataFrame, rule: ForeignKey, id_col: str = "id") -> DataFrame:
    """The rows of source that point to a deleted row; deleted has the column of rule.target_field."""
    keys = deleted.select(F.col(rule.target_field).alias("__target")).distinct()
    return source.join(keys, F.col(rule.field) == F.col("__target"), "left_semi")


def cascade(tables: dict[str, tuple[DataFrame, str]], rules, entity: str, deleted: DataFrame, owner: tuple[dict[str, str], object] | None = None, not_null=(), work: int | None = None) -> dict[str, DataFrame]:
    """What deleting these rows of entity entails: {entity: ids to delete}, and under "set_null" (entity, field, id).

    tables maps an entity to its frame and id column; deleted has the id column of entity. Levels are planned breadth
    first, each entity's frontier without what it has already given, so cyclic references end. A restricted child that
    is not itself deleted raises ForeignKeyViolation. owner ({entity: field}, sender): children of other owners are set
    to null, not deleted; a not-null field forbids that. work: the most rows that may be deleted or set to null, counted
    level by level; more raise LimitExceeded.
    """
    key = lambda e: tables[e][1]
    ids = lambda df, e: df.select(F.col(key(e)).cast("string").alias("id"))
    found = {entity: ids(deleted, entity)}
    nulled, restricted, counted = [], [], 0
    frontier, depth, done = {entity: deleted.select(key(entity))}, 0, 0
    while frontier:
        depth += 1
        if depth > MAX_CASCADE_DEPTH:
            raise LimitExceeded(f"the cascade is deeper than {MAX_CASCADE_DEPTH}")
        upcoming: dict[str, DataFrame] = {}
        for at, rows in frontier.items():
            for rule in (r for r in rules if r.target == at):
                source, id_col = tables[rule.source]
                parents = rows if rule.target_field == key(at) else rows.join(tables[at][0].select(key(at), rule.target_field), key(at))
                hit = referencing(source, parents, rule, id_col)
                if rule.on_delete is OnDelete.RESTRICT:
                    restricted.append((rule, hit))
                    continue
                mine = F.lit(True)
                if owner and rule.source in owner[0]:
                    mine = F.col(owner[0][rule.source]).eqNullSafe(F.lit(owner[1]))
                others = hit if rule.on_delete is OnDelete.SET_NULL else hit.filter(~mine)
                nulled.append((rule, others.select(F.lit(rule.source).alias("entity"), F.lit(rule.field).alias("field"), F.col(id_col).cast("string").alias("id"))))
                if rule.on_delete is OnDelete.CASCADE:
                    new = hit.filter(mine).select(id_col)
                    if rule.source in found:
                        new = new.join(found[rule.source].select(F.col("id").alias("__id")), F.col(id_col).cast("string") == F.col("__id"), "left_anti")
                    upcoming[rule.source] = upcoming[rule.source].unionByName(new).distinct() if rule.source in upcoming else new.distinct()
        cyclic = {e for e in upcoming if e in found}
        frontier = {}
        for e, rows in upcoming.items():
            rows = written(rows, f"cascade-{e}") if e in cyclic else rows
            if e in cyclic and not rows.take(1):
                continue
            found[e] = found[e].unionByName(ids(rows, e)) if e in found else ids(rows, e)
            frontier[e] = rows
        if work is not None:
            fresh, counted = nulled[counted:], len(nulled)
            done += sum(rows.limit(work + 1).count() for rows in (*frontier.values(), *(rows for _, rows in fresh)))
            if done > work:
                raise LimitExceeded(f"the cascade touches more than {work} rows")
    for rule, hit in restricted:
        left = hit.join(found[rule.source].select(F.col("id").alias("__id")), F.col(key(rule.source)).cast("string") == F.col("__id"), "left_anti") if rule.source in found else hit
        if left.take(1):
            raise ForeignKeyViolation(f"{rule.source}.{rule.field} still refers to {rule.target}")
    for rule, rows in nulled:
        if NotNull(rule.source, rule.field) in not_null and rows.take(1):
            raise ForeignKeyViolation(f"{rule.source}.{rule.field} cannot be null")
    out = dict(found)
    if nulled:
        every = reduce(DataFrame.unionByName, (rows for _, rows in nulled))
        for e, gone in found.items():
            every = every.join(gone.select(F.lit(e).alias("entity"), "id"), ["entity", "id"], "left_anti") if any(r.source == e for r, _ in nulled) else every
        out["set_null"] = every.select("entity", "field", "id").distinct()
    return out


def check_set_null(rule: ForeignKey, schema: Schema | None, not_null=()) -> None:
    """A set-null key needs a field that may be null: declared rules forbid others when they are made."""
    if rule.on_delete is OnDelete.SET_NULL:
        if NotNull(rule.source, rule.field) in not_null:
            raise SchemaViolation(f"{rule.source}.{rule.field} is not null; it cannot be set to null")
        if schema and rule.field in schema.fields and schema.fields[rule.field].type.value != "null":
            raise SchemaViolation(f"{rule.source}.{rule.field} has a type that null does not fit")


def stale_entries(index: DataFrame, data: DataFrame, id_col: str = "id") -> DataFrame:
    """Index rows whose record is gone."""
    return index.join(data.select(id_col), id_col, "left_anti")
