"""Row-level access: ownership, shares, derived access, recipients, closures, topic protection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.predicates import protection_regex
from quernel.operators.constraints import written
from quernel.plans.model import MAX_CLOSURE_NODES, LimitExceeded

#: Permissions in order of strength.
LEVELS = {"view": 1, "edit": 2}


def level_of(permission: Column) -> Column:
    return F.when(permission == "edit", 2).when(permission == "view", 1).otherwise(0)


def owned(sender, owner_field: str | None, admin: bool = False) -> Column:
    """Whether sender may touch the row as its owner; all may where nothing is owned, and admins or internal calls."""
    if admin or sender is None or owner_field is None:
        return F.lit(True)
    return F.coalesce(F.col(owner_field) == F.lit(sender), F.lit(False))


def effective_levels(shares: DataFrame) -> DataFrame:
    """resource_entity, resource_id, grantee, level: the strongest of the grants."""
    return shares.groupBy("resource_entity", "resource_id", "grantee").agg(F.max(level_of(F.col("permission"))).alias("level"))


def accessible(df: DataFrame, shares: DataFrame, entity: str, sender, needed: str, owner_field: str, id_col: str = "id") -> DataFrame:
    """The rows that sender owns or holds a share of at least `needed` for."""
    mine = effective_levels(shares.filter((F.col("resource_entity") == entity) & (F.col("grantee") == F.lit(sender)))).filter(F.col("level") >= LEVELS[needed])
    joined = df.join(mine.select(F.col("resource_id").alias("__rid"), F.lit(True).alias("__shared")), F.col(id_col).cast("string") == F.col("__rid"), "left")
    return joined.filter(owned(sender, owner_field) | F.coalesce("__shared", F.lit(False))).select(*df.columns)


def derived(children: DataFrame, key: str, parents: DataFrame, shares: DataFrame, parent_entity: str, sender, needed: str, owner_field: str, parent_id: str = "id") -> DataFrame:
    """The children whose parent sender may access; those without a parent row are out of reach."""
    allowed = accessible(parents, shares, parent_entity, sender, needed, owner_field, parent_id).select(F.col(parent_id).alias("__parent"))
    return children.join(allowed, F.col(key) == F.col("__parent"), "left_semi")


def shared_with(df: DataFrame, shares: DataFrame, entity: str, grantee, id_col: str = "id") -> DataFrame:
    """The rows shared with grantee, and level; grants for rows that are gone give nothing."""
    mine = effective_levels(shares.filter((F.col("resource_entity") == entity) & (F.col("grantee") == F.lit(grantee))))
    return df.join(mine.select(F.col("resource_id").alias("__rid"), "level"), F.col(id_col).cast("string") == F.col("__rid")).drop("__rid")


def recipients(events: DataFrame, owners: DataFrame, shares: DataFrame) -> DataFrame:
    """events with recipients, the sorted owner and grantees of the governing resource; null where nobody owns it.

    events has governing_entity and governing_id (a child's are its parent's); owners has entity, id, owner.
    """
    granted = shares.groupBy(F.col("resource_entity").alias("governing_entity"), F.col("resource_id").alias("governing_id")).agg(F.collect_set("grantee").alias("__grantees"))
    named = owners.select(F.col("entity").alias("governing_entity"), F.col("id").alias("governing_id"), F.col("owner").alias("__owner"))
    joined = events.join(named, ["governing_entity", "governing_id"], "left").join(granted, ["governing_entity", "governing_id"], "left")
    everyone = F.sort_array(F.array_distinct(F.concat(F.array("__owner"), F.coalesce("__grantees", F.array().cast("array<string>")))))
    return joined.withColumn("recipients", F.when(F.col("__owner").isNotNull(), everyone)).drop("__owner", "__grantees")


def share_events(grants: DataFrame, owners: DataFrame) -> DataFrame:
    """resource_entity, resource_id, recipient: a grant tells its grantee, and the owner unless they granted it."""
    named = grants.join(owners.select(F.col("entity").alias("resource_entity"), F.col("id").alias("resource_id"), "owner"), ["resource_entity", "resource_id"], "left")
    others = F.array_distinct(F.array_compact(F.array("grantee", F.when(~F.col("owner").eqNullSafe(F.col("granted_by")), F.col("owner")))))
    return named.select("resource_entity", "resource_id", F.explode(others).alias("recipient"))


def closure(edges: DataFrame, roots: DataFrame, most: int = MAX_CLOSURE_NODES) -> DataFrame:
    """id of all rows below roots (id), these included. edges: parent, child; cycles end, more than `most` rows fail.

    As at most `most` rows can be found, each level is a small frame: only its edges are looked up.
    """
    seen = roots.select("id").distinct()
    level = seen
    while True:
        below = edges.join(level, F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id")).distinct().join(seen, "id", "left_anti")
        ids = [r["id"] for r in below.limit(most + 1).collect()]  # most + 1 ids, a fixed limit
        if not ids:
            return seen
        level = edges.sparkSession.createDataFrame([(i,) for i in ids], below.schema)
        seen = seen.unionByName(level)
        if seen.limit(most + 1).count() > most:
            raise LimitExceeded(f"the closure has more than {most} rows")


def closure_all(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root and id for each root (id) and row below it, without a limit; levels are written as they are found."""
    seen = roots.select(F.col("id").alias("root"), "id").distinct()
    level = seen
    while True:
        below = level.join(edges, level["id"] == edges["parent"]).select("root", F.col("child").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        level = written(below, "closure")
        if not level.take(1):
            return seen
        seen = seen.unionByName(level)


def grant(shares: DataFrame, rows: DataFrame, entity: str, root, grantee: str, permission: str, by: str) -> DataFrame:
    """shares after a grant: the root gets the level given, rows below it (id) the higher of theirs and it."""
    new = rows.select(F.lit(entity).alias("resource_entity"), F.col("id").cast("string").alias("resource_id"), F.lit(grantee).alias("grantee"), F.lit(permission).alias("__given"), F.lit(by).alias("__by"))
    joined = shares.join(new, ["resource_entity", "resource_id", "grantee"], "full")
    higher = F.when(level_of(F.col("permission")) > level_of(F.col("__given")), F.col("permission")).otherwise(F.col("__given"))
    final = F.when(F.col("__given").isNull(), F.col("permission")).when(F.col("resource_id") == F.lit(str(root)), F.col("__given")).otherwise(higher)
    return joined.select("resource_entity", "resource_id", "grantee", final.alias("permission"), F.coalesce("__by", "granted_by").alias("granted_by"))


def revoke(shares: DataFrame, rows: DataFrame, entity: str, grantee: str) -> DataFrame:
    gone = rows.select(F.lit(entity).alias("resource_entity"), F.col("id").cast("string").alias("resource_id"), F.lit(grantee).alias("grantee"))
    return shares.join(gone, ["resource_entity", "resource_id", "grantee"], "left_anti")


def without_grants(shares: DataFrame, deleted: DataFrame) -> DataFrame:
    """shares without those of deleted resources (entity, id)."""
    gone = deleted.select(F.col("entity").alias("resource_entity"), F.col("id").cast("string").alias("resource_id"))
    return shares.join(gone, ["resource_entity", "resource_id"], "left_anti")


def protection_rules(root: str = "quernel") -> tuple[tuple[str, str], ...]:
    """The tiers of the topic space, of which the first match decides; root is the product's own name in it."""
    # fixed values
    return (
        (f"_{root}/#", "block"),
        ("$DB/_idx/#", "block"),
        ("$DB/_unique/#", "block"),
        ("$DB/_fk/#", "block"),
        ("$DB/_query/#", "block"),
        ("$DB/p+/#", "block"),
        ("$DB/+/events/#", "read_only"),
        ("$DB/u/#", "read_only"),
        ("$DB/_sub/#", "write_only"),
        (f"$SYS/{root}/cluster/#", "admin"),
        ("$SYS/#", "read_only"),
        ("$DB/_verify/#", "admin"),
    )


#: Internal entities that anyone may address.
OPEN_INTERNAL = ("_health", "_vault", "_auth", "_verify")


def tier_of(topic: Column, rules=protection_rules()) -> Column:
    """The tier of the first rule that matches; internal entities need an admin; else open."""
    level = F.concat(F.lit("/"), topic)
    entity = F.regexp_extract(topic, r"^\$DB/([^/]*)", 1)
    internal = entity.startswith("_") & ~entity.isin(*OPEN_INTERNAL)
    return reduce(lambda rest, rule: F.when(level.rlike(protection_regex(rule[0])), rule[1]).otherwise(rest), reversed(rules), F.when(internal, "internal").otherwise("open"))


def protection(topics: DataFrame, rules=protection_rules()) -> DataFrame:
    """topics (topic) with tier."""
    return topics.withColumn("tier", tier_of(F.col("topic"), rules))


def topic_access(requests: DataFrame, rules=protection_rules()) -> DataFrame:
    """requests (topic, publish, admin) with tier and refused: why the topic is out of reach; null where it is not."""
    tier, publish, admin = F.col("tier"), F.col("publish"), F.col("admin")
    refused = F.when(tier == "block", "blocked").when((tier == "read_only") & publish, "read_only").when((tier == "write_only") & ~publish, "write_only").when(tier.isin("admin", "internal") & ~admin, tier)
    return protection(requests, rules).withColumn("refused", refused)
