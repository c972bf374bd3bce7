"""Delivery of change events: matching, modes, groups, expiry, retries, retained values, offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.predicates import topic_regex_of
from quernel.functions.scalars import bucket
from quernel.operators.listing import keyset_page
from quernel.operators.mutate import sequenced
from quernel.plans.model import Config, QuernelError


def _limited(subscriptions: DataFrame, config: Config) -> DataFrame:
    """subscriptions, whose number is checked: they are broadcast."""
    if subscriptions.limit(config.subscriptions + 1).count() > config.subscriptions:
        raise QuernelError(f"more than {config.subscriptions} subscriptions")
    return subscriptions


def matches(events: DataFrame, subscriptions: DataFrame, topic: str = "topic", config: Config = Config()) -> DataFrame:
    """events x the subscriptions whose pattern and entity (if any) fit.

    The pairs are found on distinct (entity, topic) and joined back. Patterns without wildcards are joined on equality;
    of the others only those that begin with one are tried on every topic, the rest on topics with the same first level.
    """
    first = lambda c: F.substring_index(c, "/", 1)
    subs = _limited(subscriptions, config).withColumnRenamed("entity", "__sub_entity").withColumns({"__regex": topic_regex_of(F.col("pattern")), "__first": first(F.col("pattern"))})
    places = events.select("entity", topic).distinct()
    wild, free = F.col("pattern").rlike("(^|/)[+#](/|$)"), F.col("__first").isin("+", "#")
    mine = F.col("__sub_entity").isNull() | (F.col("__sub_entity") == F.col("entity"))
    fit = F.rlike(F.concat(F.lit("/"), F.col(topic)), F.col("__regex")) & mine
    sides = ((~wild, (F.col(topic) == F.col("pattern")) & mine), (wild & ~free, (first(F.col(topic)) == F.col("__first")) & fit), (free, fit))
    pairs = reduce(DataFrame.unionByName, (places.join(F.broadcast(subs.filter(which)), on) for which, on in sides))
    return events.join(pairs.drop("__regex", "__sub_entity", "__first"), ["entity", topic])


def matches_stream(events: DataFrame, subscriptions: DataFrame, topic: str = "topic", config: Config = Config()) -> DataFrame:
    """matches() for a stream of events: a stream-static join."""
    subs = _limited(subscriptions, config).select(F.col("entity").alias("__sub_entity"), topic_regex_of(F.col("pattern")).alias("__regex"), *(c for c in subscriptions.columns if c != "entity"))
    fit = F.rlike(F.concat(F.lit("/"), F.col(topic)), F.col("__regex")) & (F.col("__sub_entity").isNull() | (F.col("__sub_entity") == F.col("entity")))
    return events.join(F.broadcast(subs), fit).drop("__regex", "__sub_entity")


def broadcast_mode(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("share_group").isNull())


def round_robin(matched: DataFrame, order) -> DataFrame:
    """Of a group's matching members, one per event, in turn. The turn is the event's place in the group's sequence.

    matched has share_group, subscription_id and the event's columns; order names columns that tell events apart. Members
    of an event are ordered by id.
    """
    events = W.partitionBy("share_group", *order)
    rows = matched.filter(F.col("share_group").isNotNull())
    rows = rows.withColumn("__place", F.row_number().over(events.orderBy("subscription_id")) - 1).withColumn("__members", F.count(F.lit(1)).over(events))
    turns = sequenced(rows.filter("__place = 0").select("share_group", *order), list(map(F.col, order)), per=["share_group"])
    rows = rows.join(turns, ["share_group", *order])
    return rows.filter(F.col("__place") == F.pmod(F.col("sequence") - 1, F.col("__members"))).drop("__place", "__members", "sequence")


def assignments(members: DataFrame, partitions: int = Config.group_partitions) -> DataFrame:
    """share_group, partition, member: partition p of a group goes to its member number p modulo their number, by id."""
    ordered = members.select("share_group", "member").distinct().withColumn("__at", F.row_number().over(W.partitionBy("share_group").orderBy("member")) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("share_group")))
    parts = ordered.withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))))
    return parts.filter(F.pmod("partition", "__n") == F.col("__at")).select("share_group", "partition", "member")


def event_partition(entity: Column, id_: Column, n: int = Config.group_partitions) -> Column:
    return bucket(F.concat_ws(":", entity, id_.cast("string")), n)


def ordered(events: DataFrame, assigned: DataFrame, n: int = Config.group_partitions) -> DataFrame:
    """events of share_group with member: all of a record's events go to the owner of its partition."""
    return events.withColumn("partition", event_partition(F.col("entity"), F.col("id"), n)).join(assigned, ["share_group", "partition"])


def fresh_members(members: DataFrame, now: int, timeout_s: int = Config.group_timeout_s) -> DataFrame:
    return members.filter(F.lit(now) - F.col("heartbeat") <= timeout_s)


def mixed_groups(subscriptions: DataFrame) -> DataFrame:
    """Groups whose members disagree about the mode; such a subscription is refused."""
    return subscriptions.filter(F.col("share_group").isNotNull()).groupBy("share_group").agg(F.countDistinct("mode").alias("modes")).filter("modes > 1")


def subscribe(subscriptions: DataFrame, row: DataFrame, config: Config = Config()) -> DataFrame:
    """subscriptions with row; refuses a mixed group or more than the configured number."""
    out = subscriptions.unionByName(row)
    if mixed_groups(out).take(1):
        raise QuernelError("a share group has one mode")
    if out.limit(config.subscriptions + 1).count() > config.subscriptions:
        raise QuernelError(f"more than {config.subscriptions} subscriptions")
    return out


def outbox(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """entries with action: dead past the retries, deliver in the oldest batch, else wait; and from, where to resume."""
    alive = entries.filter(F.col("retry_count") < config.outbox_retries)
    batch = alive.orderBy("created_at", "entry_id").limit(config.outbox_batch).select("entry_id", F.lit(True).alias("__now"))
    action = F.when(F.col("retry_count") >= config.outbox_retries, "dead").when(F.col("__now"), "deliver").otherwise("wait")
    return entries.join(F.broadcast(batch), "entry_id", "left").withColumn("action", action).withColumn("from", F.col("dispatched_count")).drop("__now")


def sweep(df: DataFrame, now: int, until: str = "_expires_at") -> tuple[DataFrame, DataFrame]:
    """(kept, expired): expired rows are those whose time has come. Reads before a sweep still show them."""
    gone = F.coalesce(F.col(until) <= now, F.lit(False))
    return df.filter(~gone), df.filter(gone)


def retained(messages: DataFrame, order: Column) -> DataFrame:
    """The last message of each topic; an empty payload clears it."""
    last = messages.groupBy("topic").agg(F.max_by(F.struct(*(c for c in messages.columns if c != "topic")), order).alias("m"))
    return last.select("topic", "m.*").filter(F.coalesce(F.length("payload"), F.lit(0)) > 0)


def offsets(commits: DataFrame, now: int | None = None, keep_s: int = 7 * 86_400) -> DataFrame:
    """consumer, partition, sequence, at: the last commit of each; stale ones are purged where now is given."""
    last = commits.groupBy("consumer", "partition").agg(F.max(F.struct("sequence", "at")).alias("c")).select("consumer", "partition", "c.sequence", "c.at")
    return last if now is None else last.filter(F.lit(now) - F.col("at") <= keep_s)


def expired_sessions(sessions: DataFrame, now: int) -> DataFrame:
    """Sessions that are disconnected for longer than their expiry interval."""
    return sessions.filter(~F.col("connected") & (F.col("disconnected_at") + F.col("expiry_s") <= now))


def idempotency(requests: DataFrame, now: int, keep_s: int) -> DataFrame:
    """request_id, outcome of each request by its first one: first, replay, mismatch (other parameters), or expired."""
    first = W.partitionBy("request_id").orderBy("sequence")
    rows = requests.withColumn("__hash", F.first("params").over(first)).withColumn("__at", F.first("at").over(first)).withColumn("__n", F.row_number().over(first))
    outcome = F.when(F.lit(now) - F.col("__at") > keep_s, "expired").when(F.col("__n") == 1, "first").when(~F.col("params").eqNullSafe(F.col("__hash")), "mismatch").otherwise("replay")
    return rows.select("request_id", "sequence", outcome.alias("outcome"))


def idempotency_check(records: DataFrame, requests: DataFrame, per_partition: int) -> DataFrame:
    """requests with outcome against the records of earlier ones: mismatch (another entity or id under the key), cached
    (committed; response is the old one), processing, expired, full (its partition has no room), or proceed.

    records has partition, request_key, entity, id, status (processing, committed, expired) and response; requests has
    partition, request_key, entity, id and sequence, a key once. New keys take the room that is left in order of sequence.
    """
    old = records.select("partition", "request_key", F.struct("entity", "id", "status", "response").alias("old"))
    rows = requests.join(old, ["partition", "request_key"], "left")
    used = records.groupBy("partition").agg(F.count(F.lit(1)).alias("used"))
    fresh = sequenced(rows.filter(F.col("old").isNull()).select("partition", "request_key", F.col("sequence").alias("at")), [F.col("at")], per=["partition"])
    fresh = fresh.join(used, "partition", "left").select("partition", "request_key", (F.col("sequence") + F.coalesce("used", F.lit(0)) > per_partition).alias("full"))
    differs = (F.col("old.entity") != F.col("entity")) | (F.col("old.id") != F.col("id"))
    outcome = F.when(differs, "mismatch").when(F.col("old.status") == "committed", "cached").when(F.col("old").isNotNull(), F.col("old.status")).when(F.col("full"), "full").otherwise("proceed")
    joined = rows.join(fresh, ["partition", "request_key"], "left").withColumn("outcome", outcome)
    return joined.select("partition", "request_key", "sequence", "outcome", F.when(F.col("outcome") == "cached", F.col("old.response")).alias("response"))


def scoped(events: DataFrame, topic: Column) -> DataFrame:
    """One row per recipient with its topic; events without a recipient go nowhere."""
    return events.select("*", F.explode("recipients").alias("recipient")).withColumn("recipient_topic", F.concat_ws("/", F.lit("$USERS"), "recipient", topic))


def strongest_qos(exact: DataFrame, wildcard: DataFrame, published: int) -> DataFrame:
    """client and qos of all routes: the highest subscribed, the published one at most."""
    return exact.unionByName(wildcard).groupBy("client").agg(F.max("qos").alias("sub")).select("client", F.least("sub", F.lit(published)).alias("qos"))


def reconcile(desired: DataFrame, actual: DataFrame, keys) -> DataFrame:
    """keys and change (add or remove) that turn actual into desired."""
    side = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = side(desired, "__want").join(side(actual, "__have"), list(keys), "full")
    return both.filter(F.col("__want").isNull() | F.col("__have").isNull()).select(*keys, F.when(F.col("__have").isNull(), "add").otherwise("remove").alias("change"))


def replay(log: DataFrame, after: int, most: int = 10_000) -> DataFrame:
    """The next events of a log after a sequence."""
    return keyset_page(log, after, most, "sequence")
