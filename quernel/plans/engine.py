"""The embedded API: entities as frames, metadata, and requests that return frames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.predicates import valid_pattern
from quernel.operators import access, aggregate, constraints, listing, mutate
from quernel.plans.model import Config, Forbidden, ForeignKey, ForeignKeyViolation, ListRequest, NotFound, NotNull, NotNullViolation, QuernelError, Relationship, Schema, SchemaViolation, Unique, UniqueViolation, valid_entity
from quernel.sources import backup as backups
from quernel.streaming import routing

SHARES = "resource_entity string, resource_id string, grantee string, permission string, granted_by string"
SUBSCRIPTION = "subscription_id string, pattern string, entity string, share_group string, mode string"


@dataclass
class Engine:
    """A set of entities. Writes replace an entity's frame by a planned new one; `keep` and `commit` run and write it.

    A sender given to a request is held to ownership and shares: reads need the level view, updates and creates of
    derived children edit, deletes the row's owner. Without one, or as an admin, everything is allowed.
    """

    spark: SparkSession
    config: Config = field(default_factory=Config)
    tables: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    schemas: dict[str, Schema] = field(default_factory=dict)
    rules: list = field(default_factory=list)
    relations: dict[tuple[str, str], Relationship] = field(default_factory=dict)
    indexes: dict[str, set[str]] = field(default_factory=dict)
    owners: dict[str, str] = field(default_factory=dict)
    derived: dict[str, tuple[str, str]] = field(default_factory=dict)
    shares: DataFrame | None = None
    subscriptions: DataFrame | None = None
    heartbeats: dict[str, int] = field(default_factory=dict)
    events: list[DataFrame] = field(default_factory=list)
    scopes: dict[str, str] = field(default_factory=dict)
    admins: frozenset[str] = frozenset()

    def __post_init__(self):
        # A union that passes its sides' partitioning on fails once adaptive execution has coalesced one side and not the other.
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    # metadata
    def add_entity(self, name: str, df: DataFrame, id_col: str = "id") -> Engine:
        if not valid_entity(name):
            raise QuernelError(f"no valid entity name: {name!r}")
        self.tables[name] = (df, id_col)
        return self

    def add_schema(self, schema: Schema) -> Engine:
        old = self.schemas.get(schema.entity)
        self.schemas[schema.entity] = old.revised(schema.fields) if old else schema
        return self

    def add_index(self, entity: str, *fields: str) -> Engine:
        """Writes the entity anew, sorted by all its indexed fields, so that filters on them skip files by their statistics."""
        df, id_col = self._table(entity)
        known = self.indexes.setdefault(entity, set())
        if not known.issuperset(fields):
            known.update(fields)
            self.tables[entity] = (listing.sorted_copy(df, sorted(known)), id_col)
        return self

    def add_relationship(self, source: str, name: str, target: str, column: str = "") -> Engine:
        self.relations[source, name] = Relationship(source, name, target, column)
        return self

    def add_constraint(self, rule: Unique | NotNull | ForeignKey) -> Engine:
        df = self._table(rule.source if isinstance(rule, ForeignKey) else rule.entity)[0]
        if isinstance(rule, Unique) and constraints.unique_violations(df, rule).take(1):
            raise UniqueViolation(f"{rule.entity} already has equal values of {', '.join(rule.fields)}")
        if isinstance(rule, ForeignKey):
            constraints.check_set_null(rule, self.schemas.get(rule.source), [r for r in self.rules if isinstance(r, NotNull)])
        self.rules.append(rule)
        return self

    def remove_constraint(self, rule) -> Engine:
        self.rules.remove(rule)
        return self

    def constraints_of(self, entity: str) -> list:
        return [r for r in self.rules if (r.source if isinstance(r, ForeignKey) else r.entity) == entity]

    def entity_names(self) -> list[str]:
        return sorted(self.tables)

    def entity_record_count(self, name: str) -> int:
        return self._table(name)[0].count()

    def catalog(self) -> DataFrame:
        return aggregate.catalog({n: df for n, (df, _) in self.tables.items()})

    def schema_of(self, entity: str) -> Schema | None:
        self._table(entity)
        return self.schemas.get(entity)

    def describe(self) -> DataFrame:
        """entity, record_count, schema (JSON), constraints, indexes, owner, derived_from, scope of every entity."""
        told = lambda s: json.dumps({"version": s.version, "fields": {n: {"type": f.type.value, "required": f.required, "default": f.default} for n, f in s.fields.items()}}) if s else None
        rows = [(n, told(self.schemas.get(n)), [str(r) for r in self.constraints_of(n)], sorted(self.indexes.get(n, ())), self.owners.get(n), self.derived.get(n, (None, None))[1], self.scopes.get(n)) for n in self.entity_names()]
        meta = self.spark.createDataFrame(rows, "entity string, schema string, constraints array<string>, indexes array<string>, owner string, derived_from string, scope string")
        return self.catalog().join(F.broadcast(meta), "entity")  # a row an entity

    def _table(self, name: str) -> tuple[DataFrame, str]:
        if name.startswith("_"):
            raise Forbidden(f"{name} is internal")
        if name not in self.tables:
            raise NotFound(f"no entity {name}")
        return self.tables[name]

    # reads
    def _held(self, entity: str, sender) -> bool:
        """Whether sender's access to entity is limited at all."""
        return sender is not None and sender not in self.admins and (entity in self.owners or entity in self.derived)

    def _own(self, entity: str, sender) -> tuple[DataFrame, str]:
        """The entity as lists, counts and cursors show it: what sender owns, or children of what they may view."""
        df, id_col = self._table(entity)
        if not self._held(entity, sender):
            return df, id_col
        return (df.filter(access.owned(sender, self.owners[entity])) if entity in self.owners else self.accessible(entity, sender)), id_col

    def _need(self, entity: str, ids: DataFrame, sender, needed: str) -> None:
        """All of ids (a column named like the entity's id) exist, and sender has the level on each."""
        df, id_col = self._table(entity)
        if ids.join(df.select(id_col), id_col, "left_anti").take(1):
            raise NotFound(f"no such {entity}")
        if self._held(entity, sender) and ids.join(self.accessible(entity, sender, needed).select(id_col), id_col, "left_anti").take(1):
            raise Forbidden("permission denied")

    def list(self, request: ListRequest, sender=None) -> DataFrame:
        df, id_col = self._own(request.entity, sender)
        return listing.plan(df, request, id_col, self.schemas.get(request.entity), None, self.relations, self.tables)

    def read(self, entity: str, key, includes=(), projection=None, sender=None) -> DataFrame:
        """The row; NotFound where there is none, Forbidden where sender may not view it."""
        df, id_col = self._table(entity)
        out = listing.read(df, key, id_col)
        if not out.take(1):
            raise NotFound(f"no {entity} {key}")
        if self._held(entity, sender):
            self._need(entity, out.select(id_col), sender, "view")
        for path in includes:
            out = listing.include_path(out, path, self.relations, entity, self.tables)
        return listing.project(out, projection, id_col) if projection else out

    def count(self, entity: str, filters=(), sender=None) -> DataFrame:
        return aggregate.count(self._own(entity, sender)[0], filters)

    def cursor(self, request: ListRequest, sender=None):
        df, id_col = self._own(request.entity, sender)
        return listing.cursor(df, request, id_col)

    def shared(self, entity: str, grantee) -> DataFrame:
        df, id_col = self._table(entity)
        return access.shared_with(df, self.shares, entity, grantee, id_col)

    def pages(self, request: ListRequest, sender=None) -> listing.Cursor:
        df, id_col = self._own(request.entity, sender)
        return listing.Cursor(df, request, id_col)

    # access
    def share(self, entity: str, key, grantee: str, permission: str, by: str, edges: DataFrame | None = None) -> int:
        """Grants a level on a row and what hangs below it (edges: parent, child); returns the number of grants."""
        if permission not in access.LEVELS:
            raise QuernelError(f"no such permission: {permission}")
        rows = self._below(key, edges)
        if self.shares is None:
            self.shares = self.spark.createDataFrame([], SHARES)
        self.shares = access.grant(self.shares, rows, entity, key, grantee, permission, by)
        return rows.count()

    def unshare(self, entity: str, key, grantee: str, edges: DataFrame | None = None) -> None:
        if self.shares is not None:
            self.shares = access.revoke(self.shares, self._below(key, edges), entity, grantee)

    def _below(self, key, edges: DataFrame | None) -> DataFrame:
        root = self.spark.range(1).select(F.lit(key).alias("id"))
        return access.closure(edges, root) if edges is not None else root

    def accessible(self, entity: str, sender, needed: str = "view") -> DataFrame:
        """The rows that sender owns or holds a share of that level for; of a derived entity, those of such parents."""
        df, id_col = self._table(entity)
        if self.shares is None:
            self.shares = self.spark.createDataFrame([], SHARES)
        if entity in self.derived:
            fk, parent = self.derived[entity]
            parents, parent_id = self._table(parent)
            return access.derived(df, fk, parents, self.shares, parent, sender, needed, self.owners[parent], parent_id)
        return access.accessible(df, self.shares, entity, sender, needed, self.owners[entity], id_col) if entity in self.owners else df

    # subscriptions
    def subscribe(self, subscription_id: str, pattern: str, entity: str | None = None, share_group: str | None = None, mode: str = "broadcast", now: int = 0) -> Engine:
        if not valid_pattern(pattern):
            raise QuernelError(f"no valid pattern: {pattern!r}")
        row = self.spark.createDataFrame([(subscription_id, pattern, entity, share_group, mode)], SUBSCRIPTION)
        self.subscriptions = routing.subscribe(self.subscriptions, row, self.config) if self.subscriptions is not None else row
        self.heartbeats[subscription_id] = now
        return self

    def unsubscribe(self, subscription_id: str) -> Engine:
        if self.heartbeats.pop(subscription_id, None) is None:
            raise NotFound(f"no subscription {subscription_id}")
        self.subscriptions = self.subscriptions.filter(F.col("subscription_id") != subscription_id)
        return self

    def heartbeat(self, subscription_id: str, now: int) -> None:
        if subscription_id not in self.heartbeats:
            raise NotFound(f"no subscription {subscription_id}")
        self.heartbeats[subscription_id] = now

    def groups(self, now: int) -> DataFrame:
        """share_group, partition, member of the members whose heartbeat is recent."""
        beats = self.spark.createDataFrame(list(self.heartbeats.items()), "member string, heartbeat bigint")
        members = self.subscriptions.filter(F.col("share_group").isNotNull()).select("share_group", F.col("subscription_id").alias("member")).join(beats, "member")
        return routing.assignments(routing.fresh_members(members, now, self.config.group_timeout_s), self.config.group_partitions)

    def deliveries(self) -> DataFrame:
        """The events so far with the subscriptions they go to; topics are entity/id."""
        events = mutate.union_all(self.events).withColumn("topic", F.concat_ws("/", "entity", "id"))
        return routing.matches(events, self.subscriptions)

    # writes
    def _check(self, entity: str, state: DataFrame, id_col: str, touched: DataFrame) -> None:
        """The schema and constraints on the touched rows (ids) of a new state; what they do not touch was checked before."""
        rows = state.join(touched.select(id_col).distinct(), id_col, "left_semi")
        schema = self.schemas.get(entity)
        if schema and (bad := constraints.schema_violations(rows, schema, id_col).first()):
            raise SchemaViolation(f"{entity} {bad[id_col]}: {bad['field']} {bad['violation']}")
        for rule in self.constraints_of(entity):
            if isinstance(rule, NotNull) and constraints.null_violations(rows, rule, id_col).take(1):
                raise NotNullViolation(f"{entity}.{rule.field} is null")
            if isinstance(rule, Unique) and constraints.unique_violations_of(state, rows, rule).take(1):
                raise UniqueViolation(f"{entity}: equal values of {', '.join(rule.fields)}")
            if isinstance(rule, ForeignKey) and constraints.missing_targets(rows, self.tables[rule.target][0], rule).take(1):
                raise ForeignKeyViolation(f"{entity}.{rule.field} refers to a missing {rule.target}")

    def _replace(self, entity: str, state: DataFrame, touched: DataFrame | None = None) -> None:
        """Keeps a planned state and its events, which are written; touched (ids) are all rows that may differ."""
        old, id_col = self.tables[entity]
        of = (lambda df: df.join(touched.select(id_col).distinct(), id_col, "left_semi")) if touched is not None else (lambda df: df)
        self.events.append(constraints.written(mutate.changes(of(old), of(state), entity, id_col), "events"))
        self.tables[entity] = (state, id_col)

    def keep(self, *entities: str) -> Engine:
        """Writes the states of entities (of all by default) and reads them back: writes no longer stack plans on them."""
        for name in entities or self.entity_names():
            df, id_col = self._table(name)
            self.tables[name] = (constraints.written(df, f"state-{name}"), id_col)
        return self

    def commit(self, batches: dict[str, dict], sender=None) -> Engine:
        """One batch over several entities, {entity: {puts, removes, equal, absent}} of frames: all of it or nothing.

        The preconditions (see mutate.batch) and constraints are checked for every entity, against the states that the
        whole batch leads to, before any is replaced; then the new states are written. Removes do not cascade.
        """
        before, events, planned = dict(self.tables), len(self.events), {}
        try:
            for name, parts in batches.items():
                df, id_col = self._table(name)
                for ids in (parts.get("puts"), parts.get("removes")):
                    if ids is not None and self._held(name, sender):
                        self._need(name, ids.select(id_col).join(df.select(id_col), id_col, "left_semi"), sender, "edit")
                planned[name] = mutate.batch(df, id_col, **parts)
            self.tables |= {n: (state, before[n][1]) for n, state in planned.items()}
            for name, state in planned.items():
                if (puts := batches[name].get("puts")) is not None:
                    self._check(name, state, before[name][1], puts)
            for rule in self.rules:
                if isinstance(rule, ForeignKey) and rule.target in planned and constraints.missing_targets(self.tables[rule.source][0], self.tables[rule.target][0], rule).take(1):
                    raise ForeignKeyViolation(f"{rule.source}.{rule.field} refers to a missing {rule.target}")
            states = {n: constraints.written(state, f"state-{n}") for n, state in planned.items()}
        except Exception:
            self.tables = before
            del self.events[events:]
            raise
        self.tables = before
        for name, state in states.items():
            self._replace(name, state)
        return self

    def create(self, entity: str, rows: DataFrame, now: int = 0, strict: bool = False, sender=None) -> DataFrame:
        df, id_col = self._table(entity)
        if self._held(entity, sender):
            self._need(entity, rows.select(id_col).join(df.select(id_col), id_col, "left_semi"), sender, "edit")  # overwritten ones
            if entity in self.owners:
                rows = rows.withColumn(self.owners[entity], F.lit(sender))
            else:
                fk, parent = self.derived[entity]
                parent_id = self._table(parent)[1]
                if rows.filter(F.col(fk).isNull()).take(1):
                    raise QuernelError(f"missing parent reference {fk!r}")
                if rows.join(self.accessible(parent, sender, "edit").select(F.col(parent_id).alias("__parent")), F.col(fk) == F.col("__parent"), "left_anti").take(1):
                    raise Forbidden("permission denied")
        state = mutate.create(df, rows, id_col, self.schemas.get(entity), now, strict=strict)
        self._check(entity, state, id_col, rows)
        self._replace(entity, state, rows)
        return state

    def update(self, entity: str, changes: DataFrame, given=None, expected: str | None = None, sender=None) -> DataFrame:
        """The state with changes merged in; those of absent ids do nothing, one that sender may not edit is Forbidden."""
        df, id_col = self._table(entity)
        if self._held(entity, sender):
            self._need(entity, changes.select(id_col).join(df.select(id_col), id_col, "left_semi"), sender, "edit")
        state = mutate.update(df, changes, id_col, given, expected)
        self._check(entity, state, id_col, changes)
        self._replace(entity, state, changes)
        return state

    def delete(self, entity: str, ids: DataFrame, sender=None, work: int | None = None) -> dict[str, DataFrame]:
        """Deletes rows and what hangs on them; returns the plan that was carried out. Only owners delete, and editors of
        a derived child's parent; work limits the rows it may touch."""
        id_col = self._table(entity)[1]
        if sender is not None:
            self._need(entity, ids.select(id_col), None, "view")
            mine = self._own(entity, sender)[0] if entity in self.owners else self.accessible(entity, sender, "edit") if entity in self.derived else None
            if self._held(entity, sender) and ids.join(mine.select(id_col), id_col, "left_anti").take(1):
                raise Forbidden("permission denied")
        foreign = [r for r in self.rules if isinstance(r, ForeignKey)]
        owner = (self.owners, sender) if sender is not None and sender not in self.admins else None
        gone = constraints.cascade(self.tables, foreign, entity, ids, owner, [r for r in self.rules if isinstance(r, NotNull)], work)
        nulled = gone.pop("set_null", None)
        for rule in foreign if nulled is not None else ():
            df, id_col = self.tables[rule.source]
            self._replace(rule.source, mutate.set_null(df, rule.field, nulled.filter((F.col("entity") == rule.source) & (F.col("field") == rule.field)), id_col))
        for name, rows in gone.items():
            df, id_col = self.tables[name]
            self._replace(name, df.join(rows.select(F.col("id").alias("__id")), F.col(id_col).cast("string") == F.col("__id"), "left_anti"))
            if self.shares is not None:
                self.shares = access.without_grants(self.shares, rows.select(F.lit(name).alias("entity"), "id"))
        return gone

    def backup(self, path: str) -> None:
        backups.backup({n: df for n, (df, _) in self.tables.items()}, path)

    def restore(self, path: str) -> Engine:
        for name, df in backups.restore(self.spark, path, {n: df.schema for n, (df, _) in self.tables.items()}).items():
            self.tables[name] = (df, self.tables[name][1])
        return self

    def execute(self, request: dict) -> DataFrame | dict | list | None:
        """One request of the verbs list, read, count, create, update, delete, share, unshare, shared, shares, subscribe,
        unsubscribe, and of the administration: catalog, schema, schema_set, constraints, index_add, backup, restore.

        Of the latter all but catalog, schema and constraints need an admin where a sender is given.
        """
        verb, entity, sender = request.get("op"), request.get("entity", ""), request.get("sender")
        rows = lambda: self.spark.createDataFrame(request["rows"], self._table(entity)[0].schema)
        if verb in ("schema_set", "index_add", "backup", "restore") and sender is not None and sender not in self.admins:
            raise Forbidden("admin role required")
        if verb == "list":
            return self.list(ListRequest.parse(entity, request), sender)
        if verb == "read":
            return self.read(entity, request["id"], request.get("includes", ()), request.get("projection"), sender)
        if verb == "count":
            return self.count(entity, ListRequest.parse(entity, request).filters, sender)
        if verb == "create":
            return self.create(entity, rows(), sender=sender)
        if verb == "update":
            changed = rows()
            self._need(entity, changed.select(self._table(entity)[1]), sender, "edit")  # a request names rows that exist
            return self.update(entity, changed)
        if verb == "delete":
            df, id_col = self._table(entity)
            return self.delete(entity, self.read(entity, request["id"]).select(id_col), sender)
        if verb in ("share", "unshare"):
            if sender is not None and sender not in self.admins and entity in self.owners and not self._own(entity, sender)[0].filter(F.col(self._table(entity)[1]) == request["id"]).take(1):
                raise Forbidden("permission denied")  # only the owner shares
            args = ("grantee", "permission", "by") if verb == "share" else ("grantee",)
            getattr(self, verb)(entity, request["id"], *(request[k] for k in args))
            return self.shares
        if verb in ("subscribe", "unsubscribe"):
            getattr(self, verb)(**{k: v for k, v in request.items() if k not in ("op", "sender")})
            return self.subscriptions
        if verb == "shared":
            return self.shared(entity, request.get("grantee", sender))
        if verb == "shares":
            return self.shares.filter((F.col("resource_entity") == entity) & (F.col("resource_id") == str(request["id"])))
        if verb == "catalog":
            return self.describe()
        if verb == "schema":
            return self.schema_of(entity)
        if verb == "schema_set":
            return self.add_schema(request["schema"]).schemas[entity]
        if verb == "constraints":
            return self.constraints_of(entity)
        if verb == "index_add":
            return sorted(self.add_index(entity, *request["fields"]).indexes[entity])
        if verb in ("backup", "restore"):
            return getattr(self, verb)(request["path"]) and None
        raise QuernelError(f"unknown request {verb!r}")
