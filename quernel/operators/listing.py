"""The list plan: filter, owner, sort, page, include, project. Catalyst picks the access path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import predicates
from quernel.operators.constraints import written
from quernel.plans.model import MAX_FILTERS, MAX_INCLUDE_DEPTH, Filter, LimitExceeded, ListRequest, Missing, NotFound, Op, QuernelError, Relationship, Schema


def kinds(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema}


def where(df: DataFrame, filters, missing: Missing = Missing.LIST) -> DataFrame:
    condition = predicates.conjunction(filters, kinds(df), missing)
    return df if condition is None else df.filter(condition)


def ordering(sort, id_col: str) -> list[Column]:
    """Nulls first going up, last going down; ties by id."""
    keys = [F.col(f"`{s.field}`").desc_nulls_last() if s.descending else F.col(f"`{s.field}`").asc_nulls_first() for s in sort]
    return keys + ([] if any(s.field == id_col for s in sort) else [F.col(id_col).asc()])


def paged(df: DataFrame, limit: int | None, offset: int = 0, cap: int | None = None) -> DataFrame:
    """Rows offset .. offset + limit, the end not past cap; an offset past the end gives no rows."""
    if cap is not None:
        room = max(0, cap - offset)
        limit = room if limit is None else min(limit, room)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def include(df: DataFrame, relation: Relationship, target: DataFrame, target_id: str = "id", name: str | None = None, nested: str | None = None) -> DataFrame:
    """df with relation's row as a struct column; null where the key has no row. Left outer, to-one.

    The side to broadcast is left to the optimizer's size estimate.
    """
    name = name or relation.field
    key = F.col(nested)[relation.key] if nested else F.col(f"`{relation.key}`")
    side = target.select(F.col(target_id).alias("__target_id"), F.struct(*(F.col(f"`{c}`") for c in target.columns)).alias(f"__{name}"))
    joined = df.join(side, key == F.col("__target_id"), "left").drop("__target_id")
    return joined.withColumnRenamed(f"__{name}", name)


def include_path(df: DataFrame, path: str, relations: dict[tuple[str, str], Relationship], entity: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Expands a dotted path, at most three levels; each level becomes a column named by its path with __."""
    names = path.split(".")
    if len(names) > MAX_INCLUDE_DEPTH:
        raise LimitExceeded(f"include depth {len(names)}; the most is {MAX_INCLUDE_DEPTH}")
    at = None
    for i, name in enumerate(names):
        relation = relations.get((entity, name))
        if relation is None:
            raise QuernelError(f"no relationship {name} on {entity}")
        target, key = tables[relation.target]
        column = "__".join(names[: i + 1])
        if column not in df.columns:
            df = include(df, relation, target, key, column, at)
        at, entity = column, relation.target
    return df


def project(df: DataFrame, names, id_col: str = "id") -> DataFrame:
    """The id and the named columns that exist, in the order named."""
    return df.select(id_col, *(f"`{n}`" for n in dict.fromkeys(names) if n != id_col and n in df.columns))


def plan(df: DataFrame, request: ListRequest, id_col: str = "id", schema: Schema | None = None, owner: tuple[str, object] | None = None, relations=None, tables=None, missing: Missing = Missing.LIST) -> DataFrame:
    """The rows that request asks for. owner (field, sender) limits them to the sender's own and counts as a filter."""
    request.check()
    if schema:
        schema.require((f.field for f in request.filters), "filter")
        schema.require((s.field for s in request.sort), "sort")
        schema.require(request.projection or (), "projection")
    filters = (*request.filters, Filter(owner[0], Op.EQ, owner[1])) if owner else request.filters
    if len(filters) > MAX_FILTERS:
        raise LimitExceeded(f"{len(filters)} filters; the most is {MAX_FILTERS}")
    out = where(df, filters, missing)
    if request.sort or request.limit is not None or request.offset or request.cap is not None:
        keys = ordering([s for s in request.sort if s.field in df.columns], id_col)
        out = paged(out.orderBy(*keys), request.limit, request.offset, request.cap)
    for path in request.includes:
        out = include_path(out, path, relations or {}, request.entity, tables or {})
    return out if request.projection is None else project(out, request.projection, id_col)


def read(df: DataFrame, key, id_col: str = "id") -> DataFrame:
    """The row with this id, as a frame of one row at most."""
    return df.filter(F.col(id_col) == F.lit(key)).limit(1)


def read_one(df: DataFrame, key, id_col: str = "id"):
    row = read(df, key, id_col).first()
    if row is None:
        raise NotFound(f"{key} not found")
    return row


def read_many(df: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """A row for each of keys (a frame with the id column), nulls where there is no row."""
    return keys.select(id_col).join(df, id_col, "left")


def lookup(df: DataFrame, field: str, value) -> DataFrame:
    """Equality on one field; reaches the scan as a pushed filter."""
    return df.filter(predicates.typed(Filter(field, Op.EQ, value), kinds(df)[field]))


def lookup_range(df: DataFrame, field: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """A range on one field, open-ended where a bound is None."""
    filters = [Filter(field, Op.GT if low_open else Op.GTE, low)] if low is not None else []
    filters += [Filter(field, Op.LT if high_open else Op.LTE, high)] if high is not None else []
    return where(df, filters)


def keyset_page(df: DataFrame, after, limit: int, id_col: str = "id") -> DataFrame:
    """The next rows by id after the last one seen: no offset, so page n costs as much as page 1."""
    return (df if after is None else df.filter(F.col(id_col) > F.lit(after))).orderBy(id_col).limit(limit)


def partition_page(df: DataFrame, tokens: dict[int, object], limit: int, partitions: int, id_col: str = "id", partition: Column | None = None) -> DataFrame:
    """The next rows of each partition after its own token, merged in order of (partition, id)."""
    part = (partition if partition is not None else F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(partitions))).cast("int")
    rows = df.withColumn("partition", part)
    seen = F.lit(True)
    for p, last in tokens.items():
        seen = seen & ((F.col("partition") != p) | (F.col(id_col) > F.lit(last)))
    return rows.filter(seen).orderBy("partition", id_col).limit(limit)


class Cursor:
    """Rows of a plan in order, a page at a time; each page is a keyset query after the last row seen.

    Rows are ordered by id. reset() starts again; position counts the rows given since.
    """

    def __init__(self, df: DataFrame, request: ListRequest, id_col: str = "id"):
        if request.sort and request.sort[0].field != id_col:
            raise QuernelError("a paged cursor goes by id; use cursor() for other orders")
        self.df, self.id_col, self.batch = where(df, request.filters, Missing.CURSOR), id_col, request.batch_size
        self.reset()

    def reset(self) -> None:
        self.after, self.position, self.buffer, self.done = None, 0, [], False

    def _fill(self, n: int) -> None:
        while len(self.buffer) < n and not self.done:
            size = max(self.batch, n)
            got = keyset_page(self.df, self.after, size, self.id_col).collect()  # a page
            self.done = len(got) < size
            self.buffer += got
            self.after = got[-1][self.id_col] if got else self.after

    def next_batch(self, n: int) -> list:
        self._fill(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.position += len(out)
        return out

    def next(self):
        return next(iter(self.next_batch(1)), None)

    def has_more(self) -> bool:
        self._fill(1)
        return bool(self.buffer)

    def count(self) -> int:
        return self.df.count()


def cursor(df: DataFrame, request: ListRequest, id_col: str = "id"):
    """Rows one by one, without collecting them; filters follow the cursor's rules for absent and null."""
    yield from plan(df, request, id_col, missing=Missing.CURSOR).toLocalIterator(prefetchPartitions=True)


def sorted_copy(df: DataFrame, fields) -> DataFrame:
    """df written in ranges of fields, sorted within: what filters on the first of them then skip by the files' statistics."""
    return written(df.repartitionByRange(*fields).sortWithinPartitions(*fields), "index")
