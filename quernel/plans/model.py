"""What callers state: filters, sorts, pages, list requests, schemas, constraints; and the errors they can meet."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum

# Fixed limits of a request.
MAX_FILTERS, MAX_SORT_FIELDS, MAX_LIST_RESULTS, MAX_SUBSCRIPTIONS, MAX_CURSOR_BUFFER = 16, 4, 10_000, 1_000, 100
MAX_CLOSURE_NODES, MAX_CASCADE_DEPTH, MAX_CASCADE_WORK, MAX_INCLUDE_DEPTH = 256, 16, 16_000, 3


class QuernelError(ValueError):
    """The base of all errors; code is the status a caller would see."""

    code = 400


class NotFound(QuernelError):
    code = 404


class Forbidden(QuernelError):
    code = 403


class Conflict(QuernelError):
    code = 409


class SchemaViolation(QuernelError):
    pass


class UniqueViolation(Conflict):
    pass


class NotNullViolation(QuernelError):
    pass


class ForeignKeyViolation(Conflict):
    pass


class LimitExceeded(QuernelError):
    pass


class Op(Enum):
    EQ = "eq"
    NEQ = "neq"
    LT = "lt"
    LTE = "lte"
    GT = "gt"
    GTE = "gte"
    IN = "in"
    LIKE = "like"
    IS_NULL = "is_null"
    IS_NOT_NULL = "is_not_null"

    @classmethod
    def parse(cls, text: str) -> Op:
        for op, names in _ALIASES.items():
            if text in names:
                return op
        raise QuernelError(f"unknown filter operator {text!r}")


# The spellings of each operator.
_ALIASES = {
    Op.EQ: ("", "eq", "="),
    Op.NEQ: ("neq", "ne", "<>", "!="),
    Op.LT: ("lt", "<"),
    Op.LTE: ("lte", "<="),
    Op.GT: ("gt", ">"),
    Op.GTE: ("gte", ">="),
    Op.IN: ("in",),
    Op.LIKE: ("like", "glob", "~"),
    Op.IS_NULL: ("is_null", "null", "?"),
    Op.IS_NOT_NULL: ("is_not_null", "not_null", "!?"),
}


class Missing(Enum):
    """How a predicate treats an absent field; an explicit null is a value under all of them.

    LIST: absent fields match nothing. CURSOR: absent is null, and booleans can be ordered. DOCUMENT: as LIST, but
    is_null accepts absent fields. WATCH: absent is null, `in` is unknown.
    """

    LIST = "list"
    CURSOR = "cursor"
    DOCUMENT = "document"
    WATCH = "watch"


@dataclass(frozen=True)
class Filter:
    field: str
    op: Op
    value: object = None

    @classmethod
    def of(cls, field: str, op: str, value: object = None) -> Filter:
        return cls(field, Op.parse(op), value)


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class ListRequest:
    """One list query. cap, if given, is the most rows that offset + limit may reach."""

    entity: str
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int = 0
    includes: tuple[str, ...] = ()
    projection: tuple[str, ...] | None = None
    cap: int | None = None
    batch_size: int = MAX_CURSOR_BUFFER

    def where(self, field: str, op: str, value: object = None) -> ListRequest:
        return replace(self, filters=(*self.filters, Filter.of(field, op, value)))

    def order(self, field: str, descending: bool = False) -> ListRequest:
        return replace(self, sort=(*self.sort, Sort(field, descending)))

    def page(self, limit: int, offset: int = 0) -> ListRequest:
        return replace(self, limit=limit, offset=offset)

    def include(self, *names: str) -> ListRequest:
        return replace(self, includes=(*self.includes, *names))

    def project(self, *names: str) -> ListRequest:
        return replace(self, projection=names)

    def check(self) -> ListRequest:
        if len(self.filters) > MAX_FILTERS:
            raise LimitExceeded(f"{len(self.filters)} filters; the most is {MAX_FILTERS}")
        if len(self.sort) > MAX_SORT_FIELDS:
            raise LimitExceeded(f"{len(self.sort)} sort fields; the most is {MAX_SORT_FIELDS}")
        if self.offset < 0 or (self.limit or 0) < 0:
            raise QuernelError("limit and offset cannot be negative")
        return self

    @classmethod
    def parse(cls, entity: str, payload: dict) -> ListRequest:
        """A request from its JSON form; pages are given as `pagination` or as bare limit and offset."""
        page = payload.get("pagination") or payload
        try:
            filters = tuple(Filter.of(f["field"], f.get("op", ""), f.get("value")) for f in payload.get("filters", ()))
            sort = tuple(Sort(s["field"], s.get("direction", "asc").lower() == "desc") for s in payload.get("sort", ()))
        except (KeyError, TypeError, AttributeError) as wrong:
            raise QuernelError(f"malformed list request: {wrong}") from wrong
        projection = payload.get("projection")
        return cls(entity, filters, sort, page.get("limit"), page.get("offset") or 0, tuple(payload.get("includes", ())), tuple(projection) if projection else None).check()


class FieldType(Enum):
    STRING = "string"
    NUMBER = "number"
    BOOLEAN = "boolean"
    ARRAY = "array"
    OBJECT = "object"
    NULL = "null"


@dataclass(frozen=True)
class Field:
    type: FieldType
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class Schema:
    """Declared fields are checked, others pass. The version rises when the fields change."""

    entity: str
    fields: dict[str, Field]
    version: int = 1

    def revised(self, fields: dict[str, Field]) -> Schema:
        return self if fields == self.fields else Schema(self.entity, fields, self.version + 1)

    def require(self, names, context: str) -> None:
        for name in names:
            if name != "id" and name not in self.fields:
                raise SchemaViolation(f"{context} field does not exist in schema: {name}")


class OnDelete(Enum):
    RESTRICT = "restrict"
    CASCADE = "cascade"
    SET_NULL = "set_null"


@dataclass(frozen=True)
class Unique:
    """each=True: every listed field is unique by itself, nulls collide; else the tuple is, and nulls are exempt."""

    entity: str
    fields: tuple[str, ...]
    each: bool = True


@dataclass(frozen=True)
class NotNull:
    entity: str
    field: str


@dataclass(frozen=True)
class ForeignKey:
    source: str
    field: str
    target: str
    target_field: str = "id"
    on_delete: OnDelete = OnDelete.RESTRICT


@dataclass(frozen=True)
class Relationship:
    """`field` on source_entity expands to the row of target whose id stands in `column` (field or field + _id)."""

    source: str
    field: str
    target: str
    column: str = ""

    @property
    def key(self) -> str:
        return self.column or f"{self.field}_id"


@dataclass(frozen=True)
class Config:
    cap: int = MAX_LIST_RESULTS
    subscriptions: int = MAX_SUBSCRIPTIONS
    cursor_buffer: int = MAX_CURSOR_BUFFER
    ttl_interval_s: int = 60
    outbox_interval_s: int = 5
    outbox_batch: int = 100
    outbox_retries: int = 10
    group_partitions: int = 8
    group_timeout_s: int = 30
    partitions: int = 256
    owners: dict = field(default_factory=dict)


_ENTITY = re.compile(r"[A-Za-z0-9_-]{1,128}")


def valid_entity(name: str) -> bool:
    return bool(_ENTITY.fullmatch(name))


def valid_id(name: str) -> bool:
    return 0 < len(name.encode()) <= 512 and not set(name) & set("/+#")


def parse_pairs(text: str) -> dict[str, str]:
    """`entity=field,entity=field` as a dict: the form of ownership and scope settings."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, eq, value = part.partition("=")
        if not (name.strip() and eq and value.strip()):
            raise QuernelError(f"expected entity=field, got {part!r}")
        out[name.strip()] = value.strip()
    return out


def parse_derived(text: str) -> dict[str, tuple[str, str]]:
    """`child=fk>parent,…` as {child: (fk, parent)}: whose access follows from a parent."""
    out = {}
    for child, rest in parse_pairs(text).items():
        key, arrow, parent = rest.partition(">")
        if not (key and arrow and parent):
            raise QuernelError(f"expected child=fk>parent, got {rest!r}")
        out[child] = (key, parent)
    return out
