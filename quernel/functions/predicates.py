"""Filters as Spark columns: on typed columns, on VARIANT documents, and on topic strings."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.plans.model import Filter, Missing, Op, QuernelError

_RANGE = {Op.LT: lambda a, b: a < b, Op.LTE: lambda a, b: a <= b, Op.GT: lambda a, b: a > b, Op.GTE: lambda a, b: a >= b}


def glob_regex(glob: str) -> str:
    """The anchored expression of a glob whose only special character is *."""
    return r"(?s)\A" + ".*".join(re.escape(x) for x in glob.split("*")) + r"\z"


def glob_match(col: Column, glob: str) -> Column:
    """col matches glob; prefixes, suffixes and infixes become predicates that reach the scan."""
    parts = glob.split("*")
    if len(parts) == 1:
        return col == glob
    head, tail, middle = parts[0], parts[-1], [x for x in parts[1:-1] if x]
    if not middle and not tail:
        return col.startswith(head) if head else col.isNotNull()
    if not middle and not head:
        return col.endswith(tail)
    if len(middle) == 1 and not head and not tail:
        return col.contains(middle[0])
    return col.rlike(glob_regex(glob))


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "null" if value is None else "other"


def _column_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    return "string" if isinstance(kind, T.StringType) else "other"


def typed(f: Filter, kind: T.DataType, missing: Missing = Missing.LIST) -> Column:
    """f on a column of this type, for a filter: a null result counts as false, so that comparisons stay plain and reach
    the scan. A null column is an explicit null."""
    col, want = F.col(f"`{f.field}`"), _column_kind(kind)
    never = F.lit(False)
    if f.op is Op.IS_NULL:
        return col.isNull()
    if f.op is Op.IS_NOT_NULL:
        return col.isNotNull()
    same = lambda v: v is None or _kind(v) == want or want == "other" and v is not None
    if f.op is Op.EQ:
        return col.isNull() if f.value is None else col == F.lit(f.value) if same(f.value) else never
    if f.op is Op.NEQ:
        return col.isNotNull() if f.value is None else ~col.eqNullSafe(F.lit(f.value)) if same(f.value) else F.lit(True)
    if f.op is Op.IN:
        if missing is Missing.WATCH or not isinstance(f.value, (list, tuple)):
            return never
        values = [v for v in f.value if v is not None and same(v)]
        hit = col.isin(*values) if values else never
        return hit | col.isNull() if None in f.value else hit
    if f.op is Op.LIKE:
        return glob_match(col, f.value) if want == "string" and isinstance(f.value, str) else never
    if f.value is None:  # null against null: only a cursor calls them ordered and equal
        return col.isNull() if missing is Missing.CURSOR and f.op in (Op.LTE, Op.GTE) else never
    if not same(f.value) or want == "boolean" and missing is not Missing.CURSOR:
        return never
    return _RANGE[f.op](col, F.lit(f.value))


def variant(f: Filter, data: Column, missing: Missing = Missing.LIST) -> Column:
    """f on a top-level field of a VARIANT document, where absent and null differ. Never null."""
    path = "$['" + f.field.replace("'", "\\'") + "']"
    value = F.variant_get(data, path, "variant")
    absent, null = value.isNull(), F.coalesce(F.is_variant_null(value), F.lit(False))
    kind = F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))
    never = F.lit(False)
    as_null = missing in (Missing.CURSOR, Missing.WATCH)

    def holds(v, compare) -> Column:
        if isinstance(v, bool):
            return (kind == "BOOLEAN") & compare(F.try_variant_get(data, path, "boolean"), F.lit(v))
        if isinstance(v, (int, float)):
            return kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & compare(F.try_variant_get(data, path, "double"), F.lit(float(v)))
        if isinstance(v, str):
            return (kind == "STRING") & compare(F.try_variant_get(data, path, "string"), F.lit(v))
        raise QuernelError(f"a filter value cannot be {type(v).__name__}")

    def equal(v) -> Column:
        if v is None:
            return null | absent if as_null else null
        return F.coalesce(holds(v, lambda a, b: a == b), never)

    if f.op is Op.IS_NULL:
        return null if missing is Missing.LIST else null | absent
    if f.op is Op.IS_NOT_NULL:
        return ~null & ~absent
    if f.op is Op.EQ:
        return equal(f.value)
    if f.op is Op.NEQ:
        return ~equal(f.value) if as_null else ~equal(f.value) & ~absent
    if f.op is Op.IN:
        if missing is Missing.WATCH or not isinstance(f.value, (list, tuple)):
            return never
        return reduce(lambda a, b: a | b, (equal(v) for v in f.value), never)
    if f.op is Op.LIKE:
        return F.coalesce(holds(f.value, lambda a, _: glob_match(a, f.value)), never) if isinstance(f.value, str) else never
    if f.value is None:
        return null | absent if missing is Missing.CURSOR and f.op in (Op.LTE, Op.GTE) else never
    if isinstance(f.value, bool) and missing is not Missing.CURSOR:
        return never
    return F.coalesce(holds(f.value, _RANGE[f.op]), never)


def conjunction(filters, kinds: dict[str, T.DataType], missing: Missing = Missing.LIST) -> Column | None:
    """All filters together on typed columns; fields without a column are absent. None for no filters."""
    return reduce(and_, (typed(f, kinds[f.field], missing) if f.field in kinds else _absent(f, missing) for f in filters)) if filters else None


def _absent(f: Filter, missing: Missing) -> Column:
    if missing in (Missing.CURSOR, Missing.WATCH):
        null_in = f.op is Op.IN and missing is Missing.CURSOR and isinstance(f.value, (list, tuple)) and None in f.value
        return F.lit(f.op is Op.IS_NULL or f.op is Op.NEQ and f.value is not None or f.op is Op.EQ and f.value is None or null_in)
    return F.lit(f.op is Op.IS_NULL and missing is Missing.DOCUMENT)


# Fixed order: longer spellings are tried before their prefixes.
_SPELLINGS = ("<>", "!=", ">=", "<=", "!?", ">", "<", "=", "~", "?")


def literal(text: str):
    """int, float, bool or string, the first that fits."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


def parse_filters(text: str) -> tuple[Filter, ...]:
    """Filters written as `field<op>value,…`."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        found = next(((part.index(s), s) for s in _SPELLINGS if s in part), None)
        if not found or not found[0]:
            raise QuernelError(f"no filter: {part!r}")
        at, spelling = found
        op = Op.parse(spelling)
        out.append(Filter(part[:at].strip(), op, None if op in (Op.IS_NULL, Op.IS_NOT_NULL) else literal(part[at + len(spelling) :].strip())))
    return tuple(out)


def store_filter(text: str | None) -> tuple[str, str] | None:
    """The `name=value` filter of internal stores, quotes optional; None (all rows match) for anything else."""
    m = re.fullmatch(r"\s*(id|entity_type|topic|pattern)\s*=\s*(['\"]?)(.*?)\2\s*", text or "")
    return (m[1], m[3]) if m else None


def topic_regex(pattern: str, system: bool = True) -> str:
    """An expression over '/' + topic: + is one level, # any number, also in mid-pattern.

    system=False keeps topics that begin with $ from wildcards at the first level.
    """
    levels = "".join({"+": "/[^/]*", "#": "(?:/[^/]*)*"}.get(x, "/" + re.escape(x)) for x in pattern.split("/"))
    guard = r"(?!/\$)" if not system and pattern[:1] in "+#" else ""
    return rf"(?s)\A{guard}{levels}\z"


def topic_match(topic: Column, pattern: str, system: bool = True) -> Column:
    return F.concat(F.lit("/"), topic).rlike(topic_regex(pattern, system))


def topic_regex_of(pattern: Column, system: bool = True) -> Column:
    """topic_regex() for a column of patterns."""
    one = lambda x: F.when(x == "+", "/[^/]*").when(x == "#", "(?:/[^/]*)*").otherwise(F.concat(F.lit("/"), F.regexp_replace(x, r"([^A-Za-z0-9_ -])", r"\\$1")))
    body = F.array_join(F.transform(F.split(pattern, "/"), one), "")
    guard = F.lit("") if system else F.when(F.substring(pattern, 1, 1).isin("+", "#"), r"(?!/\$)").otherwise("")
    return F.concat(F.lit(r"(?s)\A"), guard, body, F.lit(r"\z"))


def protection_regex(pattern: str) -> str:
    """As topic_regex, and a level `name+` is the name with digits after it."""
    one = lambda x: {"+": "/[^/]*", "#": "(?:/[^/]*)*"}.get(x, "/" + (re.escape(x[:-1]) + "[0-9]+" if x.endswith("+") else re.escape(x)))
    return r"(?s)\A" + "".join(one(x) for x in pattern.split("/")) + r"\z"


def valid_pattern(pattern: str) -> bool:
    """# stands last, and wildcards take a whole level."""
    levels = pattern.split("/")
    return bool(pattern) and all(x in ("+", "#") or not set(x) & {"+", "#"} for x in levels) and "#" not in levels[:-1]
