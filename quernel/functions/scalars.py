"""Keys, partitions, checksums, topics, merging, expiry and field encryption as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.plans.model import Field, FieldType, Schema


def data_key(entity, id_: Column) -> Column:
    return F.concat_ws("/", F.lit("data"), _col(entity), id_.cast("string"))


def index_key(entity, field: str, value: Column, id_: Column) -> Column:
    return F.concat_ws("/", F.lit("idx"), _col(entity), F.lit(field), value.cast("string"), id_.cast("string"))


def unique_key(entity, field: str, value: Column) -> Column:
    return F.concat_ws("/", F.lit("uniq"), _col(entity), F.lit(field), value.cast("string"))


def id_of_key(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def crc_partition(n: int, *parts) -> Column:
    """crc32 of the parts joined by / modulo n: where a record, index entry or unique value is kept."""
    return F.pmod(F.crc32(F.concat_ws("/", *map(_col, parts)).cast("binary")), F.lit(n)).cast("int")


def bucket(key: Column, n: int) -> Column:
    """A hash of a string that SQL engines agree on: the first 28 bits of its MD5, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def checksum(data: Column) -> Column:
    """A record's bytes behind their 4-byte big-endian CRC32."""
    data = data.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.crc32(data)), 8, "0")), data)


def verified(stored: Column) -> Column:
    """Whether the bytes after the first four have the CRC32 that these say. False for less than four."""
    body = F.substring(stored, 5, 1 << 30)
    return F.coalesce(F.lpad(F.hex(F.crc32(body)), 8, "0") == F.hex(F.substring(stored, 1, 4)), F.lit(False))


def sortable_long(x: Column) -> Column:
    """16 hex digits whose order as text is the order of the numbers."""
    return F.lpad(F.hex(x.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def sortable_double(x: Column) -> Column:
    """16 hex digits whose order as text is IEEE 754's total order: -NaN, -inf, negative, -0, 0, positive, inf, NaN."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x.cast("double")).cast("bigint")
    return F.when(x.isNotNull(), F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0"))


def index_value(value: Column) -> Column:
    """The key part of a VARIANT value in an index, as hex: null, true and false by name, numbers sortable, text as it is.

    Whole numbers and others have encodings of their own. Arrays and objects cannot be indexed: an error.
    """
    kind = F.schema_of_variant(value)
    text = lambda s: F.hex(F.encode(s, "UTF-8"))
    get = lambda t: F.try_variant_get(value, "$", t)
    name = F.when(value.isNull() | (kind == "VOID"), text(F.lit("null"))).when(kind == "BOOLEAN", text(get("boolean").cast("string"))).when(kind == "BIGINT", sortable_long(get("bigint")))
    number = kind.rlike("^(DOUBLE|FLOAT|DECIMAL)")
    return name.when(number, sortable_double(get("double"))).when(kind == "STRING", text(get("string"))).otherwise(F.raise_error(F.lit("arrays and objects cannot be indexed")).cast("string"))


def order_of(value: Column) -> list[Column]:
    """Sort keys of mixed VARIANT values: null or absent, then booleans, numbers, text, then others by their JSON."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    rank = F.when(kind == "VOID", 0).when(kind == "BOOLEAN", 1).when(number, 2).when(kind == "STRING", 3).otherwise(4)
    get = lambda t: F.try_variant_get(value, "$", t)
    return [rank, F.when(kind == "BOOLEAN", get("boolean").cast("double")).when(number, get("double")), F.when(kind == "STRING", get("string")).when(rank == 4, F.to_json(value))]


def scope_of(entity: Column, id_: Column, scopes: dict[str, str], fields: dict[str, Column]) -> Column:
    """`parent/value` of an event: its own id where the entity is the scope's, else the scope field's value, else null."""
    out = F.lit(None).cast("string")
    for parent, field in scopes.items():
        own = F.when(entity == parent, id_.cast("string")).otherwise(fields[field].cast("string"))
        out = F.coalesce(out, F.concat(F.lit(f"{parent}/"), own))
    return out


def event_topic(root: str, entity: Column, operation: Column, id_: Column, partition: Column | None = None, scope: Column | None = None) -> Column:
    """root/entity/events[/pN]/id, or root/scope/entity/events/created|updated|deleted for a scoped event."""
    plain = F.concat_ws("/", F.lit(root), entity, F.lit("events"), *([F.concat(F.lit("p"), partition)] if partition is not None else []), id_.cast("string"))
    if scope is None:
        return plain
    verb = F.when(operation == "Create", "created").when(operation == "Update", "updated").otherwise("deleted")
    return F.when(scope.isNull(), plain).otherwise(F.concat_ws("/", F.lit(root), scope, entity, F.lit("events"), verb))


def is_kind(kind: T.DataType, wanted: FieldType) -> bool:
    """Whether a column of this Spark type holds values of a declared type."""
    return {
        FieldType.STRING: isinstance(kind, T.StringType),
        FieldType.NUMBER: isinstance(kind, T.NumericType),
        FieldType.BOOLEAN: isinstance(kind, T.BooleanType),
        FieldType.ARRAY: isinstance(kind, T.ArrayType),
        FieldType.OBJECT: isinstance(kind, (T.StructType, T.MapType)),
        FieldType.NULL: isinstance(kind, T.NullType),
    }[wanted]


#: schema_of_variant's names for the values of each declared type.
VARIANT_KINDS = {
    FieldType.STRING: "^STRING",
    FieldType.NUMBER: "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
    FieldType.BOOLEAN: "^BOOLEAN",
    FieldType.ARRAY: "^ARRAY",
    FieldType.OBJECT: "^OBJECT",
    FieldType.NULL: "^VOID",
}


def with_defaults(df: DataFrame, schema: Schema, present=None) -> DataFrame:
    """Fills declared defaults where a field is absent.

    present(name) says where a field was given; without it a null counts as absent. Fields without a column are added.
    """
    out = {}
    for name, f in schema.fields.items():
        if f.default is not None:
            given = present(name) if present else F.col(name).isNotNull() if name in df.columns else F.lit(False)
            out[name] = F.when(given, F.col(name)).otherwise(F.lit(f.default)) if name in df.columns else F.lit(f.default)
    return df.withColumns(out) if out else df


def field(kind: str, required: bool = False, default=None) -> Field:
    return Field(FieldType(kind), required, default)


def seal(value: Column, key: Column, entity: str, id_: Column) -> Column:
    """A string under AES-GCM, bound to its record by entity/id; base64. Null stays null."""
    return F.when(value.isNotNull(), F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.concat_ws("/", F.lit(entity), id_.cast("string")).cast("binary"))))


def unseal(sealed: Column, key: Column, entity: str, id_: Column) -> Column:
    return F.when(sealed.isNotNull(), F.aes_decrypt(F.unbase64(sealed), key, F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("/", F.lit(entity), id_.cast("string")).cast("binary")).cast("string"))


#: Marks a number or boolean that was sealed as text.
SCALAR_MARK = "\x01"


def seal_fields(df: DataFrame, key: Column, entity: str, owner: str | None = None, id_col: str = "id") -> DataFrame:
    """All string, number and boolean columns sealed, but for the id, the owner and those that begin with _."""
    out = {}
    for f in df.schema:
        if f.name in (id_col, owner) or f.name.startswith("_") or not isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType)):
            continue
        plain = F.col(f.name) if isinstance(f.dataType, T.StringType) else F.concat(F.lit(SCALAR_MARK), F.col(f.name).cast("string"))
        out[f.name] = seal(plain, key, entity, F.col(id_col))
    return df.withColumns(out) if out else df


def unseal_fields(df: DataFrame, like: T.StructType, key: Column, entity: str, owner: str | None = None, id_col: str = "id") -> DataFrame:
    """The frame that seal_fields() sealed; like is its schema."""
    out = {}
    for f in like:
        if f.name in (id_col, owner) or f.name.startswith("_") or not isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType)):
            continue
        plain = unseal(F.col(f.name), key, entity, F.col(id_col))
        out[f.name] = plain if isinstance(f.dataType, T.StringType) else F.substring(plain, 2, 1 << 30).cast(f.dataType)
    return df.withColumns(out) if out else df


def bench_records(spark, n: int, fields: int = 5, size: int = 100) -> DataFrame:
    """n records of `fields` strings of `size` letters and the id."""
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"))
    return rows.select("id", *(F.concat(F.lit("x" * size + "_"), F.col("id")).alias(f"field_{i}") for i in range(fields)))
