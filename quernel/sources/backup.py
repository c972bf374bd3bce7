"""Logical backup and restore: one JSON line per record, {"_entity": …, "_data": {…}}."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    """value: the backup's lines. Null fields are written, so that restoring tells them from absent ones."""
    one = lambda name, df: df.select(F.to_json(F.struct(F.lit(name).alias("_entity"), F.struct(*df.columns).alias("_data")), {"ignoreNullFields": "false"}).alias("value"))
    return reduce(DataFrame.unionByName, (one(n, df) for n, df in sorted(tables.items())))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    lines(tables).write.text(path, compression="gzip")


def restored(lines: DataFrame, entity: str, schema: T.StructType) -> DataFrame:
    """The records of entity from a backup's lines (value); versions start at 1 again, as restoring creates them."""
    parsed = lines.select(F.from_json("value", T.StructType([T.StructField("_entity", T.StringType()), T.StructField("_data", schema)])).alias("r"))
    out = parsed.filter(F.col("r._entity") == entity).select("r._data.*")
    return out.withColumn("_version", F.lit(1).cast("bigint")) if "_version" in schema.names else out


def restore(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    text = spark.read.text(path)
    return {name: restored(text, name, schema) for name, schema in schemas.items()}
