"""Every query with SQL gives what DuckDB gives, on the smallest tables and on odd ones."""

import os

import duckdb
import pytest

from quernel.plans import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    said = db.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(said.columns) == order
    assert dict(df.dtypes) == {c: TYPES.get(str(t), str(t)) for c, t in zip(said.columns, said.types, strict=True)}
    at = [said.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in said.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.oracle_sql()) <= set(__spark_entry__.oracle_sql()) and len(catalog.queries()) > 90


def test_partitions_match_the_known_value(spark):
    from pyspark.sql import functions as F

    from quernel.functions.scalars import crc_partition

    assert spark.range(1).select(crc_partition(256, "users", F.lit("123"))).first()[0] == 120


def test_whole_tables(spark):
    found, path = catalog.queries(), "/root/testdata/sf0.01"
    assert {r.id for r in found["share_closure"](spark, path).collect()} == {3 << k for k in range(10)}
    assert {r.partition for r in found["missing_partitions"](spark, path).collect()} == set(range(16)) - {0, 1, 4, 9}
