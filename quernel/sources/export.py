"""Results as JSON lines, CSV or a text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def _cell(col: Column) -> Column:
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """value: a line per row; only cells with a comma or quote are quoted. The header is ','.join(df.columns)."""
    return df.select(F.concat_ws(",", *(_cell(F.col(f"`{c}`")) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def text_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a table for a terminal; a report of that many rows."""
    got = [[("" if v is None else str(v)) for v in r] for r in df.limit(rows).collect()]
    width = [max(map(len, col)) for col in zip(df.columns, *got, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, width, strict=True)).rstrip() for line in (df.columns, *got))
