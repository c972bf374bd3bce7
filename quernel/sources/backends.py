"""Where an engine's tables live: in memory, as Parquet, or as Parquet with sealed fields."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from quernel.functions import scalars
from quernel.plans.model import NotFound


class Backend(Protocol):
    """Whole tables by name; a write replaces what was there."""

    def write(self, name: str, df: DataFrame, id_col: str = "id") -> None: ...

    def read(self, name: str) -> DataFrame: ...

    def names(self) -> list[str]: ...


@dataclass
class MemoryBackend:
    """Frames as they were given: their plans, not their rows, are kept."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, name: str, df: DataFrame, id_col: str = "id") -> None:
        self.tables[name] = df

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise NotFound(f"no table {name}")
        return self.tables[name]

    def names(self) -> list[str]:
        return sorted(self.tables)


@dataclass
class ParquetBackend:
    """A folder of Parquet tables that all executors see. A table is written beside the old one, which then goes."""

    spark: SparkSession
    path: str

    def _file(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _move(self, source: str, target: str) -> None:
        (a, files), (b, _) = self._file(source), self._file(target)
        files.delete(b, True)
        if not files.rename(a, b):
            raise OSError(f"cannot move {source} to {target}")

    def write(self, name: str, df: DataFrame, id_col: str = "id") -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/_new-{name}")
        self._move(f"{self.path}/_new-{name}", f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        where, files = self._file(f"{self.path}/{name}")
        if not files.exists(where):
            raise NotFound(f"no table {name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def names(self) -> list[str]:
        where, files = self._file(self.path)
        return sorted(n for f in (files.listStatus(where) if files.exists(where) else ()) if not (n := f.getPath().getName()).startswith(("_", ".")))


@dataclass
class SealedBackend:
    """Another backend whose string, number and boolean fields are sealed, each bound to its table and row."""

    inner: Backend
    key: Column

    def write(self, name: str, df: DataFrame, id_col: str = "id") -> None:
        sealed = scalars.seal_fields(df, self.key, name, id_col=id_col)
        note = {"quernel": json.dumps({"schema": df.schema.jsonValue(), "id": id_col})}
        first = sealed.columns[0]
        self.inner.write(name, sealed.withMetadata(first, note), id_col)

    def read(self, name: str) -> DataFrame:
        sealed = self.inner.read(name)
        note = json.loads(sealed.schema[0].metadata["quernel"])
        like = T.StructType.fromJson(note["schema"])
        return scalars.unseal_fields(sealed, like, self.key, name, id_col=note["id"]).select(*like.names)

    def names(self) -> list[str]:
        return self.inner.names()
