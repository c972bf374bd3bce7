"""Queries over internal stores: keyset pages with a simple filter string, and a Python data source for them."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quernel.functions.predicates import store_filter, topic_match
from quernel.operators.listing import keyset_page


def query(store: DataFrame, filter_text: str | None, limit: int, cursor=None, key: str = "id") -> DataFrame:
    """The next `limit` rows after cursor that the filter fits, and has_more.

    A topic filter with wildcards matches by levels; one row more than asked for tells whether there are more.
    """
    wanted = store_filter(filter_text)
    if wanted:
        name, value = wanted
        name = name if name in store.columns else key
        wild = name in ("topic", "pattern") and set(value) & {"+", "#"}
        store = store.filter(topic_match(F.col(name), value) if wild else F.col(name) == value)
    page = keyset_page(store, cursor, limit + 1, key)
    n = page.agg(F.count(F.lit(1)).alias("n"))
    return page.orderBy(key).limit(limit).crossJoin(F.broadcast(n.select((F.col("n") > limit).alias("has_more"))))  # one row


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema, path: str):
        self.names, self.path = schema.names, path

    def partitions(self) -> list[InputPartition]:
        files, root = _folder(self.path)
        return [_Part(f.path) for f in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path) if f.path.endswith(".jsonl")]

    def read(self, part: _Part) -> Iterator[tuple]:
        with _folder(self.path)[0].open_input_stream(part.path) as f:
            for line in io.TextIOWrapper(f, "utf-8"):
                row = json.loads(line)
                yield tuple(row.get(n) for n in self.names)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """A file a task, under a name that readers skip until all tasks are done."""

    def __init__(self, names, path: str, overwrite: bool):
        self.names, self.path, self.overwrite = names, path, overwrite

    def write(self, rows) -> _Written:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.part"
        with files.open_output_stream(name) as out:
            for row in rows:
                out.write((json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False) + "\n").encode())
        return _Written(name)

    def commit(self, messages) -> None:
        files, root = _folder(self.path)
        for f in files.get_file_info(fs.FileSelector(root)) if self.overwrite else ():
            if f.path.endswith(".jsonl"):
                files.delete_file(f.path)
        for m in messages:
            files.move(m.path, m.path.removesuffix(".part") + ".jsonl")

    def abort(self, messages) -> None:
        for m in filter(None, messages):
            _folder(self.path)[0].delete_file(m.path)


class DocumentSource(DataSource):
    """`format("quernel")`: a folder, shared by all executors, of .jsonl files, a partition each; read and written."""

    @classmethod
    def name(cls) -> str:
        return "quernel"

    def schema(self) -> str:
        return "id string, data string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema.names, self.options["path"], overwrite)
