"""Merkle fixity audit of WARC records.

Pages become WARC resource records. A volume holds the records of a range of keys in order, with their offsets. The
leaves of its tree are record digests; a node covers an ordered range of `fanout` slots and digests its children's slots,
digests and offset ranges. The ranges count from the node's own start: a lost record moves all that stand after it, but
only changes the digests of the nodes above it. Replicas are compared by their roots, and only the children of differing
nodes are looked at, down to records. Each level of a tree is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.shared import let, written

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  #: of records, where the pages have none


@dataclass(frozen=True)
class Params:
    fanout: int = 16
    levels: int = 3  #: above the records; a volume has fanout ** levels slots

    @property
    def slots(self) -> int:
        return self.fanout**self.levels


def record_text(key: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record: header, empty line, block, two line ends.

    Its id names the key. A null or empty URL gives no target, a null body an empty block; line ends in a URL are escaped.
    """
    body = F.coalesce(html, F.lit(""))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.when(uri == "", F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(CRLF)))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), key.cast("string"), F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}"), target, F.lit(f"Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    return F.concat(head, body, F.lit(CRLF * 2))


def _texts(pages: DataFrame, params: Params) -> DataFrame:
    """key, volume, slot, text of every row's record: key is page_id, or a negative hash of a null one's row."""
    key = F.coalesce(F.col("page_id").cast("bigint"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40)))
    return _placed(pages.select(key.alias("key"), record_text(key, F.col("url"), F.col("html")).alias("text")), params).select("key", "volume", "slot", "text")


def _placed(rows: DataFrame, params: Params) -> DataFrame:
    return rows.withColumns({"volume": F.floor(F.col("key") / params.slots).cast("bigint"), "slot": F.pmod("key", F.lit(params.slots))})


def records(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """key, volume, slot, n_bytes, sha256 of every row's record."""
    return _texts(pages, params).select("key", "volume", "slot", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def write_volumes(pages: DataFrame, path: str, params: Params = Params()) -> None:
    """Writes the records to WARC files below path, one for each volume, in order."""
    rows = _texts(pages, params).repartition("volume").sortWithinPartitions("volume", "slot", "text")
    body = F.substring("text", F.lit(1), F.length("text") - 2)  # the writer ends each record with the last line end
    rows.select("volume", body.alias("value")).write.option("lineSep", CRLF).partitionBy("volume").text(path)


def parse_warc(data: bytes):
    """(offset, end, headers, block) of each record of a WARC file; a header without a length, or a block that the file
    cuts off, ends it, and what is left is one record without headers."""
    at = 0
    while at < len(data):
        start = at
        line = data.find(b"\r\n\r\n", at)
        lines = data[at:line].decode("utf-8", "replace").split(CRLF) if line >= 0 else []
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        end = line + 4 + int(length) if length.isdigit() else -1
        if not lines or not lines[0].startswith("WARC/") or end < 0 or data[end : end + 4] != b"\r\n\r\n":
            yield start, len(data), {}, data[start:]
            return
        at = end + 4
        yield start, at, headers, data[line + 4 : end]


def read_volumes(spark: SparkSession, path: str, params: Params = Params()) -> DataFrame:
    """key, volume, slot, n_bytes, sha256, uri, payload of the records of WARC files that write_volumes() wrote.

    A file is read by one task; a volume's size is bounded by its slots. Bytes that are no record have a null key.
    """

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = list(parse_warc(data.as_py()))
                key = [k[10:-1] if (k := h.get("warc-record-id", "")).startswith("<urn:page:") else None for _, _, h, _ in rows]
                yield pa.RecordBatch.from_arrays([pa.array([int(k) if k and k.lstrip("-").isdigit() else None for k in key], pa.int64()), pa.array([data.as_py()[a:e] for a, e, _, _ in rows], pa.binary()), pa.array([h.get("warc-target-uri") for _, _, h, _ in rows], pa.string()), pa.array([x for *_, x in rows], pa.binary())], names=["key", "record", "uri", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = _placed(files.mapInArrow(run, "key bigint, record binary, uri string, payload binary"), params)
    return rows.select("key", "volume", "slot", F.length("record").cast("bigint").alias("n_bytes"), F.sha2("record", 256).alias("sha256"), "uri", "payload")


def slots(recs: DataFrame) -> DataFrame:
    """volume, slot, sha256, n_records, n_bytes, offset: the leaves in order, with their offsets in the volume.

    A slot with one record has that record's digest. Records with the same key share a slot, whose digest is that of
    their number and of the sums of their digests' quarters: so a key of any number of records is only aggregated.
    """
    quarters = [F.sum(F.conv(F.substring("sha256", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    leaves = recs.groupBy("volume", "slot").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.min("sha256").alias("one"), *quarters)
    every = F.sha2(F.concat_ws(",", "n_records", "q0", "q1", "q2", "q3"), 256)
    leaves = leaves.select("volume", "slot", F.when(F.col("n_records") == 1, F.col("one")).otherwise(every).alias("sha256"), "n_records", "n_bytes")
    before = W.partitionBy("volume").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0).cast("bigint")))


def tree(leaves: DataFrame, name: str, params: Params = Params()) -> list[DataFrame]:
    """The levels above the leaves, lowest first: volume, node, sha256, offset, end; written. A group has `fanout` rows."""
    out, below = [], leaves.select("volume", F.col("slot").alias("node"), "sha256", "offset", (F.col("offset") + F.col("n_bytes")).alias("end"))
    for level in range(params.levels):
        said = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["node"], x["offset"] - rows[0]["offset"], x["end"] - rows[0]["offset"], x["sha256"])), ",")
        digest = F.sha2(let(F.sort_array(F.collect_list(F.struct("node", "offset", "end", "sha256"))), said), 256)
        below = written(below.groupBy("volume", F.expr(f"node div {params.fanout}").alias("node")).agg(digest.alias("sha256"), F.min("offset").alias("offset"), F.max("end").alias("end")), f"{name}-{level}")
        out.append(below)
    return out


def _differing(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    theirs = theirs.select("volume", key, F.col("sha256").alias("sha256_b"))
    both = ours.select("volume", key, F.col("sha256").alias("sha256_a")).join(theirs, ["volume", key], "full")
    return both.filter(~F.col("sha256_a").eqNullSafe(F.col("sha256_b")))


def mismatches(a: DataFrame, b: DataFrame, params: Params = Params()) -> DataFrame:
    """volume, slot, sha256_a, sha256_b of the leaves that differ, found from the roots down.

    Each level only keeps the nodes below a differing one before it compares them. A null digest: no record there.
    """
    ups, downs = tree(a, "tree-a", params), tree(b, "tree-b", params)
    bad = written(_differing(ups[-1], downs[-1], "node").select("volume", "node"), "differing")
    for ours, theirs in zip(reversed(ups[:-1]), reversed(downs[:-1]), strict=True):
        below = lambda x, bad=bad: x.withColumn("up", F.expr(f"node div {params.fanout}")).join(bad.withColumnRenamed("node", "up"), ["volume", "up"], "left_semi")
        bad = written(_differing(below(ours), below(theirs), "node").select("volume", "node"), "differing")
    leaf = lambda x: x.withColumn("node", F.expr(f"slot div {params.fanout}")).join(bad, ["volume", "node"], "left_semi")
    return _differing(leaf(a), leaf(b), "slot")


def audit(ours: DataFrame, theirs: DataFrame, params: Params = Params()) -> DataFrame:
    """audit_records() of the records of two tables of pages (page_id, url and html, nulls included)."""
    return audit_records(records(ours, params), records(theirs, params), params)


def audit_records(ours: DataFrame, theirs: DataFrame, params: Params = Params()) -> DataFrame:
    """volume, slot, key, offset, n_bytes, n_records, sha256, status for every slot of either replica (key, volume, slot,
    n_bytes, sha256 of records).

    status: ok, corrupt (digests differ), missing (only in ours) or extra (only in theirs). offset, n_bytes, n_records
    and sha256 are ours, null for extra slots. Rows with one key share a slot; a null id is a negative hash of its row;
    empty tables and very long pages are like others; other columns are ignored.
    """
    a, b = written(slots(ours), "leaves-a"), written(slots(theirs), "leaves-b")
    bad = mismatches(a, b, params).select("volume", "slot", F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256_a").isNull(), "extra").otherwise("corrupt").alias("bad"))
    rows = a.join(bad, ["volume", "slot"], "full")
    return rows.select("volume", "slot", (F.col("volume") * params.slots + F.col("slot")).alias("key"), "offset", "n_bytes", "n_records", "sha256", F.coalesce("bad", F.lit("ok")).alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for audits: every 97th id has a changed body, every 211th is lost."""
    html = F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))).otherwise(F.col("html"))
    lost = F.coalesce(F.pmod("page_id", F.lit(211)) == 7, F.lit(False))
    return pages.filter(~lost).select("page_id", "url", html.alias("html"))


#: The audit of pages against damaged(pages), stated directly.
AUDIT_SQL = f"""
WITH u AS (SELECT page_id AS key, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS uri, coalesce(html, '') AS body FROM pages),
r AS (
  SELECT key, concat('WARC/1.1', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:page:', key, '>', e, 'WARC-Date: {DATE}', e, CASE WHEN uri = '' THEN '' ELSE concat('WARC-Target-URI: ', uri, e) END,
                     'Content-Type: text/html', e, 'Content-Length: ', strlen(body), e, e, body, e, e) AS rec
  FROM u, (SELECT chr(13) || chr(10) AS e))
SELECT CAST(floor(key / 4096.0) AS BIGINT) AS volume, key % 4096 AS slot, key,
       CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY floor(key / 4096.0) ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(strlen(rec) AS BIGINT) AS n_bytes, CAST(1 AS BIGINT) AS n_records, sha256(rec) AS sha256,
       CASE WHEN key % 211 = 7 THEN 'missing' WHEN key % 97 = 5 THEN 'corrupt' ELSE 'ok' END AS status
FROM r
"""
