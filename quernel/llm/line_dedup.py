"""Near-duplicate line removal by a deletion-neighbourhood join.

Lines are compared after lower-casing ASCII letters and collapsing white space. Two lines are equal for this purpose
when one edit (insertion, deletion or substitution of a character) at most separates them; lines under `least_chars` say
too little for that and are equal when they are the same. Blank lines are never compared.

Every variant of a line with one character deleted is hashed; lines one edit apart share a variant: both delete the same
position (substitution), or one's variant is the other line (insertion). The hash is a polynomial of the characters, so
all variants of a line come from its prefix sums in one pass, and no variant is ever a string. So that not every line
emits as many variants as it has characters, lines are narrowed first: a line cut into parts, with one part left out,
gives a key; one edit lies within one part (or can be attributed to one), so lines one edit apart share such a key. Lines
are narrowed by halves, then by `blocks` parts; what is left of a line that shares a key with another is the part left
out. This is narrowed again, and only the rest emits variants. Pairs that share a variant are verified by the edit
distance of their whole lines.

An occurrence is dropped if an earlier occurrence (by doc_id, then line number) of an equal line exists. Groups are only
aggregated (minimum of the first occurrence), never paired, so a very frequent line costs no more than a rare one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import in_slices, let, written

BLOOM_BITS, BLOOM_PARTS = 25, 64


@dataclass(frozen=True)
class Params:
    least_chars: int = 24  #: shorter lines say too little to be called copies one edit apart; only exact copies go
    blocks: int = 8


#: Of the variants' hashes: two primes, so that products of residues fit 64 bits, and a base.
PRIMES, BASE = (2147483647, 2147483629), 1_000_003


def normal(line: bytes) -> str:
    """A line with its white space collapsed; A-Z are lower-cased before, in the whole text."""
    return b" ".join(line.split()).decode("utf-8", "replace")


def half_keys(line: str) -> list[int]:
    """block_keys() for two parts: hashes of either half of a line, in the length's and the next shorter one's unit."""
    n = len(line)
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"), seed=2 * u + s) - (1 << 63) for u in {n // 2, (n - 1) // 2} for s, x in ((0, line[n - u :]), (1, line[:u]))]


def _each(text: str | None):
    """(number, line) of a text's lines."""
    return enumerate(map(normal, (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")))


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def line_table(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, line_no (from 0), h and halves (half_keys) of every line that is not blank; halves is empty where the line
    is too short for near copies."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in in_slices(batches):
            at, numbers, hashes, halves = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for k, line in _each(text):
                    if line:
                        at.append(i)
                        numbers.append(k)
                        hashes.append(line_hash(line))
                        halves.append(half_keys(line) if len(line) >= p.least_chars else [])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "line_no", "h", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line_no int, h bigint, halves array<bigint>")


def _slots(h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    return np.concatenate([h >> np.uint64(64 - BLOOM_BITS), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BLOOM_BITS)]).astype(np.int64)


def _bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the column h: of fixed size; a large input fills it, which costs speed, not results."""
    size = 1 << (BLOOM_BITS - 3)

    def mark(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            slots = _slots(b.column(0).to_numpy())
            np.bitwise_or.at(bits, slots >> 3, (128 >> (slots & 7)).astype(np.uint8))
        if bits.any():
            parts = bits.reshape(BLOOM_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOOM_PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=["part", "bits"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(v), np.uint8)
                sums[k] = sums[k] | x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((BLOOM_PARTS, size // BLOOM_PARTS), np.uint8)
    for r in hashes.select("h").mapInArrow(mark, "part int, bits binary").repartition(BLOOM_PARTS, "part").mapInArrow(merge, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def lines_with(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """h and line, once each, for the hashes wanted (h)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches):
        bits, seen = shared.value, set()
        for b in in_slices(batches):
            lines, hashes = [], []
            for text in b.column(0).to_pylist():
                for _, line in _each(text):
                    if len(line) >= p.least_chars:
                        lines.append(line)
                        hashes.append(line_hash(line))
            h = np.array(hashes, np.int64)
            slots = _slots(h)
            hit = (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).reshape(2, -1).all(axis=0)
            keep = [i for i in np.flatnonzero(hit) if hashes[i] not in seen and not seen.add(hashes[i])]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array([lines[i] for i in keep], pa.string())], names=["h", "line"])

    return docs.select("text").mapInArrow(run, "h bigint, line string").join(wanted, "h", "left_semi").dropDuplicates(["h"])


def block_keys(text: Column, outer: Column, n: int) -> Column:
    """Array of (key, rest): for each part, the hash of what stands before and after it, and the part itself.

    Parts before the one left out are counted from the start, those after it from the end, in units of the length
    div n. As a line one character shorter may have a smaller unit, that unit's keys are given too.
    """

    def cut(t: Column, unit: Column, s: int) -> Column:
        head, tail = unit * s, unit * (n - 1 - s)
        key = F.xxhash64(outer, F.lit(s), unit, F.substring(t, F.lit(1), head), F.substring(t, F.length(t) - tail + 1, tail))
        return F.struct(key.alias("key"), F.substring(t, head + 1, F.length(t) - head - tail).alias("rest"))

    def keys(t: Column) -> Column:
        unit, less = F.floor(F.length(t) / n).cast("int"), F.floor((F.length(t) - 1) / n).cast("int")
        own = F.array(*(cut(t, unit, s) for s in range(n)))
        return F.when(unit == less, own).otherwise(F.concat(own, F.array(*(cut(t, less, s) for s in range(n)))))

    return let(text, keys)


def _shared(rows: DataFrame) -> DataFrame:
    """The keys that more than one line has."""
    return rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter(F.col("low") != F.col("high")).select("key")


def _with_shared(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose key more than one line has. The keys are written, so a key that very many rows have can be split."""
    return rows.join(written(_shared(rows), name), "key", "left_semi")


def _powers(n: int, p: int) -> np.ndarray:
    """BASE**i modulo p for i below n."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(BASE, done, p)) % np.uint64(p)
        done += more
    return out[:n]


def variant_hashes(rest: str, outer: int) -> np.ndarray:
    """Hashes of rest itself (first) and of rest without its character i (at i + 1), each with outer."""
    chars = np.frombuffer(rest.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(chars) + 1, np.uint64)
    for p in PRIMES:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * _powers(len(chars), p) % np.uint64(p), dtype=np.uint64) % np.uint64(p)])
        after = (sums[-1] + np.uint64(p) - sums[1:]) % np.uint64(p) * np.uint64(pow(BASE, -1, p)) % np.uint64(p)  # moved one place down
        each = np.concatenate([sums[-1:], (sums[:-1] + after) % np.uint64(p)])
        out = out << np.uint64(32) | each
    out ^= np.uint64(outer & ((1 << 64) - 1))
    out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def one_edit(a: str, b: str) -> bool:
    """Whether one edit at most separates a and b: what is left between their common start and end is that edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    x, y = (np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    start = np.flatnonzero(x[:n] != y[:n])
    if not len(start):
        return True
    end = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    return int(start[0]) + int(end[0]) >= max(len(x), len(y)) - 1 if len(end) else True


def _variants(inner: DataFrame) -> DataFrame:
    """h, first, g, pos for each variant of the rows' rest (key, h, first, rest); pos is -1 for the rest itself."""
    kind = inner.schema["first"].dataType.simpleString()

    def run(batches):
        for b in in_slices(batches, 3, 1 << 18):
            got = [variant_hashes(rest, outer) for outer, rest in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            pos = np.concatenate([np.arange(-1, len(g) - 1, dtype=np.int32) for g in got] or [np.zeros(0, np.int32)])
            g = np.concatenate(got or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(g), pa.array(pos)], names=["h", "first", "g", "pos"])

    return inner.select("key", "h", "first", "rest").mapInArrow(run, f"h bigint, first {kind}, g bigint, pos int")


def near_firsts(docs: DataFrame, firsts: DataFrame, p: Params) -> DataFrame:
    """h and near: for each line with others one edit away, the first occurrence of the earliest of these."""
    halves = firsts.select("h", F.explode("halves").alias("key"))
    wanted = written(_with_shared(halves, "line-half-keys").select("h").distinct(), "line-wanted")
    lines = written(lines_with(docs, wanted, p), "line-texts")
    rows = lines
    for text, outer in ((F.col("line"), F.lit(0).cast("bigint")), (F.col("rest"), F.col("key"))):
        parts = written(rows.select("h", F.explode(block_keys(text, outer, p.blocks)).alias("b")).select("h", "b.*"), "line-parts")
        rows = _with_shared(parts, "line-part-keys").dropDuplicates(["key", "h"])
    variants = written(_variants(rows.join(firsts.select("h", "first"), "h")), "line-variants")
    mine = F.struct("first", "h")
    by_pos = variants.groupBy("g", "pos").agg(F.min(mine).alias("best"), F.min("h").alias("low"), F.max("h").alias("high"))
    same_pos = by_pos.filter((F.col("pos") >= 0) & (F.col("low") != F.col("high"))).select("g", "pos", "best")
    full = by_pos.filter(F.col("pos") < 0).select("g", F.col("best").alias("full"))
    cut = by_pos.filter(F.col("pos") >= 0).groupBy("g").agg(F.min("best").alias("cut"))
    across = full.join(cut, "g")
    substituted = variants.join(same_pos, ["g", "pos"]).select("h", "best")
    inserted = variants.join(across, "g").select("h", F.when(F.col("pos") < 0, F.col("cut")).otherwise(F.col("full")).alias("best"))
    pairs = substituted.unionByName(inserted).filter(F.col("best.h") != F.col("h")).select("h", F.col("best.first").alias("near"), F.col("best.h").alias("other")).distinct()
    both = pairs.join(lines, "h").join(lines.select(F.col("h").alias("other"), F.col("line").alias("other_line")), "other")
    kind = pairs.schema["near"].dataType.simpleString()

    def run(batches):
        for b in in_slices(batches, 2):
            same = pa.array([one_edit(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield b.select([0, 1]).filter(same)

    return both.select("h", "near", "line", "other_line").mapInArrow(run, f"h bigint, near {kind}").groupBy("h").agg(F.min("near").alias("near"))


def dropped_lines(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id and gone, the sorted numbers of its dropped lines, for each document that loses a line."""
    p = params
    table = written(line_table(docs, p), "lines")
    at = F.struct("doc_id", "line_no")
    firsts = written(table.groupBy("h").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves")), "line-firsts")
    near = written(near_firsts(docs, firsts, p), "line-near")
    known = firsts.filter("n > 1").select("h", "first").unionByName(near.withColumnRenamed("near", "first")).groupBy("h").agg(F.min("first").alias("first"))
    late = table.select("doc_id", "line_no", "h").join(written(known, "line-known"), "h").filter(F.col("first") < at)
    return late.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def _kept(docs: DataFrame, params: Params) -> tuple[DataFrame, Column]:
    """docs with the numbers of lines to drop, and the rest of the text.

    The numbers grow with the input, so they are never broadcast: the join is by sorted shuffles at every size.
    """
    gone = written(dropped_lines(docs.select("doc_id", "text"), params).select(F.col("doc_id").alias("__gone_id"), F.col("gone").alias("__gone")), "lines-gone")
    joined = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["__gone_id"]), "left")
    rest = let(F.split(docs["text"], "\n"), lambda x: F.array_join(F.filter(x, lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n"))
    return joined, F.when(F.col("__gone").isNull(), docs["text"]).otherwise(rest)


def dedup_lines(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for every row of docs: the text without later copies of lines.

    Null text stays null, with no lines; an empty table gives an empty one. Rows with the same id count as one document:
    a line's place is its id and number, and equal places do not drop each other; a null id comes first. Lines of any
    length are compared whole. Other columns are ignored.
    """
    joined, text = _kept(docs.select("doc_id", "text"), params)
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return joined.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_dropped")).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))


def without_repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with its own columns: texts without later copies of lines, n_chars (where there is one) as they are then.

    A document that loses lines and has no word left goes; all others stay.
    """
    joined, text = _kept(docs, params)
    out = joined.withColumn("text", text).filter(F.col("__gone").isNull() | F.col("text").rlike(r"[^ \x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
