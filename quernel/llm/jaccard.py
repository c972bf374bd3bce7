"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

1. Every whole text becomes a set of word-shingle hashes (64 bits, sorted). Documents with equal sets form one node.
2. A tile holds the nodes that share a prefix key and lie in one size band. Prefix keys: with similarity t, sets A and B
   that link have an overlap of at least t*|A|, so the first |A| - ceil(t*|A|) + 1 elements of each, in any common
   order, share an element. The order puts rare shingles first by a count sketch of fixed size over all documents.
   Sizes that link differ by the factor t at most: a tile is read in order of size, and only that band is compared. The
   places of the first common key in both sets bound their overlap too: a pair is only judged where these allow a link,
   and the smaller set's place must be in the first (1-t)/(1+t) of it. Rows without such a partner leave their tile.
3. A set's bitmap has a bit for each hash modulo its width. Bits set in A's and not in B's bound |A - B| from below, and
   so the overlap from above; pairs that pass are intersected exactly.
4. First each row of a tile is only linked with the nearest row before it that passes, in one order of the nodes for all
   tiles, so that a group of k copies gives about k pairs, however many keys it shares; linked nodes are merged to
   components. Then all other pairs that pass and lie in different components are intersected. Tiles of `small_tile`
   rows give these other pairs in the same pass; only larger tiles with several components are read again, with the
   arrays, and intersect them in place: a link merges two components there, so a tile gives fewer links than it has
   components, however many pairs they make. Those over `tile_shingles` are dealt in blocks: the rows of the tile's
   largest component to one block each, the others to every block. So no link between components is lost, and no row is
   compared with its own component.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.shared import in_slices, small, written
from quernel.operators.mutate import sequenced

SKETCH_BITS, BLOCKS = 22, 64
LOOK = 64  #: rows back in a large tile that a row is first compared with


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    num: int = 90  #: two sets link when den * overlap >= num * union
    den: int = 100
    max_bits: int = 1 << 14  #: of a bitmap
    tile_rows: int = 4096  #: of a chunk of a tile, when rows are linked with near ones before them
    tile_shingles: int = 1 << 20  #: of a block of a tile, when its components are compared: 8 bytes each
    small_tile: int = 16
    hot_rows: int = 1 << 20  #: shingles that may be in so many documents (and 64 times the mean) are placed in ranges


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(h) - n + 1
    acc = _mix(h[:m])
    for k in range(1, n):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(acc)


def bitmap(hashes: np.ndarray, most: int) -> bytes:
    bits = min(most, max(64, 1 << (2 * len(hashes) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap (uint64 words) for a smaller power of two: bits that share a remainder fall together."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0) if len(bits) > width else bits


def most_overlap(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """The upper bound of the overlap; a and b are bitmaps of one width, b may be a matrix of them."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _first_pass(rows: DataFrame, p: Params) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, node binary, bits binary, block int, counts binary"
    names = ["doc_id", "n", "node", "bits", "block", "counts"]

    def run(batches):
        total, kind_pa = np.zeros(1 << SKETCH_BITS, np.int32), None
        for b in in_slices(batches):
            kind_pa = b.column(0).type
            sizes, nodes, bits = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, p.shingle)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bits.append(bitmap(s, p.max_bits) if len(s) else None)
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bits, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        if total.any():
            for k, x in enumerate(total.reshape(BLOCKS, -1)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind_pa), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def _sketch(first: DataFrame) -> np.ndarray:
    """A class of frequency for each slot: of fixed size, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(v), np.int32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"block": list(sums), "classes": [np.minimum(255, 6 * np.log2(1.0 + x)).astype(np.uint8).tobytes() for x in sums.values()]}, schema=pa.schema([("block", pa.int32()), ("classes", pa.binary())]))

    out = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.uint8)
    for r in first.filter("block is not null").select("block", "counts").repartition(BLOCKS, "block").mapInArrow(add, "block int, classes binary").collect():
        out[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return out.reshape(-1)


def _nid(node: bytes) -> int:
    """A node's short name, by which key rows refer to it; two nodes with one name only cost a comparison."""
    return int.from_bytes(node[:8], "big", signed=True)


def _hot_class(classes: np.ndarray, p: Params) -> int:
    """The class of frequency from which on a shingle is very frequent."""
    mean = float(np.exp2(classes / 6.0).mean()) - 1
    return min(255, int(6 * np.log2(1 + max(p.hot_rows, 64 * mean))))


def _keys(rows: DataFrame, classes: np.ndarray, p: Params) -> DataFrame:
    """key, nid, n, pos, hot: the prefix of each set, with the place of each key in it, and whether many sets may have it;
    copies within a task are given once."""
    limit = _hot_class(classes, p)
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        order, seen = shared.value, set()
        for b in in_slices(batches):
            keys, nids, sizes, places, hot = [], [], [], [], []
            for t in b.column(0).to_pylist():
                s = shingles(t, p.shingle)
                if not len(s) or (nid := _nid(xxhash.xxh3_128_digest(s.tobytes()))) in seen:
                    continue
                seen.add(nid)
                n = len(s) + -(-p.num * len(s) // p.den) * -1 + 1
                often = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[:n]
                keys.append(s[first])
                hot.append(often[first] >= limit)
                nids.append(np.full(n, nid, np.int64))
                sizes.append(np.full(n, len(s), np.int32))
                places.append(np.arange(n, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (nids, sizes, places, hot))], names=["key", "nid", "n", "pos", "hot"])

    return rows.select("text").mapInArrow(run, "key bigint, nid bigint, n int, pos int, hot boolean")


def _hot_members(keys: DataFrame) -> DataFrame:
    """_members() for very frequent keys: all their rows."""
    rows = keys.dropDuplicates(["key", "nid"])
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    placed = sequenced(rows, [F.col("n"), F.col("nid")], per=["key"]).withColumnRenamed("sequence", "idx")
    return placed.join(written(sizes, "hot-keys"), "key").select("key", "nid", "n", "pos", F.col("idx").cast("int").alias("idx"), "rows").filter("rows > 1")


def _members(keys: DataFrame, p: Params) -> DataFrame:
    """key, nid, n, pos, idx, rows: the tiles, without the rows whose place or size leaves them no partner there.

    idx is a row's place in its tile by size and node, rows the tile's number of rows.
    """
    keys = keys.repartition("key").dropDuplicates(["key", "nid"])  # one shuffle: copies of other tasks, and the windows
    w = W.partitionBy("key").orderBy("n", "nid")
    shallow = F.col("pos") * (p.den + p.num) <= F.col("n") * (p.den - p.num)
    fits = lambda less, more: F.coalesce(p.den * less >= p.num * more, F.lit(False))
    rows = keys.select("*", F.max(F.when(shallow, F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("less"), F.lead("n").over(w).alias("more"))
    rows = rows.filter(fits(F.col("less"), F.col("n")) | (shallow & fits(F.col("n"), F.col("more")))).drop("less", "more")
    return rows.select("*", F.row_number().over(w).alias("idx"), F.count(F.lit(1)).over(W.partitionBy("key")).alias("rows")).filter("rows > 1")


def _pairs_schema():
    return pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _dealt(rows: DataFrame, place: list[str], columns: list[str]) -> DataFrame:
    """The rows of tiles, dealt by place and sorted by it, size and node."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*place, *columns).repartition(parts, *place).sortWithinPartitions(*place, "n", "node")


def _tiles_of(batches, places: int):
    """(place, rows) of each tile from sorted rows; a row is the tuple of the other columns."""
    at, tile = None, []
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for place, row in zip(zip(*columns[:places], strict=True), zip(*columns[places:], strict=True), strict=True):
            if place != at:
                if len(tile) > 1:
                    yield at, tile
                at, tile = place, []
            tile.append(row)
    if len(tile) > 1:
        yield at, tile


def _allowed(n: int, i: int, m: int, j: int, p: Params) -> bool:
    """Whether sets of n and m elements can link if their first common element is at i and j."""
    a, b = n - i, m - j
    return p.den * min(a, b) >= p.num * (i + j + max(a, b))


class _Bits:
    """A bitmap as an integer, and its foldings to smaller powers of two."""

    def __init__(self, raw: bytes):
        self.width, self.at = len(raw) * 8, {len(raw) * 8: int.from_bytes(raw, "little")}

    def fold(self, width: int) -> int:
        if width not in self.at:
            wide = self.fold(2 * width)
            self.at[width] = wide & ((1 << width) - 1) | wide >> width
        return self.at[width]


def _may_link(a: _Bits, n: int, b: _Bits, m: int, p: Params) -> bool:
    width = min(a.width, b.width)
    x, y = a.fold(width), b.fold(width)
    both = x & y
    top = min(n - (x ^ both).bit_count(), m - (y ^ both).bit_count())
    return p.den * top >= p.num * (n + m - top)


def _first_pairs(members: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """u, v, first: pairs in a tile that the bitmaps do not rule out. first: the nearest one before a row, of each row;
    the others are only given for small tiles."""
    chunk = F.floor((F.col("idx") - 1) / p.tile_rows).cast("int")
    ahead = F.pmod(F.col("idx") - 1, F.lit(p.tile_rows)) >= p.tile_rows - LOOK  # also at hand for the next chunk
    chunks = F.explode(F.when(ahead & (F.col("rows") > p.tile_rows), F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    rows = members.select("*", chunks.alias("chunk")).join(nodes.select("nid", "node", "bits"), "nid")
    full = _dealt(rows, ["key", "chunk"], ["n", "node", "pos", "rows", "bits"])

    def run(batches):
        for out in in_lots(judged(batches)):
            u, v, first = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(first, pa.bool_())], names=["u", "v", "first"])

    def judged(batches):
        for _, tile in _tiles_of(in_slices(batches, 6), 2):
            whole = tile[0][3] <= p.small_tile
            bits = [_Bits(r[4]) for r in tile]
            for k in range(1, len(tile)):
                n, node, pos = tile[k][:3]
                first = True
                for j in range(k - 1, -1 if whole else max(-1, k - 1 - LOOK), -1):
                    m, other, place = tile[j][:3]
                    if p.den * m < p.num * n:
                        break
                    if node != other and _allowed(n, pos, m, place, p) and _may_link(bits[k], n, bits[j], m, p):
                        yield min(node, other), max(node, other), first
                        first = False
                        if not whole:
                            break

    return full.mapInArrow(run, "u binary, v binary, first boolean").groupBy("u", "v").agg(F.max("first").alias("first"))


def in_lots(rows, most: int = 20_000):
    """Lists of at most so many of rows."""
    lot = []
    for r in rows:
        lot.append(r)
        if len(lot) >= most:
            yield lot
            lot = []
    if lot:
        yield lot


def _arrays(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """node and hashes of the wanted nodes, from the whole text of one document each."""
    ids = written(nodes.join(wanted, "node", "left_semi").select(F.col("doc").alias("wanted_id"), "node"), "jaccard-wanted")
    n = ids.count()
    ids_only = small(ids.select("wanted_id").distinct(), n, 16)
    texts = docs.select("doc_id", "text").join(ids_only, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            sets = [s for t in b.column(0).to_pylist() if len(s := shingles(t, p.shingle))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    made = texts.mapInArrow(run, "node binary, hashes binary").join(small(ids.select("node"), n, 32), "node", "left_semi")
    return made.dropDuplicates(["node"])


def _linked(x: np.ndarray, y: np.ndarray, p: Params) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return p.den * both >= p.num * (len(x) + len(y) - both)


def _exact(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, p: Params, name: str) -> DataFrame:
    """Of the pairs (u, v), those whose sets really link; written."""
    pairs = written(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    arrays = written(_arrays(docs, nodes, wanted, p), f"{name}-arrays")
    side = lambda x: arrays.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(_linked(x, y, p))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], schema=_pairs_schema())

    return written(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "h_u", "h_v").mapInArrow(run, "u binary, v binary"), f"{name}-links")


def connected(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for each node of the edges (u, v).

    Alternates large-star and small-star steps; each is an aggregation and a join, and ends written to the shared
    folder. It stops when a round changes nothing.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "cc")
    sign = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now, before = sign(e), None
    while now != before and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        e = written(star.distinct(), "cc")
        now, before = sign(e), now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _later_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """u, v: links between different components in the large tiles, enough of them to connect what links there."""
    labelled = nodes.join(labels, "node", "left").select("nid", "node", F.coalesce("label", "node").alias("label"))
    rows = members.filter(F.col("rows") > p.small_tile).select("key", "nid", "n", "pos").join(labelled, "nid")
    rows = written(rows.select("key", "node", "n", "pos", "label"), "tile-rows")
    each = rows.groupBy("key", "label").agg(F.sum("n").alias("k"))
    tiles = each.groupBy("key").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda k: F.greatest(F.lit(1), F.ceil(k / p.tile_shingles)).cast("int")
    tiles = written(tiles.select("key", F.col("most.label").alias("main"), blocks(F.col("most.k")).alias("wide"), blocks(F.col("all") - F.col("most.k")).alias("high")), "mixed-tiles")
    rows = written(rows.join(tiles, "key"), "mixed-rows")
    arrays = written(_arrays(docs, nodes, rows.select("node").distinct(), p), "mixed-arrays")
    dealt = rows.withColumn("side", F.col("label") != F.col("main"))
    # block (a, b): a share of the main component beside a share of the others; (-1 - a, b): two shares of the others
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("side"), F.col("high")).otherwise(F.col("wide"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    places = F.when(~F.col("side"), F.transform(every(F.col("high")), lambda b: F.struct(F.col("mine").alias("a"), b.alias("b")))).otherwise(
        F.concat(
            F.transform(every(F.col("wide")), lambda a: F.struct(a.alias("a"), F.col("mine").alias("b"))),
            F.transform(every(F.col("high")), lambda b: F.struct((-1 - F.least("mine", b)).alias("a"), F.greatest("mine", b).alias("b"))),
        )
    )
    dealt = dealt.withColumn("mine", mine).select("key", "node", "n", "pos", "label", "side", "mine", F.explode(places).alias("at"))
    full = _dealt(dealt.select("key", "at.a", "at.b", "node", "n", "pos", "label", "side", "mine").join(arrays, "node"), ["key", "a", "b"], ["n", "node", "pos", "label", "side", "mine", "hashes"])

    def links(place, tile):
        up: dict[bytes, bytes] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                x = y
            return x

        if len({r[3] for r in tile}) < 2:
            return
        n, pos, side, mine = (np.array([r[k] for r in tile]) for k in (0, 2, 4, 5))
        sets = [np.frombuffer(r[6], np.uint64) for r in tile]
        words = [np.frombuffer(bitmap(x, p.max_bits), np.uint64) for x in sets]
        label = [r[3] for r in tile]
        widths = np.array([len(w) for w in words])
        stacks, starts = {}, {}
        for width in np.unique(widths):  # rows are in order of n, so rows of one width stand together
            at = np.flatnonzero(widths == width)
            starts[width], stacks[width] = at[0], np.stack([words[i] for i in at])
        begin = np.searchsorted(p.den * n, p.num * n, side="left")
        across = place[1] >= 0  # the main component beside others; else others among themselves
        halves = not across and -1 - place[1] != place[2]  # two different shares of them
        for i in range(1, len(tile)):
            for width, stack in stacks.items():
                a, b = max(begin[i], starts[width]), min(i, starts[width] + len(stack))
                if a >= b:
                    continue
                x, y = n[i] - pos[i], n[a:b] - pos[a:b]
                fits = p.den * np.minimum(x, y) >= p.num * (pos[i] + pos[a:b] + np.maximum(x, y))
                if across:
                    fits &= side[a:b] != side[i]
                elif halves:
                    fits &= mine[a:b] != mine[i]
                other = np.flatnonzero(fits) + a
                if not len(other):
                    continue
                top = most_overlap(fold(words[i], width), n[i], stack[other - starts[width]], n[other])
                for j in other[p.den * top >= p.num * (n[i] + n[other] - top)]:
                    one, two = root(label[i]), root(label[j])
                    if one != two and _linked(sets[i], sets[j], p):
                        up[one] = two
                        yield min(tile[i][1], tile[j][1]), max(tile[i][1], tile[j][1])

    def run(batches):
        for out in in_lots(x for place, tile in _tiles_of(in_slices(batches, 9), 3) for x in links(place, tile)):
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=_pairs_schema())

    return full.mapInArrow(run, "u binary, v binary").distinct()


def components(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    component_id is the smallest doc_id that links lead to, the own one included. Null, empty or blank text has no
    shingle, links with nothing and is its own component. Null ids are linked like others; a component of null ids only
    has a null component_id. Repeated rows give repeated rows; other columns are ignored.
    """
    p = params
    docs = docs.select("doc_id", "text")
    first = written(_first_pass(docs, p), "jaccard-sets")
    classes = _sketch(first)
    sets = first.filter("block is null")
    nodes = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = written(nodes.select("*", F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("bigint").alias("nid")), "jaccard-nodes")
    keys = _keys(docs, classes, p)
    members = _members(keys.filter("not hot").drop("hot"), p)
    if (classes >= _hot_class(classes, p)).any():
        members = members.unionByName(_hot_members(keys.filter("hot").drop("hot")))
    members = written(members, "jaccard-members")
    pairs = written(_first_pairs(members, nodes, p), "jaccard-pairs")
    links = _exact(pairs.filter("first").select("u", "v"), docs, nodes, p, "first")
    labels = connected(links)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    other = pairs.filter("not first").select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    other = other.filter(F.coalesce("label_u", "u") != F.coalesce("label_v", "v")).select("u", "v")
    across = _exact(other, docs, nodes, p, "across").unionByName(written(_later_links(members, docs, nodes, labels, p), "later-links"))
    if across.take(1):
        labels = connected(links.unionByName(across))
    named = nodes.select("node", "doc").join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    ids = named.join(lowest, "label").select("node", "component_id")
    return sets.join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs, with its own columns, without the documents whose component holds a smaller id.

    Rows with the same id are one document: it goes if any of them is linked to a smaller id. Rows with a null id go
    if a document with an id is linked to them, and stay otherwise.
    """
    found = components(docs, params)
    gone = written(found.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct(), "jaccard-gone")
    return docs.join(small(gone, gone.count(), 16), docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


#: The same for 3 words and 90 %, stated directly.
COMPONENTS_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS e FROM s),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT u AS doc_id, u AS other FROM (SELECT doc_id AS u FROM n) UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""
