"""SimHash near-duplicate groups by multi-index hashing.

Fingerprint: 256 bits, each the sign of a sum over a text's distinct words. Two texts are near-duplicates where at most `radius` bits differ. The first radius // 3 + 1 segments of equal width cover the fingerprint: of a pair within the radius one segment differs in two bits at most, so that the Hamming balls of radius 1 around both its values meet. Every fingerprint writes its ball into each segment's table and finds those that meet it there; each pair that meets in a segment comes out of it once, whatever the number of meeting points, and has its whole distance verified.

A smaller radius has wider segments, in which fewer unrelated texts meet: with 11 segments of 23 bits these are some 36 million pairs of 250,000 texts in four languages, and grow with the square. A corpus of a hundred million texts wants a radius of 23 (8 segments of 32 bits) or less.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import kernels as K
from pagemill.llm.components import components
from pagemill.llm.store import cut, shuffle_partitions, table

LONGS, RADIUS = 4, 32
#: Fingerprints whose balls are written at once, ball members that a task sorts, fingerprints of a block of verification.
BATCH, BUCKET, BLOCK = 8192, 1 << 22, 1 << 21
BROADCAST_ROWS = 1 << 20  # of 16 bytes
_OWN = 63  # in place of the flipped bit
_SALTS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, LONGS, dtype=np.uint64)
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)


def layout(radius: int) -> tuple[int, int]:
    """Segments and their width."""
    if not 0 <= radius < 3 * 64 * LONGS // 8:
        raise ValueError("the radius is too large for segments of 8 bits")
    segments = radius // 3 + 1
    return segments, min(58, 64 * LONGS // segments)


def fingerprints(t: K.Texts) -> np.ndarray:
    """[texts, LONGS] of uint64. A text without words has the hash of its bytes instead of a sum over words."""
    w = K.words(t)
    text = np.repeat(np.arange(len(w.counts), dtype=np.uint64), w.counts)
    keys = np.sort((text << np.uint64(48)) | (w.hashes & _LOW48))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    first = np.searchsorted(keys, np.arange(len(w.counts) + 1, dtype=np.uint64) << np.uint64(48))
    out = K.mix(K.range_hash(K._BYTE[t.data], t.offsets[:-1], t.offsets[1:])[:, None] ^ _SALTS[None, :])
    lo = 0
    while lo < len(w.counts):  # some texts at a time: the lanes take 256 bytes a word
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 16), "right")) - 1)
        _sums(keys[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], out[lo:hi])
        lo = hi
    return out


def _sums(keys: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    """The signs of the sums over keys[first[i]:first[i + 1]] into out[i], where there are any."""
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return
    begin = first[:-1][some]
    pieces = np.unique(np.concatenate([begin, np.arange(0, len(keys), 255)]))
    part = []
    for lo in range(0, len(pieces), 4096):  # a very long text is one of many pieces
        own = pieces[lo : lo + 4096]
        rows = keys[own[0] : pieces[lo + 4096] if lo + 4096 < len(pieces) else len(keys)]
        bits = K.mix((rows & _LOW48)[:, None] ^ _SALTS[None, :]).view(np.uint8).reshape(len(rows), LONGS * 8)
        # eight 8-bit counters a byte: sums of up to 255 rows don't overflow
        part.append(np.add.reduceat(_SPREAD[bits], own - own[0], axis=0).view(np.uint8).reshape(len(own), LONGS * 64))
    ones = np.add.reduceat(np.concatenate(part), np.searchsorted(pieces, begin), axis=0, dtype=np.int32)
    signs = 2 * ones > np.diff(first)[some][:, None]
    out[some] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64).reshape(len(some), LONGS)


def _text_hash(text_col: str):
    """Null for a null text."""
    text = F.col(text_col).cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text))


_FP = [f"f{i}" for i in range(LONGS)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_hash, f0..) from (id, text, text_hash)."""
    for batch in batches:
        for t in K.chunks(batch.column(1), 1 << 20):
            f = fingerprints(t).view(np.int64)
            ids, hashes = (batch.column(k).slice(t.lo, t.hi - t.lo) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, hashes, *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(LONGS))], names=["id", "text_hash", *_FP])


def segment_values(f: np.ndarray, segments: int, width: int) -> np.ndarray:
    """[rows, segments] of the fingerprints' segments."""
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), LONGS * 8), axis=1, bitorder="little")[:, : segments * width]
    return (bits.reshape(len(f), segments, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(2)


def _numbers(batch: pa.RecordBatch, columns: int = LONGS + 1) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of numbers, all lowest ones first, which compress better so."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: pa.Scalar, width: int) -> np.ndarray:
    at = np.frombuffer(raw.as_buffer(), np.uint8).reshape(width, -1)
    out = np.zeros((at.shape[1], 8), np.uint8)
    out[:, :width] = at.T
    return out.view("<u8").ravel()


def _width(n: int) -> int:
    """Bytes of numbers below n."""
    return max(1, -(-(n - 1).bit_length() // 8))


def _balls(segments: int, width: int, buckets: int, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, nodes, keys, who): every node's ball of radius 1 in each segment, by bucket; who is the place among nodes and the bit that was flipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                node, *f = _numbers(big.slice(at, BATCH))
                v = segment_values(np.stack(f, 1).view(np.uint64), segments, width)
                nodes = planes(node, wide)
                flips = np.append(np.uint64(0), np.uint64(1) << np.arange(width, dtype=np.uint64))
                names = np.append(_OWN, np.arange(width)).astype(np.uint64)
                who = ((np.arange(len(node), dtype=np.uint64) << np.uint64(6))[:, None] | names[None, :]).ravel()
                for s in range(segments):
                    keys = (v[:, s][:, None] ^ flips[None, :]).ravel()
                    bucket = _bucket(keys, s, buckets)
                    order = np.lexsort((keys, bucket))
                    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(bounds))
                    parts = [order[bounds[b] : bounds[b + 1]] for b in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([nodes] * len(some), pa.binary()), pa.array(np.full(len(some), s, np.int32)), pa.array([planes(keys[x], -(-width // 8)) for x in parts], pa.binary()), pa.array([planes(who[x], 3) for x in parts], pa.binary())], names=["bucket", "nodes", "segment", "keys", "who"])

    return run


def _bucket(keys: np.ndarray, segment: int, buckets: int) -> np.ndarray:
    return (K.mix(keys + np.uint64(segment << 58)) % np.uint64(buckets)).astype(np.int64)


def meeting_pairs(key: np.ndarray, node: np.ndarray, bit: np.ndarray, rows: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of nodes of one segment whose balls meet under one key, each at one of its meeting points only."""
    order = np.argsort(key, kind="stable")
    key, node, bit = key[order], node[order], bit[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(key)))
    begin, size = begin[size > 1], size[size > 1]
    # the row at place i of its run meets the i rows before it
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    n = at - np.repeat(begin, size)
    first = np.repeat(begin, size)
    at, n, first = at[n > 0], n[n > 0], first[n > 0]
    total = np.cumsum(n)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + rows, "right")))
        m = n[lo:hi]
        right = np.repeat(at[lo:hi], m)
        left = np.repeat(first[lo:hi] - np.cumsum(m) + m, m) + np.arange(m.sum())
        swap = node[left] > node[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        x, y = bit[left], bit[right]
        # no bit differs: at the own values; one does: where it is set; two do: where the lesser node has flipped the lesser one
        own = np.minimum(x, y)
        keep = np.where((x == _OWN) & (y == _OWN), True, np.where((x == _OWN) | (y == _OWN), (key[left] >> own.astype(np.uint64)) & np.uint64(1) == 1, x < y)) & (node[left] != node[right])
        yield node[left[keep]], node[right[keep]]
        lo = hi


def block_of(node: np.ndarray, blocks: int) -> np.ndarray:
    return (K.mix(node.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def cell_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the pair of blocks."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    return high * (high + 1) // 2 + low


_CELL = "cell int, a binary, b binary, f binary"


def _meet(blocks: int, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        width = 1
        for b in batches:
            for nodes, s, keys, who in zip(b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                w = unplanes(who, 3)
                width = len(keys.as_buffer()) // len(w)
                held.setdefault(s, []).append((unplanes(keys, width), unplanes(nodes, wide).view(np.int64)[(w >> np.uint64(6)).astype(np.int64)], (w & np.uint64(63)).astype(np.uint8)))
        for s in list(held):
            for a, b in meeting_pairs(*(np.concatenate(x) for x in zip(*held.pop(s), strict=True))):
                cell = cell_of(block_of(a, blocks), block_of(b, blocks))
                order = np.lexsort((b, a, cell))
                a, b, cell = a[order], b[order], cell[order]
                some, first = np.unique(cell, return_index=True)
                last = np.append(first[1:], len(cell))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([planes(x[i:j], wide) for i, j in zip(first, last, strict=True)], pa.binary()) for x in (a, b)), pa.nulls(len(some), pa.binary())], names=["cell", "a", "b", "f"])

    return run


def _spread(blocks: int, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fingerprints to all cells of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            node, *f = _numbers(big)
            block = block_of(node, blocks)
            for k in np.unique(block):
                at = np.flatnonzero(block == k)
                cells = np.unique(cell_of(np.full(blocks, k), np.arange(blocks)))
                a, raw = planes(node[at], wide), np.ascontiguousarray(np.stack(f, 1)[at]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array([a] * len(cells), pa.binary()), pa.nulls(len(cells), pa.binary()), pa.array([raw] * len(cells), pa.binary())], names=["cell", "a", "b", "f"])

    return run


def _verify(radius: int, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints, left, right = ([np.zeros(0, np.int64)], [np.zeros((0, LONGS), np.uint64)], [], [])
        for batch in batches:
            for a, b, f in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                if f.is_valid:
                    nodes.append(unplanes(a, wide).view(np.int64))
                    prints.append(np.frombuffer(f.as_buffer(), np.uint64).reshape(-1, LONGS))
                else:
                    left.append(unplanes(a, wide).view(np.int64))
                    right.append(unplanes(b, wide).view(np.int64))
        n, f = np.concatenate(nodes), np.concatenate(prints)
        order = np.argsort(n)
        n, f = n[order], f[order]
        found = []
        for a, b in zip(left, right, strict=True):
            for lo in range(0, len(a), 1 << 18):
                x, y = np.searchsorted(n, a[lo : lo + (1 << 18)]), np.searchsorted(n, b[lo : lo + (1 << 18)])
                d = np.bitwise_count(f[x] ^ f[y]).sum(1, dtype=np.int32)
                found.append(np.stack([x, y, d], 1)[d <= radius])
        if found:
            x, y, d = np.unique(np.concatenate(found), axis=0).T  # a pair may meet in several segments
            yield pa.RecordBatch.from_arrays([pa.array(n[x]), pa.array(n[y]), pa.array(d.astype(np.int32))], names=["a", "b", "distance"])

    return run


def near_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b, distance), a < b, of nodes (node, f0..) of different fingerprints, numbered from 0, that differ in at most radius bits: all of them, each once."""
    segments, width = layout(radius)
    f = nodes.select("node", *_FP)
    n, parts = f.count(), shuffle_partitions(nodes.sparkSession)
    wide = _width(n)
    buckets = max(-(-n * segments * (width + 1) // BUCKET), min(parts, -(-n // 512)), 1)
    blocks = max(-(-n // BLOCK), min(math.isqrt(parts) + 1, -(-n // 4096)), 1)
    balls = f.mapInArrow(_balls(segments, width, buckets, wide), "bucket int, nodes binary, segment int, keys binary, who binary")
    met = cut(balls.repartitionById(buckets, "bucket").mapInArrow(_meet(blocks, wide), _CELL), "met")
    return met.unionByName(f.mapInArrow(_spread(blocks, wide), _CELL)).repartitionById(blocks * (blocks + 1) // 2, "cell").mapInArrow(_verify(radius, wide), "a long, b long, distance int")


def _numbered(nodes: DataFrame) -> DataFrame:
    """node from 0 on without gaps, from a written table with Spark's monotonic ids: these hold the writing task and the row in it, and only the tasks' counts come to the driver."""
    task = F.shiftright("node", 33)
    counts = sorted(map(tuple, nodes.groupBy(task).count().collect()))
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    first = nodes.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(counts, before, strict=False)], "task long, first long")
    return nodes.join(F.broadcast(first), task == F.col("task")).withColumn("node", F.col("first") + F.col("node").bitwiseAND((1 << 33) - 1)).drop("task", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, group_size, n_links, keep) for every member of every group of two or more near-duplicates.

    Groups are the connected components of the near-duplicate pairs; group_id is the least id of the group and keep marks it; n_links counts the different texts within the radius of the document's own. Every pair within the radius is found. Rows with a null id or a null text belong to no group. Texts without words (also empty ones) are compared by their bytes. Rows that repeat an id count as one document each in group_size and fall into one group if their texts are near. Other columns are not looked at. An empty table gives no rows.
    """
    return _members(docs, id_col, text_col, radius).drop("text_hash", "root")


def _members(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS) -> DataFrame:
    """As near_duplicates, with the hash of the member's text, and the group's root: groups that hold the same id may have the same group_id."""
    prints = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("text_hash")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(_sign, "id long, text_hash long, " + ", ".join(f"{f} long" for f in _FP)), "prints")
    texts = prints.groupBy(*_FP, "text_hash").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    nodes = _numbered(cut(texts.groupBy(*_FP).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.count("*").alias("texts")).withColumn("node", F.monotonically_increasing_id()), "nodes"))
    links = cut(near_pairs(nodes, radius).select("a", "b"), "links")
    roots = components(links)
    both = links.union(links.select("b", "a"))
    degree = both.join(nodes.select(F.col("node").alias("b"), "texts"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("texts").alias("others"))
    # a node in no link matters only where exact copies, or texts of one fingerprint, share it
    placed = cut(nodes.join(degree, "node", "left").join(roots, "node", "left").where("n > 1 OR root IS NOT NULL").select(*_FP, "n", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("texts") - 1).alias("n_links")), "placed")
    groups = placed.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_size"))
    member = placed.join(groups, "root").select(*_FP, "root", "group_id", "group_size", "n_links")
    return prints.join(member, _FP).select(F.col("id").alias("doc_id"), "group_id", "group_size", "n_links", "text_hash", "root", (F.col("id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one document of each near-duplicate group: the one of least id; of rows of the group that repeat that id, one. Rows of that id whose own text isn't in the group stay, as do rows with a null id or text. No text is shuffled as long as the documents to drop are few enough to broadcast their ids."""
    rank = F.row_number().over(Window.partitionBy("root", "doc_id").orderBy("text_hash"))
    found = _members(docs, id_col, text_col, radius).groupBy("doc_id", "text_hash", "root", "keep").agg(F.count("*").alias("rows"))
    # of a text that stays, one row does: where it has several, they are looked at apart
    gone = cut(found.withColumn("stays", F.col("keep") & (rank == 1)).where("NOT stays OR rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), "stays"), "gone")
    same = lambda x: (F.col(id_col).cast("long") == x["__id"]) & (_text_hash(text_col) == x["__text"])
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x.hint("shuffle_hash")
    kept, again = small(gone), gone.where("stays")
    out = docs.join(kept, same(kept), "left_anti")
    if again.isEmpty():
        return out
    again = small(again)
    first = docs.join(again, same(again), "left_semi").select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("i"), _text_hash(text_col).alias("t")).groupBy("i", "t").agg(F.first("row").alias("row"))
    return out.unionByName(first.select("row.*"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
