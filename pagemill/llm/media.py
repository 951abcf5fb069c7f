"""Media columns: what ISO media containers say about their tracks, read from the boxes without touching payloads.

A container is a sequence of boxes (size, type, body), some of which hold boxes. walk() reads box headers only and steps over what it doesn't need, `mdat` above all. From a track's sample tables, and from the track runs of its fragments, come the times, sizes and file offsets of its samples, hence duration, keyframes and their byte ranges. No count is believed that the box or the file has no bytes for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.store import table

_HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}
_ATOMS = {b"mvhd", b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"}
DEEPEST = 32  # boxes within boxes
KEYFRAME = np.dtype([("sample", np.int32), ("time_s", np.float64), ("begin", np.int64), ("end", np.int64)])


class Malformed(ValueError):
    pass


def walk(data: memoryview, lo: int, hi: int) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, begin of the box, begin and end of its body) for each box within data[lo:hi], holders before what they hold."""
    open_ = [((), lo, hi)]
    while open_:
        path, lo, hi = open_.pop()
        if lo >= hi:
            continue
        if hi - lo < 8:
            raise Malformed(f"{hi - lo} bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise Malformed("a long box without its size")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo  # to the end
        if kind == b"uuid":
            head += 16
        if size < head or lo + size > hi:
            raise Malformed(f"box {kind.decode('latin-1')} of {size} bytes doesn't fit")
        yield (*path, kind), lo, lo + head, lo + size
        open_.append((path, lo + size, hi))
        if kind in _HOLDERS:
            if len(path) >= DEEPEST:
                raise Malformed(f"boxes nested {DEEPEST} deep")
            open_.append(((*path, kind), lo + head, lo + size))


def _array(data: memoryview, lo: int, hi: int, count: int, width: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if count * width * size > hi - lo:
        raise Malformed("a table is longer than its box")
    return np.frombuffer(data, kind, count * width, lo).reshape(count, width).astype(np.int64)


def _table(data: memoryview, box: tuple[int, int], width: int, kind: str = ">u4") -> np.ndarray:
    lo, hi = box
    if hi - lo < 8:
        raise Malformed("a table without its count")
    return _array(data, lo + 8, hi, struct.unpack_from(">I", data, lo + 4)[0], width, kind)


def _times(data: memoryview, box: tuple[int, int]) -> tuple[int, int]:
    """(timescale, duration) of mvhd or mdhd."""
    lo, hi = box
    try:
        return struct.unpack_from(">IQ", data, lo + 20) if data[lo] == 1 else struct.unpack_from(">II", data, lo + 12)
    except (struct.error, IndexError):
        raise Malformed("a header that is cut short") from None


def samples(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(decode time, size, offset, whether a keyframe) of a track's samples, from its tables."""
    if b"stz2" in boxes:
        lo, hi = boxes[b"stz2"]
        field, n = data[lo + 7], struct.unpack_from(">I", data, lo + 8)[0]
        if field == 4:
            raw = _array(data, lo + 12, hi, (n + 1) // 2, 1, "u1")[:, 0]
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        elif field in (8, 16):
            sizes = _array(data, lo + 12, hi, n, 1, f">u{field // 8}")[:, 0]
        else:
            raise Malformed(f"sample sizes of {field} bits")
    elif b"stsz" in boxes:
        lo, hi = boxes[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, lo + 4)
        if fixed and fixed * n > len(data):
            raise Malformed("samples of more bytes than the file has")
        sizes = np.full(n, fixed, np.int64) if fixed else _array(data, lo + 12, hi, n, 1, ">u4")[:, 0]
    else:
        sizes = np.zeros(0, np.int64)
    n = len(sizes)
    steps = _table(data, boxes[b"stts"], 2) if b"stts" in boxes else np.zeros((0, 2), np.int64)
    if steps[:, 0].sum() != n and (n or len(steps)):
        raise Malformed("stts and stsz disagree on the number of samples")
    deltas = np.repeat(steps[:, 1], steps[:, 0])
    times = np.cumsum(deltas) - deltas
    chunks = _table(data, boxes[b"co64"], 1, ">u8")[:, 0] if b"co64" in boxes else _table(data, boxes[b"stco"], 1)[:, 0] if b"stco" in boxes else np.zeros(0, np.int64)
    runs = _table(data, boxes[b"stsc"], 3) if b"stsc" in boxes else np.zeros((0, 3), np.int64)
    if n and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise Malformed("stsc doesn't cover the chunks")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if n else np.zeros(0, np.int64)
    if per_chunk.sum() != n:
        raise Malformed("stsc and stsz disagree on the number of samples")
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks[: len(per_chunk)] - (before[first] if n else 0), per_chunk) + before if n else np.zeros(0, np.int64)
    key = np.ones(n, bool)
    if b"stss" in boxes:
        at = _table(data, boxes[b"stss"], 1)[:, 0] - 1
        if len(at) and (at.min() < 0 or at.max() >= n):
            raise Malformed("stss names a sample that isn't there")
        key[:] = False
        key[at] = True
    return times, sizes, offsets, key


def _field(data: memoryview, at: int, hi: int, kind: str) -> int:
    if at + struct.calcsize(kind) > hi:
        raise Malformed("a box that is cut short")
    return struct.unpack_from(kind, data, at)[0]


def _track_id(data: memoryview, box: tuple[int, int]) -> int:
    return _field(data, box[0] + (20 if data[box[0]] == 1 else 12), box[1], ">I")


class Fragments:
    """Samples of track runs, by track."""

    def __init__(self, data: memoryview):
        self.data, self.defaults, self.runs, self.clock, self.end = data, {}, {}, {}, 0
        self.moof, self.first, self.track, self.base = 0, True, 0, None

    def box(self, kind: bytes, begin: int, lo: int, hi: int) -> None:
        data = self.data
        if kind == b"trex":
            self.defaults[_field(data, lo + 4, hi, ">I")] = tuple(_field(data, lo + 12 + 4 * i, hi, ">I") for i in range(3))
        elif kind == b"moof":
            self.moof, self.first = begin, True
        elif kind == b"traf":
            self.base = None
        elif kind == b"tfhd":
            flags = _field(data, lo, hi, ">I") & 0xFFFFFF
            self.track = _field(data, lo + 4, hi, ">I")
            at = lo + 8
            base = self.moof if flags & 0x20000 or self.first else self.end
            if flags & 0x1:
                base, at = _field(data, at, hi, ">Q"), at + 8
            at += 4 * bool(flags & 0x2)
            own = list(self.defaults.get(self.track, (0, 0, 0)))
            for i, bit in enumerate((0x8, 0x10, 0x20)):
                if flags & bit:
                    own[i], at = _field(data, at, hi, ">I"), at + 4
            self.base, self.end, self.own, self.first = base, base, own, False
        elif kind in (b"tfdt", b"trun") and self.base is None:
            raise Malformed("a track run without its header")
        elif kind == b"tfdt":
            self.clock[self.track] = _field(data, lo + 4, hi, ">Q" if data[lo] == 1 else ">I")
        elif kind == b"trun":
            self._run(lo, hi)

    def _run(self, lo: int, hi: int) -> None:
        data, flags, n = self.data, _field(self.data, lo, hi, ">I") & 0xFFFFFF, _field(self.data, lo + 4, hi, ">I")
        at, first = lo + 8, None
        if flags & 0x1:
            self.end, at = self.base + _field(data, at, hi, ">i"), at + 4
        if flags & 0x4:
            first, at = _field(data, at, hi, ">I"), at + 4
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if n * max(1, self.own[1] if 0x200 not in columns else 1) > len(data):
            raise Malformed("samples of more bytes than the file has")
        held = dict(zip(columns, _array(data, at, hi, n, len(columns), ">u4").T, strict=True)) if columns else {}
        take = lambda bit, i: held.get(bit, np.full(n, self.own[i], np.int64))
        delta, sizes, marks = take(0x100, 0), take(0x200, 1), take(0x400, 2)
        if first is not None and n:
            marks = np.append(first, marks[1:])
        begin = self.clock.get(self.track, 0)
        before = np.cumsum(sizes) - sizes
        self.runs.setdefault(self.track, []).append((begin + np.cumsum(delta) - delta, sizes, self.end + before, marks & 0x10000 == 0))
        self.clock[self.track] = begin + int(delta.sum())
        self.end += int(sizes.sum())


def tracks(raw: bytes) -> list[dict]:
    """The container's tracks, in file order; keyframes are a table of type KEYFRAME."""
    data, out, boxes, movie = memoryview(raw), [], {}, (0, 0)
    fragments = Fragments(data)
    for path, begin, lo, hi in walk(data, 0, len(data)):
        if path[-1] == b"trak":
            boxes = {}
            out.append(boxes)
        elif path[-1] == b"mvhd":
            movie = _times(data, (lo, hi))
        elif path[-1] in _ATOMS and out and b"trak" in path:
            boxes[path[-1]] = (lo, hi)
        elif path[-1] == b"moof" or b"moof" in path or path[-1] == b"trex":
            fragments.box(path[-1], begin, lo, hi)
    found = []
    for i, b in enumerate(out):
        scale, duration = _times(data, b[b"mdhd"]) if b"mdhd" in b else movie
        times, sizes, offsets, key = samples(data, b)
        number = _track_id(data, b[b"tkhd"]) if b"tkhd" in b else i + 1
        if runs := fragments.runs.get(number):
            times, sizes, offsets, key = (np.concatenate([x, *y]) for x, y in zip((times, sizes, offsets, key), zip(*runs, strict=True), strict=True))
            duration = max(duration, fragments.clock[number])
        lo, hi = b.get(b"stsd", (0, 0))
        codec = bytes(data[lo + 12 : lo + 16]).decode("latin-1") if hi - lo >= 16 else None
        lo, hi = b.get(b"hdlr", (0, 0))
        handler = bytes(data[lo + 8 : lo + 12]).decode("latin-1") if hi - lo >= 12 else None
        at = np.flatnonzero(key)
        ranges = np.empty(len(at), KEYFRAME)
        ranges["sample"], ranges["begin"], ranges["end"] = at + 1, offsets[at], offsets[at] + sizes[at]
        ranges["time_s"] = times[at] / scale if scale else np.nan
        found.append({"track": i + 1, "handler": handler, "codec": codec, "timescale": int(scale), "duration_s": duration / scale if scale else None, "n_samples": len(sizes), "sample_bytes": int(sizes.sum()), "keyframes": ranges})
    return found


_RANGE = pa.struct([("sample", pa.int32()), ("time_s", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())])
_FIELDS = [("track", pa.int32(), "int"), ("handler", pa.string(), "string"), ("codec", pa.string(), "string"), ("timescale", pa.int64(), "long"), ("duration_s", pa.float64(), "double"), ("n_samples", pa.int32(), "int"), ("sample_bytes", pa.int64(), "long"), ("keyframes", pa.list_(_RANGE), "array<struct<sample:int,time_s:double,begin:long,end:long>>")]


def _lists(tables: list[np.ndarray | None]) -> pa.Array:
    """A list array of keyframe tables."""
    held = np.concatenate([x for x in tables if x is not None] or [np.empty(0, KEYFRAME)])
    ends = np.append(0, np.cumsum([0 if x is None else len(x) for x in tables]))
    where = pa.array([None if x is None else int(e) for x, e in zip(tables, ends, strict=False)] + [int(ends[-1])], pa.int32())
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(held[f.name]), f.type, from_pandas=True) for f in _RANGE], fields=list(_RANGE))
    return pa.ListArray.from_arrays(where, flat, type=pa.list_(_RANGE))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 512):
            batch = big.slice(lo, 512)
            source, rows, status = [], [], []
            for i, raw in enumerate(batch.column(1)):
                try:
                    found = [] if not raw.is_valid else tracks(raw.as_buffer())
                    said = "null" if not raw.is_valid else "ok" if found else "no tracks"
                except (Malformed, struct.error, IndexError, ValueError, OverflowError) as e:
                    found, said = [], f"malformed: {e}"
                rows += found or [{}]
                status += [said] * max(1, len(found))
                source += [i] * max(1, len(found))
            ids = batch.column(0).take(pa.array(source, pa.int32()))
            columns = [_lists([r.get(k) for r in rows]) if k == "keyframes" else pa.array([r.get(k) for r in rows], t) for k, t, _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([ids, pa.array(status, pa.string()), *columns], names=["id", "status", *(k for k, *_ in _FIELDS)])


def media_columns(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, status, track, handler, codec, timescale, duration_s, n_samples, sample_bytes, keyframes), a row for each track.

    keyframes: sample number from 1, decode time (edit lists and composition offsets are not applied), and byte range [begin, end) in the container, in file order; a track without a sync table has every sample as one. Samples of movie fragments follow those of the sample tables. Counts that exceed what the box or the file could hold, and boxes nested over 32 deep, are malformed. A null container, one without tracks (also an empty one) and a malformed one have a row with status 'null', 'no tracks' or 'malformed: why' and null columns. Ids, also null or repeated ones, are passed on; other columns are not looked at; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(_parse, f"id {kind}, status string, " + ", ".join(f"{k} {t}" for k, _, t in _FIELDS))


def _box(kind: bytes, *body: bytes) -> bytes:
    inside = b"".join(body)
    return struct.pack(">I4s", len(inside) + 8, kind) + inside


def mux(payload: bytes, codec: bytes = b"avc1", sample: int = 1000, group: int = 5, per_chunk: int = 3, timescale: int = 12800, delta: int = 512) -> bytes:
    """A container of one video track whose payload is cut into samples of the given bytes, every group-th a keyframe."""
    sizes = [len(payload[i : i + sample]) for i in range(0, len(payload), sample)]
    n, full = len(sizes), b"\0\0\0\0"
    table = lambda kind, rows: _box(kind, full, struct.pack(">I", len(rows)), *(struct.pack(f">{len(r)}I", *r) for r in rows))
    chunks, rest = divmod(n, per_chunk)
    runs = [(1, per_chunk, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)

    def moov(base: int) -> bytes:
        offsets = [(base + i * per_chunk * sample,) for i in range(chunks + bool(rest))]
        entry = _box(codec, b"\0" * 6, struct.pack(">H", 1), b"\0" * 70)
        stbl = _box(b"stbl", _box(b"stsd", full, struct.pack(">I", 1), entry), table(b"stts", [(n, delta)] * bool(n)), table(b"stss", [(i + 1,) for i in range(0, n, group)]), table(b"stsc", runs), _box(b"stsz", full, struct.pack(f">II{n}I", 0, n, *sizes)), table(b"stco", offsets))
        mdhd = _box(b"mdhd", full, struct.pack(">IIIIHH", 0, 0, timescale, n * delta, 0, 0))
        hdlr = _box(b"hdlr", full, full, b"vide", b"\0" * 13)
        return _box(b"moov", _box(b"mvhd", full, struct.pack(">IIII", 0, 0, 1000, n * delta * 1000 // timescale), b"\0" * 80), _box(b"trak", _box(b"mdia", mdhd, hdlr, _box(b"minf", stbl))))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    base = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(base) + _box(b"mdat", payload)


def _mux_all(codecs: tuple[bytes, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                ids = batch.column(0).to_pylist()
                made = [None if x is None else mux(x, codecs[(i or 0) % len(codecs)]) for i, x in zip(ids, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "content"])

    return run


def as_containers(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, content): each row's bytes muxed into a container, for tables that hold no media of their own."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(_mux_all((b"avc1", b"hvc1", b"av01")), "id long, content binary")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media: every page's bytes are muxed into a container, and those are read."""
    found = media_columns(as_containers(table(spark, sf_dir, "pages"), "page_id", "html"), "id", "content")
    return found.select(F.col("id").alias("page_id"), "status", "track", "handler", "codec", "timescale", F.round("duration_s", 6).alias("duration_s"), "n_samples", "sample_bytes", F.array_join(F.transform("keyframes", lambda k: F.concat_ws(":", k["sample"], k["begin"], k["end"])), ",").alias("keyframes"))


#: What the sizes of the muxed boxes make of each page: the boxes before the payload take 431 bytes and 4 for every sample, chunk and keyframe, 8 for stts's row and 12 for each of stsc's.
_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS b FROM pages WHERE html IS NOT NULL),
n AS (SELECT page_id, b, CAST(ceil(b / 1000.0) AS INT) AS n FROM p),
h AS (SELECT *, 431 + 4 * n + 4 * CAST(ceil(n / 3.0) AS INT) + 4 * CAST(ceil(n / 5.0) AS INT) + CASE WHEN n > 0 THEN 8 ELSE 0 END + CASE WHEN n >= 3 THEN 12 ELSE 0 END + CASE WHEN n % 3 > 0 THEN 12 ELSE 0 END AS base FROM n)
SELECT page_id, 'ok' AS status, 1 AS track, 'vide' AS handler, CASE page_id % 3 WHEN 0 THEN 'avc1' WHEN 1 THEN 'hvc1' ELSE 'av01' END AS codec, CAST(12800 AS BIGINT) AS timescale, round(n * 512 / 12800.0, 6) AS duration_s, n AS n_samples, b AS sample_bytes,
array_to_string(list_transform(range(0, n, 5), lambda i: concat(i + 1, ':', base + i * 1000, ':', base + least((i + 1) * 1000, b))), ',') AS keyframes FROM h
UNION ALL SELECT page_id, 'null', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages WHERE html IS NULL"""

QUERIES = {"op10_media_columns": op10_media_columns}
ORACLE_SQL = {"op10_media_columns": _SQL}
