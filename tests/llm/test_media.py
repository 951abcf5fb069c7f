import random
import struct

import pytest

from pagemill.llm import media
from pagemill.llm.media import _box

FULL = b"\0\0\0\0"


def fragmented(payloads, default_size=None, base_is_moof=True, version=0):
    """One track whose samples lie in one fragment for each list of payloads; the first of each is a keyframe."""
    tkhd = _box(b"tkhd", FULL, struct.pack(">III", 0, 0, 7), b"\0" * 68)
    mdhd = _box(b"mdhd", FULL, struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))
    hdlr = _box(b"hdlr", FULL, FULL, b"vide", b"\0" * 13)
    empty = lambda kind: _box(kind, FULL, struct.pack(">I", 0))
    stbl = _box(b"stbl", _box(b"stsd", FULL, struct.pack(">I", 1), _box(b"avc1", b"\0" * 78)), empty(b"stts"), empty(b"stsc"), _box(b"stsz", FULL, struct.pack(">II", 0, 0)), empty(b"stco"))
    trex = _box(b"trex", FULL, struct.pack(">IIIII", 7, 1, 40, default_size or 0, 0x10000))
    out = _box(b"ftyp", b"isom") + _box(b"moov", _box(b"mvhd", FULL, struct.pack(">IIII", 0, 0, 1000, 0), b"\0" * 80), _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, _box(b"minf", stbl))), _box(b"mvex", trex))
    clock = 0
    for samples in payloads:
        flags = 0x1 | 0x4 | (0 if default_size else 0x200)

        def moof(offset, clock=clock, samples=samples, flags=flags):
            sizes = b"" if default_size else b"".join(struct.pack(">I", len(s)) for s in samples)
            trun = _box(b"trun", struct.pack(">IIiI", flags, len(samples), offset, 0), sizes)
            tfdt = _box(b"tfdt", struct.pack(">IQ", 1 << 24, clock) if version else struct.pack(">II", 0, clock))
            return _box(b"moof", _box(b"mfhd", FULL, FULL), _box(b"traf", _box(b"tfhd", struct.pack(">II", 0x20000 if base_is_moof else 0, 7)), tfdt, trun))

        out += moof(len(moof(0)) + 8) + _box(b"mdat", *samples)
        clock += 40 * len(samples)
    return out


@pytest.mark.parametrize("options", [{}, {"version": 1}, {"base_is_moof": False}, {"default_size": 5}])
def test_fragments(options):
    payloads = [[b"aaaaa", b"bbbbb", b"ccccc"], [b"ddddd"], [b"eeeee", b"fffff"]]
    raw = fragmented(payloads, **options)
    (track,) = media.tracks(raw)
    assert track["n_samples"] == 6 and track["sample_bytes"] == 30 and track["duration_s"] == pytest.approx(0.24) and track["codec"] == "avc1"
    assert [raw[k["begin"] : k["end"]] for k in track["keyframes"]] == [b"aaaaa", b"ddddd", b"eeeee"]
    assert [(k["sample"], round(k["time_s"], 3)) for k in track["keyframes"]] == [(1, 0), (4, 0.12), (5, 0.16)]


def container(**atoms):
    return _box(b"moov", _box(b"mvhd", FULL, b"\0" * 16, b"\0" * 80), _box(b"trak", _box(b"mdia", _box(b"minf", _box(b"stbl", *(_box(k.encode(), FULL, v) for k, v in atoms.items()))))))


HUGE = 2**32 - 1


@pytest.mark.parametrize(
    "raw",
    [
        container(stsz=struct.pack(">II", 1, HUGE)),
        container(stsz=struct.pack(">II", 0, HUGE)),
        container(stsz=struct.pack(">II", 0, 0), stts=struct.pack(">III", 1, HUGE, 1)),
        container(stsz=struct.pack(">III", 0, 1, 9), stts=struct.pack(">III", 1, 1, 1), stsc=struct.pack(">IIII", 1, 1, HUGE, 1), stco=struct.pack(">II", 1, 0)),
        container(stz2=struct.pack(">II", 4, HUGE)),
        container(stz2=struct.pack(">II", 3, 1)),
        container(stsz=b"\0"),
        fragmented([[b"x"]]).replace(struct.pack(">IIiI", 0x205, 1, 100, 0), struct.pack(">IIiI", 0x5, HUGE, 100, 0)),
    ],
)
def test_counts_without_bytes_are_malformed(raw):
    with pytest.raises((media.Malformed, struct.error)):
        media.tracks(raw)


def test_deep_nesting_and_random_bytes():
    deep = b""
    for _ in range(2000):
        deep = _box(b"moov", deep)
    with pytest.raises(media.Malformed):
        media.tracks(deep)
    rng, raw = random.Random(4), media.mux(bytes(3000)) + fragmented([[b"aaaaa"], [b"b"]])
    for _ in range(3000):
        bad = bytearray(raw)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.choice((0, 1, 255, rng.randrange(256)))
        try:
            media.tracks(bytes(bad[: rng.randrange(len(bad))] if rng.random() < 0.3 else bad))
        except (media.Malformed, struct.error, IndexError, ValueError, OverflowError):
            pass


def test_odd_rows(spark):
    raw = media.mux(b"x" * 2500)
    rows = [(1, raw), (1, raw), (None, raw), (2, None), (3, b""), (4, container(stsz=struct.pack(">II", 1, HUGE))), (5, fragmented([[b"aaaaa", b"b"]])), (6, container())]
    docs = spark.createDataFrame([(i, x, "s", "t") for i, x in rows], "id long, content binary, status string, track string")
    got = media.media_columns(docs, "id", "content").collect()
    said = sorted((str(r["id"]), r["status"].split(":")[0], r["n_samples"], None if r["keyframes"] is None else len(r["keyframes"])) for r in got)
    assert said == sorted([("1", "ok", 3, 1)] * 2 + [("None", "ok", 3, 1), ("2", "null", None, None), ("3", "no tracks", None, None), ("4", "malformed", None, None), ("5", "ok", 2, 1), ("6", "ok", 0, 0)])
    assert media.media_columns(docs.limit(0), "id", "content").count() == 0
