"""Documents to typed cells, and what can be done to cells.

One Arrow pass makes lines (wrapping and hyphen merging are folds, and Unicode normalisation has no built-in); all that follows is built-in expressions, with shuffles by doc_id only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

READING = ("z", "y", "x")


@dataclass(frozen=True)
class Layout:
    page_width: int = 1024
    page_height: int = 1400
    line_height: int = 24
    line_gap: int = 6
    margin: int = 64

    @property
    def wrap_bytes(self) -> int:
        return max(self.page_width // 10, 40)


PRESETS = {"reports": Layout(), "slides": Layout(1920, 1080, 42, 12), "news": Layout(1100, 1600, 28, 8), "scans": Layout(1400, 2000, 30, 8)}


def wrap(line: str, width: int) -> list[str]:
    """A line that fits is trimmed only; else words are joined while they fit, a longer word standing alone."""
    if len(line.encode()) <= width:
        return [line.strip()]
    out, now, size = [], [], 0
    for word in line.split():
        n = len(word.encode())
        if now and size + n + 1 > width:
            out.append(" ".join(now))
            now, size = [], 0
        size += n + bool(now)
        now.append(word)
    return [*out, " ".join(now)] if now else out or [""]


def merge_hyphens(lines: list[str]) -> list[str]:
    out, carry = [], ""
    for line in lines:
        if carry:
            line = carry + line.lstrip()
        bare = line.rstrip()
        if bare.endswith("-") and len(bare) > 1:
            carry = bare.rstrip("-")
        else:
            out.append(line)
            carry = ""
    return [*out, carry] if carry else out


def normalise(line: str) -> str:
    if not line.isascii():
        line = unicodedata.normalize("NFKC", line)
    if not line.isprintable():
        line = "".join(c for c in line.strip("".join(map(chr, range(33)))) if unicodedata.category(c) != "Cc")
    return " ".join(line.split())


def page_lines(text: str, width: int, hyphens: bool = True) -> list[list[str]]:
    pages = []
    for page in text.split("\f"):
        raw = page.replace("\r\n", "\n").split("\n")
        wrapped = [part for line in (raw[:-1] if len(raw) > 1 and raw[-1] == "" else raw) for part in wrap(line, width)]
        pages.append([x for x in map(normalise, merge_hyphens(wrapped) if hyphens else wrapped) if x])
    return pages


def _lines(width: int, hyphens: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                at, z, i, out = [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for page, held in enumerate(page_lines(text, width, hyphens)):
                        at += [row] * len(held)
                        z += [page] * len(held)
                        i += range(len(held))
                        out += held
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(z, pa.int32()), pa.array(i, pa.int32()), pa.array(out, pa.string())], names=["doc_id", "z", "line", "text"])

    return run


def lines(docs: DataFrame, layout: Layout = PRESETS["reports"], hyphens: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z, line, text): the non-empty normalised lines of each page. Null texts have none; an empty table gives no rows; other columns aren't read."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_lines(layout.wrap_bytes, hyphens), f"doc_id {kind}, z int, line int, text string")


def cells(docs: DataFrame, layout: Layout = PRESETS["reports"], hyphens: bool = True, **tuning: float) -> DataFrame:
    """(doc_id, z, x, y, w, h, code_id, cell_type, importance, text), a cell for each line; no shuffle."""
    found = lines(docs, layout, hyphens).withColumn("cell_type", T.cell_type(F.col("text")))
    step = layout.line_height + layout.line_gap
    return found.select("doc_id", "z", F.lit(layout.margin).alias("x"), (F.lit(layout.margin) + F.col("line") * step).alias("y"), F.lit(max(layout.page_width - 2 * layout.margin, 0)).alias("w"), F.lit(layout.line_height).alias("h"), T.payload_hash(F.col("text")).alias("code_id"), "cell_type", T.importance(F.col("text"), F.col("cell_type"), F.col("line"), **tuning).alias("importance"), "text")


def dictionary(found: DataFrame) -> DataFrame:
    """(doc_id, code_id, payload): each payload once a document."""
    return found.groupBy("doc_id", "code_id").agg(F.first("text").alias("payload"))


def resolve(found: DataFrame, payloads: DataFrame, missing: str = "<missing>") -> DataFrame:
    """Cells without text, joined with their payloads."""
    return found.join(payloads, ["doc_id", "code_id"], "left").withColumn("text", F.coalesce("payload", F.lit(missing))).drop("payload")


def prune(payloads: DataFrame, found: DataFrame) -> DataFrame:
    """Payloads that cells still use."""
    return payloads.join(found.select("doc_id", "code_id"), ["doc_id", "code_id"], "left_semi")


def budget(found: DataFrame, n: int) -> DataFrame:
    """Each document's n most important cells, ties in reading order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("importance"), *READING)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def drop_footers(found: DataFrame) -> DataFrame:
    return found.where("cell_type <> 'FOOTER'")


def _apart(pages: int, at: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by (document, payload, reading order), those more than `pages` pages after the last kept one of their payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, kept = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, code, z = (batch.column(i) for i in at)
            same = np.zeros(batch.num_rows, bool)
            for c in (doc, code):
                equal = pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
                same[1:] = equal if c is doc else same[1:] & equal
            same[0] = before == (doc[0].as_py(), code[0].as_py())
            places, keep = z.to_numpy(zero_copy_only=False), ~same
            for i in np.flatnonzero(same):
                if i and not same[i - 1]:
                    kept = places[i - 1]
                if places[i] - kept > pages:
                    keep[i], kept = True, places[i]
            if not same[-1]:
                kept = places[-1]
            before = doc[-1].as_py(), code[-1].as_py()
            yield batch.filter(pa.array(keep))

    return run


def dedup_window(found: DataFrame, pages: int) -> DataFrame:
    """A cell goes where a kept one of the same payload lies at most `pages` pages before; pages = 0 keeps all.

    One pass over cells sorted by document, payload and place: only the last kept page matters.
    """
    if pages <= 0:
        return found
    at = tuple(found.columns.index(c) for c in ("doc_id", "code_id", "z"))
    return found.repartition("doc_id", "code_id").sortWithinPartitions("doc_id", "code_id", *READING).mapInArrow(_apart(pages, at), found.schema)


def run_lengths(found: DataFrame) -> DataFrame:
    """rle: at the first cell of a run of equal payloads how many follow it, else 0."""
    w = Window.partitionBy("doc_id").orderBy(*READING)
    island = F.sum(F.when(F.lag("code_id").over(w) == F.col("code_id"), 0).otherwise(1)).over(w)
    run = Window.partitionBy("doc_id", "__island")
    first = F.row_number().over(run.orderBy(*READING)) == 1
    return found.withColumn("__island", island).withColumn("rle", F.when(first, F.count("*").over(run) - 1).otherwise(0).cast("int")).drop("__island")


def deltas(found: DataFrame) -> DataFrame:
    """dz, dx, dy to the cell before in reading order; of the first to 0."""
    w = Window.partitionBy("doc_id").orderBy(*READING)
    return found.select("doc_id", "code_id", *((F.col(c) - F.lag(c, 1, 0).over(w)).alias(f"d{c}") for c in "zxy"), F.row_number().over(w).alias("ordinal"))


def from_deltas(coded: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return coded.select("doc_id", "ordinal", "code_id", *(F.sum(f"d{c}").over(w).cast("int").alias(c) for c in "zxy"))


def number_guards(found: DataFrame) -> DataFrame:
    """(doc_id, z, x, y, units, sha1), a row for each number in a cell."""
    return found.select("doc_id", "z", "x", "y", F.explode(T.guards(F.col("text"))).alias("g")).select("doc_id", "z", "x", "y", F.col("g.units").alias("units"), F.sha1("g.digits").alias("sha1"))


def verify_guards(guards: DataFrame, found: DataFrame, units: list[str] | None = None) -> DataFrame:
    """guards with `issue`: UnitNotAllowed, MissingCell, MissingPayload, HashMismatch or null. A guard is held against all digits of the first cell at its place."""
    at = found.groupBy("doc_id", "z", F.greatest("x", F.lit(0)).alias("x"), F.greatest("y", F.lit(0)).alias("y")).agg(F.min_by("text", "code_id").alias("__text"), F.lit(True).alias("__there"))
    digits = F.regexp_replace("__text", "[^0-9]", "")
    allowed = F.lit(True) if units is None else (F.col("units") == "") | F.col("units").isin([u.lower() for u in units])
    issue = F.when(~allowed, "UnitNotAllowed").when(F.col("__there").isNull() | F.col("__text").isNull(), "MissingCell").when(digits == "", "MissingPayload").when(F.sha1(digits) != F.col("sha1"), "HashMismatch")
    return guards.join(at, ["doc_id", "z", "x", "y"], "left").withColumn("issue", issue).drop("__text", "__there")


def alert_summary(alerts: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, alerts, summary): the first n issues of each document as issue@z{page}:{unit}."""
    w = Window.partitionBy("doc_id").orderBy("z", "y", "x", "units", "sha1")
    said = F.concat(F.col("issue"), F.lit("@z"), F.col("z").cast("string"), F.lit(":"), F.col("units"))
    ranked = alerts.where("issue IS NOT NULL").withColumn("n", F.row_number().over(w)).withColumn("s", said)
    return ranked.groupBy("doc_id").agg(F.count("*").alias("alerts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= n, F.struct("n", "s")))), lambda x: x["s"]), ", ").alias("summary"))


def select_box(found: DataFrame, z: int, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Cells of a page whose box overlaps another, edges included; ends may be given in either order."""
    (x0, x1), (y0, y1) = sorted(x), sorted(y)
    return found.where((F.col("z") == z) & (F.col("x") <= x1) & (F.col("x") + F.col("w") >= x0) & (F.col("y") <= y1) & (F.col("y") + F.col("h") >= y0))


def parse_selector(selector: str) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """'z=0,x=0..1024,y=0..4096'; a single number is a range of one; all three are needed."""
    held = {}
    for part in selector.split(","):
        key, _, value = part.strip().partition("=")
        ends = [int(v) for v in value.split("..")]
        if key not in ("x", "y", "z") or len(ends) > 2:
            raise ValueError(f"bad selector part {part!r}")
        held[key] = (ends[0], ends[-1])
    if set(held) != {"x", "y", "z"}:
        raise ValueError("a selector needs z, x and y")
    return held["z"][0], held["x"], held["y"]


def ordered_text(column: str | Column = "text", by: tuple[str, ...] = READING, sep: str = "\n") -> Column:
    held = F.array_sort(F.collect_list(F.struct(*by, (F.col(column) if isinstance(column, str) else column).alias("__t"))))
    return F.array_join(F.transform(held, lambda c: c["__t"]), sep)


def decode(found: DataFrame) -> DataFrame:
    """(doc_id, text): the cells' texts in reading order."""
    return found.groupBy("doc_id").agg(ordered_text().alias("text"))


def context_line(limit: int = 96) -> Column:
    shown = F.when(F.col("text").isNull(), "<missing>").when(F.col("cell_type") == "TABLE", T.table_preview(F.col("text"), limit)).otherwise(T.preview(F.col("text"), limit))
    return F.format_string('(z=%d,x=%d,y=%d,w=%d,h=%d,code=%s,rle=%d,imp=%d,type=%s) "%s"', "z", "x", "y", "w", "h", F.substring("code_id", 1, 16), "rle", "importance", "cell_type", T.escape_quotes(shown))


GRAMMAR = '\ngrammar: --select "z=0,x=0..1024,y=0..4096"\n'


def serialise(found: DataFrame, preset: str = "reports", label: str = "auto", limit: int = 96, grammar: bool = False) -> DataFrame:
    """(doc_id, context): header, a line for each cell with its rle, the grammar line if wanted, footer."""
    body = found.withColumn("__line", context_line(limit)).groupBy("doc_id").agg(ordered_text("__line").alias("body"))
    return body.select("doc_id", F.concat(F.lit(f"<ctx3d grid=coarse codeset=HASH256 preset={preset} budget={label}>\n"), "body", F.lit("\n" + GRAMMAR * grammar + "</ctx3d>\n")).alias("context"))


def manifest(found: DataFrame, limit: int = 96) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*READING)
    return found.select("doc_id", (F.row_number().over(w) - 1).alias("cell_index"), F.col("code_id").alias("code_hash"), "z", "x", "y", "w", "h", "importance", "cell_type", "text", T.preview(F.col("text"), limit).alias("preview"))


def redact(found: DataFrame, keep: list[str], limit: int = 96) -> DataFrame:
    """Texts of other types than keep are replaced, in the preview as well; an empty keep keeps all."""
    kept = F.lit(True) if not keep else F.col("cell_type").isin([k.upper() for k in keep])
    return found.withColumn("text", F.when(kept, F.col("text")).otherwise("<redacted>")).withColumn("preview", T.preview(F.col("text"), limit))


def encode_metrics(found: DataFrame, kept: DataFrame, guards: DataFrame) -> DataFrame:
    """A row for each document: pages with cells, cells before and after selection, guards, payload repetition, words."""
    before = found.groupBy("doc_id").agg((F.max("z") + 1).alias("pages"), F.count("*").alias("cells_total"), F.countDistinct("code_id").alias("payloads"), F.sum(T.word_count(F.col("text"))).alias("tokens"))
    after = kept.groupBy("doc_id").agg(F.count("*").alias("cells_kept"))
    g = guards.groupBy("doc_id").agg(F.count("*").alias("numguard_count"))
    out = before.join(after, "doc_id", "left").join(g, "doc_id", "left")
    return out.select("doc_id", "pages", F.col("cells_total").alias("lines_total"), "cells_total", F.coalesce("cells_kept", F.lit(0)).alias("cells_kept"), F.coalesce("numguard_count", F.lit(0)).alias("numguard_count"), F.round(F.col("cells_total") / F.col("payloads"), 6).alias("dedup_ratio"), "tokens")


def encode_summary(found: DataFrame, n: int) -> DataFrame:
    """encode_metrics() of cells cut to the n most important and then rid of footers, in one pass: cells are ranked once, and kept ones and numbers are counted beside the others."""
    # texts are counted where the cells are made: they aren't shuffled or sorted
    counted = found.select("doc_id", *READING, "importance", "cell_type", "code_id", T.word_count(F.col("text")).alias("words"), F.coalesce(F.regexp_count(F.lower("text"), F.lit(T.GUARD)), F.lit(0)).alias("numbers"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("importance"), *READING)))
    kept = (F.col("rank") <= n) & (F.col("cell_type") != "FOOTER")
    out = ranked.groupBy("doc_id").agg((F.max("z") + 1).alias("pages"), F.count("*").alias("cells_total"), F.count_if(kept).alias("cells_kept"), F.sum("numbers").alias("numguard_count"), F.countDistinct("code_id").alias("payloads"), F.sum("words").alias("tokens"))
    return out.select("doc_id", "pages", F.col("cells_total").alias("lines_total"), "cells_total", "cells_kept", "numguard_count", F.round(F.col("cells_total") / F.col("payloads"), 6).alias("dedup_ratio"), "tokens")


def index(found: DataFrame) -> DataFrame:
    """The cells as index records: ids by ordinal, importance from 0 to 1, boxes as corners."""
    w = Window.partitionBy("doc_id").orderBy(*READING)
    doc = F.col("doc_id").cast("string")
    cell = F.row_number().over(w)
    kind = F.when(F.col("cell_type") == "HEADER", "heading").otherwise(F.lower("cell_type"))
    return found.select(F.format_string("doc_%s_cell_%06d", doc, cell).alias("cell_id"), F.concat(F.lit("doc_"), doc).alias("doc_id"), F.format_string("doc_%s_page_%04d", doc, F.col("z") + 1).alias("page_id"), kind.alias("kind"), "text", (F.col("importance") / 255).cast("float").alias("importance"), F.array(*(c.cast("float") for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))).alias("bbox"), cell.alias("ordinal"))
