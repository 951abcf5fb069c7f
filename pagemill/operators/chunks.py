"""Cells to chunks. A document's cells are collected once, in reading order; windows over them are slices, so a chunker takes one shuffle."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators.cells import READING

MODES = {"cells": 0, "tokens": 1, "headings": 2, "table_rows": 3}
_SPANS = "array<struct<s:int,e:int>>"


def cell_windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    size = max(size, 1)
    step, out, start = size - min(overlap, size - 1), [], 0
    while start < n:
        out.append((start, min(start + size, n)))
        if start + size >= n:
            break
        start += step
    return out


def token_windows(tokens: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Filled greedily, a cell at least; the next window goes back until the overlap is reached, but always ahead of the last start."""
    most = max(most, 1)
    overlap, start, out = min(overlap, most - 1), 0, []
    size = [max(t, 1) for t in tokens]
    while start < len(size):
        end, used = start, 0
        while end < len(size) and (end == start or used + size[end] <= most):
            used += size[end]
            end += 1
        out.append((start, end))
        if end == len(size):
            break
        new, back = end, 0
        while overlap and new > start and back < overlap:
            new -= 1
            back += size[new]
        start = max(new, start + 1)
    return out


def heading_windows(types: list[str], tokens: list[int], most: int = 0) -> list[tuple[int, int]]:
    """From a heading to before the next, or to the cell that reaches `most` tokens; what lies before the first heading, or beyond, is left out."""
    out, i, n = [], 0, len(types)
    while i < n:
        if types[i] != "HEADER":
            i += 1
            continue
        end, used = i + 1, tokens[i]
        while end < n and types[end] != "HEADER" and not (most and used >= most):
            used += tokens[end]
            end += 1
        out.append((i, end))
        i = end
    return out


def table_windows(types: list[str], size: int) -> list[tuple[int, int]]:
    """Runs of table cells, cut into pieces of size."""
    out, i, n = [], 0, len(types)
    while i < n:
        if types[i] != "TABLE":
            i += 1
            continue
        end = i
        while end < n and types[end] == "TABLE":
            end += 1
        out += [(s, min(s + max(size, 1), end)) for s in range(i, end, max(size, 1))]
        i = end
    return out


def _folded(fold: Callable[[list, list], list[tuple[int, int]]]):
    @F.pandas_udf(_SPANS)
    def spans(types: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e} for s, e in fold(list(t), list(n))] for t, n in zip(types, tokens, strict=True)])

    return spans


def _windows(mode: str, size: int, overlap: int, most: int) -> Column:
    types, tokens = F.transform("cells", lambda c: c["cell_type"]), F.transform("cells", lambda c: c["tokens"])
    if mode == "cells":
        size = max(size, 1)
        step, n = size - min(overlap, size - 1), F.size("cells")
        last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("s"), F.least(k * step + size, n).alias("e")))
    if mode == "tokens":
        return _folded(lambda t, n: token_windows(n, most, overlap))(types, tokens)
    if mode == "headings":
        return _folded(lambda t, n: heading_windows(t, n, most))(types, tokens)
    if mode == "table_rows":
        return _folded(lambda t, n: table_windows(t, size))(types, tokens)
    raise ValueError(f"unknown chunk mode {mode!r}")


def chunks(found: DataFrame, mode: str = "cells", size: int = 8, overlap: int = 2, most: int = 512) -> DataFrame:
    """(chunk_id, doc, chunk_index, z_start, z_end, cell_start, cell_end, text, token_count, dominant_type, importance_mean).

    cell_end is included. A chunk whose text is blank is dropped and takes no number. Of types that are equally frequent the first of TEXT, TABLE, FIGURE, FOOTER, HEADER.
    """
    cell = F.struct(*READING, "cell_type", "importance", T.word_count(F.col("text")).alias("tokens"), F.coalesce("text", F.lit("")).alias("text"))
    docs = found.groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    spans = docs.withColumn("w", F.explode(_windows(mode, size, overlap, most))).select("doc", F.col("w.s").alias("cell_start"), (F.col("w.e") - 1).alias("cell_end"), F.slice("cells", F.col("w.s") + 1, F.col("w.e") - F.col("w.s")).alias("c"))
    total = lambda field: F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x[field])
    count = lambda t: F.size(F.filter("c", lambda x: x["cell_type"] == t))
    best = F.array_max(F.array(*(F.struct(count(t).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(T.CELL_TYPES))))["t"]
    text = F.array_join(F.transform(F.filter("c", lambda x: F.trim(x["text"]) != ""), lambda x: x["text"]), "\n")
    made = spans.select("doc", "cell_start", "cell_end", F.element_at("c", 1)["z"].alias("z_start"), F.element_at("c", -1)["z"].alias("z_end"), text.alias("text"), total("tokens").cast("int").alias("token_count"), best.alias("dominant_type"), (total("importance") / F.size("c") / 255).alias("importance_mean")).where("trim(text) <> ''")
    made = made.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc").orderBy("cell_start")) - 1)
    return made.select(T.chunk_id(F.col("doc"), MODES[mode], F.col("chunk_index"), F.col("cell_start"), F.col("cell_end")).alias("chunk_id"), "doc", "chunk_index", "z_start", "z_end", "cell_start", "cell_end", "text", "token_count", "dominant_type", "importance_mean")


def parse_filter(expression: str) -> Column:
    """'type=TABLE,type=TEXT,min_importance=51,doc_id=a': values of one key are alternatives, keys must all hold."""
    held: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in expression.split(","))):
        key, eq, value = part.partition("=")
        if not eq or key not in ("doc_id", "type", "min_importance"):
            raise ValueError(f"unknown filter {part!r}")
        if key == "type" and value.upper() not in T.CELL_TYPES:
            raise ValueError(f"unknown cell type {value!r}")
        held.setdefault(key, []).append(value)
    out = F.lit(True)
    if "doc_id" in held:
        out = out & F.col("doc").isin(held["doc_id"])
    if "type" in held:
        out = out & F.col("dominant_type").isin([t.upper() for t in held["type"]])
    if "min_importance" in held:
        out = out & (F.col("importance_mean") >= min(max(float(held["min_importance"][-1]) / 255, 0.0), 1.0))
    return out
