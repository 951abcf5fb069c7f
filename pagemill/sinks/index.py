"""Documents as index tables, containers and a retrieval store: written as parquet, read back as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import cells as C

STORE = {
    "collections": "id long, name string",
    "documents": "id string, collection_id long, source_path string, title string",
    "cells": "id string, document_id string, page int, importance double, sensitivity string, text string, text_encrypted string, embedding array<double>, bbox_x int, bbox_y int, bbox_w int, bbox_h int",
}


def document_records(files: DataFrame) -> DataFrame:
    """(doc_id, title, source_type, source_format, source_ref, tags) from files(doc_id, path): the file's stem, and its last extension in lower case or `unknown`."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$|^[^.]\.([^.]+)$", 1))
    stem = F.when(name.rlike(r".\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return files.select("doc_id", stem.alias("title"), F.lit("files").alias("source_type"), F.when(ext == "", "unknown").otherwise(ext).alias("source_format"), F.col("path").alias("source_ref"), F.array().cast("array<string>").alias("tags"))


def page_records(cells: DataFrame, layout: C.Layout = C.PRESETS["reports"]) -> DataFrame:
    """(page_id, doc_id, page_number, approx_tokens, width_px, height_px, z), a row for each page with cells; pages are numbered by place, tokens are words, null for a blank page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda c: c["text"]), "\n")
    pages = cells.groupBy("doc_id", "z").agg(text.alias("__text"))
    words = T.word_count(F.col("__text"))
    doc = F.col("doc_id").cast("string")
    return pages.select(F.format_string("doc_%s_page_%04d", doc, F.col("z") + 1).alias("page_id"), F.concat(F.lit("doc_"), doc).alias("doc_id"), (F.col("z") + 1).alias("page_number"), F.when(words > 0, words).alias("approx_tokens"), F.lit(layout.page_width).alias("width_px"), F.lit(layout.page_height).alias("height_px"), "z")


def join_pages(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Index cells (page_id computed from their place) with the page's own id where the pages table has the place, and its width and height, else null."""
    held = pages.groupBy("doc_id", "z").agg(F.min("page_id").alias("__id"), F.min("width_px").alias("width_px"), F.min("height_px").alias("height_px"))
    z = F.regexp_extract("page_id", r"_page_([0-9]+)$", 1).cast("int") - 1
    return cells.withColumn("z", z).join(held, ["doc_id", "z"], "left").withColumn("page_id", F.coalesce("__id", "page_id")).drop("__id")


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, pages and cells of an index; cells are sorted by cell_id where an order is needed, not here."""
    return tuple(spark.read.parquet(f"{root}/index/{n}") for n in ("documents", "pages", "cells"))


def write_container(cells: DataFrame, root: str, mode: str = "overwrite") -> None:
    """A document set as two tables: cells without texts, and each document's payloads once."""
    cells.drop("text").write.mode(mode).option("compression", "zstd").parquet(f"{root}/cells")
    C.dictionary(cells).write.mode(mode).option("compression", "zstd").parquet(f"{root}/dict")


def read_container(spark: SparkSession, root: str) -> DataFrame:
    """Cells with their texts, `<missing>` where the dictionary lacks one."""
    return C.resolve(spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/dict"))


def container_json(cells: DataFrame) -> DataFrame:
    """(doc_id, json): a document's cells in reading order and its dictionary as one JSON text."""
    shown = F.struct("z", "x", "y", "w", "h", "code_id", "cell_type", "importance")
    held = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(shown)).alias("cells"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("code_id", "text")))).alias("dict"))
    return held.select("doc_id", F.to_json(F.struct("cells", "dict")).alias("json"))


def from_container_json(found: DataFrame) -> DataFrame:
    """Cells from container_json()."""
    kind = "struct<cells: array<struct<z: int, x: int, y: int, w: int, h: int, code_id: string, cell_type: string, importance: int>>, dict: map<string, string>>"
    each = found.select("doc_id", F.from_json("json", kind).alias("d")).select("doc_id", F.explode("d.cells").alias("c"), F.col("d.dict").alias("dict"))
    return each.select("doc_id", "c.*", F.coalesce(F.try_element_at("dict", F.col("c.code_id")), F.lit("<missing>")).alias("text"))


def write_context(contexts: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Contexts as text, a folder for each document."""
    contexts.select(F.col("doc_id").cast("string").alias("doc_id"), "context").write.mode(mode).partitionBy("doc_id").text(root)


def write_embeddings(embedded: DataFrame, root: str, model: str, dims: int, mode: str = "overwrite") -> None:
    """JSON lines of vectors, and a row that says what they are beside them."""
    embedded.write.mode(mode).option("ignoreNullFields", "false").json(f"{root}/vectors")
    embedded.sparkSession.createDataFrame([("embed_meta", model, dims)], "row_type string, model string, dims int").coalesce(1).write.mode(mode).json(f"{root}/meta")


def store_cells(cells: DataFrame, sensitivity: str = "public", key: str | None = None, dims: int = 64) -> DataFrame:
    """Cells for a store, with embeddings; under a key, texts above `public` are encrypted and their plain text is null."""
    hide = F.lit(key is not None) & (T.sensitivity_rank(F.lit(sensitivity)) > 0)
    return cells.select(F.concat_ws(":", F.col("doc_id").cast("string"), "z", "y", "x").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.col("z").alias("page"), (F.col("importance") / 255).alias("importance"), F.lit(sensitivity).alias("sensitivity"), F.when(~hide, F.col("text")).alias("text"), (F.when(hide, T.encrypt(F.col("text"), key)) if key else F.lit(None).cast("string")).alias("text_encrypted"), T.hash_embedding(F.col("text"), dims).alias("embedding"), F.col("x").alias("bbox_x"), F.col("y").alias("bbox_y"), F.col("w").alias("bbox_w"), F.col("h").alias("bbox_h"))


def insert(root: str, collections: DataFrame | None = None, documents: DataFrame | None = None, cells: DataFrame | None = None) -> None:
    """Append to a store's tables. Cells come before their documents, so that a reader who joins both sees a document whole or not at all."""
    for name, df in (("cells", cells), ("documents", documents), ("collections", collections)):
        if df is not None:
            df.write.mode("append").parquet(f"{root}/{name}")


def open_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(kind).parquet(f"{root}/{name}") for name, kind in STORE.items()}


def collection_cells(store: dict[str, DataFrame], name: str) -> DataFrame:
    """The cells of a collection, with their documents' source_path."""
    own = store["collections"].where(F.col("name") == name).select(F.col("id").alias("collection_id"))
    docs = store["documents"].join(own, "collection_id").select(F.col("id").alias("document_id"), "source_path")
    return store["cells"].join(docs, "document_id")


def push(vectors: DataFrame, send, batch: int = 256) -> int:  # noqa: ANN001
    """Vectors to an outside database through send(rows), a picklable function, `batch` rows at a time; how many went. Where a task is tried again its rows are sent again: send must replace by id."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for part in parts:
            for lo in range(0, len(part), batch):
                send(part.iloc[lo : lo + batch].to_dict("records"))
            n += len(part)
        yield pd.DataFrame({"n": [n]})

    return vectors.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_task_metrics(metrics: DataFrame, path: str) -> dict:
    """A row a task merged into the JSON file at a local path; tasks are few."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except FileNotFoundError:
        held = {}
    held |= {r["task"]: {k: r[k] for k in metrics.columns if k != "task"} for r in metrics.collect()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(held, f, indent=2, sort_keys=True)
    return held
