"""File discovery, format detection, and readers of files' texts."""

from __future__ import annotations

import fnmatch
import gzip
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagemill.sources import convert as C
from pagemill.store import numbered

FORMATS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "html": "html", "htm": "html", "xhtml": "html", "xml": "xml", "rss": "rss", "atom": "atom", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "csv": "csv", "tsv": "tsv", "tex": "tex", "bib": "bib", "bbl": "bbl", "log": "log", "rtf": "rtf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}

QUICK_GLOBS = "*.pdf,*.md,*.txt"
DEFAULT_GLOBS = "*.pdf,*.md,*.txt,*.html,*.htm,*.xml,*.xhtml,*.rss,*.atom,*.json,*.yaml,*.yml,*.csv,*.tsv,*.csv.gz,*.tsv.gz,*.tex,*.bib,*.bbl,*.ini,*.cfg,*.conf,*.toml,*.log,*.rtf,*.png,*.jpg,*.jpeg"


def glob_pattern(globs: str) -> str:
    """One regular expression for comma-separated, case-insensitive globs; one without a slash holds at any depth."""
    parts = [p.strip() for p in globs.split(",") if p.strip()]
    full = [p if "/" in p else f"**/{p}" for p in parts]
    one = lambda p: fnmatch.translate(p).replace("(?s:", "(?is:").replace(r"\Z", "$").replace(r"\z", "$")
    return "|".join(f"(?:{one(p.removeprefix('**/'))}|{one('*/' + p.removeprefix('**/'))})" if p.startswith("**/") else one(p) for p in full)


def file_format(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    bare = F.regexp_replace(name, r"\.gz$", "")
    ext = F.when(name.rlike(r"\.(csv|tsv)\.gz$"), F.regexp_extract(bare, r"\.([^.]+)$", 1)).otherwise(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))


def discover(spark: SparkSession, root: str, globs: str = QUICK_GLOBS) -> DataFrame:
    """(path, relative, format, content) of the files under root that a glob fits; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(base) + "/", "")
    return found.withColumn("relative", relative).where(F.col("relative").rlike(glob_pattern(globs))).select("path", "relative", file_format(F.col("path")).alias("format"), "content")


def with_ids(files: DataFrame, last: int = 0) -> DataFrame:
    """files with doc_id doc_0001 and on in the order of paths, after `last`. Paths are numbered apart from the contents."""
    ids = numbered(files.select("path"), ("path",), "__n").select("path", F.format_string("doc_%04d", F.col("__n") + last).alias("doc_id"))
    return files.join(ids, "path")


def gather(spark: SparkSession, inputs: list[str], globs: str = DEFAULT_GLOBS) -> DataFrame:
    """What discover() finds in each of several files, folders, or globs (which hold *, ? or [)."""
    parts = []
    for x in inputs:
        if re.search(r"[*?\[]", x):
            root = re.split(r"[*?\[]", x)[0].rsplit("/", 1)[0] or "."
            parts.append(discover(spark, root, x[len(root) :].lstrip("/")))
        else:
            parts.append(discover(spark, x, globs))
    return union_sources(parts).dropDuplicates(["path"])


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some bytes of a column, a row at least: Python's objects for a part are there at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def to_text(files: DataFrame, readers: dict[str, Callable[[bytes, str], str | None]] | None = None, strict: bool = False) -> DataFrame:
    """files with text and status: ok, unsupported (no reader for the format), or failed with the reason; strict makes failures errors.

    readers: by format, functions of a file's bytes and stem that give its text or None, as for pdf and image, for which there is none here. They run before the converters and must be picklable.
    """

    kept = [c for c in files.columns if c != "content"]

    def one(kind: str, path: str, raw: bytes) -> tuple[str | None, str]:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            data = gzip.decompress(raw) if path.lower().endswith(".gz") else raw
            found = readers[kind](data, stem) if readers and kind in readers else C.to_markdown(kind, data.decode("utf-8", "replace"), stem)
            return found, "unsupported" if found is None else "ok"
        except Exception as e:  # noqa: BLE001 - a document's own fault is its status
            if strict:
                raise
            return None, f"failed: {type(e).__name__}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, len(kept)):
                rows = zip(*(piece.column(c).to_pylist() for c in ("format", "path", "content")), strict=True)
                texts, said = zip(*(one(*r) for r in rows), strict=True)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string()), pa.array(said, pa.string())], names=[*kept, "text", "status"])

    out = StructType([*(files.schema[c] for c in kept), StructField("text", StringType()), StructField("status", StringType())])
    return files.select(*kept, "content").mapInArrow(read, out)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Blank lines are skipped; a malformed one is an error; a file that isn't there is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gold_texts(spark: SparkSession, root: str) -> DataFrame:
    """(rel, page, gold) of the gold files under root: {rel}.txt has page null, {rel}/page_0001.txt page 0."""
    raw = discover(spark, root, "*.txt").select("relative", F.decode("content", "UTF-8").alias("gold"))
    page = F.regexp_extract("relative", r"(?:^|/)page_([0-9]{4})\.txt$", 1)
    is_page = page != ""
    rel = F.when(is_page, F.regexp_replace("relative", r"/?page_[0-9]{4}\.txt$", "")).otherwise(F.regexp_replace("relative", r"\.txt$", ""))
    return raw.select(rel.alias("rel"), F.when(is_page, page.cast("int") - 1).alias("page"), "gold")


def unit_list(raw: str) -> list[str]:
    """A unit a line, lower-cased, without comments and repeats."""
    return list(dict.fromkeys(x for x in (line.split("#", 1)[0].strip().lower() for line in raw.splitlines()) if x))


def synthetic_reports(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(doc_id, text): n markdown reports with figures that follow from the seed and the number."""
    figure = lambda k, low, high: (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(high - low))).cast("string")
    lines = [F.concat(F.lit("# Report "), (F.col("id") + 1).cast("string")), *(F.concat(F.lit(f"{name}: $"), figure(k, 100, 10_000), F.lit(" USD")) for k, name in enumerate(("Revenue", "Expenses", "Profit"))), F.concat(F.lit("Growth: "), figure(9, 1, 60), F.lit("%"))]
    return spark.range(n).select("id", F.array_join(F.array(*lines), "\n\n").alias("text")).select(F.format_string("doc_%04d", F.col("id") + 1).alias("doc_id"), "text")


def read_embeddings(spark: SparkSession, jsonl: str | None = None, index: str | None = None) -> DataFrame:
    """Vectors from JSON lines (a row of row_type embed_meta is left out) or from a written index; exactly one of the two."""
    if (jsonl is None) == (index is None):
        raise ValueError("give either JSON lines or an index")
    if index:
        return spark.read.parquet(index)
    raw = spark.read.json(jsonl)
    return raw.where(F.coalesce(F.col("row_type") != "embed_meta", F.lit(True))).drop("row_type") if "row_type" in raw.columns else raw
