"""The engine's verbs: on one document, on a folder, and a whole run from a configuration."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import cells as C
from pagemill.operators import samples as S
from pagemill.sinks import dataset_card, write_index, write_jsonl
from pagemill.sinks import index as I
from pagemill.sources import files


@dataclass(frozen=True)
class Encoder:
    """What an encoding depends on. strict refuses documents with number alerts."""

    preset: str = "reports"
    budget: int | None = None
    dedup_pages: int = 0
    drop_footers: bool = False
    hyphens: bool = True
    heading_boost: float = 1.0
    number_boost: float = 1.0
    footer_penalty: float = 0.5
    early_bonus: float = 1.0
    table_tolerance: int | None = None
    strict: bool = False

    @property
    def layout(self) -> C.Layout:
        if self.preset not in C.PRESETS:
            raise ValueError(f"unknown preset {self.preset!r}")
        return C.PRESETS[self.preset]


def encode(docs: DataFrame, settings: Encoder = Encoder()) -> DataFrame:  # noqa: B008 - frozen
    """Cells of docs(doc_id, text): classified, deduplicated and cut to the budget, in this order."""
    tuning = {k: getattr(settings, k) for k in ("heading_boost", "number_boost", "footer_penalty", "early_bonus")}
    found = C.cells(docs, settings.layout, settings.hyphens, **tuning)
    if settings.table_tolerance is not None:
        wide = (F.col("cell_type") == "TEXT") & T.has_column_gap(F.col("text"), settings.table_tolerance)
        found = found.withColumn("cell_type", F.when(wide, "TABLE").otherwise(F.col("cell_type")))
    if settings.drop_footers:
        found = C.drop_footers(found)
    found = C.dedup_window(found, settings.dedup_pages)
    found = found if settings.budget is None else C.budget(found, settings.budget)
    if settings.strict:
        check_guards(C.number_guards(found), found)
    return found


def check_guards(guards: DataFrame, cells: DataFrame, units: list[str] | None = None) -> None:
    """An error that names the first alerts, if there are any."""
    alerts = C.verify_guards(guards, cells, units).where("issue IS NOT NULL")
    if first := alerts.select("doc_id", "issue", "z", "units").orderBy("doc_id", "z").limit(3).collect():
        raise ValueError("number guards: " + ", ".join(f"{r['doc_id']} {r['issue']}@z{r['z']}:{r['units']}" for r in first))


def decode_text(cells: DataFrame, page: int | None = None) -> DataFrame:
    return C.decode(cells if page is None else cells.where(F.col("z") == page))


def encode_to_context(docs: DataFrame, settings: Encoder = Encoder(), limit: int = 96, grammar: bool = False) -> DataFrame:  # noqa: B008
    return C.serialise(C.run_lengths(encode(docs, settings)), settings.preset, "auto" if settings.budget is None else str(settings.budget), limit, grammar)


def encode_to_cells(docs: DataFrame, settings: Encoder = Encoder(), limit: int = 96) -> DataFrame:  # noqa: B008
    return C.manifest(encode(docs, settings), limit)


def stats(cells: DataFrame, count=T.word_count) -> DataFrame:  # noqa: ANN001
    """(doc_id, tokens_raw, tokens_context, cells, unique_payloads, savings_ratio): tokens of the decoded text over those of the context, by any counting column function; 0 where the latter is 0."""
    sizes = cells.groupBy("doc_id").agg(F.count("*").alias("cells"), F.countDistinct("code_id").alias("unique_payloads"))
    raw = C.decode(cells).select("doc_id", count(F.col("text")).alias("tokens_raw"))
    said = C.serialise(C.run_lengths(cells)).select("doc_id", count(F.col("context")).alias("tokens_context"))
    return raw.join(said, "doc_id").join(sizes, "doc_id").select("doc_id", "tokens_raw", "tokens_context", "cells", "unique_payloads", F.round(T.over(F.col("tokens_raw").cast("double"), F.col("tokens_context").cast("double")), 6).alias("savings_ratio"))


def plain_text(docs: DataFrame, settings: Encoder = Encoder()) -> DataFrame:  # noqa: B008
    """(doc_id, text) before cells are made: each page's wrapped lines, each with its end, pages parted by a blank line."""
    lines = C.lines(docs, settings.layout, settings.hyphens)
    pages = lines.groupBy("doc_id", "z").agg(C.ordered_text(by=("line",)).alias("t"))
    return pages.groupBy("doc_id").agg(C.ordered_text(F.concat("t", F.lit("\n")), ("z",), "\n").alias("text"))


@dataclass
class Config:
    """A run: files in, tasks, exports out. Read from YAML or TOML; PAGEMILL_<FIELD> in the environment wins."""

    source: str
    output: str
    globs: str = files.DEFAULT_GLOBS
    tasks: str = "qa,summary"
    exports: list[str] = field(default_factory=lambda: ["hf_chat"])
    preset: str = "reports"
    budget: int | None = None
    lang: str = "en"
    per_doc: int = S.QA_A_DOC

    @classmethod
    def read(cls, path: str, environment: dict[str, str] | None = None) -> Config:
        with open(path, "rb") as f:
            raw = f.read()
        if path.endswith(".toml"):
            said = tomllib.loads(raw.decode())
        else:
            import yaml

            said = yaml.safe_load(raw) or {}
        known = {f.name: f for f in fields(cls)}
        if wrong := sorted(set(said) - set(known)):
            raise ValueError(f"unknown setting {wrong[0]!r}")
        for name in known:
            if (value := (os.environ if environment is None else environment).get(f"PAGEMILL_{name.upper()}")) is not None:
                said[name] = value.split(",") if name == "exports" else int(value) if name in ("budget", "per_doc") else value
        return cls(**said)


def ingest(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    """Texts of the files that can be read, as an index of documents, pages and cells under output; files with their status, and cells."""
    found = files.to_text(files.with_ids(files.discover(spark, config.source, config.globs)))
    docs = found.where("status = 'ok'").select(F.regexp_replace("doc_id", "^doc_", "").alias("doc_id"), "text")
    cells = encode(docs, Encoder(preset=config.preset, budget=config.budget))
    write_index(I.document_records(found.where("status = 'ok'")), I.page_records(cells, C.PRESETS[config.preset]), C.index(cells), config.output, "overwrite")
    return found.drop("text"), cells


def run_tasks(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Samples of each task from the index under output, written under samples/ and read again."""
    _, _, cells = I.read_index(spark, config.output)
    for task in S.parse_tasks(config.tasks):
        one = S.qa_samples(cells, config.per_doc, config.lang) if task == "qa" else S.summary_samples(cells, lang=config.lang)
        one.write.mode("overwrite").parquet(f"{config.output}/samples/{task}")
    return read_tasks(spark, config)


def read_tasks(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """The samples that run_tasks() wrote."""
    return {task: spark.read.parquet(f"{config.output}/samples/{task}") for task in S.parse_tasks(config.tasks)}


def run_exports(spark: SparkSession, config: Config, made: dict[str, DataFrame]) -> str:
    """Each wanted format as JSON lines under exports/, and the card's text."""
    _, _, cells = I.read_index(spark, config.output)
    empty = {"qa": "sample_id string, task string, doc_id string, cell_ids array<string>, question string, answer string, lang string", "summary": "sample_id string, task string, doc_id string, cell_ids array<string>, title string, summary string"}
    qa, summary = (made.get(k, spark.createDataFrame([], empty[k])) for k in ("qa", "summary"))
    asked = S.compose_context(qa, cells)
    for kind in config.exports:
        write_jsonl(S.hf_train(qa, summary, cells) if kind == "hf" else S.export(asked, kind), f"{config.output}/exports/{kind}")
    return dataset_card(qa.count(), summary.count())


def run(spark: SparkSession, config: Config) -> str:
    """Ingest, tasks and exports in this order; the dataset card."""
    ingest(spark, config)
    return run_exports(spark, config, run_tasks(spark, config))
