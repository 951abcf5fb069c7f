"""python -m pagemill VERB ...: the verbs on files, for spark-submit or a local session."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import api
from pagemill.operators import cells as C
from pagemill.operators import search as R
from pagemill.sinks import index, write_jsonl
from pagemill.sources import files

ENCODING = ("encode", "context", "cells", "stats", "text")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in ENCODING:
        one = verbs.add_parser(name, help=f"{name} of files, folders or globs")
        one.add_argument("inputs", nargs="+")
        one.add_argument("--output", required=True)
        one.add_argument("--preset", default="reports", choices=sorted(C.PRESETS))
        one.add_argument("--budget", type=int)
        one.add_argument("--dedup-pages", type=int, default=0)
        one.add_argument("--drop-footers", action="store_true")
        one.add_argument("--no-hyphens", action="store_true")
        one.add_argument("--strict", action="store_true")
        one.add_argument("--limit", type=int, default=96)
    decode = verbs.add_parser("decode", help="texts of a container")
    decode.add_argument("container")
    decode.add_argument("--output", required=True)
    decode.add_argument("--select", help="z=0,x=0..1024,y=0..4096")
    decode.add_argument("--page", type=int)
    search = verbs.add_parser("search", help="the best documents of a container for a question")
    search.add_argument("container")
    search.add_argument("question")
    search.add_argument("--top", type=int, default=5)
    search.add_argument("--output", required=True)
    for name in ("ingest", "tasks", "exports", "run"):
        verbs.add_parser(name, help=f"{name} of a configuration").add_argument("--config", required=True)
    return out


def documents(spark: SparkSession, inputs: list[str]) -> DataFrame:
    found = files.to_text(files.with_ids(files.gather(spark, inputs)))
    return found.where("status = 'ok'").select("doc_id", "text")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("pagemill").getOrCreate()
    if a.verb in ENCODING:
        docs = documents(spark, a.inputs)
        settings = api.Encoder(preset=a.preset, budget=a.budget, dedup_pages=a.dedup_pages, drop_footers=a.drop_footers, hyphens=not a.no_hyphens, strict=a.strict)
        if a.verb == "encode":
            index.write_container(api.encode(docs, settings), a.output)
        elif a.verb == "context":
            index.write_context(api.encode_to_context(docs, settings, a.limit), a.output)
        else:
            made = {"cells": lambda: api.encode_to_cells(docs, settings, a.limit), "stats": lambda: api.stats(api.encode(docs, settings)), "text": lambda: api.plain_text(docs, settings)}[a.verb]()
            write_jsonl(made, a.output)
    elif a.verb == "decode":
        found = index.read_container(spark, a.container)
        write_jsonl(api.decode_text(C.select_box(found, *C.parse_selector(a.select)) if a.select else found, a.page), a.output)
    elif a.verb == "search":
        texts = C.decode(index.read_container(spark, a.container))
        asked = spark.createDataFrame([(1, a.question)], "query_id long, query_text string").withColumn("query_embedding", R.T.hash_embedding(F.col("query_text")))
        write_jsonl(R.hybrid(R.embed(texts), asked, a.top, "doc_id", "query_id"), a.output)
    else:
        config = api.Config.read(a.config)
        if a.verb in ("ingest", "run"):
            api.ingest(spark, config)
        if a.verb in ("tasks", "run"):
            api.run_tasks(spark, config)
        if a.verb in ("exports", "run"):
            print(api.run_exports(spark, config, api.read_tasks(spark, config)))


if __name__ == "__main__":
    main()
