"""Continuous ingest: documents from a stream to cells, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import cells as C

SCHEMA = "doc_id string, text string, arrived timestamp"


def cell_stream(spark: SparkSession, folder: str, late: str = "1 day", layout: C.Layout = C.PRESETS["reports"]) -> DataFrame:
    """The cells of each document that arrives in folder as parquet(doc_id, text, arrived). A document that arrives again within `late` is dropped; lines and types need no state, as a document arrives whole."""
    docs = spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id"])
    return C.cells(docs, layout)


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append cells to target, partitioned by type, for what lies in folder now."""
    return cell_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).partitionBy("cell_type").trigger(availableNow=True).start()


def arrivals(spark: SparkSession, folder: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents and characters by arrival window; a document later than `late` isn't counted."""
    docs = spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("arrived", late)
    return docs.groupBy(F.window("arrived", width)).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
