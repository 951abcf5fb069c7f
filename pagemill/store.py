"""Written tables, and row numbers over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_RANGE = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it twice doesn't make it twice, and its rows are the same each time."""
    path = f"{shared_folder(df.sparkSession)}/pagemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _leaf(key: Column, bounds: list, values: list) -> Column:
    """values[number of bounds that are not greater than key], by halving."""
    if not bounds:
        return values[0] if isinstance(values[0], Column) else F.lit(values[0])
    at = len(bounds) // 2
    return F.when(key < F.lit(bounds[at]), _leaf(key, bounds[:at], values[: at + 1])).otherwise(_leaf(key, bounds[at + 1 :], values[at + 1 :]))


def numbered(df: DataFrame, by: tuple[str, ...], name: str = "n") -> DataFrame:
    """df with the place of each row, from 1, in the order of columns; rows alike in all of them are in any order.

    df is written once. Ranges of the first column are cut between sampled bounds; only the ranges' counts come to the driver, and rows are counted within ranges, so that no task sees the whole table. Nulls come first.
    """
    rows = written(df, "rows")
    n, spark = rows.count(), df.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // ROWS_A_RANGE)))
    key, bounds = F.col(by[0]), []
    if parts > 1:
        held = [r[0] for r in rows.select(by[0]).where(key.isNotNull()).sample(fraction=min(1.0, 64 * parts / n), seed=3).orderBy(by[0]).collect()]
        bounds = sorted({held[len(held) * i // parts] for i in range(1, parts)}) if held else []
    leaf = lambda values: F.when(key.isNull(), values[0]).otherwise(_leaf(key, bounds, values))
    part = leaf(list(range(len(bounds) + 1)))
    counts = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    before = [sum(counts.get(i, 0) for i in range(p)) for p in range(len(bounds) + 1)]
    w = Window.partitionBy("__range").orderBy(*by)
    return rows.withColumn("__range", part).withColumn(name, F.row_number().over(w) + leaf([F.lit(b).cast("long") for b in before])).drop("__range")
