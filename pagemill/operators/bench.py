"""Quality metrics of texts against gold ones, and their rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagemill.functions import text as T
from pagemill.functions.edits import codes, distance
from pagemill.store import numbered


def word_distance(gold: list[str], said: list[str]) -> int:
    return distance(*codes(gold, said))


@F.pandas_udf(DoubleType())
def word_error_rate(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Word edits over gold words; without gold words 0 or 1."""
    for gold, said in texts:
        out = []
        for g, s in zip(gold, said, strict=True):
            a, b = (g or "").split(), (s or "").split()
            out.append(word_distance(a, b) / len(a) if a else float(bool(b)))
        yield pd.Series(out, dtype=float)


def numeric_stats(pairs: DataFrame, id_col: str = "doc_id", gold: str = "gold", said: str = "predicted") -> DataFrame:
    """(id, precision, recall, f1, units_ok): the k-th occurrence of a number on one side matches the k-th on the other; units_ok is the share of matches of one unit. No numbers on either side: 1."""
    def bag(column: str, name: str) -> DataFrame:
        one = pairs.select(id_col, F.posexplode(T.numbers(F.col(column))).alias("p", "x")).select(id_col, "p", F.col("x.value").alias("value"), F.col("x.unit").alias(f"{name}_unit"))
        return one.withColumn("k", F.row_number().over(Window.partitionBy(id_col, "value").orderBy("p"))).select(id_col, "value", "k", f"{name}_unit", F.lit(1).alias(name))

    both = bag(gold, "g").join(bag(said, "s"), [id_col, "value", "k"], "full")
    hit = F.col("g").isNotNull() & F.col("s").isNotNull()
    n = both.groupBy(id_col).agg(F.count_if(hit).alias("m"), F.count("g").alias("ng"), F.count("s").alias("ns"), F.count_if(hit & (F.col("g_unit") == F.col("s_unit"))).alias("u"))
    out = pairs.select(id_col).distinct().join(n, id_col, "left").fillna(0)
    none = (F.col("ng") == 0) & (F.col("ns") == 0)
    p = F.when(none, 1.0).when(F.col("ns") > 0, F.col("m") / F.col("ns")).otherwise(0.0)
    r = F.when(none, 1.0).when(F.col("ng") > 0, F.col("m") / F.col("ng")).otherwise(0.0)
    return out.withColumn("precision", p).withColumn("recall", r).select(id_col, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0), 6).alias("f1"), F.round(F.when(F.col("m") > 0, F.col("u") / F.col("m")).otherwise(1.0), 6).alias("units_ok"))


def at_ranks(rows: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at some places, from 1, of a sorted column; 0 beyond its ends. Sorted in ranges: no task holds the column."""
    held = {r["n"]: float(r[column]) for r in numbered(rows.select(column).where(F.col(column).isNotNull()), (column,)).where(F.col("n").isin(ranks)).collect()}
    return [held.get(r, 0.0) for r in ranks]


def corpus_rollup(rows: DataFrame, value: str = "savings", latency: str = "ms", pages: str | None = None, memory: str | None = None) -> DataFrame:
    """One row: mean, median (sorted[n / 2]) and nearest-rank percentiles (sorted[round((n - 1) q)]) over documents; with their columns, mean pages a second and the most memory."""
    n, m = rows.agg(F.count(value), F.count(latency)).first()
    place = lambda q: int((m - 1) * q + 0.5) + 1
    (median,), (p50, p95) = at_ranks(rows, value, [n // 2 + 1]), at_ranks(rows, latency, [place(0.5), place(0.95)])
    out = rows.agg(F.count("*").alias("docs"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("mean_value"), *([F.round(F.avg(T.over(F.col(pages) * 1000.0, F.col(latency))), 6).alias("pages_per_s")] if pages else []), *([F.max(memory).alias("max_memory")] if memory else []))
    return out.select("docs", "mean_value", F.lit(median).alias("median_value"), F.lit(p50).alias("p50"), F.lit(p95).alias("p95"), *out.columns[2:])


def gate(rollup: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(metric, value, most) for every metric over its limit."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("most")) for k, v in limits.items()))
    return rollup.select(F.explode(rows).alias("x")).select("x.*").where("value > most")


def binned(rows: DataFrame, edges: list[int], size: str, group: str, *values: str) -> DataFrame:
    """Count and means by group and bin [edge, next edge), the last one open; a bin without rows has zeros."""
    spark = rows.sparkSession
    bins = spark.createDataFrame(list(enumerate(edges)), "bin int, low int")
    number = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        number = F.when(F.col(size) >= low, i).otherwise(number)
    some = rows.withColumn("bin", number).where("bin IS NOT NULL").groupBy(group, "bin").agg(F.count("*").alias("n"), *(F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values))
    grid = rows.select(group).distinct().crossJoin(F.broadcast(bins))
    return grid.join(some, [group, "bin"], "left").fillna(0, ["n", *(f"mean_{v}" for v in values)])


def accuracy_by_run(rows: DataFrame) -> DataFrame:
    """rows(run_id, pages, tokens, cells, cer) to tokens and cells a page, weighted by pages (one at least), and the mean of the known error rates."""
    p = F.greatest(F.lit(1), "pages")
    return rows.where("cer IS NOT NULL").groupBy("run_id").agg(F.round(F.sum("tokens") / F.sum(p), 6).alias("tokens_per_page"), F.round(F.sum("cells") / F.sum(p), 6).alias("cells_per_page"), F.round(F.avg("cer"), 6).alias("mean_cer"))


def with_gold(rows: DataFrame, gold: DataFrame, text: str = "text") -> DataFrame:
    """rows(rel, text) with the error rates against gold(rel, page, gold): the document's own gold text, else its pages' joined by blank lines; null without any."""
    whole = gold.where("page IS NULL").select("rel", F.col("gold").alias("__doc"))
    pages = gold.where("page IS NOT NULL").groupBy("rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "gold"))), lambda x: x["gold"]), "\n\n").alias("__pages"))
    held = rows.join(whole, "rel", "left").join(pages, "rel", "left").withColumn("gold", F.coalesce("__doc", "__pages")).drop("__doc", "__pages")
    known = F.col("gold").isNotNull()
    return held.withColumn("cer", F.when(known, T.character_error_rate(F.col("gold"), F.col(text)))).withColumn("wer", F.when(known, word_error_rate("gold", text)))


def page_rows(pages: DataFrame, gold: DataFrame) -> DataFrame:
    """(rel, page, cer_page, precision_page, tokens_gold, tokens_page, compression_ratio), a row for each gold page; a page that isn't there counts as empty."""
    held = gold.where("page IS NOT NULL").join(pages.select("rel", "page", "text"), ["rel", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    cer = T.character_error_rate(F.col("gold"), F.col("text"))
    a, b = T.word_count(F.col("gold")), T.word_count(F.col("text"))
    return held.select("rel", "page", F.round(cer, 6).alias("cer_page"), F.round(T.page_precision(cer), 6).alias("precision_page"), a.alias("tokens_gold"), b.alias("tokens_page"), F.round(T.over(a.cast("double"), b.cast("double")), 6).alias("compression_ratio"))


def bench_rows(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of documents and of pages in one table, told apart by row_type."""
    return documents.withColumn("row_type", F.lit("doc")).unionByName(pages.withColumn("row_type", F.lit("page")), allowMissingColumns=True)


def budget_sweep(cells: DataFrame, budgets: list[int | None]) -> DataFrame:
    """cells once for each budget, cut to it (null keeps all), with the budget. The cells are ranked once: a rank within a budget is one within any larger one."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("importance"), "z", "y", "x")
    ranked = cells.withColumn("__rank", F.row_number().over(w))
    each = F.explode(F.array(*(F.lit(b).cast("int") for b in budgets)))
    return ranked.withColumn("budget", each).where("budget IS NULL OR __rank <= budget").drop("__rank")
