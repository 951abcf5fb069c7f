"""Mixing sources to target weights by entropy balancing.

Of all document rates r > 0 whose token sums meet the targets, the ones closest to 1 in relative entropy are r = exp(sum of the multipliers of the document's groups, times its tokens). The multipliers minimise a convex dual, sum of rates minus multipliers times targets, by damped Newton steps. Each step is one aggregation over the histogram of (groups, tokens), which is all of the corpus that the dual depends on. Rates are rounded into copies by a hash of the id, without bias.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.store import cut, table

#: A source's default weight is its tokens to this power: between its own share (1) and an equal one (0).
SMOOTHING = 0.5
TOLERANCE, MOST_STEPS, BROADCAST_ROWS = 1e-12, 200, 50_000
MOST_COPIES = 2**31 - 1
TOKEN = "[^ \t\n\r\f]+"


def token_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(TOKEN)), F.lit(0))


def _targets(have: dict, weights: dict | None, total: float | None, smoothing: float) -> dict:
    """Target tokens by group; groups without tokens have none."""
    w = {g: (n**smoothing if weights is None else float(weights.get(g, 0.0))) for g, n in have.items() if n > 0}
    if any(x < 0 for x in w.values()):
        raise ValueError("weights must not be negative")
    whole = sum(w.values())
    every = sum(have.values()) if total is None else total
    return {g: every * x / whole for g, x in w.items()} if whole else {}


def solve(histogram: DataFrame, margins: list[str], weights: dict[str, dict] | None = None, total: float | None = None, smoothing: float = SMOOTHING) -> list[dict]:
    """A dict of multipliers by group for each margin, from histogram(margins, n, docs).

    A group of target 0 has multiplier -inf (rate 0). Where several margins can't be met together the last damped step is returned, with a warning. The driver holds a few numbers for each group, and with several margins their Hessian; of one margin it is diagonal.
    """
    sums = histogram.groupBy(*margins).agg(F.sum(F.col("n").cast("double") * F.col("docs")).alias("t"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("docs")).alias("q")).collect()
    have = [{} for _ in margins]
    square = [{} for _ in margins]
    for r in sums:
        for j in range(len(margins)):
            have[j][r[j]] = have[j].get(r[j], 0.0) + r["t"]
            square[j][r[j]] = square[j].get(r[j], 0.0) + r["q"]
    target = [_targets(h, (weights or {}).get(m), total, smoothing) for m, h in zip(margins, have, strict=True)]
    keys = [(j, g) for j in range(len(margins)) for g in sorted(have[j], key=lambda x: (x is None, x)) if target[j].get(g, 0) > 0]
    place = {k: i for i, k in enumerate(keys)}
    none = [{g: -math.inf for g, n in have[j].items() if n > 0 and target[j].get(g, 0) <= 0} for j in range(len(margins))]
    if not keys:
        return none
    goal = np.array([target[j][g] for j, g in keys])
    size = np.array([square[j][g] / have[j][g] for j, g in keys])  # unit of each multiplier: one over a typical document's tokens
    spark, kinds = histogram.sparkSession, [histogram.schema[m].dataType for m in margins]

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual value, gradient and Hessian."""
        df, tilt = histogram, F.lit(0.0)
        for j, m in enumerate(margins):
            rows = [(g, float(x[place[j, g]] / size[place[j, g]])) for k, g in keys if k == j]
            df = attach(df, spark.createDataFrame(rows, f"__g{j} {kinds[j].simpleString()}, __l{j} double"), F.col(m).eqNullSafe(F.col(f"__g{j}")), len(rows), "inner")
            tilt = tilt + F.col(f"__l{j}")
        mass = F.col("docs") * F.exp(F.least(tilt * F.col("n"), F.lit(300.0)))
        n = F.col("n").cast("double")
        cells = df.groupBy(*margins).agg(F.sum(mass), F.sum(mass * n), F.sum(mass * n * n)).collect()
        g, h, value = -goal / size, np.zeros((len(keys),) * min(2, len(margins))), -float(x @ (goal / size))
        for r in cells:
            mine = [place[j, r[j]] for j in range(len(margins))]
            s0, s1, s2 = r[len(margins) :]
            value += s0
            for a in mine:
                g[a] += s1 / size[a]
                if len(margins) == 1:
                    h[a] += s2 / size[a] ** 2
                    continue
                for b in mine:
                    h[a, b] += s2 / size[a] / size[b]
        return value, g, h

    x = np.zeros(len(keys))
    value, g, h = at(x)
    for _ in range(MOST_STEPS):
        if np.max(np.abs(g) * size / goal) < TOLERANCE:
            break
        if len(margins) == 1:
            step = -g / np.maximum(h, 1e-300)
        else:
            h[np.diag_indices_from(h)] *= 1 + 1e-12
            step = -np.linalg.lstsq(h, g, rcond=1e-13)[0]
        step *= min(1.0, 4.0 / max(np.max(np.abs(step)), 1e-300))
        while True:
            new = at(x + step)
            if new[0] <= value + 1e-12 * abs(value) or np.max(np.abs(step)) < 1e-14:
                break
            step = step / 2
        if np.max(np.abs(step)) < 1e-14:
            break
        x, (value, g, h) = x + step, new
    if (miss := float(np.max(np.abs(g) * size / goal))) > 1e-6:
        warnings.warn(f"the targets can't all be met: one is missed by {miss:.2%}", stacklevel=2)
    return [none[j] | {g: float(x[place[k, g]] / size[place[k, g]]) for k, g in keys if k == j} for j in range(len(margins))]


def attach(df: DataFrame, small: DataFrame, on: Column, rows: int, how: str) -> DataFrame:
    """A join whose right side is broadcast only where it has few rows."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def with_copies(counted: DataFrame, margins: list[str], multipliers: list[dict], id_col: str) -> DataFrame:
    """counted, with n_tokens, plus rate and copies."""
    spark, tilt = counted.sparkSession, F.lit(0.0)
    kept = counted.columns
    for j, m in enumerate(margins):
        rows = list(multipliers[j].items())
        if not rows:
            continue
        counted = attach(counted, spark.createDataFrame(rows, f"__g{j} {counted.schema[m].dataType.simpleString()}, __l{j} double"), F.col(m).eqNullSafe(F.col(f"__g{j}")), len(rows), "left")
        tilt = tilt + F.coalesce(f"__l{j}", F.lit(0.0))
    rate = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.exp(tilt * F.col("n_tokens")))
    unit = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return counted.withColumn("rate", rate).withColumn("copies", F.floor(F.least(F.col("rate") + unit, F.lit(float(MOST_COPIES)))).cast("int")).select(*kept, "rate", "copies")


def balance(docs: DataFrame, margins: tuple[str, ...] = ("source",), weights: dict[str, dict] | None = None, total: float | None = None, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the margins, n_tokens, rate, copies), a row for each row of docs.

    weights: by margin, the target weight of each group (one that is missing has 0); without, tokens to the power smoothing. total: target tokens, by default as many as there are. A null group is a group like others. Null texts and texts without tokens have rate 1 and one copy and count for nothing. Null ids round alike, as do rows that share an id. Other columns are not looked at; a margin can't have the name of a result column. An empty table gives no rows.
    """
    names = list(margins)
    if taken := {"doc_id", "n_tokens", "rate", "copies"} & set(names):
        raise ValueError(f"a margin named {sorted(taken)[0]}")
    counted = cut(docs.select(F.col(id_col).alias("doc_id"), *names, token_count(text_col).alias("n_tokens")), "tokens")
    histogram = cut(counted.where("n_tokens > 0").groupBy(*names, F.col("n_tokens").alias("n")).agg(F.count("*").alias("docs")), "histogram")
    return with_copies(counted, names, solve(histogram, names, weights, total, smoothing), "doc_id")


def mix(docs: DataFrame, margins: tuple[str, ...] = ("source",), weights: dict[str, dict] | None = None, total: float | None = None, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row repeated as often as balance() has copies of it: not at all, once or more; the columns stay."""
    names = list(margins)
    row = F.struct(*docs.columns).alias("__row")
    counted = docs.select(row, F.col(id_col).alias("doc_id"), *names, token_count(text_col).alias("n_tokens"))
    histogram = cut(counted.where("n_tokens > 0").groupBy(*names, F.col("n_tokens").alias("n")).agg(F.count("*").alias("docs")), "histogram")
    found = with_copies(counted, names, solve(histogram, names, weights, total, smoothing), "doc_id")
    return found.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


_SQL = f"""
WITH counted AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS INT) AS n_tokens FROM documents),
hist AS (SELECT source, n_tokens AS n, count(*) AS c FROM counted WHERE n_tokens > 0 GROUP BY source, n_tokens),
lists AS (SELECT source, list({{'n': CAST(n AS DOUBLE), 'c': CAST(c AS DOUBLE)}} ORDER BY n) AS h, sum(n * c) AS t FROM hist GROUP BY source),
goal AS (SELECT source, h, sum(t) OVER () * sqrt(t) / sum(sqrt(t)) OVER () AS want FROM lists),
solved AS (SELECT source, list_reduce(CAST(range(0, 300) AS DOUBLE[]), lambda l, i: l - (list_sum(list_transform(h, lambda x: x.c * x.n * exp(l * x.n))) - want) / list_sum(list_transform(h, lambda x: x.c * x.n * x.n * exp(l * x.n))), CAST(0 AS DOUBLE)) AS l FROM goal),
rated AS (SELECT d.doc_id, d.source, d.n_tokens, CASE WHEN d.n_tokens = 0 THEN 1.0 ELSE exp(coalesce(s.l, 0) * d.n_tokens) END AS rate FROM counted d LEFT JOIN solved s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, n_tokens, round(rate, 6) AS rate, CAST(floor(rate + CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0) AS INT) AS copies FROM rated"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE_SQL = {"op4_mix_sources": _SQL}
