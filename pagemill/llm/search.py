"""Exact top-k search by block-at-a-time pruning.

Documents lie in blocks, each a forward index of its documents' query terms. Per query, a block's bound is the sum over the query's terms of the largest weight that any of the block's documents has for it. Blocks are taken by falling bound and scored whole, until the bound is below the k-th score so far. A first pass scores every partition's best block, which gives each query a k-th score to start from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import kernels as K
from pagemill.llm.store import cut, table

TOP, K1, B, BLOCK_DOCS, QUERIES_A_PASS = 10, 1.2, 0.75, 256, 2000
#: Scores are compared after rounding to this many places, ties by id: copies of a document tie whatever the order of summation.
PLACES = 6


class Queries:
    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        w = [K.words(t) for t in K.chunks(pa.array(["" if x is None else x for x in texts], pa.large_string()), 1 << 40, 1 << 30)]
        hashes = np.concatenate([x.hashes for x in w]) if w else np.zeros(0, np.uint64)
        counts = np.concatenate([x.counts for x in w]) if w else np.zeros(0, int)
        self.terms, number = np.unique(hashes, return_inverse=True)
        query = np.repeat(np.arange(len(ids)), counts)
        pair, self.times = np.unique(query * max(1, len(self.terms)) + number, return_counts=True)
        self.term = pair % max(1, len(self.terms))
        self.bounds = np.searchsorted(pair // max(1, len(self.terms)), np.arange(len(ids) + 1))

    def weights(self, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, its terms, their weights)."""
        for q in range(len(self.ids)):
            at = slice(self.bounds[q], self.bounds[q + 1])
            if at.stop > at.start:
                yield q, self.term[at], self.times[at] * idf[self.term[at]]


_INDEX = "docs array<long>, lengths array<int>, bounds array<int>, terms array<int>, times array<int>"


def _index(terms: np.ndarray, block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, len(terms))
        for batch in batches:
            for t in K.chunks(batch.column(1), max_rows=block_docs):
                w = K.words(t)
                at = np.minimum(np.searchsorted(terms, w.hashes), n - 1)
                hit = terms[at] == w.hashes if len(terms) else np.zeros(len(at), bool)
                doc = np.repeat(np.arange(len(w.counts)), w.counts)[hit]
                pair, times = np.unique(doc * n + at[hit], return_counts=True)
                bounds = np.searchsorted(pair // n, np.arange(len(w.counts) + 1))
                one = lambda x, kind: K.list_array(x, np.array([0, len(x)]), kind)
                ids = batch.column(0).slice(t.lo, t.hi - t.lo).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([one(ids, pa.int64()), *(one(x.astype(np.int32), pa.int32()) for x in (w.counts, bounds, pair % n, times))], names=["docs", "lengths", "bounds", "terms", "times"])

    return run


def _frequencies(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, docs) sums; term -1 has the number of documents, -2 that of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
            lengths = batch.column(1).flatten().to_numpy()
            docs, length = docs + len(lengths), length + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, length]))], names=["term", "docs"])

    return run


class Block:
    def __init__(self, docs: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, terms: np.ndarray, times: np.ndarray, mean: float, k1: float, b: float):
        self.docs, self.terms = docs, terms
        doc = np.repeat(np.arange(len(docs)), np.diff(bounds))
        self.doc, self.weight = doc, times * (k1 + 1) / (times + k1 * (1 - b + b * lengths[doc] / mean))

    def largest(self, n: int) -> np.ndarray:
        """Term maxima."""
        out = np.zeros(n)
        np.maximum.at(out, self.terms, self.weight)
        return out

    def score(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, dense[self.terms] * self.weight, len(self.docs))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(queries: Queries, idf: np.ndarray, mean: float, k: int, k1: float, b: float, floor: dict[int, float] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query's best of a partition's blocks; without floors, of its best block only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            columns = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns]
            for i in range(batch.num_rows):
                blocks.append(Block(*(v[o[i] : o[i + 1]] for o, v in columns), mean, k1, b))
        if not blocks:
            return
        largest = np.stack([x.largest(len(queries.terms)) for x in blocks])
        dense = np.zeros(len(queries.terms))
        for q, terms, weights in queries.weights(idf):
            bound = largest[:, terms] @ weights
            ids, scores = np.zeros(0, np.int64), np.zeros(0)
            least = floor.get(q, 0.0) if floor is not None else 0.0
            dense[terms] = weights
            for at in np.argsort(-bound, kind="stable"):
                if bound[at] <= 0 or bound[at] < least - 2 * 10.0**-PLACES:
                    break
                s = np.round(blocks[at].score(dense), PLACES)
                some = np.flatnonzero((s >= least - 10.0**-PLACES) & (s > 0))
                ids, scores = _best(np.append(ids, blocks[at].docs[some]), np.append(scores, s[some]), k)
                if floor is None:
                    break
                if len(scores) == k:
                    least = max(least, scores[-1])
            dense[terms] = 0.0
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B, block_docs: int = BLOCK_DOCS, queries_a_pass: int = QUERIES_A_PASS) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of queries the k documents of highest BM25 score, exactly.

    Terms are runs of letters and digits, lower-cased in ASCII; a term that a query repeats counts as often. Ties go to the lesser id. Documents with no term of the query aren't listed, so a query may have fewer than k, or, without terms, null or empty, none. Rows of docs with a null id or text are left out and count for nothing; empty texts count as documents. Each row is a document and a query of its own, also where ids repeat; null query ids are passed on. A query column named rank, doc_id or score is called query_rank and so on. Other columns are not looked at. Empty tables give no rows. Queries are held by the driver, queries_a_pass at a time.
    """
    spark, kind = docs.sparkSession, queries.schema[query_id].dataType.simpleString()
    name = f"query_{query_id}" if query_id in ("rank", "doc_id", "score") else query_id
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found, held = [], []

    def search() -> None:
        own = Queries([i for i, _ in held], [x for _, x in held])
        index = cut(source.mapInArrow(_index(own.terms, block_docs), _INDEX), "blocks")
        counts = {r["term"]: r["docs"] for r in index.select("terms", "lengths").mapInArrow(_frequencies(len(own.terms)), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
        n, words = counts.get(-1, 0), counts.get(-2, 0)
        df = np.array([counts.get(t, 0) for t in range(len(own.terms))], float)
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(words, 1) / max(n, 1)
        run = lambda floor: index.mapInArrow(_search(own, idf, mean, k, k1, b, floor), "q int, doc_id long, score double").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")))
        floor = {r["q"]: r["score"] for r in run(None).where(F.col("rank") == k).select("q", "score").collect()}
        names = spark.createDataFrame(list(enumerate(own.ids)), f"q int, name {kind}")
        found.append(run(floor).where(F.col("rank") <= k).join(names, "q").select(F.col("name").alias(name), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        held.clear()

    for row in queries.select(F.col(query_id).alias("i"), F.col(query_text).cast("string").alias("t")).toLocalIterator():
        held.append(tuple(row))
        if len(held) == queries_a_pass:
            search()
    if held:
        search()
    if not found:
        return spark.createDataFrame([], f"`{name}` {kind}, rank int, doc_id long, score double")
    return reduce(DataFrame.unionByName, found)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, q, w, count(*) AS qn FROM (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS w FROM benchmark) GROUP BY item_id, q, w),
s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
tf AS (SELECT doc_id, r, w, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, r, unnest(ws) AS w, len(ws) AS dl FROM d) WHERE w IN (SELECT w FROM q) GROUP BY doc_id, r, w),
idf AS (SELECT w, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, s GROUP BY w),
scored AS (SELECT q, item_id, doc_id, round(sum(qn * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / mean))), {PLACES}) AS score FROM q JOIN tf USING (w) JOIN idf USING (w), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {TOP}"""

QUERIES = {"op5_topk_search": op5_topk_search}
ORACLE_SQL = {"op5_topk_search": _SQL}
