"""Queries of the index, stores, prompts, statistics and benches, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions import text as T
from pagemill.operators import bench as B
from pagemill.operators import cells as C
from pagemill.operators import samples as S
from pagemill.operators import search as R
from pagemill.plans import queries as P
from pagemill.sinks import index as I

Query = Callable[[SparkSession, str], DataFrame]
BUDGETS = [None, 4, 12]


def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every document, with the grammar line."""
    return C.serialise(C.run_lengths(C.cells(P.paged(spark, sf_dir))), grammar=True)


def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stats(C.cells(P.paged(spark, sf_dir)))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.plain_text(P.paged(spark, sf_dir))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.page_records(C.cells(P.paged(spark, sf_dir)))


def cells_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index cells with their pages' sizes; pages 4 and on are left out of the pages table, so that their ids are computed."""
    found = C.cells(P.paged(spark, sf_dir))
    return I.join_pages(C.index(found), I.page_records(found).where("z < 3").withColumn("page_id", F.concat("page_id", F.lit("_own")))).select("cell_id", "page_id", "width_px", "height_px")


def resolved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells joined with a dictionary that lacks tables' payloads."""
    found = C.cells(P.paged(spark, sf_dir))
    return C.resolve(found.drop("text"), C.dictionary(found.where("cell_type <> 'TABLE'"))).select("doc_id", "z", "y", "text")


def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.budget_sweep(C.cells(P.paged(spark, sf_dir)), BUDGETS).groupBy("doc_id", "budget").agg(F.count("*").alias("cells"), F.sum("importance").alias("importance"))


def collection_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as collections, documents in them, and the documents' lines as their cells: how much each collection holds."""
    docs = P.table(spark, sf_dir, "documents")
    names = docs.where("source IS NOT NULL").select("source").distinct().select(F.col("source").alias("id"), F.upper("source").alias("name"))
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("collection_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path"))
    held = C.cells(P.paged(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("document_id"), "z", "y", "importance")
    store = {"collections": names, "documents": own, "cells": held}
    return I.collection_cells(store, "SRC1").groupBy("source_path").agg(F.count("*").alias("cells"), F.max("importance").alias("importance"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer prompt for each benchmark item, from the three documents of best BM25 score."""
    asked = P._asked(spark, sf_dir)
    hits = R.best(R.bm25(P.table(spark, sf_dir, "documents"), asked, "doc_id", "query_id", k=3), 3, "query_id", "doc_id")
    texts = P.table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("page"), "text")
    context = R.answer_context(R.small(hits, of=asked).join(texts, "doc_id"))
    return R.prompts(context, asked.select("query_id", F.col("query_text").alias("question")))


def sample_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", S.qa_prompt(F.col("text")).alias("qa"), S.summary_prompt(F.col("source"), F.col("text"), "de").alias("summary"))


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a sample of the document of its number, with a label; every third document has no title."""
    docs = P.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("source")).alias("title"))
    turns = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    return S.with_labels(turns, docs)


def gold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates of documents, without digits, against the documents as gold texts; every fourth has none."""
    docs = P.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select(F.col("doc_id").cast("string").alias("rel"), F.regexp_replace("text", "[0-9]", "").alias("text"))
    gold = docs.where("doc_id % 4 > 0").select(F.col("doc_id").cast("string").alias("rel"), F.lit(None).cast("int").alias("page"), F.col("text").alias("gold"))
    return B.with_gold(rows, gold).select("rel", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"))


def page_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents against the first line of each as gold."""
    pages = C.lines(P.paged(spark, sf_dir)).groupBy(F.col("doc_id").cast("string").alias("rel"), F.col("z").alias("page")).agg(C.ordered_text(by=("line",)).alias("text"))
    gold = pages.select("rel", "page", F.substring_index("text", "\n", 1).alias("gold"))
    return B.page_rows(pages, gold).select("rel", "page", "tokens_gold", "tokens_page", "compression_ratio")


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select("o_orderkey", T.grouped_thousands(F.floor(price)).alias("grouped"), T.number_ratio(F.floor(price / 100).cast("double")).alias("ratio"), T.currency(F.floor(price).cast("double")).alias("currency"), T.round_binary(T.token_factor(price, F.col("o_orderkey") % 3), 6).alias("factor"), T.round_binary(T.page_precision(1 - price / 200_000), 6).alias("precision"))


def made_up_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts with hyphens at line ends, compatibility characters, tabs and control characters, one for each customer."""
    names = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("inter-\nnational "), F.col("c_name"), F.lit("-\n  tail\n---\nﬁne ½ a\tb\u0007c\fＡＢ end-")).alias("text"))
    return C.lines(names)


QUERIES: dict[str, Query] = {f.__name__: f for f in (context_text, context_stats, plain_text, page_records, cells_with_pages, resolved_cells, budget_sweep, collection_cells, prompts, sample_prompts, document_labels, gold_rates, page_rates, number_formats, made_up_lines)}

_LINES = f"WITH {P._CELLS}"
_CTX = rf"""{P._WITH}, b AS (SELECT *, CASE WHEN lag(code_id) OVER (PARTITION BY doc_id ORDER BY o) = code_id THEN 0 ELSE 1 END AS new FROM o),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY o) AS island FROM b),
r AS (SELECT *, CASE WHEN new = 1 THEN count(*) OVER (PARTITION BY doc_id, island) - 1 ELSE 0 END AS rle FROM i),
t AS (SELECT *, list_filter(list_transform(string_split_regex(text, '[|\t,]'), lambda x: trim(x)), lambda x: x <> '') AS parts,
greatest(1, CASE WHEN contains(text, '|') THEN len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) ELSE len(regexp_extract_all(text, '\S+')) END) AS cols FROM r),
s AS (SELECT *, CASE WHEN cell_type <> 'TABLE' THEN text WHEN strlen(text) <= 192 AND len(parts) > 0 THEN array_to_string(parts, ', ') END AS body FROM t),
shown AS (SELECT *, CASE WHEN body IS NULL THEN concat('[table rows=1 cols=', cols, ']') ELSE (CASE WHEN cell_type = 'TABLE' THEN '[csv ' ELSE '' END) || (CASE WHEN strlen(body) <= 96 THEN body ELSE left(body, 96) || '...' END) || (CASE WHEN cell_type = 'TABLE' THEN ']' ELSE '' END) END AS p FROM s),
ctx AS (SELECT doc_id, '<ctx3d grid=coarse codeset=HASH256 preset=reports budget=auto>' || chr(10) || string_agg(printf('(z=%d,x=%d,y=%d,w=%d,h=%d,code=%s,rle=%d,imp=%d,type=%s) "', z, x, y, w, h, left(code_id, 16), rle, importance, cell_type) || replace(p, '"', '\"') || '"', chr(10) ORDER BY o) || chr(10) AS body FROM shown GROUP BY doc_id)"""
_TOK = lambda x: rf"CAST(len(regexp_extract_all({x}, '\S+')) AS INT)"
_PAGES = "pages_ AS (SELECT doc_id, z, string_agg(text, chr(10) ORDER BY y) AS text FROM cells GROUP BY doc_id, z)"
_HITS = f"WITH {P._ASKED}, {P._BM25('SELECT doc_id AS id, text FROM documents')}, hits AS ({P._RANKED('SELECT * FROM lexical', 3, 'doc_id')})"

ORACLE_SQL: dict[str, str] = {
    "context_text": _CTX + """ SELECT doc_id, body || chr(10) || 'grammar: --select "z=0,x=0..1024,y=0..4096"' || chr(10) || '</ctx3d>' || chr(10) AS context FROM ctx""",
    "context": _CTX + " SELECT doc_id, body || '</ctx3d>' || chr(10) AS context FROM ctx",
    "context_stats": _CTX + f""", decoded AS (SELECT doc_id, {_TOK("string_agg(text, chr(10) ORDER BY z, y)")} AS tokens_raw, count(*) AS cells, count(DISTINCT code_id) AS unique_payloads FROM cells GROUP BY doc_id)
SELECT doc_id, tokens_raw, {_TOK("body || '</ctx3d>'")} AS tokens_context, cells, unique_payloads, round(tokens_raw / CAST({_TOK("body || '</ctx3d>'")} AS DOUBLE), 6) AS savings_ratio FROM decoded JOIN ctx USING (doc_id)""",
    "plain_text": f"{_LINES}, p AS (SELECT doc_id, z, string_agg(text, chr(10) ORDER BY y) || chr(10) AS t FROM cells GROUP BY doc_id, z) SELECT doc_id, string_agg(t, chr(10) ORDER BY z) AS text FROM p GROUP BY doc_id",
    "page_records": f"{_LINES}, {_PAGES} SELECT printf('doc_%d_page_%04d', doc_id, z + 1) AS page_id, concat('doc_', doc_id) AS doc_id, z + 1 AS page_number, nullif({_TOK('text')}, 0) AS approx_tokens, 1024 AS width_px, 1400 AS height_px, z FROM pages_",
    "cells_with_pages": f"{P._WITH} SELECT printf('doc_%d_cell_%06d', doc_id, o + 1) AS cell_id, printf('doc_%d_page_%04d', doc_id, z + 1) || CASE WHEN z < 3 THEN '_own' ELSE '' END AS page_id, CASE WHEN z < 3 THEN 1024 END AS width_px, CASE WHEN z < 3 THEN 1400 END AS height_px FROM o",
    "resolved_cells": f"{_LINES} SELECT doc_id, z, y, CASE WHEN cell_type = 'TABLE' THEN '<missing>' ELSE text END AS text FROM cells",
    "budget_sweep": f"{_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, z, y, x) AS k FROM cells), b AS (SELECT unnest([NULL, 4, 12]) AS budget) SELECT doc_id, CAST(budget AS INT) AS budget, count(*) AS cells, CAST(sum(importance) AS BIGINT) AS importance FROM r, b WHERE budget IS NULL OR k <= budget GROUP BY doc_id, budget",
    "collection_cells": f"{_LINES} SELECT concat('doc/', doc_id) AS source_path, count(*) AS cells, max(importance) AS importance FROM cells JOIN documents d USING (doc_id) WHERE upper(d.source) = 'SRC1' GROUP BY doc_id",
    "prompts": _HITS + r""", c AS (SELECT query_id, string_agg(concat('[DOC: ', source, ', page 1]', chr(10), text, chr(10), chr(10)), '' ORDER BY rank) AS context FROM hits JOIN documents USING (doc_id) GROUP BY query_id)
SELECT query_id, concat('You are a helpful assistant. Answer only with the information in CONTEXT.', chr(10), chr(10), '=== CONTEXT START ===', chr(10), context, '=== CONTEXT END ===', chr(10), chr(10), 'Question: ', trim(query_text), chr(10), 'Answer:') AS prompt FROM c JOIN asked USING (query_id)""",
    "sample_prompts": f"""SELECT doc_id, concat('Here is a fragment of a document:', chr(10), text, chr(10), chr(10), 'Generate a helpful question and a precise answer following the format:', chr(10), 'Question: ...', chr(10), 'Answer: ...', chr(10), 'Language: en.') AS qa,
concat('Write a concise summary of the document section. Language: de.', chr(10), chr(10), 'Heading: ', coalesce(source, '(untitled)'), chr(10), chr(10), CASE WHEN length(text) > {S.SUMMARY_MOST} THEN left(text, {S.SUMMARY_MOST}) || '…' ELSE text END) AS summary FROM documents WHERE text IS NOT NULL""",
    "document_labels": "SELECT c.conv_id AS doc_id, c.turn, CASE WHEN d.doc_id % 3 > 0 AND trim(d.source) <> '' THEN d.source ELSE CAST(c.conv_id AS VARCHAR) END AS label FROM conversations c LEFT JOIN documents d ON c.conv_id = d.doc_id",
    "page_rates": f"{_LINES}, {_PAGES}, g AS (SELECT *, string_split(text, chr(10))[1] AS gold FROM pages_) SELECT CAST(doc_id AS VARCHAR) AS rel, z AS page, {_TOK('gold')} AS tokens_gold, {_TOK('text')} AS tokens_page, round(CASE WHEN {_TOK('text')} = 0 THEN 0 ELSE {_TOK('gold')} / CAST({_TOK('text')} AS DOUBLE) END, 6) AS compression_ratio FROM g",
    "number_formats": r"""WITH v AS (SELECT o_orderkey, o_totalprice AS p, floor(o_totalprice) AS f, floor(o_totalprice / 100) AS r FROM orders)
SELECT o_orderkey, replace(format('{:,}', CAST(f AS BIGINT)), ',', ' ') AS grouped, CASE WHEN r <= 0 THEN '0.0x' WHEN r >= 100 THEN printf('%.0fx', r) WHEN r >= 10 THEN printf('%.1fx', r) ELSE printf('%.2fx', r) END AS ratio,
CASE WHEN f >= 1 THEN printf('~$%.2f', f) WHEN f >= 0.01 THEN printf('~$%.3f', f) ELSE printf('~$%.4f', f) END AS currency, CASE WHEN o_orderkey % 3 > 0 THEN round(p / (o_orderkey % 3), 6) END AS factor, round(greatest(0.0, least(1.0, 1.0 - (1 - p / 200000))), 6) AS precision FROM v""",
    "made_up_lines": """SELECT c_custkey AS doc_id, CAST(z AS INT) AS z, CAST(line AS INT) AS line, text FROM (SELECT c_custkey, unnest([0, 0, 0, 1]) AS z, unnest([0, 1, 2, 0]) AS line, unnest(['international ' || c_name || 'tail', 'fine 1⁄2 abc', NULL, 'AB end']) AS text FROM customer) WHERE text IS NOT NULL""",
}
