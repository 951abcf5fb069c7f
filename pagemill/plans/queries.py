"""A query for each operator family over the given tables, and the SQL that its result is held against.

The tables' texts have no form feeds; every eighth line ends a page here, so that documents have several.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import bench as B
from pagemill.operators import cells as C
from pagemill.operators import chunks as K
from pagemill.operators import samples as S
from pagemill.operators import search as R
from pagemill.sources import convert, files

BUDGET, WINDOW, TOP = 12, 2, 10
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 8).cast("int")), lambda i: F.array_join(F.slice(lines, i * 8 + 1, 8), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.let(F.split("text", "\n"), groups), "\n\f").alias("text"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cells(paged(spark, sf_dir))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.index(_cells(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), T.hash_embedding(F.col("text")).alias("query_embedding"))


def cell_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("cell_type").agg(F.count("*").alias("cells"), F.countDistinct("code_id").alias("payloads"), F.sum(F.octet_length("text")).alias("octets"), F.round(F.avg("importance"), 6).alias("mean_importance"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dictionary(_cells(spark, sf_dir))


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.budget(_cells(spark, sf_dir), BUDGET).select("doc_id", "z", "y", "importance", "code_id")


def dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_window(_cells(spark, sf_dir), WINDOW).select("doc_id", "z", "y", "code_id")


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_lengths(_cells(spark, sf_dir)).select("doc_id", "z", "y", "rle")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deltas(_cells(spark, sf_dir)).select("doc_id", "ordinal", "dz", "dx", "dy")


def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_deltas(C.deltas(_cells(spark, sf_dir))).drop("ordinal")


def number_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.number_guards(_cells(spark, sf_dir))


def guard_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cells(spark, sf_dir)
    return C.verify_guards(C.number_guards(found), found, ["%", "kg", "usd"]).groupBy("issue", "units").agg(F.count("*").alias("guards"))


def box_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_box(_cells(spark, sf_dir), *C.parse_selector("z=1,x=0..1024,y=150..64")).select("doc_id", "z", "y", "text")


def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decode(_cells(spark, sf_dir))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.serialise(C.run_lengths(_cells(spark, sf_dir)))


def redacted_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.manifest(C.redact(_cells(spark, sf_dir), ["header", "table"])).select("doc_id", "cell_index", "code_hash", "cell_type", "text", "preview")


def encode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.encode_summary(_cells(spark, sf_dir), BUDGET)


def index_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("cell_id", "doc_id", "page_id", "kind", F.round("importance", 4).alias("importance"), F.array_join(F.transform("bbox", lambda v: v.cast("int").cast("string")), ",").alias("bbox"))


def _chunks(mode: str, **parameters: int) -> Query:
    return lambda spark, sf_dir: K.chunks(_cells(spark, sf_dir), mode, **parameters).withColumn("importance_mean", F.round("importance_mean", 6))


def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(_cells(spark, sf_dir)).where(K.parse_filter("type=TEXT,type=TABLE,min_importance=105")).select("doc", "chunk_index", "dominant_type", "token_count")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.embed(table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.posexplode("embedding").alias("dim", "v")).where("v > 0").select("item_id", "dim", F.round("v", 6).alias("v"))


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_top_k(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), TOP, "vec_id", "query_id")


def policy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("public", "internal", "confidential", "restricted", "other"))), F.col("label") % 5 + 1)
    stored = table(spark, sf_dir, "embeddings").withColumn("sensitivity", level).withColumn("text_encrypted", F.when(F.col("vec_id") % 7 == 0, F.lit("x")))
    return R.dense_top_k(R.allowed(stored, "internal", external=True), _asked(spark, sf_dir), TOP, "vec_id", "query_id", T.cosine)


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best(R.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "doc_id", "query_id", k=TOP), TOP, "query_id", "doc_id")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return R.hybrid(R.embed(stored), _asked(spark, sf_dir), TOP, "page_id", "query_id")


def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = _asked(spark, sf_dir)
    hits = R.best(R.bm25(docs, asked, "doc_id", "query_id", k=3), 3, "query_id", "doc_id")
    return R.answer_context(R.small(hits, of=asked).join(docs, "doc_id").select("query_id", "rank", "source", F.lit(1).alias("page"), "text"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pricing = spark.createDataFrame([("en", "src1", 2.0, None, 6.0, None), ("en", "src2", None, 500.0, None, None), ("de", "src3", None, None, None, None)], "provider string, model string, prompt_per_1k double, prompt_per_1m double, completion_per_1k double, completion_per_1m double")
    usage = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("provider"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("model"), F.col("n_chars").alias("raw_tokens"), T.word_count(F.col("text")).alias("prompt_tokens"), F.lit(10).alias("completion_tokens"))
    return R.price(usage, pricing).select("doc_id", *(F.round(c, 6).alias(c) for c in ("prompt_cost", "completion_cost", "saved_cost")))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(_indexed(spark, sf_dir)).select("doc_id", "section", "title", "text", F.array_join("cell_ids", ",").alias("cell_ids"))


def qa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.qa_samples(_indexed(spark, sf_dir)).withColumn("cell_ids", F.array_join("cell_ids", ","))


def summary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary_samples(_indexed(spark, sf_dir)).withColumn("cell_ids", F.array_join("cell_ids", ","))


def rag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _indexed(spark, sf_dir)
    return S.rag_samples(S.qa_samples(found), found).select("sample_id", "task", "doc_id", "question", "answer", "lang", "context")


def hf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _indexed(spark, sf_dir)
    return S.hf_train(S.qa_samples(found), S.summary_samples(found), found)


def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _indexed(spark, sf_dir)
    return S.task_metrics(S.qa_samples(found), S.summary_samples(found))


def _export(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _indexed(spark, sf_dir)
        out = S.export(S.compose_context(S.qa_samples(found), found), kind)
        nested = next((c for c in ("messages", "conversations") if c in out.columns), None)
        return out.withColumn(nested, F.array_join(F.transform(nested, lambda m: F.concat_ws("=", *(m[f.name] for f in out.schema[nested].dataType.elementType.fields))), "\n---\n")) if nested else out

    return run


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("gold"), F.regexp_replace("text", "7", "1").alias("predicted"))


def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.numeric_stats(_pairs(spark, sf_dir))


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("gold"), F.initcap("text").alias("said"))
    return pair.select("conv_id", "turn", F.round(T.character_error_rate(F.col("gold"), F.col("said")), 6).alias("cer"), F.round(B.word_error_rate("gold", "said"), 6).alias("wer"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("ms"), T.word_count(F.col("text")).alias("tokens"), F.round(F.col("n_chars") / F.greatest(F.lit(1), T.word_count(F.col("text"))), 6).alias("savings"))


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.corpus_rollup(_measured(spark, sf_dir))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.gate(B.corpus_rollup(_measured(spark, sf_dir)), {"mean_value": 2.0, "p50": 1e9, "p95": 10.0})


def precision_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.binned(_measured(spark, sf_dir), [0, 100, 1000, 1000000], "tokens", "lang", "savings")


def accuracy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("cer")), "doc_id", "left")
    return B.accuracy_by_run(rows.select(F.col("source").alias("run_id"), (F.col("tokens") / 100).cast("int").alias("pages"), "tokens", F.col("tokens").alias("cells"), "cer"))


def customer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.table_markdown(table(spark, sf_dir, "customer"), "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.col("page_id"), F.concat("url", F.lit(".html")).alias("path"), F.lit("html").alias("format"), F.encode("html", "UTF-8").alias("content"))
    return files.to_text(found)


def event_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat JSON objects as headings by sorted key."""
    pairs = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("### "), e["key"], F.lit("\n\n"), convert.cell_column(e["value"]))), "\n\n").alias("markdown"))


def url_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.file_format(F.col("url")).alias("format"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (cell_profile, cells, dictionary, budget, dedup_window, run_lengths, deltas, delta_round_trip, number_guards, guard_alerts, box_select, decode, context, redacted_manifest, encode_metrics, index_cells, chunk_filter, hash_embedding, dense_search, policy_search, bm25, hybrid_search, answer_contexts, costs, sections, qa_samples, summary_samples, rag_samples, hf_train, task_metrics, numeric_stats, error_rates, corpus_rollup, gates, precision_bins, accuracy_runs, customer_markdown, page_text, event_markdown, url_formats)}
QUERIES |= {"chunks_cells": _chunks("cells", size=8, overlap=2), "chunks_tokens": _chunks("tokens", most=120, overlap=20), "chunks_headings": _chunks("headings", most=200), "chunks_tables": _chunks("table_rows", size=4)}
QUERIES |= {f"export_{k}": _export(k) for k in ("hf_chat", "alpaca", "sharegpt", "openai", "axolotl_chat", "axolotl_text", "rag")}

_W = C.PRESETS["reports"].wrap_bytes
_CELLS = rf"""docs AS (SELECT doc_id, regexp_replace(text, '((?:[^\n]*\n){{8}})', '\1' || chr(12), 'g') AS text FROM documents WHERE text IS NOT NULL),
pg AS (SELECT doc_id, unnest(range(0, len(p))) AS z, unnest(p) AS page FROM (SELECT doc_id, string_split(text, chr(12)) AS p FROM docs)),
raw AS (SELECT doc_id, z, unnest(range(0, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, z, string_split(CASE WHEN ends_with(page, chr(10)) THEN left(page, length(page) - 1) ELSE page END, chr(10)) AS l FROM pg)),
worded AS (SELECT *, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS words FROM raw),
wrapped AS (SELECT doc_id, z, n, unnest(range(0, len(w))) AS m, unnest(w) AS line FROM (SELECT doc_id, z, n, CASE WHEN strlen(line) <= {_W} OR len(words) = 0 THEN [trim(line)] ELSE string_split(list_reduce(words, lambda a, w: a || CASE WHEN strlen(string_split(a, chr(10))[-1]) + strlen(w) + 1 > {_W} THEN chr(10) ELSE ' ' END || w), chr(10)) END AS w FROM worded)),
normal AS (SELECT doc_id, z, n, m, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM wrapped),
numbered AS (SELECT doc_id, CAST(z AS INT) AS z, CAST(row_number() OVER (PARTITION BY doc_id, z ORDER BY n, m) - 1 AS INT) AS line, text, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS letters FROM normal WHERE text <> ''),
caps AS (SELECT *, length(letters) > 3 AND NOT regexp_matches(letters, '[^\p{{Lu}}]') AS caps FROM numbered),
typed AS (SELECT *, CASE WHEN contains(text, '|') OR regexp_matches(lower(text), '{T.TABLE_WORDS}') THEN 'TABLE' WHEN caps THEN 'HEADER' WHEN contains(lower(text), 'page ') OR contains(lower(text), 'confidential') THEN 'FOOTER' ELSE 'TEXT' END AS cell_type FROM caps),
cells AS MATERIALIZED (SELECT doc_id, z, 64 AS x, CAST(64 + line * 30 AS INT) AS y, 896 AS w, 24 AS h, sha256(text) AS code_id, cell_type, CAST(greatest(0, least(255, CASE cell_type WHEN 'HEADER' THEN 220 WHEN 'FOOTER' THEN 20 WHEN 'TABLE' THEN 160 ELSE 100 END + CASE WHEN caps THEN 35 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 20 ELSE 0 END + CASE WHEN line < 5 THEN 15 ELSE 0 END - 10 * (strlen(text) // 120))) AS INT) AS importance, text FROM typed)"""
_O = "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY z, y, x) - 1 AS o, count(*) OVER (PARTITION BY doc_id) AS n, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS tokens FROM cells)"
_GUARDS = f"guards AS (SELECT doc_id, z, x, y, unnest(list_zip(regexp_extract_all(lower(text), '{T.GUARD}', 1), regexp_extract_all(lower(text), '{T.GUARD}', 2)), max_depth := 1) AS g, text FROM cells), g AS (SELECT doc_id, z, x, y, coalesce(g[2], '') AS units, sha1(regexp_replace(g[1], '[^0-9]', '', 'g')) AS sha1, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM guards)"
_INDEX = "idx AS MATERIALIZED (SELECT printf('doc_%d_cell_%06d', doc_id, o + 1) AS cell_id, concat('doc_', doc_id) AS doc_id, printf('doc_%d_page_%04d', doc_id, z + 1) AS page_id, CASE cell_type WHEN 'HEADER' THEN 'heading' ELSE lower(cell_type) END AS kind, text, importance, x, y, w, h FROM o)"
_FIRST = lambda x, n: f"array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')[1:{n}], ' ')"
_QA = rf"""led AS (SELECT doc_id, cell_id, kind, trim(text) AS t, lead(kind) OVER w AS k2, lead(trim(text)) OVER w AS t2, lead(cell_id) OVER w AS id2 FROM idx WINDOW w AS (PARTITION BY doc_id ORDER BY cell_id)),
pair AS (SELECT *, coalesce(strlen(t) < {S.QA_CONTEXT_BYTES} AND k2 IN ('text', 'heading') AND t2 <> '', false) AS more FROM led WHERE kind IN ('text', 'heading') AND strlen(t) >= {S.QA_LEAST_BYTES}),
said AS (SELECT doc_id, cell_id, CASE WHEN more THEN cell_id || ',' || id2 ELSE cell_id END AS cell_ids, CASE WHEN more THEN t || chr(10) || chr(10) || t2 ELSE t END AS context FROM pair),
qa AS MATERIALIZED (SELECT printf('qa_%06d', row_number() OVER (ORDER BY doc_id, cell_id)) AS sample_id, 'qa' AS task, doc_id, cell_ids, '{S.QUESTION}' AS question, {_FIRST("context", 60)} AS answer, 'en' AS lang, strlen(context) AS context_chars, context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cell_id) AS k FROM said) WHERE k <= {S.QA_A_DOC})"""
_SECTIONS = r"""marked AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cell_id) AS section FROM idx WHERE kind IN ('heading', 'text')),
sections AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(trim(text)) FILTER (kind = 'heading') AS title, string_agg(trim(text), chr(10) || chr(10) ORDER BY cell_id) FILTER (kind = 'text') AS text, string_agg(cell_id, ',' ORDER BY cell_id) AS cell_ids FROM marked GROUP BY doc_id, section HAVING coalesce(string_agg(trim(text), '') FILTER (kind = 'text'), '') <> '')"""
_SUMMARIES = rf"""summaries AS MATERIALIZED (SELECT printf('summary_%06d', row_number() OVER (ORDER BY doc_id, section)) AS sample_id, 'summary' AS task, doc_id, cell_ids, title, {_FIRST("coalesce(title, '(untitled)') || chr(10) || chr(10) || CASE WHEN length(text) > 12000 THEN left(text, 12000) || '…' ELSE text END", 80)} AS summary, 'en' AS lang, CAST(length(text) AS INT) AS context_chars, length(text) > {S.SUMMARY_MOST} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS k FROM sections WHERE length(text) >= {S.SUMMARY_LEAST}) WHERE k <= {S.SUMMARIES_A_DOC})"""
_EMBED = lambda x: f"list_transform(range(0, 64), lambda i: CAST(len(list_filter(list_transform(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5('1337:' || w), 1, 8) AS BIGINT) % 64), lambda b: b = i)) AS DOUBLE))"
_UNIT = lambda x: f"CASE WHEN list_dot_product({x}, {x}) > 0 THEN list_transform({x}, lambda v: v / sqrt(list_dot_product({x}, {x}))) ELSE {x} END"
_ASKED = f"counted AS (SELECT item_id AS query_id, text AS query_text, {_EMBED('text')} AS e FROM benchmark), asked AS MATERIALIZED (SELECT query_id, query_text, {_UNIT('e')} AS qe FROM counted)"
_TERMS = lambda x: rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BM25 = lambda records: f"""toks AS (SELECT id, {_TERMS('text')} AS t FROM ({records})),
al AS (SELECT avg(len(t)) AS avg_len FROM toks),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY id, len, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), mx AS (SELECT max(df) AS n FROM df),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS('query_text')}) AS term FROM asked) GROUP BY query_id, term),
lexical AS (SELECT query_id, id, round(sum(times * greatest(0.0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), mx, al GROUP BY query_id, id)"""  # noqa: E731
_RANKED = lambda scored, k, name: f"SELECT query_id, id AS {name}, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({scored})) WHERE rank <= {k}"
_CHUNK = lambda mode: f"""agg AS (SELECT doc_id, k, min(o) AS cell_start, max(o) AS cell_end, arg_min(z, o) AS z_start, arg_max(z, o) AS z_end, string_agg(text, chr(10) ORDER BY o) AS text, CAST(sum(tokens) AS INT) AS token_count, round(sum(importance) / count(*) / 255, 6) AS importance_mean FROM m GROUP BY doc_id, k),
types AS (SELECT doc_id, k, arg_max(cell_type, 10 * c - list_position(['TEXT', 'TABLE', 'FIGURE', 'FOOTER', 'HEADER'], cell_type)) AS dominant_type FROM (SELECT doc_id, k, cell_type, count(*) AS c FROM m GROUP BY doc_id, k, cell_type) GROUP BY doc_id, k),
made AS (SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cell_start) - 1 AS INT) AS chunk_index, z_start, z_end, CAST(cell_start AS INT) AS cell_start, CAST(cell_end AS INT) AS cell_end, text, token_count, dominant_type, importance_mean FROM agg JOIN types USING (doc_id, k)),
chunks AS (SELECT sha256(encode(doc) || unhex(printf('%08x%08x%016x%016x%016x', 1, {mode}, chunk_index, cell_start, cell_end))) AS chunk_id, * FROM made)"""  # noqa: E731
_BY_CELLS = "spans AS (SELECT doc_id, unnest(range(0, CAST(ceil(greatest(n - 8, 0) / 6.0) AS INT) + 1)) AS k FROM (SELECT DISTINCT doc_id, n FROM o)), m AS (SELECT o.*, k FROM spans JOIN o ON o.doc_id = spans.doc_id AND o.o >= k * 6 AND o.o < k * 6 + 8)"
_BY_HEADINGS = "h AS (SELECT *, sum(CASE WHEN cell_type = 'HEADER' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o) AS k FROM o), c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id, k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE k > 0), m AS (SELECT * FROM c WHERE before < 200 OR cell_type = 'HEADER')"
_BY_TABLES = "t AS (SELECT *, o - row_number() OVER (PARTITION BY doc_id ORDER BY o) AS island FROM o WHERE cell_type = 'TABLE'), m AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY o) - 1) // 4 + island * 100000 AS k FROM t)"
_NUM = lambda c, s: f"{s}0 AS (SELECT doc_id, unnest(range(0, len(n))) AS p, regexp_replace(unnest(n), '[^0-9.\\-]', '', 'g') AS value, coalesce(lower(unnest(u)), '') AS unit FROM (SELECT doc_id, regexp_extract_all({c}, '{T.NUMBER}', 1) AS n, regexp_extract_all({c}, '{T.NUMBER}', 2) AS u FROM documents)), {s} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY p) AS k FROM {s}0)"
_MEASURED = "measured AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS ms, tokens, round(n_chars / CAST(greatest(1, tokens) AS DOUBLE), 6) AS savings FROM (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS INT) AS tokens FROM documents))"
_ROLLUP = "rollup AS (SELECT count(*) AS docs, round(coalesce(avg(savings), 0), 6) AS mean_value, coalesce(list_sort(list(savings))[count(*) // 2 + 1], 0) AS median_value, list_sort(list(ms))[CAST(round((count(*) - 1) * 0.5) AS INT) + 1] AS p50, list_sort(list(ms))[CAST(round((count(*) - 1) * 0.95) AS INT) + 1] AS p95 FROM measured)"
_ASK = "'Context:' || chr(10) || trim(context) || chr(10) || chr(10) || 'Question: ' || question"
_WITH = f"WITH {_CELLS}, {_O}"
_SAMPLES = f"{_WITH}, {_INDEX}, {_QA}"
_TURNS = lambda *t: " || chr(10) || '---' || chr(10) || ".join(f"'{who}=' || {what}" for who, what in t)

ORACLE_SQL: dict[str, str] = {
    "cell_profile": f"WITH {_CELLS} SELECT cell_type, count(*) AS cells, count(DISTINCT code_id) AS payloads, CAST(sum(strlen(text)) AS BIGINT) AS octets, round(avg(importance), 6) AS mean_importance FROM cells GROUP BY cell_type",
    "cells": f"WITH {_CELLS} SELECT * FROM cells",
    "dictionary": f"WITH {_CELLS} SELECT DISTINCT doc_id, code_id, text AS payload FROM cells",
    "budget": f"WITH {_CELLS} SELECT doc_id, z, y, importance, code_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, z, y, x) AS k FROM cells) WHERE k <= {BUDGET}",
    "dedup_window": f"WITH {_CELLS}, f AS (SELECT doc_id, code_id, z, min(y) AS y FROM cells GROUP BY doc_id, code_id, z), l AS (SELECT doc_id, code_id, list_reduce(list_transform(list(z ORDER BY z), lambda v: [v]), lambda a, v: CASE WHEN v[1] - a[-1] > {WINDOW} THEN list_concat(a, v) ELSE a END) AS kept FROM f GROUP BY doc_id, code_id) SELECT f.doc_id, f.z, f.y, f.code_id FROM f JOIN l ON f.doc_id = l.doc_id AND f.code_id = l.code_id AND list_contains(l.kept, f.z)",
    "run_lengths": f"{_WITH}, b AS (SELECT *, CASE WHEN lag(code_id) OVER (PARTITION BY doc_id ORDER BY o) = code_id THEN 0 ELSE 1 END AS new FROM o), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY o) AS island FROM b) SELECT doc_id, z, y, CAST(CASE WHEN new = 1 THEN count(*) OVER (PARTITION BY doc_id, island) - 1 ELSE 0 END AS INT) AS rle FROM i",
    "deltas": f"{_WITH} SELECT doc_id, CAST(o + 1 AS INT) AS ordinal, z - lag(z, 1, 0) OVER w AS dz, x - lag(x, 1, 0) OVER w AS dx, y - lag(y, 1, 0) OVER w AS dy FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY o)",
    "delta_round_trip": f"WITH {_CELLS} SELECT doc_id, code_id, z, x, y FROM cells",
    "number_guards": f"WITH {_CELLS}, {_GUARDS} SELECT doc_id, z, x, y, units, sha1 FROM g",
    "guard_alerts": f"WITH {_CELLS}, {_GUARDS} SELECT CASE WHEN units NOT IN ('', '%', 'kg', 'usd') THEN 'UnitNotAllowed' WHEN sha1(digits) <> sha1 THEN 'HashMismatch' END AS issue, units, count(*) AS guards FROM g GROUP BY ALL",
    "box_select": f"WITH {_CELLS} SELECT doc_id, z, y, text FROM cells WHERE z = 1 AND y <= 150 AND y + h >= 64",
    "decode": f"WITH {_CELLS} SELECT doc_id, string_agg(text, chr(10) ORDER BY z, y, x) AS text FROM cells GROUP BY doc_id",
    "redacted_manifest": f"{_WITH}, r AS (SELECT *, CASE WHEN cell_type IN ('HEADER', 'TABLE') THEN text ELSE '<redacted>' END AS t FROM o) SELECT doc_id, CAST(o AS INT) AS cell_index, code_id AS code_hash, cell_type, t AS text, CASE WHEN strlen(t) <= 96 THEN t ELSE left(t, 96) || '...' END AS preview FROM r",
    "encode_metrics": f"{_WITH}, {_GUARDS}, kept AS (SELECT doc_id, count(*) FILTER (cell_type <> 'FOOTER') AS kept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, z, y, x) AS k FROM cells) WHERE k <= {BUDGET} GROUP BY doc_id), gc AS (SELECT doc_id, count(*) AS gn FROM g GROUP BY doc_id) SELECT doc_id, max(z) + 1 AS pages, count(*) AS lines_total, count(*) AS cells_total, any_value(kept) AS cells_kept, coalesce(any_value(gn), 0) AS numguard_count, round(count(*) / count(DISTINCT code_id), 6) AS dedup_ratio, CAST(sum(tokens) AS BIGINT) AS tokens FROM o JOIN kept USING (doc_id) LEFT JOIN gc USING (doc_id) GROUP BY doc_id",
    "index_cells": f"{_WITH}, {_INDEX} SELECT cell_id, doc_id, page_id, kind, round(CAST(importance / 255 AS FLOAT), 4) AS importance, concat_ws(',', x, y, x + w, y + h) AS bbox FROM idx",
    "chunks_cells": f"{_WITH}, {_BY_CELLS}, {_CHUNK(0)} SELECT * FROM chunks",
    "chunks_headings": f"{_WITH}, {_BY_HEADINGS}, {_CHUNK(2)} SELECT * FROM chunks",
    "chunks_tables": f"{_WITH}, {_BY_TABLES}, {_CHUNK(3)} SELECT * FROM chunks",
    "chunk_filter": f"{_WITH}, {_BY_CELLS}, {_CHUNK(0)} SELECT doc, chunk_index, dominant_type, token_count FROM chunks WHERE dominant_type IN ('TEXT', 'TABLE') AND importance_mean >= round(105 / 255, 6)",
    "hash_embedding": f"WITH {_ASKED} SELECT query_id AS item_id, dim, round(v, 6) AS v FROM (SELECT query_id, CAST(unnest(range(0, 64)) AS INT) AS dim, unnest(qe) AS v FROM asked) WHERE v > 0",
    "dense_search": f"WITH {_ASKED} " + _RANKED("SELECT query_id, vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), qe), 6) AS score FROM embeddings, asked", TOP, "vec_id"),
    "policy_search": f"WITH {_ASKED} " + _RANKED("SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) AS score FROM embeddings, asked WHERE label % 5 IN (0, 1, 4) AND vec_id % 7 <> 0", TOP, "vec_id"),
    "bm25": f"WITH {_ASKED}, {_BM25('SELECT doc_id AS id, text FROM documents')} " + _RANKED("SELECT * FROM lexical", TOP, "doc_id"),
    "hybrid_search": f"WITH {_ASKED}, stored AS (SELECT page_id AS id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages), sc AS (SELECT id, {_EMBED('text')} AS e FROM stored), se AS (SELECT id, {_UNIT('e')} AS e FROM sc), {_BM25('SELECT * FROM stored')} " + _RANKED("SELECT query_id, id, round(0.7 * round(list_dot_product(e, qe), 6) + 0.3 * coalesce(score, 0), 8) AS score FROM (SELECT * FROM se, asked) LEFT JOIN lexical USING (query_id, id)", TOP, "page_id"),
    "answer_contexts": f"WITH {_ASKED}, {_BM25('SELECT doc_id AS id, text FROM documents')}, hits AS ({_RANKED('SELECT * FROM lexical', 3, 'doc_id')}) SELECT query_id, string_agg('[DOC: ' || source || ', page 1]' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS context, count(DISTINCT source) AS documents FROM hits JOIN documents USING (doc_id) GROUP BY query_id",
    "costs": "WITH u AS (SELECT doc_id, lang, source, n_chars, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS t, CASE WHEN lang = 'en' AND source = 'src1' THEN 2.0 WHEN lang = 'en' AND source = 'src2' THEN 0.5 END AS p, CASE WHEN lang = 'en' AND source = 'src1' THEN 6.0 WHEN lang = 'en' AND source = 'src2' THEN 0.0 END AS c FROM documents) SELECT doc_id, round(CAST(t AS DOUBLE) / 1000 * p, 6) AS prompt_cost, round(CAST(10 AS DOUBLE) / 1000 * c, 6) AS completion_cost, round(CAST(greatest(n_chars - t, 0) AS DOUBLE) / 1000 * p, 6) AS saved_cost FROM u",
    "sections": f"{_WITH}, {_INDEX}, {_SECTIONS} SELECT * FROM sections",
    "qa_samples": f"{_SAMPLES} SELECT * EXCLUDE (context) FROM qa",
    "summary_samples": f"{_WITH}, {_INDEX}, {_SECTIONS}, {_SUMMARIES} SELECT * FROM summaries",
    "rag_samples": f"{_SAMPLES} SELECT replace(sample_id, 'qa', 'rag') AS sample_id, 'rag' AS task, doc_id, question, answer, lang, context FROM qa",
    "hf_train": f"{_SAMPLES}, {_SECTIONS}, {_SUMMARIES}, sc AS (SELECT sample_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY p) AS context FROM (SELECT sample_id, unnest(range(0, len(c))) AS p, unnest(c) AS cell_id FROM (SELECT sample_id, string_split(cell_ids, ',') AS c FROM summaries)) JOIN idx USING (cell_id) GROUP BY sample_id) SELECT sample_id AS id, task, question, answer, NULL AS summary, context, doc_id FROM qa UNION ALL SELECT sample_id, task, NULL, NULL, summary, context, doc_id FROM summaries JOIN sc USING (sample_id)",
    "task_metrics": f"{_SAMPLES}, {_SECTIONS}, {_SUMMARIES} SELECT 'qa' AS task, count(*) AS samples, CAST(0 AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens FROM qa UNION ALL SELECT 'summary', count(*), 0, 0 FROM summaries",
    "export_hf_chat": f"{_SAMPLES} SELECT sample_id AS id, task, doc_id, {_TURNS(('user', _ASK), ('assistant', 'answer'))} AS messages FROM qa",
    "export_alpaca": f"{_SAMPLES} SELECT 'Answer the question using only the document context.' AS instruction, {_ASK} AS input, answer AS output FROM qa",
    "export_sharegpt": f"{_SAMPLES} SELECT sample_id AS id, {_TURNS(('human', _ASK), ('gpt', 'answer'))} AS conversations FROM qa",
    "export_openai": f"{_SAMPLES} SELECT {_TURNS(('system', chr(39) + 'You are an assistant and must answer strictly from the provided document context.' + chr(39)), ('user', _ASK), ('assistant', 'answer'))} AS messages FROM qa",
    "export_axolotl_chat": f"{_SAMPLES} SELECT {_TURNS(('user', _ASK), ('assistant', 'answer'))} AS messages FROM qa",
    "export_axolotl_text": f"{_SAMPLES} SELECT 'Context:' || chr(10) || trim(context) || chr(10) || chr(10) || 'Answer:' || chr(10) || answer AS text FROM qa",
    "export_rag": f"{_SAMPLES} SELECT sample_id AS id, doc_id, question, answer, context, lang FROM qa",
    "numeric_stats": f"WITH {_NUM('text', 'g')}, {_NUM(chr(114) + 'eplace(text, ' + chr(39) + '7' + chr(39) + ', ' + chr(39) + '1' + chr(39) + ')', 's')}, j AS (SELECT coalesce(g.doc_id, s.doc_id) AS doc_id, count(*) FILTER (g.k IS NOT NULL AND s.k IS NOT NULL) AS m, count(g.k) AS ng, count(s.k) AS ns, count(*) FILTER (g.unit = s.unit) AS u FROM g FULL JOIN s ON g.doc_id = s.doc_id AND g.value = s.value AND g.k = s.k GROUP BY 1), pr AS (SELECT d.doc_id, m, u, coalesce(m / nullif(ns, 0), CASE WHEN coalesce(ng, 0) = 0 THEN 1.0 ELSE 0.0 END) AS p, coalesce(m / nullif(ng, 0), CASE WHEN coalesce(ns, 0) = 0 THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN j USING (doc_id)) SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(coalesce(u / nullif(m, 0), 1.0), 6) AS units_ok FROM pr",
    "corpus_rollup": f"WITH {_MEASURED}, {_ROLLUP} SELECT * FROM rollup",
    "gates": f"WITH {_MEASURED}, {_ROLLUP} SELECT * FROM (SELECT 'mean_value' AS metric, mean_value AS value, 2.0::DOUBLE AS most FROM rollup UNION ALL SELECT 'p50', p50, 1e9 FROM rollup UNION ALL SELECT 'p95', p95, 10.0 FROM rollup) WHERE value > most",
    "precision_bins": f"WITH {_MEASURED}, bins AS (SELECT * FROM (VALUES (0, 0, 100), (1, 100, 1000), (2, 1000, 1000000), (3, 1000000, NULL)) b(bin, low, high)) SELECT l.lang, bin, low, count(m.doc_id) AS n, coalesce(round(avg(savings), 6), 0) AS mean_savings FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN bins LEFT JOIN measured m ON m.lang = l.lang AND tokens >= low AND (high IS NULL OR tokens < high) GROUP BY l.lang, bin, low",
    "accuracy_runs": f"WITH {_MEASURED} SELECT source AS run_id, round(sum(tokens) / sum(greatest(1, tokens // 100)), 6) AS tokens_per_page, round(sum(tokens) / sum(greatest(1, tokens // 100)), 6) AS cells_per_page, round(avg(toxic), 6) AS mean_cer FROM measured JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY source",
    "customer_markdown": "WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), l AS (SELECT (n - 1) // 50 AS chunk, n, '| ' || concat_ws(' | ', c_custkey, c_name, c_nationkey, c_mktsegment) || ' |' AS l FROM n) SELECT chunk, '## Rows ' || (chunk * 50 + 1) || '-' || (chunk * 50 + count(*)) || chr(10) || chr(10) || '| c_custkey | c_name | c_nationkey | c_mktsegment |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg(l, chr(10) ORDER BY n) AS text FROM l GROUP BY chunk",
    "event_markdown": "WITH k AS (SELECT event_id, unnest(list_sort(json_keys(props))) AS key, props FROM events) SELECT event_id, string_agg('### ' || key || chr(10) || chr(10) || json_extract_string(props, '$.' || key), chr(10) || chr(10) ORDER BY key) AS markdown FROM k GROUP BY event_id",
    "url_formats": "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(html|htm|xhtml)$') THEN 'html' ELSE 'unknown' END AS format FROM pages",
}
