"""Training samples from indexed cells, by a provider that is deterministic by default, and their export formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.store import numbered

QA_LEAST_BYTES, QA_CONTEXT_BYTES, SUMMARY_LEAST, SUMMARY_MOST, QA_A_DOC, SUMMARIES_A_DOC = 80, 900, 200, 12_000, 4, 3
QUESTION = "What key facts are stated in the excerpt?"
TASKS = ("qa", "summary")


def parse_tasks(said: str) -> list[str]:
    found = list(dict.fromkeys(t.strip().lower() for t in said.split(",") if t.strip()))
    if wrong := [t for t in found if t not in TASKS]:
        raise ValueError(f"unknown task {wrong[0]}")
    return found


QA_SYSTEM, SUMMARY_SYSTEM = "You are an analyst who must answer strictly from the provided context.", "You write concise, factual summaries of corporate documents."


def qa_prompt(context: Column, lang: str = "en") -> Column:
    return F.concat(F.lit("Here is a fragment of a document:\n"), context, F.lit(f"\n\nGenerate a helpful question and a precise answer following the format:\nQuestion: ...\nAnswer: ...\nLanguage: {lang}."))


def summary_prompt(title: Column, text: Column, lang: str = "en") -> Column:
    return F.concat(F.lit(f"Write a concise summary of the document section. Language: {lang}.\n\nHeading: "), F.coalesce(title, F.lit("(untitled)")), F.lit("\n\n"), T.clamp_text(text, SUMMARY_MOST))


def with_labels(samples: DataFrame, documents: DataFrame) -> DataFrame:
    """samples with `label`: the document's title where it isn't blank, else its id."""
    titles = documents.select("doc_id", F.when(F.trim("title") != "", F.col("title")).alias("__title"))
    return samples.join(titles, "doc_id", "left").withColumn("label", F.coalesce("__title", F.col("doc_id").cast("string"))).drop("__title")


def merge_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """new's row of each task, and old's of tasks that new lacks."""
    return old.join(new, "task", "left_anti").unionByName(new)


def local_answer(context: Column) -> Column:
    return F.concat(F.lit(f"Question: {QUESTION}\nAnswer: "), T.first_words(context, 60))


def local_summary(title: Column, text: Column) -> Column:
    return T.first_words(F.concat(F.coalesce(title, F.lit("(untitled)")), F.lit("\n\n"), text), 80)


def _numbered(first: DataFrame, prefix: str) -> DataFrame:
    """first, written once, with ids that run on over all documents."""
    return numbered(first, ("doc_id", "__n"), "__i").withColumn("sample_id", F.format_string(f"{prefix}_%06d", F.col("__i")))


def qa_samples(cells: DataFrame, per_doc: int = QA_A_DOC, lang: str = "en", reply=local_answer) -> DataFrame:  # noqa: ANN001
    """(sample_id, task, doc_id, cell_ids, question, answer, lang, context_chars) from the first per_doc textual cells of each document that are long enough, each with its textual successor where it is short."""
    w = Window.partitionBy("doc_id").orderBy("cell_id")
    textual = lambda kind: kind.isin("text", "heading")
    body = F.trim("text")
    pair = cells.select("doc_id", "cell_id", "kind", body.alias("t"), F.lead("kind").over(w).alias("k2"), F.lead(body).over(w).alias("t2"), F.lead("cell_id").over(w).alias("id2")).where(textual(F.col("kind")) & (F.octet_length("t") >= QA_LEAST_BYTES))
    more = F.coalesce((F.octet_length("t") < QA_CONTEXT_BYTES) & textual(F.col("k2")) & (F.col("t2") != ""), F.lit(False))
    said = pair.select("doc_id", "cell_id", F.when(more, F.array("cell_id", "id2")).otherwise(F.array("cell_id")).alias("cell_ids"), F.when(more, F.concat("t", F.lit("\n\n"), "t2")).otherwise(F.col("t")).alias("context"))
    # replies are made for a document's first per_doc cells, and for all of its others only where one of these is no sample
    asked = T.question_and_answer(reply(F.col("context")))
    early = said.withColumn("__n", F.row_number().over(w)).withColumn("__early", F.when(F.col("__n") <= per_doc, asked)).withColumn("__good", F.count("__early").over(Window.partitionBy("doc_id")))
    qa = F.when(F.col("__n") <= per_doc, F.col("__early")).otherwise(F.when(F.col("__good") < per_doc, asked))
    first = early.withColumn("qa", qa).where("qa IS NOT NULL").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_doc).drop("__early", "__good")
    return _numbered(first, "qa").select("sample_id", F.lit("qa").alias("task"), "doc_id", "cell_ids", "qa.question", "qa.answer", F.lit(lang).alias("lang"), F.octet_length("context").alias("context_chars"))


def sections(cells: DataFrame) -> DataFrame:
    """(doc_id, section, title, text, cell_ids): a heading and the text cells up to the next one; sections without text are left out."""
    w = Window.partitionBy("doc_id").orderBy("cell_id")
    marked = cells.where("kind IN ('heading', 'text')").withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(w))
    held = F.array_sort(F.collect_list(F.struct("cell_id", "kind", F.trim("text").alias("t"))))
    grouped = marked.groupBy("doc_id", "section").agg(held.alias("h"))
    texts = F.transform(F.filter("h", lambda c: (c["kind"] == "text") & (c["t"] != "")), lambda c: c["t"])
    titles = F.filter("h", lambda c: c["kind"] == "heading")
    return grouped.select("doc_id", "section", F.when(F.size(titles) > 0, F.element_at(titles, 1)["t"]).alias("title"), F.array_join(texts, "\n\n").alias("text"), F.transform("h", lambda c: c["cell_id"]).alias("cell_ids")).where("trim(text) <> ''")


def summary_samples(cells: DataFrame, per_doc: int = SUMMARIES_A_DOC, lang: str = "en", reply=local_summary) -> DataFrame:  # noqa: ANN001
    long = sections(cells).where(F.length("text") >= SUMMARY_LEAST).withColumn("summary", F.trim(reply(F.col("title"), T.clamp_text(F.col("text"), SUMMARY_MOST)))).where("summary <> ''")
    first = long.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("section"))).where(F.col("__n") <= per_doc)
    return _numbered(first, "summary").select("sample_id", F.lit("summary").alias("task"), "doc_id", "cell_ids", "title", "summary", F.lit(lang).alias("lang"), F.length("text").alias("context_chars"), (F.length("text") > SUMMARY_MOST).alias("truncated"))


def compose_context(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """samples with `context`: their cells' texts in the order of cell_ids, blank and unknown ones left out."""
    at = samples.select("sample_id", F.posexplode("cell_ids").alias("p", "cell_id"))
    held = at.join(cells.select("cell_id", F.trim("text").alias("t")).where("t <> ''"), "cell_id").groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "\n\n").alias("context"))
    return samples.join(held, "sample_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def rag_samples(qa: DataFrame, cells: DataFrame) -> DataFrame:
    """A retrieval sample for each question with a context; numbers are the question's, with gaps."""
    return compose_context(qa, cells).where("context <> ''").withColumn("sample_id", F.regexp_replace("sample_id", "^qa", "rag")).withColumn("task", F.lit("rag"))


def task_metrics(*samples: DataFrame) -> DataFrame:
    out = None
    for s in samples:
        one = s.groupBy("task").agg(F.count("*").alias("samples"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
        out = one if out is None else out.unionByName(one)
    return out


def _asked(context: str = "context") -> Column:
    return F.concat(F.lit("Context:\n"), F.trim(context), F.lit("\n\nQuestion: "), "question")


def _turn(names: tuple[str, str], who: str, what: Column | str) -> Column:
    return F.struct(F.lit(who).alias(names[0]), (F.col(what) if isinstance(what, str) else what).alias(names[1]))


def export(samples: DataFrame, kind: str) -> DataFrame:
    """Composed question samples in a training format: hf_chat, alpaca, sharegpt, openai, axolotl_chat, axolotl_text or rag."""
    some, chat = samples.where("trim(context) <> ''"), ("role", "content")
    user, assistant = _turn(chat, "user", _asked()), _turn(chat, "assistant", "answer")
    if kind == "hf_chat":
        return some.select(F.col("sample_id").alias("id"), "task", "doc_id", F.array(user, assistant).alias("messages"))
    if kind == "alpaca":
        return some.select(F.lit("Answer the question using only the document context.").alias("instruction"), _asked().alias("input"), F.col("answer").alias("output"))
    if kind == "sharegpt":
        return some.select(F.col("sample_id").alias("id"), F.array(_turn(("from", "value"), "human", _asked()), _turn(("from", "value"), "gpt", "answer")).alias("conversations"))
    if kind == "openai":
        return some.select(F.array(_turn(chat, "system", F.lit("You are an assistant and must answer strictly from the provided document context.")), user, assistant).alias("messages"))
    if kind == "axolotl_chat":
        return some.select(F.array(user, assistant).alias("messages"))
    if kind == "axolotl_text":
        return some.select(F.concat(F.lit("Context:\n"), F.trim("context"), F.lit("\n\nAnswer:\n"), "answer").alias("text"))
    if kind == "rag":
        return some.select(F.col("sample_id").alias("id"), "doc_id", "question", "answer", "context", "lang")
    raise ValueError(f"unknown export {kind!r}")


def hf_train(qa: DataFrame, summaries: DataFrame, cells: DataFrame) -> DataFrame:
    """Questions and summaries in one table, with their contexts, also empty ones."""
    both = qa.select("sample_id", "task", "question", "answer", "doc_id", "cell_ids").unionByName(summaries.select("sample_id", "task", "summary", "doc_id", "cell_ids"), allowMissingColumns=True)
    return compose_context(both, cells).select(F.col("sample_id").alias("id"), "task", "question", "answer", "summary", "context", "doc_id")
