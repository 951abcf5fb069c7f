import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import samples as S


def test_a_reply_is_made_once(spark):
    reply = F.concat(F.lit("MARK"), F.col("t"))
    plan = spark.createDataFrame([("x",)], "t string").select(T.question_and_answer(reply).alias("qa"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("MARK") == 1


@pytest.mark.parametrize(("reply", "want"), [("Question: q\nAnswer: a: b", ("q", "a: b")), ("x\r\nANSWER: 1\nquestion:\nanswer:2\nQuestion: w", ("w", "2")), ("first\nrest\nmore", ("first", "rest\nmore")), ("Question: q\nAnswer:", ("Question: q", "Answer:")), ("questionable\nanswer: 1", ("questionable", "answer: 1")), ("one line", None), ("\n", None), ("", None), (None, None)])
def test_parts_of_a_reply(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "t string").select(T.question_and_answer(F.col("t")).alias("qa")).first()["qa"]
    assert (got and tuple(got)) == want


def test_cells_without_a_reply_make_room(spark):
    long = "word " * 20
    rows = [(d, f"{d}_{i:02}", "text" if i % 3 else "table", f"{'bad ' if i < 7 and d == 'a' else ''}{long}{i}") for d in ("a", "b") for i in range(15)]
    cells = spark.createDataFrame(rows, "doc_id string, cell_id string, kind string, text string")
    reply = lambda c: F.when(~c.startswith("bad"), S.local_answer(c))
    got = sorted((r["sample_id"], r["doc_id"], r["cell_ids"][0]) for r in S.qa_samples(cells, reply=reply).collect())
    assert got == [(f"qa_{n:06}", d, f"{d}_{i:02}") for n, (d, i) in enumerate([("a", 7), ("a", 8), ("a", 10), ("a", 11), ("b", 1), ("b", 2), ("b", 4), ("b", 5)], 1)]


@pytest.mark.parametrize(("line", "caps"), [("ABCD", True), ("A-B C.D", True), ("ABC", False), ("ABCd", False), ("ÄÖÜß", False), ("ÄÖÜẞ", True), ("AǅCDE", False), ("一二三四", False), ("12 34", False), ("", False), ("AB1CD2EF", True), ("A" * 100_000, True), (None, None)])
def test_capitals(spark, line, caps):
    assert spark.createDataFrame([(line,)], "t string").select(T.is_all_caps(F.col("t")).alias("c")).first()["c"] is caps
