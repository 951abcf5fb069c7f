import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import bench as B
from pagemill.operators import cells as C
from pagemill.operators import chunks as K
from pagemill.operators import samples as S
from pagemill.operators import search as R
from pagemill.sources import convert, files


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_normalise():
    assert C.normalise("  H e l l o   —  WORLD  ") == "H e l l o — WORLD"
    assert C.normalise("a\tb") == "ab"


def test_hyphens():
    assert C.merge_hyphens(["inter-", "national", "---", "x"]) == ["international", "x"]


def test_wrap():
    assert C.wrap("  a   b ", 40) == ["a   b"]
    assert C.wrap("x" * 50 + " yy zz", 40) == ["x" * 50, "yy zz"]


def test_types_and_importance(spark):
    rows = [("ANNUAL REPORT", 0, "HEADER", 255), ("TOTAL AMOUNT USD", 0, "TABLE", 210), ("Revenue: $12.4M", 2, "TEXT", 135), ("Page 3 of 9", 10, "FOOTER", 40), ("plain words", 10, "TEXT", 100), ("| Col |", 9, "TABLE", 160)]
    found = spark.createDataFrame(rows, "t string, i int, k string, n int").withColumn("kind", T.cell_type(F.col("t"))).withColumn("imp", T.importance(F.col("t"), F.col("kind"), F.col("i"))).collect()
    assert all(r["kind"] == r["k"] and r["imp"] == r["n"] for r in found)


def test_guards(spark):
    assert [(g["digits"], g["units"]) for g in one(spark, "Revenue 12345 usd 5% 1,234.5 kg", T.guards)] == [("123", ""), ("45", "usd"), ("5", "%"), ("12345", "kg")]


def test_cells_of_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "A\fB", "x")], "doc_id long, text string, z string")
    assert [(r["doc_id"], r["z"], r["text"]) for r in C.cells(docs).orderBy("doc_id", "z").collect()] == [(3, 0, "A"), (3, 1, "B")]
    assert C.cells(docs.limit(0)).count() == 0


def cells_of(spark, texts_by_page):
    return C.cells(spark.createDataFrame([(1, "\f".join(texts_by_page))], "doc_id long, text string"))


def test_dedup_window(spark):
    found = cells_of(spark, ["same", "same", "same", "same", "same", "", "", "", "", "same"])
    assert sorted(r["z"] for r in C.dedup_window(found, 2).collect()) == [0, 3, 9]


def test_run_lengths(spark):
    found = C.run_lengths(cells_of(spark, ["a\na\nb\na"]))
    assert [r["rle"] for r in found.orderBy("y").collect()] == [1, 0, 0, 0]


def test_guard_verification(spark):
    found = cells_of(spark, ["5 kg\n5 kg 7 mg"])
    got = C.verify_guards(C.number_guards(found), found).orderBy("y").collect()
    assert [r["issue"] for r in got] == [None, "HashMismatch", "HashMismatch"]


def test_selector():
    assert C.parse_selector("z=0,x=0..9,y=4") == (0, (0, 9), (4, 4))
    with pytest.raises(ValueError):
        C.parse_selector("z=0,x=1")


def test_windows():
    assert K.cell_windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert K.heading_windows(list(map({"T": "TEXT", "H": "HEADER"}.get, "THTTHT")), [1] * 6) == [(1, 4), (4, 6)]
    assert K.token_windows([600, 20, 20], 512, 64) == [(0, 1), (1, 3)]


def test_cell_chunks_agree_with_windows(spark):
    for n, size, overlap in ((1, 3, 1), (9, 4, 3), (10, 4, 1), (5, 5, 9)):
        found = K.chunks(cells_of(spark, ["\n".join(f"w{i}" for i in range(n))]), "cells", size, overlap).orderBy("chunk_index").collect()
        assert [(r["cell_start"], r["cell_end"] + 1) for r in found] == K.cell_windows(n, size, overlap)


def test_filter_errors():
    with pytest.raises(ValueError):
        K.parse_filter("colour=red")


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a x"), (2, "a y"), (3, "a b")], "id long, text string")
    asked = spark.createDataFrame([("b", "b"), ("a", "a")], "query_id string, query_text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in R.bm25(docs, asked, "id", "query_id").collect()}
    assert got["b", 3] == pytest.approx(0.510826, abs=1e-6) and got["a", 1] == 0


def test_replies(spark):
    assert tuple(one(spark, "Question: What?\nAnswer: Because", T.question_and_answer)) == ("What?", "Because")
    assert tuple(one(spark, "Why?\nBecause", T.question_and_answer)) == ("Why?", "Because")
    assert one(spark, "nothing", T.question_and_answer) is None


def test_tasks():
    assert S.parse_tasks("qa, summary, qa") == ["qa", "summary"]
    with pytest.raises(ValueError):
        S.parse_tasks("poem")


def test_error_rates(spark):
    got = spark.createDataFrame([("a c d", "a b"), ("", ""), ("hello", "hello")], "g string, p string").select(B.word_error_rate("g", "p").alias("w"), T.character_error_rate(F.col("g"), F.col("p")).alias("c")).collect()
    assert [round(r["w"], 6) for r in got] == [round(2 / 3, 6), 0.0, 0.0] and got[2]["c"] == 0


def test_numeric_stats(spark):
    r = B.numeric_stats(spark.createDataFrame([(1, "5 mg 7 9", "5 kg 7")], "doc_id long, gold string, predicted string")).first()
    assert (r["precision"], r["recall"], r["f1"], r["units_ok"]) == (1.0, round(2 / 3, 6), 0.8, 0.5)


def test_nearest_rank(spark):
    r = spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "v double").agg(T.nearest_rank(F.col("v"), 0.5).alias("a"), T.nearest_rank(F.col("v"), 0.95).alias("b")).first()
    assert (r["a"], r["b"]) == (3.0, 4.0)


def test_converters():
    assert "| a" in convert.render(json.loads('{"rows":[{"a":1,"b":2},{"a":3,"b":4}]}'))
    assert "| name" in convert.to_markdown("csv", "name,value\nx,1\n", "t")
    assert "## Intro" in convert.tex("\\section{Intro}\ntext\n\\begin{itemize}\n\\item Bullet\n\\end{itemize}")
    assert "### [key] article" in convert.bib("@article{key, author={Doe}, title={Test}}")
    assert "bold" in convert.rtf("{\\rtf1\\ansi This is \\b bold\\b0 text}")
    assert convert.to_markdown("pdf", "", "t") is None


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("paper.pdf", "sub/notes.MD", "readme.txt"):
        (tmp_path / name).write_text("# x")
    found = files.with_ids(files.discover(spark, str(tmp_path), "*.pdf,*.md")).orderBy("path").collect()
    assert [(r["relative"], r["doc_id"], r["format"]) for r in found] == [("paper.pdf", "doc_0001", "pdf"), ("sub/notes.MD", "doc_0002", "markdown")]
