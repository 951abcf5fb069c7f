import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pagemill.operators import search as R

RECORDS = [(1, "a b b c"), (2, "a x"), (2, "a a x y"), (2, "b x"), (3, "c"), (4, None), (5, ""), (6, "A, b. 7"), (7, "zz"), (None, "b c 7"), (8, "a " * 50 + "é")]
ASKED = [("p", "b c b"), ("q", "a"), ("r", "nothing known"), ("s", "!?"), ("t", "É 7 zz"), ("p", "zz"), (None, "x"), ("u", None)]


def words(text):
    return re.findall(r"[^\W_]+", text.lower()) if text is not None else None


def by_hand(records, asked):
    """{(query, id): score}, as the SQL says it."""
    toks = [(i, t) for i, x in records if (t := words(x)) is not None]
    average = sum(len(t) for _, t in toks) / len(toks)
    df = Counter(w for _, t in toks for w in set(t))
    tf = Counter((i, len(t), w) for i, t in toks for w in t)
    times = Counter((q, w) for q, x in asked for w in words(x) or ())
    out = defaultdict(float)
    for (i, n, w), f in tf.items():
        for (q, v), k in times.items():
            if v == w:
                out[q, i] += k * max(0.0, math.log((max(df.values()) - df[w] + 0.5) / (df[w] + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / average))
    return out


@pytest.mark.parametrize("at_once", [2, 1024])
def test_bm25_by_hand(spark, monkeypatch, at_once):
    monkeypatch.setattr(R, "QUERIES_A_PASS", at_once)
    docs, asked = spark.createDataFrame(RECORDS, "id long, text string"), spark.createDataFrame(ASKED, "query_id string, query_text string")
    want = by_hand(RECORDS, ASKED)
    got = {(r["query_id"], r["id"]): r["score"] for r in R.bm25(docs, asked, "id", "query_id").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-6) for x in want)
    two = {(r["query_id"], r["id"]) for r in R.best(R.bm25(docs, asked, "id", "query_id", k=2), 2, "query_id", "id").collect()}
    first = lambda q: sorted((x for x in got if x[0] == q), key=lambda x: (-got[x], x[1] is not None, x[1] or 0))[:2]
    assert two == {x for q in {x[0] for x in got} for x in first(q)}


@pytest.mark.parametrize("at_once", [2, 1024])
def test_hybrid_by_hand(spark, monkeypatch, at_once):
    monkeypatch.setattr(R, "QUERIES_A_PASS", at_once)
    vector = lambda n: None if n % 5 == 3 else [float(n % 3), 1.0 / (n + 1)]
    rows = [(i, x, vector(n), n % 4 != 1) for n, (i, x) in enumerate(RECORDS)]
    asked = [(f"{q}{n}", x, [0.5, float(n)] if n != 1 else None) for n, (q, x) in enumerate(ASKED)]
    lexical = by_hand(RECORDS, [(q, x) for q, x, _ in asked])
    want = Counter()
    for q, x, v in asked:
        for i, _, w, kept in rows:
            if v and w and kept:
                dense = round(sum(a * b for a, b in zip(v, w)), 6)
                want[q, i, round(dense if words(x) == [] else 0.7 * dense + 0.3 * round(lexical.get((q, i), 0), 6), 5)] += 1
    got = R.hybrid(spark.createDataFrame(rows, "id long, text string, embedding array<double>, kept boolean"), spark.createDataFrame(asked, "query_id string, query_text string, query_embedding array<double>"), 99, "id", "query_id", where=F.col("kept"))
    assert Counter((r["query_id"], r["id"], round(r["score"], 5)) for r in got.collect()) == want


def test_without_rows(spark):
    docs, asked = spark.createDataFrame(RECORDS, "id long, text string"), spark.createDataFrame(ASKED, "query_id string, query_text string")
    assert R.bm25(docs.limit(0), asked, "id", "query_id").count() == R.bm25(docs, asked.limit(0), "id", "query_id").count() == 0


@pytest.mark.parametrize("name", ["bm25", "prompts", "answer_contexts", "hybrid_search"])
def test_pairs_of_queries_and_records_stay(spark, name):
    """Every query meets nearly every record: pairs aren't shuffled, and texts aren't for a few hits."""
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, (doc|page)_id#", plan)
    assert "SortMergeJoin" not in plan
