import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pagemill.functions import edits as E
from pagemill.functions import text as T


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("block", [1, 5, 64, 16_384])
def test_distances_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    r = random.Random(block)
    for n in range(200):
        a = "".join(r.choices("ab😀d"[: r.randint(1, 4)], k=r.randrange(60)))
        b = "".join(x for x in a if r.random() > 0.2) if n % 2 else "".join(r.choices("abd", k=r.randrange(60)))
        want = table(a, b)
        assert E.distance(a, b) == E.distance(list(a), list(b)) == want
        assert E._many(a, b) == E._few(a, b, 99) == want


def test_long_texts():
    r = random.Random(2)
    a = "".join(r.choices("abcdefg ", k=100_000))
    b = a[:500] + "1" + a[500:50_000] + "22" + a[50_001:]
    assert E.distance(a, b) == 3
    assert E.distance("x" * 30_000, "y" * 20_000) == 30_000


def test_rates_of_controls_and_nulls(spark):
    rows = [("a\nb", "a\tb", 0.0), ("abc", None, None), (None, "x", 1.0), (None, None, 0.0), ("\n", "", 0.0), ("\n", "x", 1.0), ("äöü", "äo", 2 / 3)]
    got = spark.createDataFrame(rows, "g string, s string, want double").withColumn("r", T.character_error_rate(F.col("g"), F.col("s"))).collect()
    assert all(r["r"] == r["want"] for r in got)


def test_long_documents_have_rates(spark, tmp_path):
    long = "word 12 words, " * 3_000  # 45,000 characters
    spark.createDataFrame([(1, long), (2, "a 1"), (3, None), (4, long)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["rel"]: (r["wer"], r["cer"]) for r in queries()["gold_rates"](spark, str(tmp_path)).collect()}
    assert got == {"1": (round(1 / 3, 6), round(2 / 15, 6)), "2": (0.5, round(1 / 3, 6)), "4": (None, None)}
