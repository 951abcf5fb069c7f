import random

import pyarrow as pa
import pytest

from pagemill.sources import files


@pytest.mark.parametrize("sizes", [[], [0, 0, 0], [5, 5, 5, 1, 30, 2, 2, None, 6, 4], [100], [11, 11], None])
def test_parts_of_a_batch(sizes):
    sizes = [random.Random(1).randrange(12) for _ in range(200)] if sizes is None else sizes
    whole = pa.RecordBatch.from_arrays([pa.array(range(1, len(sizes) + 1), pa.int64()), pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], names=["i", "content"])
    for batch in (whole, whole.slice(2)):
        parts = list(files.pieces(batch, 1, 10))
        assert [i for p in parts for i in p.column(0).to_pylist()] == batch.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column(1).to_pylist()) <= 10 for p in parts)


def test_pages_are_read_by_their_bytes(spark):
    """Not in an Arrow function that holds the texts of all rows that Spark sends at once."""
    page = "<p>" + "word " * 200_000 + "</p>"
    found = spark.createDataFrame([(i, f"/a/{i}.html", "html", page.encode()) for i in range(12)], "n int, path string, format string, content binary").coalesce(1)
    text = files.to_text(found)
    assert text.columns == ["n", "path", "format", "text", "status"]

    assert [(r["n"], r["status"]) for r in text.select("n", "status").collect()] == [(i, "ok") for i in range(12)]
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
