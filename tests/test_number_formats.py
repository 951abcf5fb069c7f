import math

import pytest

from __spark_entry__ import queries

#: Prices whose precision lies next to a half of the sixth decimal, and some of other kinds.
PRICES = [k / 100 for k in range(10, 40_000_000, 39_990)] + [0.0, 0.05, 199_999.99, 200_000.0, 250_000.5, -3.25]


def test_decimals_are_rounded_as_by_the_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PRICES)), "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r for r in queries()["number_formats"](spark, str(tmp_path)).collect()}
    assert len(got) == len(PRICES)
    half_away = lambda x: math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x)
    for k, p in enumerate(PRICES):
        assert got[k]["precision"] == half_away(max(0.0, min(1.0, 1.0 - (1 - p / 200_000))))
        assert got[k]["factor"] == (half_away(p / (k % 3)) if k % 3 else None)


def test_missing_price(spark, tmp_path):
    spark.createDataFrame([(1, None)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert queries()["number_formats"](spark, str(tmp_path)).first()["factor"] is None


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_the_sql(spark, size):
    duckdb = pytest.importorskip("duckdb")
    from __spark_entry__ import oracle_sql

    con, at = duckdb.connect(), f"/root/testdata/{size}"
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{at}/orders.parquet')")
    got = queries()["number_formats"](spark, at)
    rows = con.execute(oracle_sql()["number_formats"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
