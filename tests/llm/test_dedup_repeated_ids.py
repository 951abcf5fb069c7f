from pagemill.llm import simhash


def test_rows_of_a_repeated_id_are_decided_by_their_own_text(spark):
    one, two, other, clean = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, one), (2, one), (2, clean), (3, two), (3, other), (4, two), (5, other), (3, two), (None, one), (6, None)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (2, clean), (3, two), (3, other), (None, one), (6, None)], key=str)
