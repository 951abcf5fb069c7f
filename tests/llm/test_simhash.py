import itertools

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import kernels, simhash


def prints_of(texts):
    return np.concatenate([simhash.fingerprints(t) for t in kernels.chunks(pa.array(texts, pa.string()))])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_and_links_are_those_of_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").where("text IS NOT NULL").collect()]
    f = prints_of([t for _, t in rows])
    root, links = list(range(len(f))), [set() for _ in f]
    for i in range(len(f)):
        near = np.flatnonzero(np.bitwise_count(f[i] ^ f).sum(1) <= simhash.RADIUS)
        links[i] = {rows[k][1] for k in near} - {rows[i][1]}
        low = min(root[k] for k in near)
        old = {root[k] for k in near}
        root = [low if r in old else r for r in root]
    groups = {}
    for (i, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append(i)
    want = {i: (min(groups[r]), len(groups[r]), len(n)) for (i, _), r, n in zip(rows, root, links, strict=True) if len(groups[r]) > 1}
    got = {r["doc_id"]: (r["group_id"], r["group_size"], r["n_links"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_every_pair_within_the_radius_is_found_once(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (40, simhash.LONGS), dtype=np.uint64)
    rows = [base]
    for radius in (0, 1, 5, 17, 31, 32, 33, 40):  # exactly so many bits away, and those of one base from each other
        bits = np.zeros((40, 64 * simhash.LONGS), np.uint8)
        for i in range(40):
            bits[i, rng.choice(64 * simhash.LONGS, radius, replace=False)] = 1
        rows.append(base ^ np.packbits(bits, axis=1).view(np.uint64))
    f = np.unique(np.concatenate(rows), axis=0)
    nodes = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(f.view(np.int64))], "node long, " + ", ".join(f"f{i} long" for i in range(simhash.LONGS)))
    for radius in (simhash.RADIUS, 17, 2):
        want = {(a, b, d) for a, b in itertools.combinations(range(len(f)), 2) if (d := int(np.bitwise_count(f[a] ^ f[b]).sum())) <= radius}
        got = simhash.near_pairs(nodes, radius).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_a_pair_comes_out_of_a_segment_once():
    width = 6
    values = np.array([0b000000, 0b000001, 0b000011, 0b000111, 0b000000], np.uint64)
    flips = np.append(np.uint64(0), np.uint64(1) << np.arange(width, dtype=np.uint64))
    keys = (values[:, None] ^ flips).ravel()
    node = np.repeat(np.arange(len(values)), width + 1)
    bit = np.tile(np.append(simhash._OWN, np.arange(width)), len(values)).astype(np.uint8)
    got = [(int(a), int(b)) for x, y in simhash.meeting_pairs(keys, node, bit, 7) for a, b in zip(x, y, strict=True)]
    assert sorted(got) == [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if bin(int(values[a] ^ values[b])).count("1") <= 2]


def test_long_texts_sum_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 70000}" for i in range(150000))
    (one,) = prints_of([text])
    w = next(iter(kernels.chunks(pa.array([text]))))
    h = np.unique(kernels.words(w).hashes & simhash._LOW48)
    bits = np.unpackbits(kernels.mix(h[:, None] ^ simhash._SALTS).view(np.uint8), axis=1, bitorder="little").astype(int)
    want = (2 * bits - 1).sum(0) > 0
    assert (np.unpackbits(one.view(np.uint8), bitorder="little") == want).all()


def test_rows_of_one_text_and_ties(spark):
    docs = spark.createDataFrame([(5, "same words here"), (5, "same words here"), (3, "same words here"), (3, "same words here"), (9, None), (None, "same words here"), (7, "quite other things to say")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["group_id"], r["group_size"], r["n_links"], r["keep"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(3, 3, 4, 0, True)] * 2 + [(5, 3, 4, 0, False)] * 2
    left = sorted(map(str, simhash.drop_near_duplicates(docs.withColumnRenamed("text", "t").selectExpr("doc_id", "t AS text", "1 AS stays", "2 AS row")).collect()))
    assert len(left) == 4 and sum("doc_id=3" in x for x in left) == 1
