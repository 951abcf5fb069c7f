import itertools
import random

import pytest

from pagemill.llm import bpe, chat, langid, media, mixing, search, secrets, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, node string"


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    return spark.createDataFrame([*rows([None, "", "a b", "a b", long, long + " tail", "naïve ééé", "?!"]), (None, "no id", None, None, None, None, None)], DOCS)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = {r["doc_id"]: (r["group_id"], r["group_size"], r["n_links"], r["keep"]) for r in simhash.near_duplicates(odd).collect()}
    assert got == {2: (2, 2, 0, True), 3: (2, 2, 0, False), 4: (4, 2, 1, True), 5: (4, 2, 1, False)}
    assert simhash.drop_near_duplicates(odd).count() == 7 and simhash.drop_near_duplicates(odd).columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_secrets(spark, odd):
    strong, weak = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef" * 2
    docs = spark.createDataFrame(rows([f"id {strong} here", f"hash {weak} alone", f"user: someone\nhash {weak}", f"user: someone\n\n{weak}", None]), DOCS)
    got = sorted((r["doc_id"], r["kind"], r["confidence"]) for r in secrets.scan(docs).collect())
    assert got == [(0, "aws_key_id", "medium"), (2, "assigned_id", "low"), (2, "hex_string", "low")]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[0] == "id [aws_key_id] here" and weak in clean[1] and weak not in clean[2] and len(clean) == 5
    assert secrets.scan(odd).count() == 0 and secrets.redact(odd).count() == odd.count()


def test_bpe_against_the_plain_encoder():
    rng, codec = random.Random(3), bpe.Codec(leaf=16, window=4)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t'é中1.s") for _ in range(rng.randrange(200)))
        tokens = codec.encode(text)
        assert tokens == codec.merge.encode_ordinary(text) and codec.decode(tokens) == text.encode()


def test_bpe_of_odd_rows(spark, odd):
    got = {r["doc_id"]: r for r in bpe.encode(odd).collect()}
    assert got[0]["tokens"] is None and got[1]["tokens"] == [] and got[4]["round_trip"] and len(got) == 9
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back[6] == "naïve ééé" and back[0] is None


def test_language_of_held_out_documents(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs.where("doc_id % 2 = 0"), langid.fit(docs.where("doc_id % 2 = 1"))).join(docs.select("doc_id", "lang"), "doc_id").where("letter_bytes >= 40").collect()
    assert sum(r["pred_lang"] == r["lang"] for r in got) >= 0.95 * len(got)
    model = langid.fit(docs)
    assert [r["accepted"] for r in langid.identify(odd, model).where("doc_id IN (0, 1, 7)").collect()] == [False] * 3
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_mixing_meets_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "ab"[i % 3 == 0], 1, "", "") for i in range(3000)], DOCS)
    got = mixing.balance(docs, weights={"source": {"a": 1.0, "b": 3.0}}).groupBy("source").agg({"*": "count"}).count()
    r = {x["source"]: x["t"] for x in mixing.balance(docs, weights={"source": {"a": 1.0, "b": 3.0}}).selectExpr("source", "rate * n_tokens t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    assert got == 2 and r["b"] == pytest.approx(3 * r["a"], rel=1e-6)
    mixed = mixing.mix(docs, weights={"source": {"a": 1.0, "b": 0.0}})
    assert mixed.columns == docs.columns and {x["source"] for x in mixed.select("source").distinct().collect()} == {"a"}


def test_mixing_of_odd_rows(spark, odd):
    got = mixing.balance(odd).collect()
    assert len(got) == 9 and mixing.balance(odd.limit(0)).count() == 0


def test_search_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(map(tuple, search.top_k(docs, asked, block_docs=7).collect()))
    assert got == sorted(map(tuple, search.top_k(docs, asked, block_docs=100000).collect()))
    assert search.top_k(odd, odd.selectExpr("doc_id AS item_id", "text"), k=2).where("item_id = 2").count() == 2


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hello?"), (1, 1, "assistant", "Hi.\nMore."), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["chat"] for r in chat.format_chats(chat.to_transcripts(turns), chat.fit(turns)).collect()}
    assert got == {1: "<|im_start|>user\nHello?<|im_end|>\n<|im_start|>assistant\nHi.\nMore.<|im_end|>\n"}
    logs = chat._logs(chat.fit(turns))
    marks, classes = [1, None, 2, None], [1, 0, 2, 0]
    k = 2 * len(chat.ROLES)
    emit = [logs[2][:, len(chat.ROLES) if m is None else m] + logs[3][:, c] for m, c in zip(marks, classes, strict=True)]
    score = lambda s: logs[0][s[0]] + sum(logs[1][a, b] for a, b in itertools.pairwise(s)) + sum(e[x] for e, x in zip(emit, s, strict=True))
    assert score(chat.viterbi(marks, classes, logs)) == pytest.approx(max(map(score, itertools.product(range(k), repeat=4))))


def test_media(spark):
    payload = bytes(range(256)) * 20
    raw = media.mux(payload)
    track = media.tracks(raw)[0]
    assert track["n_samples"] == 6 and track["sample_bytes"] == len(payload)
    assert all(raw[k["begin"] : k["end"]] == payload[1000 * (k["sample"] - 1) :][:1000] for k in track["keyframes"])
    got = {r["id"]: r["status"] for r in media.media_columns(spark.createDataFrame([(1, raw), (2, None), (3, b""), (4, raw[:90])], "k long, c binary"), "k", "c").collect()}
    assert got[1] == "ok" and got[2] == "null" and got[3] == "no tracks" and got[4].startswith("malformed")
