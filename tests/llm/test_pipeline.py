import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pagemill.llm import bpe, kernels, langid, mixing, secrets, simhash

SF = "/root/testdata/sf0.001"


def linked(text):
    """A text with its reported secrets and identifiers masked, part by part."""
    parts = secrets.parts_of(text)
    out = []
    for kind, part, strong, begin, end, scope in parts:
        others = [p for p in parts if p[5] == scope and (p[1] == "secret") != (part == "secret")]
        if (strong or others) and part != "endpoint":
            out.append([begin, end, kind])
    out.sort(key=lambda x: (x[0], -x[1], x[2]))
    whole = []
    for begin, end, kind in out:
        if whole and begin < whole[-1][1]:
            whole[-1][1] = max(end, whole[-1][1])
        else:
            whole.append([begin, end, kind])
    for begin, end, kind in reversed(whole):
        text = f"{text[:begin]}[{kind}]{text[end:]}"
    return text


def by_hand(docs, model):
    """The five stages, a document or a pair at a time."""
    kept = []
    for d in docs:
        if d["text"] is None:
            continue
        (t,) = kernels.chunks(pa.array([d["text"]]))
        if langid.decide(*langid.score(t, model), model)["accepted"][0]:
            kept.append(d)
    f = np.concatenate([simhash.fingerprints(t) for t in kernels.chunks(pa.array([d["text"] for d in kept]))])
    root = list(range(len(kept)))
    for i in range(len(kept)):
        near = np.flatnonzero(np.bitwise_count(f[i] ^ f).sum(1) <= simhash.RADIUS)
        old, low = {root[k] for k in near}, min(root[k] for k in near)
        root = [low if r in old else r for r in root]
    first = {}
    for d, r in zip(kept, root, strict=True):
        first[r] = min(first.get(r, math.inf), d["doc_id"])
    kept = [d | {"text": linked(d["text"])} for d, r in zip(kept, root, strict=True) if d["doc_id"] == first[r]]
    tokens = [len(re.findall(mixing.TOKEN, d["text"])) for d in kept]
    have = collections.Counter()
    for d, n in zip(kept, tokens, strict=True):
        have[d["source"]] += n
    weight = sum(n**mixing.SMOOTHING for n in have.values())
    out = []
    for source, total in have.items():
        own = [(d, n) for d, n in zip(kept, tokens, strict=True) if d["source"] == source]
        goal = sum(have.values()) * total**mixing.SMOOTHING / weight
        lo, hi = -1.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(n * math.exp(min(mid * n, 300)) for _, n in own) > goal else (mid, hi)
        for d, n in own:
            unit = int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:13], 16) / 2**52
            out += [d] * math.floor((math.exp(lo * n) if n else 1.0) + unit)
    codec = bpe.Codec()
    return sorted((d["doc_id"], tuple(codec.merge.encode_ordinary(d["text"]))) for d in out)


def test_against_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = by_hand([r.asDict() for r in docs.collect()], langid.fit(docs))
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r["round_trip"] for r in got)
    assert sorted((r["doc_id"], tuple(r["tokens"])) for r in got) == want
    for d, t in want:
        assert not re.search(r"AKIA[0-9A-Z]{16}|BEGIN [A-Z ]*PRIVATE KEY", bpe.Codec().decode(list(t)).decode()), d


def test_stages_take_odd_rows_and_keep_the_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, stays string, hit string, row string, `__id` string, `__copy` string"
    plain = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    text = plain[0][1] or plain[1][1]
    odd = [(900, None, None, None, None), (901, "", "en", "a", 0), (None, text, "en", None, 9), (902, text, None, "a", None), (902, text, "en", "a", None), (903, "?! 12 34", "en", "a", 3), (904, " ".join([text] * 300), "en", "b", 5), (905, f"{text} user: someone\npassword=Abcdef12!", "en", "b", 5)]
    docs = spark.createDataFrame([(*r, "s", "h", "r", "i", "c") for r in plain + odd], kind)
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            rows = out.collect()
            assert last or out.columns == docs.columns, name
            assert len(rows) <= 3 * len(plain + odd) and (rows or d is not docs), name
        if name == "simhash_near_dedup":
            left = [r["doc_id"] for r in stage(spark, docs, SF).collect()]
            assert left.count(902) <= 1 and 900 in left and None in left
        if name == "secret_scan":
            (r,) = [r for r in stage(spark, docs, SF).collect() if r["doc_id"] == 905]
            assert "Abcdef12" not in r["text"] and r["n_chars"] == len(r["text"]) and r["hit"] == "h"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_is_named_once(name):
    assert [n for n, _ in corpus_pipeline.STAGES].count(name) == 1 and len(corpus_pipeline.STAGES) == 5
