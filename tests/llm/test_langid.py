import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import kernels, langid

PIECES = sorted([b"a", b"b", b"ab", b"ba", b"aab", b"abababababab"])
P = np.array([0.3, 0.2, 0.2, 0.15, 0.1, 0.05])


@pytest.fixture
def model():
    keys, at = langid.piece_index(PIECES)
    probs = np.append(dict(zip(PIECES, P, strict=True)) and P, 0)[:, None]
    return langid.Model(["x"], keys, at, np.concatenate([probs, probs[::-1] * 0 + np.append(P[::-1], 0)[:, None]], 1), 12)


def total(word, p):
    return 1.0 if not word else sum(p[word[:k]] * total(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def logs(words, model):
    low = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return langid.word_logs(low, ends - [len(w) for w in words], ends, model)


WORDS = [b"a", b"abba", b"aabab", b"bbaabaabbaab", b"abababababababab"]


@pytest.mark.parametrize("long", [1, 6, 256])
def test_segmentations_against_enumeration(model, monkeypatch, long):
    monkeypatch.setattr(langid, "LONG", long)
    monkeypatch.setattr(langid, "SLAB", 2)
    for j in range(2):
        p = {x: model.probs[i, j] for i, x in enumerate(PIECES)}
        assert logs(WORDS, model)[:, j] == pytest.approx([np.log(total(w, p)) for w in WORDS])


def test_very_long_words_scale(model):
    word = b"abbaab" * 3000
    one, two = logs([word], model), logs([word, b"a"], model)
    assert np.isfinite(one).all() and two[0] == pytest.approx(one[0])
    short = logs([b"abbaab" * 30], model)  # a slab and a long word agree in what a repeat adds
    longer, longest = logs([b"abbaab" * 40], model), logs([b"abbaab" * 60, b"abbaab" * 50], model)
    assert (longer - short)[0] == pytest.approx((longest[0] - longest[1]), rel=1e-6)


@pytest.mark.parametrize("long", [1, 256])
def test_expected_counts_against_enumeration(model, monkeypatch, long):
    monkeypatch.setattr(langid, "LONG", long)
    p = np.append(P, 0)
    by = dict(zip(PIECES, P, strict=True))

    def cuts(word):
        return [[]] if not word else [[word[:k], *c] for k in range(1, len(word) + 1) if word[:k] in by for c in cuts(word[k:])]

    want = np.zeros(len(PIECES) + 1)
    for w, n in zip(WORDS[:4], (1, 2, 3, 4), strict=True):
        ways = [(c, np.prod([by[x] for x in c])) for c in cuts(w)]
        for c, x in ways:
            for piece in c:
                want[PIECES.index(piece)] += n * x / sum(y for _, y in ways)
    low = np.frombuffer(b" ".join(WORDS[:4]), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in WORDS[:4]]) - 1
    got = langid._expected(low, ends - [len(w) for w in WORDS[:4]], ends, np.array([1.0, 2, 3, 4]), model.keys, model.at, p, 12)
    assert got == pytest.approx(want)


def test_all_letter_pieces_of_the_vocabulary_are_used():
    pieces = langid.read_pieces()
    assert max(map(len, pieces)) == 33 and sum(len(p) > 8 for p in pieces) == 5603


def test_ties_repeats_and_long_texts(spark):
    kind = "doc_id long, text string, lang string, posterior string"
    docs = spark.createDataFrame([(1, "abc abc", "x", ""), (2, "abc abc", "y", ""), (3, "abc", None, ""), (3, "abc", None, ""), (4, "中文字" * 3000, "z", ""), (5, "中文字" * 20, None, ""), (None, "abc", None, None)], kind)
    model = langid.fit(docs)
    got = [tuple(r) for r in langid.identify(docs, model).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[3][1] == "x" and by[3][3] == pytest.approx(0.5, abs=1e-3) and got.count(by[3]) == 2
    assert by[4][1] == by[5][1] == "z" and by[5][5]
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0 and langid.keep_identified(empty, model).count() == 0


def test_words_of_a_batch():
    t = next(kernels.chunks(pa.array(["ab  cd", "", "é"])))
    assert kernels.words(t, kernels.LETTERS).counts.tolist() == [2, 0, 1]
