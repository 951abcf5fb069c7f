"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's likelihood is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities (a forward algorithm over byte positions); a text's is the product over its words, runs of letters. Word likelihoods are computed once for each distinct word of two megabytes of text, for thousands of words and all languages at a time; those of very long words a place at a time, over the pieces that match there.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import kernels as K
from pagemill.llm.store import table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TRAIN_DOCS, ROUNDS = 400, 3
SLAB, LONG = 8192, 256  # words taken together, and bytes of a word that is taken alone
#: A text is rejected where its best language explains its letters worse than this many nats a byte (a uniform choice among 64 bytes), or is less likely than not.
WORST_NATS, LEAST_POSTERIOR = 4.16, 0.5
_SLOTS = 1 << 18


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's lower-cased letter pieces without the leading space, and every byte that letters use."""
    found = {bytes([b]) for b in range(256) if K.LETTERS[b] == b and b}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece = np.frombuffer(base64.b64decode(line.split()[0]).strip(b" "), np.uint8)
                low = K.LETTERS[piece]
                if len(low) and low.all():
                    found.add(low.tobytes())
    return sorted(found)


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # open addressing: piece hash by slot, 0 where empty
    at: np.ndarray  # piece number by slot
    probs: np.ndarray  # [pieces + 1, languages]; the last row, for what is no piece, is 0
    longest: int  # bytes of the longest piece


def piece_index(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    h = K.range_hash(K._BYTE[data], np.append(0, ends[:-1]), ends)
    keys, at = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, len(pieces), np.int32)
    for i, x in enumerate(h):
        s = int(x) & (_SLOTS - 1)
        while keys[s]:
            s = (s + 1) & (_SLOTS - 1)
        keys[s], at[s] = x, i
    return keys, at


def look_up(keys: np.ndarray, at: np.ndarray, h: np.ndarray, none: int) -> np.ndarray:
    """Piece number of each hash, or none."""
    slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
    found = keys[slot]
    out = at[slot]
    miss = np.flatnonzero((found != h) & (found != 0))
    out[found != h] = none
    while len(miss):
        slot[miss] = (slot[miss] + 1) & (_SLOTS - 1)
        found = keys[slot[miss]]
        hit = found == h[miss]
        out[miss[hit]] = at[slot[miss[hit]]]
        miss = miss[~hit & (found != 0)]
    return out


class Substrings:
    """Hashes of substrings of a byte buffer."""

    def __init__(self, low: np.ndarray):
        up, self.down = K.powers(len(low) + 1)
        self.prefix = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(K._BYTE[low] * up[: len(low)], out=self.prefix[1:])

    def hash(self, starts: np.ndarray, length: int) -> np.ndarray:
        return K.mix((self.prefix[starts + length] - self.prefix[starts]) * self.down[starts] + np.uint64(length))


def word_logs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """[words, languages]: log of the sum over segmentations."""
    sub, n = Substrings(low), ends - starts
    out = np.zeros((len(starts), model.probs.shape[1]))
    order = np.argsort(-n, kind="stable")
    alone = int(np.searchsorted(-n[order], -LONG, "left"))
    for i in order[:alone]:
        out[i] = _long_word_log(sub, int(starts[i]), int(n[i]), model)
    for lo in range(alone, len(order), SLAB):
        at = order[lo : lo + SLAB]
        out[at] = _slab_logs(sub, starts[at], n[at], model)
    return out


def _slab_logs(sub: Substrings, s: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """word_logs of words by falling length: a byte position of all words at a time, each as long as it lasts."""
    langs, longest = model.probs.shape[1], min(model.longest, int(n[0]))
    out, scale = np.zeros((len(s), langs)), np.zeros((len(s), langs))
    ring = np.zeros((longest + 1, len(s), langs))
    ring[0] = 1.0
    for e in range(1, int(n[0]) + 1):
        active = int(np.searchsorted(-n, -e, "right"))
        now = ring[e % (longest + 1)]
        now[:active] = 0.0
        for length in range(1, min(longest, e) + 1):
            piece = look_up(model.keys, model.at, sub.hash(s[:active] + (e - length), length), len(model.probs) - 1)
            some = np.flatnonzero(piece < len(model.probs) - 1)
            now[some] += ring[(e - length) % (longest + 1)][some] * model.probs[piece[some]]
        done = slice(int(np.searchsorted(-n, -e, "left")), active)
        out[done] = np.log(now[done]) + scale[done]
        if e % 8 == 0:
            top = now[:active].copy()
            ring[:, :active] /= top[None]
            scale[:active] += np.log(top)
    return out


def matches(sub: Substrings, start: int, n: int, keys: np.ndarray, at: np.ndarray, none: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, piece) of every piece that a word holds, by end, shorter ones first."""
    found = []
    for k in range(1, min(longest, n) + 1):
        piece = look_up(keys, at, sub.hash(start + np.arange(n - k + 1), k), none)
        some = np.flatnonzero(piece < none)
        found.append(np.stack([some + k, np.full(len(some), k), piece[some]], 1))
    all_ = np.concatenate(found)
    return tuple(all_[np.lexsort((all_[:, 1], all_[:, 0]))].T)


def _long_word_log(sub: Substrings, start: int, n: int, model: Model) -> np.ndarray:
    end, length, piece = matches(sub, start, n, model.keys, model.at, len(model.probs) - 1, model.longest)
    rows, before = model.probs[piece], end - length
    cuts = np.searchsorted(end, np.arange(n + 2))
    f, scale = np.zeros((n + 1, model.probs.shape[1])), np.zeros(model.probs.shape[1])
    f[0] = 1.0
    for e in range(1, n + 1):
        x = slice(cuts[e], cuts[e + 1])
        f[e] = np.einsum("ij,ij->j", f[before[x]], rows[x])
        if e % 64 == 0:
            top = f[e].copy()
            f[max(0, e - model.longest) : e + 1] /= top
            scale += np.log(top)
    return np.log(f[n]) + scale


def _expected(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, keys: np.ndarray, at: np.ndarray, p: np.ndarray, longest: int) -> np.ndarray:
    """Expected piece counts under p by forward and backward sums."""
    sub, total = Substrings(low), np.zeros(len(p))
    for n in np.unique(ends - starts):
        mine = np.flatnonzero(ends - starts == n)
        if n >= LONG:
            for i in mine:
                total += counts[i] * _expected_in_long(sub, int(starts[i]), int(n), keys, at, p, longest)
            continue
        for lo in range(0, len(mine), 20000):
            s, c = starts[mine[lo : lo + 20000]], counts[mine[lo : lo + 20000]]
            piece = {(e, k): look_up(keys, at, sub.hash(s + (e - k), k), len(p) - 1) for e in range(1, n + 1) for k in range(1, min(longest, e) + 1)}
            piece = {x: i for x, i in piece.items() if (i < len(p) - 1).any()}
            a, b = np.zeros((n + 1, len(s))), np.zeros((n + 1, len(s)))
            a[0], b[n] = 1.0, 1.0
            for (e, k), i in piece.items():
                a[e] += a[e - k] * p[i]
            for (e, k), i in reversed(piece.items()):
                b[e - k] += b[e] * p[i]
            for (e, k), i in piece.items():
                total += np.bincount(i, a[e - k] * p[i] * b[e] * (c / a[n]), len(p))
    total[-1] = 0
    return total


def _expected_in_long(sub: Substrings, start: int, n: int, keys: np.ndarray, at: np.ndarray, p: np.ndarray, longest: int) -> np.ndarray:
    """As _expected, of one word, a place at a time; the sums are kept as logarithms."""
    end, length, piece = matches(sub, start, n, keys, at, len(p) - 1, longest)
    before, logs = end - length, np.log(p[piece])
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0], b[n] = 0.0, 0.0
    cuts = np.searchsorted(end, np.arange(n + 2))
    by_begin = np.argsort(before, kind="stable")
    from_ = np.searchsorted(before[by_begin], np.arange(n + 2))
    for e in range(1, n + 1):
        x = slice(cuts[e], cuts[e + 1])
        a[e] = np.logaddexp.reduce(a[before[x]] + logs[x])
    for s in range(n - 1, -1, -1):
        x = by_begin[from_[s] : from_[s + 1]]
        b[s] = np.logaddexp.reduce(b[end[x]] + logs[x])
    return np.bincount(piece, np.exp(a[before] + logs + b[end] - a[n]), len(p))


def train(texts: dict[str, pa.Array], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Piece probabilities by expectation maximisation on each language's texts, started from how often each piece occurs in them."""
    keys, at = piece_index(pieces)
    longest = max(map(len, pieces))
    langs, columns = sorted(texts), []
    for lang in langs:
        raw = pa.array([b" ".join(x.as_py().encode() for x in texts[lang] if x.is_valid)], pa.binary())
        w = K.words(next(K.chunks(raw, 1 << 40)), K.LETTERS)
        _, first, counts = np.unique(w.hashes, return_index=True, return_counts=True)
        starts, ends, counts = w.starts[first], w.ends[first], counts.astype(float)
        p = np.zeros(len(pieces) + 1)
        sub = Substrings(w.low)
        at_, of = _places(starts, ends)
        for k in range(1, longest + 1):
            m = at_ + k <= ends[of]
            at_, of = at_[m], of[m]
            p += np.bincount(look_up(keys, at, sub.hash(at_, k), len(pieces)), counts[of], len(p))
        for i in range(rounds + 1):
            p[-1] = 0
            p = (p + 0.01) / (p.sum() + 0.01 * len(pieces))
            p[-1] = 0
            if i < rounds:
                p = _expected(w.low, starts, ends, counts, keys, at, p, longest)
        columns.append(p)
    return Model(langs, keys, at, np.stack(columns, 1) if columns else np.zeros((len(pieces) + 1, 0)), longest)


def _places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte's place in some words, and which word it is in."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n), of


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, vocabulary: str = VOCABULARY) -> Model:
    """A model of the languages that lang_col names, each from a sample of labelled rows bounded by train_docs in expectation (all rows where there are fewer), chosen by a hash of the text."""
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    n = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, k in n.items():
        share = F.when(F.col("lang") == lang, float(min(1.0, train_docs / k))).otherwise(share)
    unit = (F.xxhash64("text").bitwiseAND((1 << 53) - 1) / float(1 << 53)).cast("double")
    rows = d.where(F.col("text").isNotNull() & (unit < share)).toArrow()
    langs = np.array(rows["lang"].to_pylist(), object)
    return train({x: rows["text"].combine_chunks().filter(pa.array(langs == x)) for x in sorted(n) if (langs == x).any()}, read_pieces(vocabulary))


def score(t: K.Texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """[texts, languages] log-likelihoods, and the bytes of letters of each text."""
    w = K.words(t, K.LETTERS)
    letters = K.sum_by(w.ends - w.starts, w.bounds)
    if not len(w.hashes) or not model.langs:
        return np.zeros((len(letters), len(model.langs))), letters
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    return K.sum_by(word_logs(w.low, w.starts[first], w.ends[first], model)[inverse], w.bounds), letters


def decide(logs: np.ndarray, letters: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    n = len(letters)
    if not model.langs:
        nothing = np.full(n, None, object)
        return {"pred_lang": nothing, "log_likelihood": nothing, "posterior": nothing, "accepted": np.zeros(n, bool)}
    best = logs.argmax(1)  # the first in the alphabet where several are equally likely
    top = logs[np.arange(n), best]
    posterior = 1 / np.exp(logs - top[:, None]).sum(1)
    ok = (letters > 0) & (top >= -WORST_NATS * letters) & (posterior >= LEAST_POSTERIOR)
    names = np.where(letters > 0, np.array(model.langs, object)[best], None)
    return {"pred_lang": names, "log_likelihood": np.where(letters > 0, top, np.nan), "posterior": np.where(letters > 0, posterior, np.nan), "accepted": ok}


def _decisions(batch: pa.RecordBatch, text_at: int, model: Model) -> Iterator[tuple[K.Texts, dict[str, np.ndarray], np.ndarray]]:
    for t in K.chunks(batch.column(text_at), 1 << 21):
        logs, letters = score(t, model)
        yield t, decide(logs, letters, model), letters


def _classify(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, d, letters in _decisions(batch, 1, model):
                number = lambda x: pa.array(x.astype(float), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(d["pred_lang"], pa.string()), number(d["log_likelihood"]), number(d["posterior"]), pa.array(letters), pa.array(d["accepted"])], names=["doc_id", "pred_lang", "log_likelihood", "posterior", "letter_bytes", "accepted"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pred_lang, log_likelihood, posterior, letter_bytes, accepted), a row for each row of docs.

    posterior is among the model's languages, equally likely beforehand. A null text, or one without letters (also an empty one), has null pred_lang, log_likelihood and posterior and is not accepted. Equally likely languages: the first in the alphabet. Ids, also null or repeated ones, are passed on; other columns are not looked at; an empty table gives no rows. A model of no languages accepts nothing.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_classify(model), f"doc_id {docs.schema[id_col].dataType.simpleString()}, pred_lang string, log_likelihood double, posterior double, letter_bytes long, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns."""
    if docs.schema[text_col].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} must be a string column")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [d["accepted"] for _, d, _ in _decisions(batch, at, model)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
