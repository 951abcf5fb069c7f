"""Byte-level BPE by a tree reduction over the monoid of texts.

encode(a + b) is made from encode(a) and encode(b): only tokens near the join can change. The pattern that precedes the merges always puts a boundary where a character that isn't white space meets white space, and where letters, digits and punctuation (but for the apostrophe, which may begin a match with letters) meet each other: no match goes across, and what follows is matched without regard to what precedes. Tokens therefore are final on the far sides of the last such place in a and the first in b. A window that grows from the join until it holds both is encoded anew; the rest is kept. In a run without any such place, as of thousands of letters, the window grows to its ends. Texts are halved down to leaves that the tokenizer's merge routine encodes; decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.store import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, WINDOW = 256, 16
#: Characters of the classes the pattern knows, a part of each is enough.
_LETTERS, _DIGITS, _MARKS = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "0-9", "!-&(-/:-@\\[-`{-~\u3001\u3002\u300c\u300d\uff01\uff0c\uff1a\uff1b\uff1f"
_FINAL = re.compile(rf"(?<=\S)(?=[ \t\n\r\f\v])|(?<=[{_LETTERS}])(?=[{_DIGITS}{_MARKS}])|(?<=[{_DIGITS}])(?=[{_LETTERS}{_MARKS}])|(?<=[{_MARKS}])(?=[{_LETTERS}{_DIGITS}])")


class Codec:
    def __init__(self, vocabulary: str = VOCABULARY, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = dict.fromkeys(ranks.values(), 0) | {i: len(b) for b, i in ranks.items()}
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.merge.encode_ordinary(text)
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.merge.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a = b = None
        w = self.window
        while a is None or b is None:  # the places must be final in the halves alone as in the whole
            if a is None:
                begin = max(lo, mid - w)
                for m in _FINAL.finditer(text, begin, mid):
                    a = m.start()
                a = lo if a is None and begin == lo else a
            if b is None:
                end = min(hi, mid + w)
                m = _FINAL.search(text, mid + 1, end) if mid + 1 < end else None
                b = m.start() if m else hi if end == hi else None
            w *= 2
        keep = len(left)
        need = len(text[a:mid].encode())
        while need > 0:
            keep -= 1
            need -= self.size[left[keep]]
        skip, need_right = 0, len(text[mid:b].encode())
        while need_right > 0:
            need_right -= self.size[right[skip]]
            skip += 1
        if need or need_right:
            raise AssertionError("a final place lies within a token")
        return left[:keep] + self.merge.encode_ordinary(text[a:b]) + right[skip:]

    def decode(self, tokens: list[int]) -> bytes:
        if len(tokens) <= self.leaf:
            return self.merge.decode_bytes(tokens)
        mid = len(tokens) // 2
        return self.decode(tokens[:mid]) + self.decode(tokens[mid:])


def _encode(vocabulary: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                ids, counts, same = [], [], []
                for text in batch.column(at).to_pylist():
                    tokens = [] if text is None else codec.encode(text)
                    ids.append(None if text is None else np.array(tokens, np.int32))
                    counts.append(None if text is None else len(tokens))
                    same.append(None if text is None else codec.decode(tokens) == text.encode())
                bounds = np.append(0, np.cumsum([0 if x is None else len(x) for x in ids]))
                where = pa.array([None if x is None else int(b) for x, b in zip(ids, bounds, strict=False)] + [int(bounds[-1])], pa.int32())
                flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(where, flat), pa.array(counts, pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip), a row for each row of docs; round_trip tells whether the decoded tokens are the text's bytes.

    A null text has null tokens, n_tokens and round_trip; an empty one no tokens. Ids, also null or repeated ones, are passed on; other columns are not looked at. Strings that name special tokens are ordinary text. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(vocabulary, 1), f"doc_id {kind}, tokens array<int>, n_tokens int, round_trip boolean")


def _decode(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from tokens: array<int>. Null tokens give a null text, no tokens an empty one; bytes that are no UTF-8 are replaced. A token that the vocabulary lacks is an error."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(_decode(vocabulary), f"doc_id {kind}, text string")


def op6_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe_encode": op6_bpe_encode}
ORACLE_SQL: dict[str, str] = {}
