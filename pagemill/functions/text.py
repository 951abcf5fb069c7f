"""Column functions over lines and cells: types, importance, previews, numbers, tokens. All are built-in expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pagemill.functions.edits import distance

CELL_TYPES = ("TEXT", "TABLE", "FIGURE", "FOOTER", "HEADER")  # by ordinal
#: A number with thousands separators and decimals, and an optional unit.
GUARD = r"([0-9]{1,3}(?:[,\s][0-9]{3})*(?:\.[0-9]+)?)\s*(%|mmhg|mm|cm|mg|kg|usd|eur|bpm)?"
NUMBER = r"([+-]?[0-9]{1,3}[0-9,.]*)\s*([a-zA-Z%$]{1,8})?"
TABLE_WORDS = r"\b(total|subtotal|amount)\b.*\b(usd|eur|%)\b"
SENSITIVITY = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once a row. Written out, an expression is made again wherever body has it, and each nesting multiplies that."""
    return F.element_at(F.transform(F.array(value), body), 1)


def payload_hash(text: Column) -> Column:
    """Content address of a payload (SHA-256, hex)."""
    return F.sha2(text, 256)


def is_all_caps(line: Column) -> Column:
    """At least four letters, all of them upper-case letters."""
    # most lines end at their first small letter; letters aren't cut out to be counted
    return ~line.rlike(r"[\p{L}&&[^\p{Lu}]]") & line.rlike(r"(?:\p{L}[^\p{L}]*+){4}")


def is_table(line: Column) -> Column:
    low = F.lower(line)
    return line.contains("|") | line.contains("\t") | ((low.contains("total") | low.contains("amount")) & low.rlike(TABLE_WORDS))


def is_footer(line: Column) -> Column:
    return F.lower(line).contains("page ") | F.lower(line).contains("confidential")


def has_column_gap(line: Column, tolerance_px: int) -> Column:
    """Three tokens or more, and a run of max(tolerance / 8, 2) spaces or more: columns laid out by spaces."""
    tokens = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    return (tokens >= 3) & line.rlike(" {%d,}" % max(tolerance_px // 8, 2))


def cell_type(line: Column) -> Column:
    return F.when(is_table(line), "TABLE").when(is_all_caps(line), "HEADER").when(is_footer(line), "FOOTER").otherwise("TEXT")


def importance(line: Column, kind: Column, index: Column, heading_boost: float = 1.0, number_boost: float = 1.0, footer_penalty: float = 0.5, early_bonus: float = 1.0) -> Column:
    """0 to 255, from the type, capitals, digits, place on the page and length of a line."""
    base = F.when(kind == "HEADER", 220).when(kind == "FOOTER", int(40 * footer_penalty)).when(kind == "TABLE", 160).otherwise(100)
    score = base + F.when(is_all_caps(line), int(35 * heading_boost)).otherwise(0) + F.when(line.rlike("[0-9]"), int(20 * number_boost)).otherwise(0) + F.when(index < 5, int(15 * early_bonus)).otherwise(0) - 10 * F.floor(F.octet_length(line) / 120).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(255), score)).cast("int")


def preview(text: Column, limit: int) -> Column:
    """The text where it has at most limit bytes, else its first limit characters and three dots."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def table_columns(payload: Column) -> Column:
    """Parts between bars that aren't blank, over the whole payload; without bars, words. One at least."""
    bars = F.size(F.filter(F.split(payload, r"\|"), lambda x: x.rlike(r"\S")))
    return F.greatest(F.lit(1), F.when(payload.contains("|"), bars).otherwise(word_count(payload)))


def table_preview(payload: Column, limit: int = 96, mode: str = "auto", rows: int = 4) -> Column:
    """A table payload as its first rows' cells (csv; bars, tabs and commas part them; cut after limit characters where it has more bytes) or its dimensions (dims); auto takes csv up to 2 * limit bytes."""
    lines = F.split(payload, r"\r?\n")
    cells = lambda line: F.filter(F.transform(F.split(F.regexp_replace(line, r"[|\t]", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    full = F.filter(lines, lambda x: x.rlike(r"\S"))
    dims = F.concat(F.lit("[table rows="), F.greatest(F.lit(1), F.size(full)).cast("string"), F.lit(" cols="), table_columns(payload).cast("string"), F.lit("]"))
    joined = F.array_join(F.slice(F.filter(F.transform(full, lambda x: F.array_join(cells(x), ", ")), lambda x: x != ""), 1, rows), " | ")
    csv = F.when(joined == "", dims).otherwise(F.concat(F.lit("[csv "), preview(joined, limit), F.lit("]")))
    return dims if mode == "dims" else csv if mode == "csv" else F.when(F.octet_length(payload) <= 2 * limit, csv).otherwise(dims)


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def clamp_text(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def word_count(text: Column) -> Column:
    """Words between white space: the token estimate that needs no vocabulary."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def guards(text: Column) -> Column:
    """array<struct<digits, units>> of the numbers in a text."""
    low = F.lower(text)
    number, unit = F.regexp_extract_all(low, F.lit(GUARD), F.lit(1)), F.regexp_extract_all(low, F.lit(GUARD), F.lit(2))
    return F.transform(F.arrays_zip(number.alias("n"), unit.alias("u")), lambda x: F.struct(F.regexp_replace(x["n"], "[^0-9]", "").alias("digits"), x["u"].alias("units")))


def numbers(text: Column) -> Column:
    """array<struct<value, unit>> of the numbers in a text, for comparing texts."""
    n, u = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    return F.transform(F.arrays_zip(n.alias("n"), u.alias("u")), lambda x: F.struct(F.regexp_replace(x["n"], r"[^0-9.\-]", "").alias("value"), F.lower(x["u"]).alias("unit")))


def chunk_id(doc: Column, mode: int, index: Column, start: Column, last: Column, version: int = 1) -> Column:
    wide = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    return F.sha2(F.concat(F.encode(doc, "UTF-8"), wide(F.lit(version), 8), wide(F.lit(mode), 8), wide(index, 16), wide(start, 16), wide(last, 16)), 256)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def hash_embedding(text: Column, dims: int = 64, seed: int = 1337) -> Column:
    """Counts of the words by a hash bucket, scaled to length 1; without words, or for a null, all zero.

    An Arrow function: as nested higher-order functions every word would be hashed once for each dimension.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                if w not in known:
                    known[w] = int(hashlib.md5(f"{seed}:{w}".encode()).hexdigest()[:8], 16) % dims
                v[known[w]] += 1
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed(text)


def sensitivity_rank(level: Column) -> Column:
    """public 0 to restricted 3; an unknown level counts as public."""
    return F.coalesce(*(F.when(F.lower(level) == k, v) for k, v in SENSITIVITY.items()), F.lit(0))


_CONTROLS = dict.fromkeys([*range(32), *range(127, 160)])


@F.pandas_udf(DoubleType())
def _character_errors(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gold, said in texts:
        out = []
        for g, s in zip(gold, said, strict=True):
            a, b = ((x or "").translate(_CONTROLS) for x in (g, s))
            out.append(float(bool(b)) if not a else None if s is None else distance(a, b) / len(a))
        yield pd.Series(out, dtype=float)


def character_error_rate(gold: Column, predicted: Column) -> Column:
    """Character edits over gold characters, control characters left out; without gold ones 0 or 1. An Arrow function: a table of the two texts grows with the square of their lengths."""
    return _character_errors(gold, predicted)


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[round((n - 1) * q)] of a column to be aggregated over groups of bounded size (operators.bench.at_ranks takes a whole corpus); 0 without values."""
    held = F.array_sort(F.collect_list(values))
    return F.coalesce(F.element_at(held, (F.round((F.size(held) - 1) * q).cast("int") + 1)), F.lit(0.0)) if q else F.coalesce(F.min(values), F.lit(0.0))


def grouped_thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def question_and_answer(reply: Column) -> Column:
    """struct<question, answer> of a reply: the last lines with those prefixes, else its first line and the rest; null where either is empty."""
    after = lambda line: F.trim(F.when(F.instr(line, ":") > 0, F.regexp_replace(line, r"^[^:]*:", "")).otherwise(""))
    last = lambda lines, word: let(F.try_element_at(F.filter(lines, lambda x: F.lower(x).startswith(word)), F.lit(-1)), lambda x: F.when(x.isNotNull(), after(x)))

    def whole(said: Column, found: Column) -> Column:
        q, a = found["question"], found["answer"]
        two = ((F.coalesce(q, F.lit("")) == "") | (F.coalesce(a, F.lit("")) == "")) & (F.instr(said, "\n") > 0)
        q = F.when(two, F.trim(F.substring_index(said, "\n", 1))).otherwise(q)
        a = F.when(two, F.trim(F.regexp_replace(said, r"^[^\n]*\n", ""))).otherwise(a)
        return let(F.struct(q.alias("question"), a.alias("answer")), lambda x: F.when((x["question"] != "") & (x["answer"] != ""), x))

    named = lambda said: let(F.split(said, r"\r?\n"), lambda lines: F.struct(last(lines, "question").alias("question"), last(lines, "answer").alias("answer")))
    return let(reply, lambda said: let(named(said), lambda found: whole(said, found)))


def number_ratio(value: Column) -> Column:
    """0.0x for nothing, else with two decimals, one from 10 and none from 100."""
    return F.when(value <= 0, "0.0x").when(value >= 100, F.format_string("%.0fx", value)).when(value >= 10, F.format_string("%.1fx", value)).otherwise(F.format_string("%.2fx", value))


def currency(value: Column) -> Column:
    return F.when(value >= 1, F.format_string("~$%.2f", value)).when(value >= 0.01, F.format_string("~$%.3f", value)).otherwise(F.format_string("~$%.4f", value))


def removal_note(total: Column, kept: Column) -> Column:
    """What share of cells was left out; empty where none was."""
    gone = F.format_string(" (%.0f%% removed as low importance/duplicates)", (total - kept) / total * 100.0)
    return F.when((total == 0) | (kept >= total), "").otherwise(gone)


def over(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0: compression, pages a second."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def token_factor(raw: Column, compressed: Column) -> Column:
    """raw / compressed; null where the latter is 0 or absent."""
    return F.when(compressed > 0, raw / compressed)


def page_precision(error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - error_rate))


def round_binary(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines do that work in binary: scaled, halves away from zero, scaled back. F.round takes the shortest decimal of x instead, which is another number where x lies next to a half."""
    scale = F.lit(float(10**digits))
    return F.round(x * scale) / scale


def encrypt(text: Column, key: str) -> Column:
    """AES-GCM in base64, under a key of 16, 24 or 32 characters."""
    return F.base64(F.aes_encrypt(text, F.lit(key), F.lit("GCM")))


def decrypt(text: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(text), F.lit(key), F.lit("GCM")).cast("string")


def backoff_seconds(attempt: int, retry_after: float | None = None) -> float:
    """Before the next of several calls: what the other side asks for, else 2 to the attempt, up to 64."""
    return retry_after if retry_after is not None else float(2 ** min(attempt, 6))


def bpe_count(text: Column, ranks_path: str) -> Column:
    """Tokens by ranks in a JSON file {token in base64: rank} or a file of lines `token rank`, by an Arrow function; null for null."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64
        import json

        import tiktoken

        with open(ranks_path, encoding="utf-8") as f:
            raw = f.read()
        pairs = json.loads(raw).items() if raw.lstrip().startswith("{") else (x.split() for x in raw.splitlines() if x.strip())
        codec = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs}, special_tokens={})
        for texts in parts:
            yield pd.Series([None if t is None else len(codec.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count(text)
