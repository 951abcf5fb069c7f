"""Secret scan by multipart credential linking.

A credential has parts: an access identifier, a secret, an endpoint. Strong parts and assigned secrets are found first, each kind by itself, also inside others; then other weak parts by one pattern. All have their character intervals; a scope is what lies between blank lines. Within a scope, every secret is linked with every identifier and endpoint. Strong parts, whose form leaves no doubt, are reported alone or linked; weak ones, which a hash, an address or a login name may resemble, only where a complementary part co-occurs.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.store import cut, table

#: The forms that the SQL knows: kind, class, strong, pattern; where several fit at a place, the first. It ends secrets early and misses some, see README.
KINDS = [
    ("private_key", "secret", True, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    ("aws_key_id", "identifier", True, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("prefixed_token", "secret", True, r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[A-Za-z0-9]{16,64})\b"),
    ("assigned_secret", "secret", True, r"""\b(?i:password|passwd|pwd|secret|token|api_?key|secret_access_key)["']?[ \t]{0,4}[=:][ \t]{0,4}["']?[A-Za-z0-9+/_=-]{16,200}["']?"""),
    ("short_secret", "secret", False, r"""\b(?i:password|passwd|pwd|secret|token|api_?key)["']?[ \t]{0,4}[=:][ \t]{0,4}["']?[A-Za-z0-9+/_=-]{6,15}["']?"""),
    ("assigned_id", "identifier", False, r"""\b(?i:user|username|login|client_id|access_key_id)["']?[ \t]{0,4}[=:][ \t]{0,4}["']?[A-Za-z0-9._-]{3,64}["']?"""),
    ("url", "endpoint", False, r"""\bhttps?://[A-Za-z0-9./_?=&%:#~-]{3,200}"""),
    ("email", "identifier", False, r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}\.[A-Za-z]{2,24}\b"),
    ("ipv4", "endpoint", False, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?\b"),
    ("hex_string", "secret", False, r"\b[0-9a-f]{32,64}\b"),
    ("base64_string", "secret", False, r"\b[A-Za-z0-9+/]{40}\b"),
]
PATTERN = "|".join(p for *_, p in KINDS)
NEEDED = "|".join(p for _, part, strong, p in KINDS if part == "secret" or strong)
_SCOPE_END = r"\n[ \t]*\n"
_KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
_KEY_END = re.compile(_KEY_BLOCK.replace("BEGIN", "END"))
_PREFIX = r"\b[A-Za-z0-9_]{0,64}?"  # as of DB_PASSWORD
_ASSIGNED = r"""(?i:password|passwd|pwd|secret|token|api_?key|secret_access_key)["']?[ \t]{0,4}[=:][ \t]{0,4}"""
#: A quoted value ends at its quote, any other at a quote, blank or line end. An address isn't one.
_VALUE = r"""(?!["']?https?://)(?:"(?P<double>(?:\\.|[^"\\\n])*)"|'(?P<single>(?:\\.|[^'\\\n])*)'|["']?(?P<bare>[^\s"']+)["']?)"""
#: As KINDS, of whole secrets. A key block goes on to its end line; value says by its form whether an assigned secret is strong.
FORMS = {
    "private_key": ("secret", True, _KEY_BLOCK),
    "aws_key_id": ("identifier", True, KINDS[1][3]),
    "prefixed_token": ("secret", True, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})\b"),
    "url_password": ("secret", True, r"""://[^\s:/@"'<>]{0,256}:([^\s/@"'<>]{1,256})@"""),  # the group alone is the secret
    "assigned_secret": ("secret", True, _ASSIGNED + _VALUE),
} | {kind: (part, strong, _PREFIX + p[2:] if kind == "assigned_id" else p) for kind, part, strong, p in KINDS[5:]}
_FIRST = {kind: re.compile(p, re.ASCII) for kind, (_, strong, p) in FORMS.items() if strong}
_WEAK = re.compile("|".join(f"(?P<{kind}>{p})" for kind, (_, strong, p) in FORMS.items() if not strong), re.ASCII)
_NAME = re.compile(r"[A-Za-z0-9_]*\Z")
_PLAIN = re.compile(r"[A-Za-z0-9+/_=-]*")
#: A text without any of these has no reported part: a secret, or a strong identifier. Means the same to Python and Java.
WANTED = "|".join(_ASSIGNED if kind == "assigned_secret" else p for kind, (part, strong, p) in FORMS.items() if part == "secret" or strong)


def _assigned_kind(m: re.Match) -> str | None:
    """assigned_secret where the value begins with 16 characters that tokens are made of; short_secret for other values of 6 characters."""
    value = next(v for v in (m["double"], m["single"], m["bare"]) if v is not None)
    return "assigned_secret" if len(_PLAIN.match(value)[0]) >= 16 else "short_secret" if len(value) >= 6 else None


def _key_end(text: str, begin: int, scope_end: int) -> int:
    """Where a key block ends whose first line ends at begin: after its end line, which may lie beyond blank lines but not beyond another block; else with its scope."""
    another = re.compile(_KEY_BLOCK).search(text, begin)
    end = _KEY_END.search(text, begin, another.start() if another else len(text))
    return end.end() if end else min(scope_end, another.start() if another else scope_end)


def _first_parts(text: str, breaks: list[tuple[int, int]]) -> Iterator[tuple[str, str, bool, int, int]]:
    """(kind, part, strong, start, end) of strong parts and assigned secrets; those of a kind don't overlap, those of several may."""
    starts = [b for b, _ in breaks]
    for kind, form in _FIRST.items():
        at = 0
        while m := form.search(text, at):
            last, name, begin, at = at, kind, m.start(), m.end()
            if kind == "private_key":
                i = bisect.bisect_left(starts, begin)
                at = _key_end(text, at, starts[i] if i < len(starts) else len(text))
            elif kind == "url_password":
                begin = m.start(1)
                at = m.end(1)
            elif kind == "assigned_secret":
                name, begin = _assigned_kind(m), _NAME.search(text[max(last, begin - 64) : begin]).start() + max(last, begin - 64)
            if name:
                yield name, FORMS[kind][0], name != "short_secret", begin, at


def parts_of(text: str) -> list[tuple]:
    """(kind, part, strong, start, end, scope) for every part of a text, in order; places count characters.

    A part inside another of the same class adds nothing, unless it alone is strong. A weak part that isn't an assigned secret goes where a secret holds its beginning, or where it holds a strong part of its class.
    """
    breaks = [m.span() for m in re.finditer(_SCOPE_END, text)]
    first = sorted(_first_parts(text, breaks), key=lambda x: (x[3], -x[4], not x[2]))
    kept: list[tuple] = []
    reach = {}  # by class and strength, how far the kept parts go
    for x in first:
        covered = max(reach.get((x[1], True), 0), 0 if x[2] else reach.get((x[1], False), 0))
        if x[4] > covered:
            kept.append(x)
            reach[x[1:3]] = max(reach.get(x[1:3], 0), x[4])
    secret = [x for x in kept if x[1] == "secret"]
    until = list(itertools.accumulate((x[4] for x in secret), max))
    strong_ids = [x for x in kept if x[1] == "identifier"]
    secret_at, id_at = [x[3] for x in secret], [x[3] for x in strong_ids]
    for m in _WEAK.finditer(text):
        part = FORMS[m.lastgroup][0]
        i, k = bisect.bisect_right(secret_at, m.start()), bisect.bisect_left(id_at, m.start())
        inside = i and until[i - 1] > m.start()
        holds = (part == "identifier" and k < len(id_at) and id_at[k] < m.end()) or (part == "secret" and i < len(secret) and secret_at[i] < m.end())
        if not inside and not holds:
            kept.append((m.lastgroup, part, False, *m.span()))
    ends = [e for _, e in breaks]
    return [(*x, bisect.bisect_right(ends, x[3])) for x in sorted(kept, key=lambda x: (x[3], -x[4], x[0]))]


_PARTS = "kind string, part string, strong boolean, start_char int, end_char int, scope int"


def _scan() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = parts_of(text)
                rows += found
                source += [i] * len(found)
            take = pa.array(source, pa.int32())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row", "doc_id", "kind", "part", "strong", "start_char", "end_char", "scope"])

    return run


def _row(id_col: str, text_col: str):
    """Of 128 bits: no two rows of a corpus share it by chance."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\u0000"), F.col(text_col).cast("string")))


def _findings(wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows whose text fits WANTED."""
    kind = wanted.schema[id_col].dataType.simpleString()
    wanted = wanted.select(_row(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = cut(wanted.mapInArrow(_scan(), f"row string, doc_id {kind}, {_PARTS}").dropDuplicates(["row", "start_char", "kind"]), "parts")  # read twice below
    # all parts of one side have the same links in a scope, so that they are counted by scope and not in pairs
    is_secret = F.col("part") == "secret"
    scopes = parts.groupBy("row", "scope", is_secret.alias("of_secrets")).agg(F.count("*").alias("n_linked"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("linked_kinds"), F.max("strong").alias("linked_strong"))
    links = scopes.withColumn("is_secret", ~F.col("of_secrets")).drop("of_secrets")
    return parts.withColumn("is_secret", is_secret).join(links, ["row", "scope", "is_secret"], "left").where("strong OR n_linked > 0").select("row", "doc_id", "kind", "part", "strong", "scope", "start_char", "end_char", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("linked_kinds", F.lit("")).alias("linked_kinds"), F.when(F.col("strong") & (F.col("n_linked") > 0), "high").when(F.col("strong") | F.col("linked_strong"), "medium").otherwise("low").alias("confidence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, part, strong, scope, start_char, end_char, n_linked, linked_kinds, confidence), a row for each reported part.

    confidence: high for a strong part with a complementary one, medium for a strong part alone or a weak one linked to a strong one, low for weak parts that complete each other. The parts' text isn't returned. Null and empty texts have no parts; a null id is passed on; rows with the same id and text count once, and the same id with other texts is scanned for each; other columns are not looked at; an empty table gives no rows.
    """
    return _findings(docs.where(F.col(text_col).cast("string").rlike(WANTED)), id_col, text_col).drop("row")


def _masked(at: int, spans_at: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                whole: list[list] = []  # parts that overlap are covered as one, of the first one's kind
                for x in sorted(spans or [], key=lambda x: (x["start_char"], -x["end_char"], x["kind"])):
                    if whole and x["start_char"] < whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], x["end_char"])
                    else:
                        whole.append([x["start_char"], x["end_char"], x["kind"]])
                for begin, end, kind in reversed(whole):
                    text = f"{text[:begin]}[{kind}]{text[end:]}"
                texts.append(text)
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the secrets and identifiers that scan() reports replaced by their kind in brackets; all rows and columns stay.

    Texts that can't hold a reported part aren't shuffled; null and empty ones stay as they are, and repeated rows are redacted alike. A column n_chars is brought up to date for the changed texts.
    """
    flag, row, held = (_unused(docs, x) for x in ("hit", "row", "spans"))
    # the patterns are tried once on each text: what they say is written with it
    flagged = cut(docs.withColumn(flag, F.coalesce(F.col(text_col).rlike(WANTED), F.lit(False))), "flagged")
    dirty = flagged.where(F.col(flag)).drop(flag)
    spans = _findings(dirty, id_col, text_col).where("part <> 'endpoint'").groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start_char", "end_char", "kind")).alias(held))
    dirty = dirty.withColumn(row, _row(id_col, text_col)).join(spans, row, "left").select(*docs.columns, held)
    done = dirty.mapInArrow(_masked(docs.columns.index(text_col), len(docs.columns), docs.columns), docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return flagged.where(~F.col(flag)).drop(flag).unionByName(done)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda p: p.replace("'", "''")
    case = lambda i: " ".join(f"WHEN regexp_full_match(m, '{q(k[3])}') THEN {i(k)}" for k in KINDS)
    return f"""
WITH found AS (SELECT DISTINCT doc_id, text, md5(concat_ws('|', doc_id, text)) AS row_key, regexp_extract_all(text, '{q(PATTERN)}') AS ms, regexp_split_to_array(text, '{q(PATTERN)}') AS ss FROM documents WHERE regexp_matches(text, '{q(NEEDED)}')),
each AS (SELECT doc_id, row_key, text, ms, ss, unnest(range(1, len(ms) + 1)) AS i FROM found),
placed AS (SELECT doc_id, row_key, text, ms[i] AS m, CAST(list_sum(list_transform(ss[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS start_char FROM each),
parts AS (SELECT doc_id, row_key, start_char, CAST(start_char + length(m) AS INT) AS end_char, len(regexp_extract_all(substr(text, 1, start_char), '{_SCOPE_END}')) AS scope, CASE {case(lambda k: f"'{k[0]}'")} END AS kind, CASE {case(lambda k: f"'{k[1]}'")} END AS part, CASE {case(lambda k: str(k[2]).upper())} END AS strong FROM placed),
pair AS (SELECT o.row_key, o.start_char AS o0, o.kind AS ok, o.strong AS os, s.start_char AS s0, s.kind AS sk, s.strong AS st FROM parts o JOIN parts s ON o.row_key = s.row_key AND o.scope = s.scope AND o.part <> 'secret' AND s.part = 'secret' AND o.start_char <= s.end_char + 500 AND o.end_char >= s.start_char - 500),
links AS (SELECT row_key, start_char, count(*) AS n_linked, string_agg(DISTINCT k, ',' ORDER BY k) AS linked_kinds, bool_or(b) AS linked_strong FROM (SELECT row_key, o0 AS start_char, sk AS k, st AS b FROM pair UNION ALL SELECT row_key, s0, ok, os FROM pair) GROUP BY row_key, start_char)
SELECT doc_id, kind, part, strong, CAST(scope AS INT) AS scope, p.start_char, end_char, coalesce(n_linked, 0) AS n_linked, coalesce(linked_kinds, '') AS linked_kinds, CASE WHEN strong AND n_linked > 0 THEN 'high' WHEN strong OR linked_strong THEN 'medium' ELSE 'low' END AS confidence
FROM parts p LEFT JOIN links l ON p.row_key = l.row_key AND p.start_char = l.start_char WHERE strong OR n_linked > 0"""


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL = {"op2_secret_scan": _sql()}
