"""Chat formatting: transcripts to canonical turns through a hidden Markov model.

The lines of a transcript are observed, the speakers are hidden. States are (role, whether the line begins a turn). A line shows a speaker marker or none, a length class and whether it ends in a question mark. Viterbi finds the likeliest states; turns are then cut at beginning lines, their markers taken off, and rendered in one form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.store import table

ROLES = ("system", "user", "assistant")
_NAMES = {"system": 0, "developer": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "instruction": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2, "a": 2, "answer": 2, "response": 2}
_WORD = "|".join(sorted(_NAMES, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*(?P<x>{_WORD})\s*(?:\|>)?|#{{1,6}}\s*(?P<y>{_WORD})\s*:?(?=\s|$)|\[(?P<w>{_WORD})\]:?|(?P<z>{_WORD})\s*:(?=\s|$))[ \t]*", re.IGNORECASE)
#: How often a turn begins with its own marker, without one, or with another's; how often a line within a turn looks like a marker.
_OWN, _BARE, _STRAY = 0.9, 0.09, 0.002
LENGTHS = (0, 40, 120, 400)
_CLASSES = 2 * (len(LENGTHS) + 1)


@dataclass
class Model:
    start: np.ndarray  # [roles]
    follow: np.ndarray  # [roles, roles]: whose turn comes next
    end: np.ndarray  # [roles]: that a turn ends with a line
    lines: np.ndarray  # [roles, begins or not, line class]


def line_class(line: str) -> int:
    n = len(line.strip())
    return 2 * sum(n > x for x in LENGTHS) + line.rstrip().endswith("?")


def marker(line: str) -> tuple[int | None, int]:
    """(role or None, characters that the marker takes)."""
    m = MARKER.match(line)
    return (_NAMES[(m["x"] or m["y"] or m["w"] or m["z"]).lower()], m.end()) if m else (None, 0)


def _logs(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition, marker and line-class log-probabilities of the states, beginning ones first."""
    k = len(ROLES)
    start = np.append(model.start, np.zeros(k))
    step = np.zeros((2 * k, 2 * k))
    for s in range(2 * k):
        step[s, :k] = model.end[s % k] * model.follow[s % k]
        step[s, k + s % k] = 1 - model.end[s % k]
    shown = np.full((2 * k, k + 1), _STRAY / k)
    shown[:k] = (1 - _OWN - _BARE) / (k - 1)
    shown[np.arange(k), np.arange(k)] = _OWN
    shown[:k, k], shown[k:, k] = _BARE, 1 - _STRAY
    with np.errstate(divide="ignore"):
        return np.log(start), np.log(step), np.log(shown), np.log(np.concatenate([model.lines[:, 0], model.lines[:, 1]]))


def viterbi(markers: list[int | None], classes: list[int], logs: tuple[np.ndarray, ...]) -> list[int]:
    """The likeliest states; of equally likely ones the first."""
    start, step, shown, lines = logs
    k = len(ROLES)
    emit = [shown[:, k if m is None else m] + lines[:, c] for m, c in zip(markers, classes, strict=True)]
    if not emit:
        return []
    best, back = start + emit[0], []
    for e in emit[1:]:
        ways = best[:, None] + step
        came = ways.argmax(0)
        back.append(came)
        best = ways[came, np.arange(2 * k)] + e
    state = [int(best.argmax())]
    for came in reversed(back):
        state.append(int(came[state[-1]]))
    return state[::-1]


def parse(text: str, logs: tuple[np.ndarray, ...]) -> list[tuple[str, str]]:
    """(role, content) for each turn that has any content."""
    lines = text.split("\n")
    marks = [marker(x) for x in lines]
    states = viterbi([m for m, _ in marks], [line_class(x[n:]) for x, (_, n) in zip(lines, marks, strict=True)], logs)
    turns: list[tuple[int, list[str]]] = []
    for line, (m, n), s in zip(lines, marks, states, strict=True):
        if s < len(ROLES) or not turns:
            turns.append((s % len(ROLES), [line[n:] if m is not None else line]))
        else:
            turns[-1][1].append(line)
    done = [(ROLES[r], re.sub(r"\s*<\|im_end\|>\s*$", "", "\n".join(x)).strip()) for r, x in turns]
    return [(r, c) for r, c in done if c]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form; its control strings are broken up where a content holds them."""
    return "".join(f"<|im_start|>{r}\n{c.replace('<|im_', '<| im_')}<|im_end|>\n" for r, c in turns)


def fit(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over all rows with a known role. Every possibility has half a count more, so that no labelled rows give a uniform model."""
    role = F.lower(F.trim(F.col(role_col)))
    code = F.coalesce(*(F.when(role == n, r) for n, r in _NAMES.items()))
    d = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), code.alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x")).where("r IS NOT NULL AND c IS NOT NULL")
    k = len(ROLES)
    start, follow, ends = np.full(k, 0.5), np.full((k, k), 0.5), np.full(k, 0.5)
    before = F.lag("r").over(Window.partitionBy("c").orderBy("t", "r"))
    for row in d.select("r", before.alias("b")).groupBy("b", "r").count().collect():
        ends[row["r"]] += row["count"]
        if row["b"] is None:
            start[row["r"]] += row["count"]
        else:
            follow[row["b"], row["r"]] += row["count"]
    lines = np.full((k, 2, _CLASSES), 0.5)
    one = d.select("r", F.posexplode(F.split(F.regexp_replace("x", r"\s+$", ""), "\n")).alias("at", "line"))
    length = F.length(F.trim("line"))
    kind = 2 * sum((length > n).cast("int") for n in LENGTHS) + F.col("line").rlike(r"\?\s*$").cast("int")
    total = np.full(k, 1.0)
    for row in one.groupBy("r", (F.col("at") > 0).cast("int").alias("i"), kind.alias("kind")).count().collect():
        lines[row["r"], row["i"], row["kind"]] += row["count"]
        total[row["r"]] += row["count"]
    return Model(start / start.sum(), follow / follow.sum(1, keepdims=True), ends / np.maximum(total, ends + 0.5), lines / lines.sum(2, keepdims=True))


def _format(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = _logs(model)
        for batch in batches:
            turns = [None if x is None else parse(x, logs) for x in batch.column(1).to_pylist()]
            some = lambda f, kind: pa.array([None if t is None else f(t) for t in turns], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), some(len, pa.int32()), some(lambda t: [r for r, _ in t], pa.list_(pa.string())), some(render, pa.string())], names=["conv_id", "n_turns", "roles", "chat"])

    return run


def format_chats(transcripts: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """(conv_id, n_turns, roles, chat), a row for each transcript.

    A null transcript has null results; an empty or blank one no turns. Turns without content are left out. Ids, also null or repeated ones, are passed on; other columns are not looked at; an empty table gives no rows.
    """
    kind = transcripts.schema[id_col].dataType.simpleString()
    return transcripts.select(F.col(id_col).alias("conv_id"), F.col(text_col).cast("string").alias("x")).mapInArrow(_format(model), f"conv_id {kind}, n_turns int, roles array<string>, chat string")


def to_transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, transcript): the turns of each conversation in order, each after a marker that its role names, in one of four styles by the conversation.

    A null role has no marker; a null text leaves its turn out; rows with a null conversation are left out. Turns that share a number, or have none (these first), are ordered by role and text; repeated rows stay.
    """
    style = F.pmod(F.xxhash64(conv_col), F.lit(4))
    role: Column = F.col(role_col)
    other = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(F.initcap(role))
    mark = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit("\n"))).when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(other, F.lit(": ")))
    said = F.concat(F.coalesce(mark, F.lit("")), F.col(text_col))
    rows = turns.where(F.col(conv_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("t"), role.alias("r"), said.alias("s")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("transcript"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return format_chats(to_transcripts(turns), fit(turns)).withColumn("roles", F.array_join("roles", ","))


_SQL = r"""
SELECT conv_id, CAST(count(*) AS INT) AS n_turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
FROM conversations WHERE conv_id IS NOT NULL AND regexp_matches(text, '\S') GROUP BY conv_id"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLE_SQL = {"op9_chat_format": _SQL}
