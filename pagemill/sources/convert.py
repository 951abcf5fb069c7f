"""Formats to markdown, a document at a time; tables that Spark reads itself have DataFrame converters."""

from __future__ import annotations

import configparser
import csv
import html
import io
import json
import re
import textwrap
import tomllib
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.store import numbered

ROWS = 50
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "pre", "blockquote", "header", "footer", "main", "nav", "item", "entry", "title", "description"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0
        self.cells = 0  # of the row so far
        self.rows = 0  # of the table so far

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "\n| ")
            self.cells += 1
        elif tag == "tr":
            self.cells = 0
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "tr":
            if self.cells:
                self.out.append(" |" + ("\n|" + " --- |" * self.cells if not self.rows else ""))
                self.rows, self.cells = self.rows + 1, 0
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(raw: str) -> str:
    parser = _Html()
    parser.feed(raw)
    parser.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def fold(text: str, width: int = 80) -> str:
    """Lines of at most width characters where words allow it; blank lines stay."""
    one = lambda x: textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False, subsequent_indent=" " * (2 if x.startswith("* ") else 0)) or [""]
    return "\n".join(part for line in text.split("\n") for part in one(line))


def markdown_text(raw: str, width: int = 80) -> str:
    """Markdown as plain text: paragraphs joined and folded, marks of emphasis, links and headings gone, code as it is."""
    out: list[str] = []
    said: list[str] = []
    code = False

    def close() -> None:
        if said:
            out.append(fold(" ".join(said), width))
            said.clear()

    for line in raw.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            close()
            code = not code
            continue
        if code:
            out.append(line)
            continue
        line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
        line = re.sub(r"(\*\*|__|`|~~)(.+?)\1", r"\2", line)
        line = re.sub(r"(?<![\w*])[*_](\S(?:.*?\S)?)[*_](?![\w*])", r"\1", line).strip()
        if not line:
            close()
            if out and out[-1]:
                out.append("")
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            out.append(m[2])
        elif re.fullmatch(r"(?:[-*_]\s*){3,}", line) or re.fullmatch(r"\|?[\s:|-]+\|?", line):
            close()
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", line):
            close()
            said.append(("* " if line[0] in "-*+" else line.split()[0] + " ") + m[1])
        elif line.startswith("|"):
            close()
            out.append(line)
        else:
            said.append(line.removeprefix("> "))
    close()
    return "\n".join(out).strip()


def plain_text(kind: str, raw: str, width: int = 80) -> str | None:
    """What a reader shows of a format: text as it is, markdown and HTML folded; None for others."""
    return raw if kind == "text" else markdown_text(raw, width) if kind == "markdown" else fold(html_text(raw), width) if kind in ("html", "xml") else None


def cell(value: object) -> str:
    if isinstance(value, list):
        return "[...]"
    if isinstance(value, dict):
        return "{...}"
    said = "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return said.replace("|", "\\|").replace("\n", " ").strip()


def table(header: list[str], rows: list[list[str]]) -> str:
    line = lambda x: "| " + " | ".join(x) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def render(value: object, depth: int = 3) -> str:
    """Objects as headings by sorted key, arrays of objects as tables of ROWS rows, other arrays as lists."""
    if isinstance(value, dict):
        return "\n\n".join(f"{'#' * min(depth, 6)} {k}\n\n{render(v, depth + 1)}" for k, v in sorted(value.items()))
    if isinstance(value, list):
        if not value:
            return "(empty array)"
        if all(isinstance(x, dict) for x in value):
            keys = sorted({k for x in value for k in x})
            parts = [table(keys, [[cell(x.get(k)) for k in keys] for x in value[i : i + ROWS]]) for i in range(0, len(value), ROWS)]
            return parts[0] if len(parts) == 1 else "\n\n".join(f"{'#' * min(depth, 6)} Table chunk {i + 1}\n\n{p}" for i, p in enumerate(parts))
        # of what lies in a list, objects are written out below their label; lists within lists are labels only
        line = lambda i, x: "  " * (depth - 3) + (f"- item {i + 1}" if isinstance(x, list | dict) else f"- {cell(x)}")
        return "\n".join(line(i, x) + (f"\n\n{render(x, depth + 1)}\n" if isinstance(x, dict) else "") for i, x in enumerate(value)).rstrip()
    return cell(value)


def ini(raw: str) -> dict:
    parser = configparser.ConfigParser(allow_no_value=True, default_section="\0", interpolation=None, strict=False)
    parser.read_string("[default]\n" + raw)
    return {s: {k: v or "" for k, v in parser[s].items()} for s in parser.sections() if s != "default" or parser[s]}


def delimited(raw: str, sep: str, stem: str) -> str:
    rows = list(csv.reader(io.StringIO(raw), delimiter=sep))
    if not rows or len(rows) == 1:
        return f"# {stem}\n\n(no rows)"
    header, body = [cell(x) for x in rows[0]], [r for r in rows[1:] if r]
    if any(len(r) != len(header) for r in body):
        raise ValueError("a row of another length than the header")
    return f"# {stem}\n\n" + "\n\n".join(f"## Rows {i + 1}-{min(i + ROWS, len(body))}\n\n" + table(header, [[cell(x) for x in r] for r in body[i : i + ROWS]]) for i in range(0, len(body), ROWS))


def _plain_tex(part: str) -> str:
    return re.sub(r"[{}\\]", "", part).strip()


def tex(raw: str) -> str:
    """Headings, lists by depth, tables with a header, and everything else joined to paragraphs, which blank lines don't end."""
    out: list[str] = []
    said: list[str] = []
    rows: list[list[str]] | None = None
    depth = 0

    def close(with_table: bool = True) -> None:
        nonlocal rows
        if said:
            out.append(" ".join(said) + "\n\n")
            said.clear()
        if with_table and rows is not None:
            if rows:
                wide = max(map(len, rows))
                rule = "|" + " --- |" * wide
                body = ["| " + " | ".join(r + [""] * (wide - len(r) if i else 0)) + " |" for i, r in enumerate(rows)]
                out.append("\n".join([body[0], rule, *body[1:]]) + "\n\n")
            rows = None

    for line in raw.splitlines():
        line = line.split("%", 1)[0].strip()
        if not line:
            continue
        if m := re.match(r"\\((?:sub){0,2})section\s*\{([^}]*)\}", line):
            close()
            out.append(f"{'#' * (2 + len(m[1]) // 3)} {_plain_tex(m[2])}\n\n")
        elif m := re.match(r"\\(begin|end)\{(?:itemize|enumerate)\}", line):
            if m[1] == "begin":
                close(with_table=False)
            depth = max(0, depth + (1 if m[1] == "begin" else -1))
        elif line.startswith("\\item"):
            if rows is not None:
                close()
            out.append("  " * max(0, depth - 1) + f"- {_plain_tex(line[5:])}\n")
        elif line.startswith("\\begin{tabular}"):
            close(with_table=False)
            rows = []
        elif line.startswith("\\end{tabular}"):
            close()
        elif rows is not None:
            rows += [c for c in ([x for x in map(_plain_tex, row.split("&")) if x] for row in line.split("\\\\")) if c]
        else:
            said.append(line)
    close()
    return "".join(out)


def bib(raw: str) -> str:
    out, at = [], 0
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", raw):
        out += [f"> {x.strip()}" for x in raw[at : m.start()].split("\n") if x.strip()]
        depth, end = 1, m.end()
        while end < len(raw) and depth:
            depth += {"{": 1, "}": -1}.get(raw[end], 0)
            end += 1
        fields = re.findall(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\w+))", raw[m.end() : end])
        out.append(f"### [{m[2]}] {m[1].lower()}\n" + "\n".join(f"- **{k.lower()}**: {(a or b or c).strip()}" for k, a, b, c in fields))
        at = end
    out += [f"> {x.strip()}" for x in raw[at:].split("\n") if x.strip()]
    return "\n\n".join(out)


def bbl(raw: str) -> str:
    parts = re.split(r"\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}", raw)
    return "\n\n".join(f"### [{k}]\n\n{' '.join(re.sub(r'\\(begin|end)\{[^}]*\}(\{[^}]*\})?', '', t).split())}" for k, t in zip(parts[1::2], parts[2::2], strict=True))


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?[0-9]+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)|\\$")


def rtf(raw: str) -> str:
    """Text of the groups that hold text: braces are counted, control words go, paragraph marks are line ends, escaped characters stay."""
    out, silent, depth = [], 0, 0  # silent: the depth of a group that holds no text
    for m in _RTF.finditer(raw):
        byte, word, number, sign, brace, text = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            silent = 0 if depth < silent else silent
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or sign == "*":
            silent = silent or depth
        elif silent:
            continue
        elif byte:
            out.append(bytes([int(byte, 16)]).decode("latin-1"))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif sign and sign in "{}\\":
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif text:
            out.append(text.replace("\r", "").replace("\n", ""))
    return "".join(out).strip()


def to_markdown(kind: str, raw: str, stem: str) -> str | None:
    """None for a format that has no reader here."""
    if kind in ("text", "markdown"):
        return raw
    if kind in ("html", "xml", "rss", "atom"):
        return f"# {stem}\n\n{html_text(raw)}"
    if kind == "json":
        return f"# {stem}\n\n{render(json.loads(raw))}"
    if kind == "yaml":
        import yaml

        return f"# {stem}\n\n{render(json.loads(json.dumps(yaml.safe_load(raw), default=str)))}"
    if kind == "toml":
        return f"# {stem}\n\n{render(json.loads(json.dumps(tomllib.loads(raw), default=str)))}"
    if kind == "ini":
        return f"# {stem}\n\n{render(ini(raw))}"
    if kind in ("csv", "tsv"):
        return delimited(raw, "," if kind == "csv" else "\t", stem)
    if kind == "log":
        return f"# {stem} (log)\n\n```text\n{raw.rstrip()}\n```"
    made = {"tex": tex, "bib": bib, "bbl": bbl, "rtf": rtf}.get(kind)
    return made(html.unescape(raw) if kind == "rtf" else raw) if made else None


def cell_column(c: Column) -> Column:
    return F.trim(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def table_markdown(df: DataFrame, order: str, columns: list[str], rows: int = ROWS) -> DataFrame:
    """(chunk, text): a table of df's columns for each `rows` rows in an order, ties by the columns. No task sees the whole table."""
    kept = df.select(F.col(order).alias("__order"), *columns)
    ranked = numbered(kept, ("__order", *columns))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell_column(F.col(c)) for c in columns)), F.lit(" |"))
    held = F.array_sort(F.collect_list(F.struct("n", line.alias("l"))))
    top = "| " + " | ".join(columns) + " |\n" + "| " + " | ".join(["---"] * len(columns)) + " |\n"
    grouped = ranked.groupBy(F.floor((F.col("n") - 1) / rows).alias("chunk")).agg(held.alias("h"))
    return grouped.select("chunk", F.concat(F.lit("## Rows "), (F.col("chunk") * rows + 1).cast("string"), F.lit("-"), (F.col("chunk") * rows + F.size("h")).cast("string"), F.lit("\n\n" + top), F.array_join(F.transform("h", lambda x: x["l"]), "\n")).alias("text"))
