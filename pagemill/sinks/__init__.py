"""Writers."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON object a line, nulls written out; as many files as the data have partitions."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_index(documents: DataFrame, pages: DataFrame, cells: DataFrame, root: str, mode: str = "append") -> None:
    for name, df in (("documents", documents), ("pages", pages), ("cells", cells)):
        df.write.mode(mode).parquet(f"{root}/index/{name}")


def dataset_card(questions: int, summaries: int) -> str:
    return "\n".join(["# Dataset", "", f"- QA samples: {questions}", f"- Summary samples: {summaries}"])


def report_html(rollup: dict, rows: list[dict]) -> str:
    """A page with the rollup and a row for each document; for reports of a bounded number of rows."""
    names = list(rows[0]) if rows else []
    line = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in xs) + "</tr>"
    return f"<html><body><pre>{html.escape(json.dumps(rollup, indent=2, default=str), quote=False)}</pre><table>{line('th', names)}{''.join(line('td', r.values()) for r in rows)}</table></body></html>"
