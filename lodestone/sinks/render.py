"""Results as text: tabs, lines, list, csv, json and html. Rows stream from the executors; only one partition is held at a time."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.values import text, typed


def as_text(df: DataFrame) -> DataFrame:
    """All columns as texts; missing values are empty."""
    return df.select(*[F.coalesce(text(typed(F.col(f"`{f.name}`"), f.dataType)), F.lit("")).alias(f.name) for f in df.schema.fields])


def render(df: DataFrame, into: str = "tabs", title: str = "", shown: Callable[[list[str]], list[str]] = list) -> Iterator[str]:
    """A result row by row. shown: what to print of a row's texts."""
    names = df.columns
    rows = (shown([v or "" for v in r]) for r in as_text(df).toLocalIterator())
    if into == "tabs":
        yield from ("\t".join(r) + "\n" for r in rows)
    elif into == "lines":
        yield from ("".join(v + "\n" for v in r) for r in rows)
    elif into == "list":
        yield from ("".join(v + "\0" for v in r) for r in rows)
    elif into == "csv":
        for r in rows:
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerow(r)
            yield out.getvalue()
    elif into == "json":
        yield "["
        for i, r in enumerate(rows):
            yield ("," if i else "") + json.dumps(dict(zip(names, r, strict=True)), ensure_ascii=False, separators=(",", ":"))
        yield "]"
    elif into == "html":
        yield f"<html><head><title>{html.escape(title, quote=True)}</title></head><body><table>"
        yield from ("<tr>" + "".join(f"<td>{html.escape(v, quote=False).replace(chr(34), '&quot;')}</td>" for v in r) + "</tr>" for r in rows)
        yield "</table></body></html>"
    else:
        raise ValueError(f"unknown output format {into}")


def write(df: DataFrame, path: str, into: str = "csv") -> None:
    """Write a result as files of a format that Spark's writers have: tabs, csv or json; every executor writes its part."""
    shown = as_text(df)
    if into == "json":
        shown.write.json(path)
    else:
        shown.write.option("sep", "\t" if into == "tabs" else ",").csv(path)
