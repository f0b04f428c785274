"""What the names of a query mean: a scope for each root."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fields import FIELDS, derive
from .values import Value, typed

#: A table's columns that stand for a file's fields, by table.
BINDINGS = {
    "documents": {"name": "doc_id", "size": "n_chars", "dir": "source", "ext": "lang", "content": "text"},
    "events": {"name": "event_type", "size": "value", "modified": "ts"},
    "pages": {"path": "url", "name": "url", "content": "html"},
    "conversations": {"content": "text"},
    "benchmark": {"content": "text"},
}
#: The columns of `select *` over files.
FILE_STAR = ("mode", "user", "group", "size", "modified", "path")


@dataclass
class Scope:
    alias: str | None
    values: dict[str, Value]
    is_file: bool = False
    bindings: dict[str, str] = field(default_factory=dict)

    def get(self, name: str) -> Value | None:
        """A column, by its own name or the name of the field that it stands for."""
        return self.values.get(name) or self.values.get(self.bindings.get(name, ""))

    def resolve(self, name: str) -> Value | None:
        known = None if self.is_file and name in ("name", "path") and name not in self.values else self.get(name)
        if known is None and name in FIELDS:
            canonical = FIELDS[name].name
            known = self.get(canonical) or derive(FIELDS[name], self.get, self.is_file)
        return known

    def star(self) -> list[str]:
        return list(FILE_STAR) if self.is_file else list(self.values)

    def file(self) -> Value | None:
        """What functions of a file read: the contents that a column holds, or the path."""
        if self.is_file:
            return Value(self.values["abspath"].col, "path")
        return self.get("content")


def framed(df: DataFrame, alias: str | None, number: int, is_file: bool, bindings: dict[str, str]) -> tuple[DataFrame, Scope]:
    """df with column names that no other root has, and its scope. Of names that differ in case only, the first counts."""
    names: dict[str, str] = {}
    for c in df.columns:
        names.setdefault(c.lower(), c)
    out = df.select(*[F.col(f"`{c}`").alias(f"r{number}_{n}") for n, c in names.items()])
    values = {n: typed(F.col(f"`r{number}_{n}`"), out.schema[f"r{number}_{n}"].dataType) for n in names}
    return out, Scope(alias, values, is_file, {k: v for k, v in bindings.items() if v in values and k not in values})
