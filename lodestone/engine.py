"""The engine: tables and file trees, queried by text."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import registry
from .lang.parser import Parser, QueryError
from .lang.tree import Col, Item, Query, Root, Star
from .plans.compiler import Compiler, is_grouped, scan_columns
from .plans.scope import BINDINGS
from .plans.values import US_DATES
from .sinks.colors import Colors
from .sinks.render import render
from .sources import fsentries
from .sources.fields import EXTENSIONS, FIELDS, OWN_EXTENSIONS

#: Fields that a scan knows without asking the file system about each entry.
FROM_PATH = {"name", "filename", "fname", "ext", "extension", "path", "abspath", "dir", "directory", "dirname", "absdir", "is_hidden", "is_archive", "is_audio", "is_book", "is_doc", "is_font", "is_image", "is_source", "is_video"}


class Engine:
    """Runs queries. A root is a table given by name, a Parquet path, or a directory.

    tables: name -> DataFrame; bindings: table -> {field: column}, the columns that stand for a file's fields.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, bindings: dict[str, dict[str, str]] | None = None, config: dict | None = None):
        self.spark = spark
        self.tables = {k.lower(): v for k, v in (tables or {}).items()}
        self.bindings = BINDINGS | (bindings or {})
        self.config = config or {}
        self.listings: dict[str, DataFrame] = {}
        self._stat = True

    @classmethod
    def over(cls, spark: SparkSession, folder: str, names: tuple[str, ...] | list[str]) -> Engine:
        """Over the Parquet tables of a folder that Spark can read."""
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def register(self, name: str, df: DataFrame, bindings: dict[str, str] | None = None) -> None:
        self.tables[name.lower()] = df
        if bindings:
            self.bindings = self.bindings | {name.lower(): bindings}

    def columns(self) -> set[str]:
        """Names that are columns somewhere."""
        return {c.lower() for df in self.tables.values() for c in df.columns} | set(FIELDS)

    def parse(self, text: str) -> Query:
        columns = self.columns()
        known = registry.FUNCTIONS.keys() | registry.AGGREGATES.keys()
        shown = lambda w: FIELDS[w].name.capitalize() if w in FIELDS else None
        parser = Parser(text, columns.__contains__, known.__contains__, lambda w: w in registry.FUNCTIONS and registry.FUNCTIONS[w].bare, shown)
        return parser.parse()

    def sql(self, text: str) -> DataFrame:
        """The result of a query as a DataFrame."""
        return self.run(self.parse(text))

    def run(self, query: Query) -> DataFrame:
        used = scan_columns(query)
        self._stat = bool(used - FROM_PATH) or "*" in used
        token = US_DATES.set(bool(self.config.get("us_dates")))
        lists = OWN_EXTENSIONS.set({k: self.config[k] for k in EXTENSIONS if k in self.config})
        try:
            return Compiler(self).result(query)
        finally:
            US_DATES.reset(token)
            OWN_EXTENSIONS.reset(lists)

    def snapshot(self, name: str, path: str, folder: str, **options) -> DataFrame:
        """Write a listing of a file tree as Parquet to a folder; from then on `from name` reads the listing instead of walking the tree."""
        fsentries.scan(self.spark, path, **options).write.mode("overwrite").parquet(folder)
        self.listings[name.lower()] = found = self.spark.read.parquet(folder)
        return found

    def stream(self, query: str, colors: Colors | None = None) -> Iterator[str]:
        """The result of a query in the format that it asks for, row by row; with colours, names of files are painted by their modes."""
        parsed = self.parse(query)
        own = [i.expr for i in parsed.items]
        named = [i for i, x in enumerate(own) if isinstance(x, Col) and x.name == "name"]
        if colors is None or parsed.into not in ("tabs", "lines") or not named or is_grouped(parsed) or any(isinstance(x, Star) for x in own):
            return render(self.run(parsed), parsed.into, parsed.text)
        root = own[named[0]].root
        parsed.items = parsed.items + [Item(Col("mode", root, "mode")), Item(Col("is_broken_symlink", root, "is_broken_symlink"))]

        def painted(row: list[str]) -> list[str]:
            *row, mode, broken = row
            return [colors.paint(v, mode, broken == "true") if i in named else v for i, v in enumerate(row)]

        return render(self.run(parsed), parsed.into, parsed.text, painted)

    def text(self, query: str) -> str:
        """The whole result of a query as one text."""
        return "".join(self.stream(query))

    def table(self, root: Root) -> tuple[DataFrame, bool, dict[str, str]]:
        """A root's rows, whether they are files, and which columns stand for fields."""
        name = root.path.lower()
        if name in self.listings:
            return self.listings[name].filter(F.col("_depth").between(root.options.get("mindepth", 0), root.options.get("maxdepth") or 1 << 30)), True, {}
        if name in self.tables:
            return self.tables[name], False, self.bindings.get(name, {})
        if name.endswith(".parquet"):
            stem = os.path.basename(name)[: -len(".parquet")]
            return self.spark.read.parquet(root.path), False, self.bindings.get(stem, {})
        options = {"stat": self._stat, **{k: self.config[k] for k in ("gitignore", "hgignore", "dockerignore", "is_zip_archive", "errors") if k in self.config}, **root.options}
        return fsentries.scan(self.spark, root.path, **options), True, {}


__all__ = ["Engine", "QueryError"]
