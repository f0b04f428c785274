"""python -m lodestone.cli QUERY...: run a query and print its result. Without a query it reads them from a prompt."""

from __future__ import annotations

import argparse
import cmd
import os
import shlex
import sys
import time
import tomllib

from pyspark.sql import SparkSession

try:
    import readline
except ImportError:  # not on every platform
    readline = None

from . import __version__
from .engine import Engine, QueryError
from .functions import registry
from .lang.parser import FORMATS, OPTIONS
from .sinks.colors import Colors
from .sources.fsentries import MissingRoot
from .sources.fields import FIELDS


def load_config(path: str | None) -> dict:
    for place in [path] if path else ["lodestone.toml", os.path.expanduser("~/.config/lodestone/config.toml")]:
        if place and os.path.exists(place):
            with open(place, "rb") as f:
                return tomllib.load(f)
    return {}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def terminal_colors(config: dict, off: bool = False) -> Colors | None:
    """Colours, if the output is a terminal and neither a switch, the configuration nor NO_COLOR forbids them."""
    if off or config.get("no_color") or os.environ.get("NO_COLOR") or not sys.stdout.isatty():
        return None
    return Colors(os.environ.get("LS_COLORS"))


def execute(engine: Engine, query: str, debug: bool = False, errors: bool = True, colors: Colors | None = None) -> int:
    """Print a result as its rows come; 0, 1 for a root that isn't there, or 2 for a query that can't be run."""
    began = time.time()
    try:
        for part in engine.stream(query, colors):
            sys.stdout.write(part)
    except QueryError as e:
        if errors:
            print(f"error: {e}", file=sys.stderr)
        return 1 if isinstance(e, MissingRoot) else 2
    except BrokenPipeError:
        return 0
    if debug:
        print(f"{(time.time() - began) * 1000:.0f} ms", file=sys.stderr)
    return 0


class Prompt(cmd.Cmd):
    prompt = "query> "
    history = os.path.expanduser("~/.config/lodestone/history")

    def preloop(self):
        """Lines of earlier sessions can be recalled, where Python has readline."""
        if readline and os.path.exists(self.history):
            readline.read_history_file(self.history)

    def postloop(self):
        if readline:
            os.makedirs(os.path.dirname(self.history), exist_ok=True)
            readline.write_history_file(self.history)

    def __init__(self, engine: Engine, colors: Colors | None = None):
        super().__init__()
        self.engine, self.debug, self.show_errors, self.colors = engine, False, True, colors

    def default(self, line: str):
        if line.strip() == "EOF":
            return True
        execute(self.engine, line.rstrip(";"), self.debug, self.show_errors, self.colors)
        return None

    def do_cd(self, path: str):
        """Change the working folder."""
        try:
            os.chdir(os.path.expanduser(path or "~"))
        except OSError as e:
            print(e)

    def do_pwd(self, _: str):
        """Show the working folder."""
        print(os.getcwd())

    def do_debug(self, on: str):
        """debug on|off: print how long queries take."""
        self.debug = on.strip() != "off"

    def do_errors(self, on: str):
        """errors on|off: print errors."""
        self.show_errors = on.strip() != "off"

    def do_quit(self, _: str):
        """Leave."""
        return True

    do_exit = do_quit


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description="Query files and tables with relaxed SQL.")
    parser.add_argument("--config")
    parser.add_argument("--no-errors", action="store_true")
    parser.add_argument("--nocolor", action="store_true", help="names are never coloured")
    parser.add_argument("--us-dates", action="store_true", help="read 1/2/2024 as January 2")
    parser.add_argument("--version", action="version", version=f"lodestone {__version__}")
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table to query by name")
    parser.add_argument("-i", "--interactive", action="store_true")
    for kind in ("fields", "functions", "root-options", "output-formats"):
        parser.add_argument(f"--{kind}", action="store_true")
    parser.add_argument("query", nargs="*")
    args = parser.parse_args(argv)
    lists = {"fields": sorted(FIELDS), "functions": sorted([*registry.FUNCTIONS, *registry.AGGREGATES]), "root_options": sorted({o[1] for o in OPTIONS} - {"order"} | {"bfs", "dfs"}), "output_formats": FORMATS}
    for kind, names in lists.items():
        if getattr(args, kind):
            print("\n".join(names))
            return 0
    config = load_config(args.config) | ({"us_dates": True} if args.us_dates else {}) | ({"errors": False} if args.no_errors else {})
    colors = terminal_colors(config, args.nocolor)
    spark = session()
    engine = Engine(spark, {n: spark.read.parquet(p) for n, _, p in (t.partition("=") for t in args.table)}, config=config)
    if args.interactive or not args.query:
        Prompt(engine, colors).cmdloop()
        return 0
    query = args.query[0] if len(args.query) == 1 else " ".join(shlex.quote(a) if " " in a and not a.startswith(("'", '"')) else a for a in args.query)
    return execute(engine, query, bool(engine.config.get("debug")), not args.no_errors, colors)


if __name__ == "__main__":
    sys.exit(main())
