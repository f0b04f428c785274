"""A Spark data source of directory entries: one row per file, folder and (asked for) member of a zip archive.

Folders are listed breadth-first until there are enough of them, and are then walked by tasks of their own. Executors read the tree by its path, so on a cluster a root is on a file system that all mount.
"""

from __future__ import annotations

import ctypes
import grp
import json
import os
import pwd
import re
import stat
import struct
import sys
import zipfile
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..lang.parser import QueryError
from ..shipping import ship
from . import ignore
from .fields import SCAN, ZIP_EXTENSIONS

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in SCAN.items()])
ROWS = 5000


@lru_cache(4096)
def _owner(kind: str, number: int) -> str:
    try:
        return pwd.getpwuid(number)[0] if kind == "user" else grp.getgrgid(number)[0]
    except KeyError:
        return ""


class MissingRoot(QueryError):
    """A root that is no folder."""


#: Folders that are known before the walk is dealt out, and tasks that they are dealt to, for each core of the session.
FOLDERS, TASKS = 16, 3


class Folders(InputPartition):
    """Folders (path, depth of their entries, ignore rules above) that one task walks; deep: and what is below them."""

    def __init__(self, folders: list[tuple[str, int, list]], deep: bool):
        super().__init__((folders, deep))
        self.folders, self.deep = folders, deep


@lru_cache(1)
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def birth_ns(path: str) -> int | None:
    """When an entry was made, by statx; None where the file system or the system doesn't say."""
    out = ctypes.create_string_buffer(256)
    try:
        # The fixed layout of statx: its mask begins the block, the time of birth lies at 80.
        if _libc().statx(-100, os.fsencode(path), 0x100, 0x800, out) == 0 and struct.unpack_from("I", out, 0)[0] & 0x800:
            seconds, ns = struct.unpack_from("qI", out, 80)
            return seconds * 1_000_000_000 + ns
    except (AttributeError, OSError):
        pass
    return None


class Walk:
    """One root's traversal."""

    def __init__(self, root: str, options: dict):
        self.root, self.o = os.path.abspath(root), options
        self.most = options.get("maxdepth") or 1 << 30
        self.least = options.get("mindepth") or 0
        self.seen: set[str] = set()
        self.real = lru_cache(1024)(os.path.realpath)
        self.above = len(self.root.rstrip("/")) + 1

    def report(self, e: Exception, path: str) -> None:
        """Say what couldn't be read, where this task logs; the walk goes on."""
        if self.o.get("errors", True):
            print(f"{path}: {e}", file=sys.stderr, flush=True)

    def entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError as e:
            self.report(e, folder)
            return []

    def into(self, entry: os.DirEntry) -> bool:
        """Is this a folder to walk? Links are followed if asked for, and no folder is walked twice."""
        follow = bool(self.o.get("symlinks"))
        try:
            if not entry.is_dir(follow_symlinks=follow):
                return False
        except OSError:
            return False
        if follow:
            real = os.path.realpath(entry.path)
            if real in self.seen:
                return False
            self.seen.add(real)
        return True

    def walk(self, folder: str, depth: int, rules: list[ignore.Rule], deep: bool = True) -> Iterator[tuple[int, os.DirEntry]]:
        """(depth, entry) below a folder, breadth or depth first."""
        if self.o.get("symlinks"):
            self.seen.add(os.path.realpath(folder))
        depth_first = self.o.get("order") == "dfs"
        queue = deque([(folder, depth, rules)])
        while queue:
            at, depth, rules = queue.popleft()
            if self.o.get("gitignore") and at != self.root:
                rules = rules + ignore.git_rules(at)
            nested = []
            for entry in self.entries(at):
                is_dir = entry.is_dir(follow_symlinks=False)
                if rules and ignore.ignored(rules, entry.path, is_dir) or self.o.get("gitignore") and entry.name == ".git":
                    continue
                go = deep and depth < self.most and self.into(entry)
                if depth_first:
                    yield depth, entry
                    if go:
                        yield from self.walk(entry.path, depth + 1, rules)
                else:
                    yield depth, entry
                    if go:
                        nested.append((entry.path, depth + 1, rules))
            queue.extend(nested)

    def row(self, entry: os.DirEntry, depth: int) -> dict:
        path = entry.path[self.above :]
        # Siblings are visited by name, so an entry's place in the walk is that of its path, part by part; breadth first, by depth before.
        seq = path.replace(os.sep, "\0") if self.o.get("order") == "dfs" else f"{depth:06}\0" + path.replace(os.sep, "\0")
        row = {"_seq": seq, "_depth": depth, "_root": self.root, "name": entry.name, "path": path, "abspath": os.path.join(self.real(os.path.dirname(entry.path)), entry.name)}
        if not self.o.get("stat", True):
            return row
        try:
            st = entry.stat(follow_symlinks=bool(self.o.get("symlinks")))
        except OSError:
            st = entry.stat(follow_symlinks=False)
        link = entry.is_symlink()
        row |= {
            "size": st.st_size, "mode_bits": st.st_mode, "is_link": link, "is_broken_symlink": link and not os.path.exists(entry.path), "link_target": os.readlink(entry.path) if link else "",
            "uid": st.st_uid, "gid": st.st_gid, "user": _owner("user", st.st_uid), "group": _owner("group", st.st_gid), "device": st.st_dev, "rdev": st.st_rdev, "inode": st.st_ino, "blocks": st.st_blocks,
            "blksize": st.st_blksize, "hardlinks": st.st_nlink, "atime_ns": st.st_atime_ns, "mtime_ns": st.st_mtime_ns, "ctime_ns": st.st_ctime_ns, "birth_ns": birth_ns(entry.path),
        }
        if stat.S_ISDIR(st.st_mode):
            try:
                with os.scandir(entry.path) as inside:
                    row["empty_dir"] = next(inside, None) is None
            except OSError:
                row["empty_dir"] = None
        return row

    def members(self, row: dict, entry: os.DirEntry) -> Iterator[dict]:
        if not self.o.get("archives") or not entry.name.lower().endswith(tuple(e.lower() for e in self.o.get("is_zip_archive", ZIP_EXTENSIONS))):
            return
        try:
            with zipfile.ZipFile(entry.path) as z:
                for i, m in enumerate(z.infolist(), 1):
                    mode = m.external_attr >> 16 or (stat.S_IFDIR | 0o755 if m.is_dir() else stat.S_IFREG | 0o644)
                    when = pa.scalar("{:04}-{:02}-{:02} {:02}:{:02}:{:02}".format(*m.date_time)).cast(pa.timestamp("ns")).value
                    yield {"_seq": f"{row['_seq']}\0{i:012}", "_depth": row["_depth"], "_root": self.root, "_archive": row["path"], "name": os.path.basename(m.filename.rstrip("/")), "path": m.filename, "abspath": f"{row['abspath']}/{m.filename}", "size": m.file_size, "mode_bits": mode if mode & 0o170000 else mode | stat.S_IFREG, "is_link": False, "is_broken_symlink": False, "link_target": "", "mtime_ns": when}
        except (OSError, zipfile.BadZipFile, pa.ArrowInvalid, NotImplementedError) as e:
            self.report(e, entry.path)

    def rows(self, part: Folders) -> Iterator[dict]:
        for folder, first, rules in part.folders:
            for depth, entry in self.walk(folder, first, rules, part.deep):
                if depth >= self.least:
                    row = self.row(entry, depth)
                    yield row
                    yield from self.members(row, entry)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[Folders]:
        walk = Walk(self.o["path"], self.o | {"errors": False})  # the tasks list these folders again
        ahead = [(walk.root, 1, ignore.rules_above(walk.root, self.o))]
        if self.o.get("symlinks"):  # no folder is walked twice, wherever links lead: one task has to know them all
            return [Folders(ahead, True)]
        cores = self.o.get("cores", 4)
        listed = []
        while ahead and len(ahead) < FOLDERS * cores:
            listed, below = listed + ahead, []
            for folder, depth, rules in ahead:
                if depth < walk.most:
                    own = rules + ignore.git_rules(folder) if self.o.get("gitignore") and folder != walk.root else rules
                    below += [(e.path, depth + 1, own) for _, e in walk.walk(folder, depth, rules, deep=False) if e.is_dir(follow_symlinks=False)]
            ahead = below
        return [Folders(part, deep) for folders, deep in ((listed, False), (ahead, True)) for i in range(TASKS * cores) if (part := folders[i :: TASKS * cores])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        batch: list[dict] = []
        for row in Walk(self.o["path"], self.o).rows(partition):
            batch.append(row)
            if len(batch) == ROWS:
                yield self.arrow(batch)
                batch = []
        if batch:
            yield self.arrow(batch)

    @staticmethod
    def arrow(rows: list[dict]) -> pa.RecordBatch:
        clean = lambda v: v if v is None or v.isascii() else v.encode("utf-8", "replace").decode()
        return pa.RecordBatch.from_arrays([pa.array([clean(r.get(n)) if t == pa.string() else r.get(n) for r in rows], t) for n, t in zip(SCHEMA.names, SCHEMA.types, strict=True)], schema=SCHEMA)


class FsEntries(DataSource):
    """format("fsentries"): options path, mindepth, maxdepth, symlinks, archives, gitignore, hgignore, dockerignore, order (bfs, dfs), stat, errors (say what can't be read), cores (that the walk is dealt out for) and is_zip_archive (a JSON list of extensions)."""

    @classmethod
    def name(cls) -> str:
        return "fsentries"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in SCAN.items())

    def reader(self, schema) -> Reader:
        def read(k, v):
            return json.loads(v) if k == "is_zip_archive" else int(v) if k.endswith("depth") or k == "cores" else v if k in ("path", "order") else str(v).lower() == "true"

        known = ("path", "mindepth", "maxdepth", "symlinks", "archives", "gitignore", "hgignore", "dockerignore", "order", "stat", "errors", "cores", "is_zip_archive")
        return Reader({k: read(k, self.options[k]) for k in known if k in self.options})


def expand(path: str, regexp: bool) -> list[str]:
    """The folders that a root means: ~ is the home folder; with regexp, segments with *, [ or ? are patterns of whole folder names."""
    path = os.path.abspath(os.path.expanduser(path))
    if not regexp:
        return [path]
    found = ["/"]
    for segment in path.strip("/").split("/"):
        if re.search(r"[*\[?]", segment):
            try:
                pattern = re.compile(segment)
            except re.error as e:
                raise QueryError(f"bad pattern {segment}: {e}") from e
            found = [os.path.join(f, n) for f in found if os.path.isdir(f) for n in sorted(os.listdir(f)) if pattern.fullmatch(n) and os.path.isdir(os.path.join(f, n))]
        else:
            found = [os.path.join(f, segment) for f in found]
    return found


def scan(spark: SparkSession, path: str, regexp: bool = False, **options) -> DataFrame:
    """All entries below a path; a path that is no folder has none, and is an error unless it came from a pattern."""
    ship(spark)
    spark.dataSource.register(FsEntries)
    roots = expand(path, regexp)
    if not regexp and not os.path.isdir(roots[0]):
        raise MissingRoot(f"no such folder or table: {path}")
    out = None
    for root in roots:
        reader = spark.read.format("fsentries").option("path", root).option("cores", spark.sparkContext.defaultParallelism)
        for k, v in options.items():
            reader = reader.option(k, json.dumps(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v))
        one = reader.load()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in SCAN.items()))
