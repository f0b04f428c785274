"""Ignore files of three kinds. Each becomes an ordered list of rules; the last rule that matches a path decides."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    base: str
    pattern: re.Pattern
    ignored: bool = True
    only_dirs: bool = False
    search: bool = False

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.only_dirs and not is_dir or not path.startswith(self.base + os.sep):
            return False
        rest = path[len(self.base) + 1 :].replace(os.sep, "/")
        return bool(self.pattern.search(rest) if self.search else self.pattern.fullmatch(rest))


def glob_body(glob: str) -> str:
    """Regex of a path glob: * and ? stay in a segment, ** spans any number, [...] is a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


def git_rules(folder: str) -> list[Rule]:
    """Rules of a folder's .gitignore. A pattern with a slash before its end is tied to the folder."""
    out = []
    for line in _lines(os.path.join(folder, ".gitignore")):
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        tied = "/" in line
        out.append(Rule(folder, re.compile(("" if tied else "(?:.*/)?") + glob_body(line.lstrip("/")), re.S), not negated, only_dirs))
    return out


def hg_rules(folder: str, file: str | None = None) -> list[Rule]:
    """Rules of a Mercurial ignore file: regexp (searched) by default or glob, after syntax lines or prefixes; subinclude reads another file for its folder."""
    out, syntax = [], "regexp"
    for line in _lines(file or os.path.join(folder, ".hgignore")):
        line = re.sub(r"(?<!\\)#.*", "", line).replace("\\#", "#").strip()
        if not line:
            continue
        if m := re.fullmatch(r"syntax:\s*(\w+)", line):
            syntax = {"re": "regexp", "rootglob": "rootglob"}.get(m[1], m[1])
            continue
        kind, body = syntax, line
        if m := re.match(r"(re|regexp|glob|relre|relglob|rootglob|subinclude|include):", line):
            kind, body = m[1], line[m.end() :]
        if kind in ("subinclude", "include"):
            other = os.path.join(folder, body.strip())
            out += hg_rules(os.path.dirname(other) if kind == "subinclude" else folder, other)
            continue
        try:
            if kind in ("regexp", "re", "relre"):
                out.append(Rule(folder, re.compile(body), search=True))
            else:
                out.append(Rule(folder, re.compile(("" if kind == "rootglob" else "(?:.*/)?") + glob_body(body) + "(?:/.*)?", re.S)))
        except re.error:
            continue
    return out


def docker_rules(folder: str) -> list[Rule]:
    """Rules of a .dockerignore: all tied to its folder; a match of a folder covers what is in it."""
    out = []
    for line in _lines(os.path.join(folder, ".dockerignore")):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = os.path.normpath(line.lstrip("!").strip().strip("/"))
        if body != ".":
            out.append(Rule(folder, re.compile(glob_body(body) + "(?:/.*)?", re.S), not negated))
    return out


def ignored(rules: list[Rule], path: str, is_dir: bool) -> bool:
    return next((r.ignored for r in reversed(rules) if r.matches(path, is_dir)), False)


def above(folder: str, *names: str) -> str | None:
    """The nearest folder, this one or above, that has all these entries."""
    while True:
        if all(os.path.lexists(os.path.join(folder, n)) for n in names):
            return folder
        if folder == os.path.dirname(folder):
            return None
        folder = os.path.dirname(folder)


def rules_above(root: str, options: dict) -> list[Rule]:
    """Rules in force at a root, from its folder and those above."""
    out: list[Rule] = []
    if options.get("gitignore"):
        top = above(root, ".git")
        folders = [root]
        while top and folders[-1] != top:
            folders.append(os.path.dirname(folders[-1]))
        for folder in reversed(folders):
            out += git_rules(folder)
    if options.get("hgignore") and (top := above(root, ".hg", ".hgignore")):
        out += hg_rules(top)
    if options.get("dockerignore") and (top := above(root, ".dockerignore")):
        out += docker_rules(top)
    return out
