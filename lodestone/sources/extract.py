"""What has to be read from a file itself. Arrow-batched functions over paths, used only for the fields that a query names."""

from __future__ import annotations

import codecs
import hashlib
import mmap
import os
import re
import struct
import subprocess
from datetime import datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import BOOL, FLOAT, INT, TIME

BLOCK = 1 << 16
#: Files whose facts a worker keeps: a whole Arrow batch, so that all fields of one kind come from one reading of a file.
KEPT = 10_000

_SPARK = {INT: "long", FLOAT: "double", BOOL: "boolean", TIME: "timestamp_ntz"}
FILE_FUNCTIONS: dict = {}


def reads(*names: str):
    def add(f):
        FILE_FUNCTIONS.update(dict.fromkeys(names, f))
        return f

    return add


def file_call(name: str, kind: str, path: Column, *args: Column) -> Column:
    """A field or function of the file at a path; missing where it can't be read."""

    @F.pandas_udf(_SPARK.get(kind, "string"))
    def call(paths: pd.Series, *rest: pd.Series) -> pd.Series:
        out = [evaluate(name, p, *a) for p, *a in zip(paths, *rest, strict=True)]
        if kind == INT:
            return pd.Series(out, dtype="Int64")
        if kind == FLOAT:
            return pd.Series([None if v is None else float(v) for v in out], dtype="Float64")
        if kind == TIME:
            return pd.Series(pd.to_datetime(out), dtype="datetime64[us]")
        return pd.Series(out, dtype="object" if kind != BOOL else "boolean")

    return call(path, *args)


def text_call(name: str, content: Column) -> Column:
    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.new({"sha3": "sha3_512"}[name], t.encode()).hexdigest(), na_action="ignore")

    return call(content)


def evaluate(name: str, path: str | None, *args):
    if path is None:
        return None
    try:
        f = FILE_FUNCTIONS[name]
        return f(path, *args) if f in _PLAIN else f(name, path, *args)
    except (OSError, ValueError, KeyError, IndexError, struct.error, UnicodeError, ZeroDivisionError):
        return None


def _blocks(path: str):
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            yield block


# Contents


@reads("sha1", "sha256", "sha512", "sha3")
def digest(name, path):
    h = hashlib.new({"sha3": "sha3_512"}.get(name, name))
    for b in _blocks(path):
        h.update(b)
    return h.hexdigest()


@reads("contains")
def contains(name, path, needle):
    want, tail = needle.encode(), b""
    if not want:
        return True
    for b in _blocks(path):
        if want in tail + b:
            return True
        tail = (tail + b)[-(len(want) - 1) :] if len(want) > 1 else b""
    return False


@reads("line_count")
def line_count(name, path):
    return sum(b.count(b"\n") for b in _blocks(path))


_BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


@lru_cache(KEPT)
def scan_text(path: str, stamp: int) -> dict:
    """Encoding, characters, words and line ends of a file in one pass of bounded memory."""
    with open(path, "rb") as f:
        start = f.read(4)
    bom, name = next(((b, n) for b, n in _BOMS if start.startswith(b)), (b"", None))
    ascii_, utf8, zeros = True, True, False
    if name is None:
        decoder = codecs.getincrementaldecoder("utf-8")()
        for b in _blocks(path):
            zeros = zeros or b"\0" in b
            ascii_ = ascii_ and b.isascii()
            if utf8:
                try:
                    decoder.decode(b)
                except UnicodeDecodeError:
                    utf8 = False
        if utf8:
            try:
                decoder.decode(b"", True)
            except UnicodeDecodeError:
                utf8 = False
        name = None if zeros else "ASCII" if ascii_ else "UTF-8" if utf8 else "ISO-8859-1"
    out = {"encoding": name, "has_bom": bool(bom), "chars": None, "words": None, "line_ending": None}
    if name is None:
        return out
    decoder = codecs.getincrementaldecoder({"ASCII": "utf-8"}.get(name, name).lower())("replace")
    chars = words = 0
    in_word, crlf, lf, cr, last = False, False, False, False, ""
    for i, b in enumerate(_blocks(path)):
        t = decoder.decode(b[len(bom) :] if not i else b)
        chars += len(t)
        parts = t.split()
        words += len(parts) - (1 if parts and in_word and not t[0].isspace() else 0)
        in_word = bool(t) and not t[-1].isspace() or (in_word and not t)
        joined = last + t
        crlf, lf = crlf or "\r\n" in joined, lf or bool(re.search(r"(?<!\r)\n", joined[len(last) - 1 if last == "\r" else 0 :]))
        cr = cr or bool(re.search(r"\r(?!\n|\Z)", joined))
        last = t[-1:] or last
    cr = cr or last == "\r"
    kinds = [n for n, x in (("CRLF", crlf), ("LF", lf), ("CR", cr)) if x]
    return out | {"chars": chars, "words": words, "line_ending": "mixed" if len(kinds) > 1 else kinds[0] if kinds else None}


@reads("word_count", "char_count", "encoding", "has_bom", "line_ending")
def text_field(name, path):
    if os.path.isdir(path):
        return None
    found = scan_text(path, os.stat(path).st_mtime_ns)
    return found[{"word_count": "words", "char_count": "chars"}.get(name, name)]


@reads("is_shebang")
def is_shebang(name, path):
    return _head(path, 2) == b"#!"


def _head(path: str, n: int) -> bytes:
    with open(path, "rb") as f:
        return f.read(n)


def _view(path: str) -> mmap.mmap:
    """All bytes of a file, mapped: only what is looked at is read, wherever in the file it lies. Empty files can't be mapped (ValueError)."""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


# Marks at the start of files of known types.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"BZh", "application/x-bzip2"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"\xfd7zXZ\0", "application/x-xz"), (b"Rar!", "application/vnd.rar"),
    (b"\x7fELF", "application/x-executable"), (b"ID3", "audio/mpeg"), (b"fLaC", "audio/flac"), (b"OggS", "application/ogg"), (b"\x1aE\xdf\xa3", "video/x-matroska"), (b"MThd", "audio/midi"), (b"<?xml", "text/xml"),
    (b"#!/bin/sh", "application/x-shellscript"), (b"#!/bin/bash", "application/x-shellscript"), (b"SQLite format 3\0", "application/vnd.sqlite3"),
)


@reads("mime")
def mime(name, path):
    import mimetypes

    if os.path.isdir(path):
        return "inode/directory"
    start = _head(path, 4096)
    if start[:4] == b"RIFF":
        return {b"WEBP": "image/webp", b"WAVE": "audio/x-wav", b"AVI ": "video/x-msvideo"}.get(start[8:12], "application/octet-stream")
    if start[4:8] == b"ftyp":
        return "video/mp4"
    if found := next((m for k, m in MAGIC if start.startswith(k)), None):
        return found
    guess = mimetypes.guess_type(path)[0]
    if not start:
        return guess if guess and guess.startswith("text/") else "application/x-zerosize"
    data = _view(path)
    if data.find(b"\0") >= 0:
        return guess if guess and not guess.startswith("text/") else "application/octet-stream"
    return guess if guess and guess.startswith("text/") else "text/html" if re.match(rb"\s*<(!doctype html|html)", start, re.I) else "image/svg+xml" if start.lstrip()[:1] == b"<" and data.find(b"<svg") >= 0 else "text/plain"


@reads("is_text", "is_binary")
def is_text(name, path):
    if os.path.isdir(path):
        return False
    m = mime("mime", path)
    found = m.startswith("text/") or "+xml" in m or "-xml" in m or m in ("application/x-awk", "application/x-perl", "application/x-php", "application/x-ruby", "application/x-shellscript")
    return found == (name == "is_text")


# Extended attributes


def _xattr(path: str, name: str) -> bytes | None:
    try:
        return os.getxattr(path, name, follow_symlinks=False)
    except OSError:
        return None


@reads("has_xattrs", "xattr_count")
def xattrs(name, path):
    n = len(os.listxattr(path, follow_symlinks=False))
    return n if name == "xattr_count" else n > 0


@reads("has_xattr", "xattr")
def xattr(name, path, key):
    found = _xattr(path, key) if "." in key else None
    found = found if found is not None else _xattr(path, "user." + key)
    return found is not None if name == "has_xattr" else None if found is None else found.decode("utf-8")


# Attribute flags of Linux file systems, and capabilities by number.
FLAGS = ((0x1, "s"), (0x2, "u"), (0x4, "c"), (0x8, "S"), (0x10, "i"), (0x20, "a"), (0x40, "d"), (0x80, "A"), (0x800, "E"), (0x1000, "I"), (0x4000, "j"), (0x8000, "t"), (0x10000, "D"), (0x20000, "T"), (0x80000, "e"), (0x100000, "V"), (0x800000, "C"), (0x2000000, "x"), (0x10000000, "N"), (0x20000000, "P"), (0x40000000, "F"))
CAPABILITIES = [
    "chown", "dac_override", "dac_read_search", "fowner", "fsetid", "kill", "setgid", "setuid", "setpcap", "linux_immutable", "net_bind_service", "net_broadcast",
    "net_admin", "net_raw", "ipc_lock", "ipc_owner", "sys_module", "sys_rawio", "sys_chroot", "sys_ptrace", "sys_pacct", "sys_admin", "sys_boot", "sys_nice",
    "sys_resource", "sys_time", "sys_tty_config", "mknod", "lease", "audit_write", "audit_control", "setfcap", "mac_override", "mac_admin", "syslog", "wake_alarm",
    "block_suspend", "audit_read", "perfmon", "bpf", "checkpoint_restore",
]


@reads("extattrs", "has_extattrs", "has_extattr")
def extattrs(name, path, flag=None):
    import fcntl

    with open(path, "rb") as f:
        value = struct.unpack("l", fcntl.ioctl(f, 0x80086601, struct.pack("l", 0)))[0]
    letters = "".join(c for bit, c in FLAGS if value & bit)
    return {"extattrs": letters, "has_extattrs": bool(letters), "has_extattr": bool(flag) and flag.strip() in letters and len(flag.strip()) == 1}[name]


def decode_acl(raw: bytes) -> list[str]:
    """Entries of a binary POSIX ACL, as type:qualifier:rwx."""
    if len(raw) < 4 or struct.unpack("<I", raw[:4])[0] != 2 or len(raw) % 8 != 4:
        raise ValueError("no ACL")
    out = []
    for tag, perm, who in struct.iter_unpack("<HHI", raw[4:]):
        kind = {1: "user", 2: "user", 4: "group", 8: "group", 16: "mask", 32: "other"}.get(tag)
        if kind:
            out.append(f"{kind}:{_who(kind, who) if tag in (2, 8) else ''}:" + "".join(c if perm & bit else "-" for bit, c in ((4, "r"), (2, "w"), (1, "x"))))
    return out


def _who(kind: str, number: int) -> str:
    import grp
    import pwd

    try:
        return pwd.getpwuid(number)[0] if kind == "user" else grp.getgrgid(number)[0]
    except KeyError:
        return str(number)


@reads("acl", "has_acl", "acl_entry", "has_acl_entry", "default_acl", "has_default_acl", "default_acl_entry", "has_default_acl_entry")
def acl(name, path, entry=None):
    raw = _xattr(path, "system.posix_acl_default" if "default" in name else "system.posix_acl_access")
    found = decode_acl(raw) if raw is not None else []
    if entry is not None:
        found = [e for e in found if e.rpartition(":")[0] == (entry if ":" in entry else entry + ":")]
        return bool(found) if name.startswith("has") else found[0].rpartition(":")[2] if found else ""
    return bool(found) if name.startswith("has") else ",".join(found)


def decode_capabilities(raw: bytes) -> list[str]:
    head = struct.unpack("<I", raw[:4])[0]
    words = struct.unpack(f"<{(len(raw) - 4) // 4}I", raw[4 : 4 + (len(raw) - 4) // 4 * 4])
    out = []
    for i, c in enumerate(CAPABILITIES):
        word, bit = divmod(i, 32)
        if 2 * word + 1 < len(words):
            permitted, inherited = words[2 * word] >> bit & 1, words[2 * word + 1] >> bit & 1
            if permitted or inherited:
                out.append(f"cap_{c}=" + ("e" if head & 1 else "") + ("i" if inherited else "") + ("p" if permitted else ""))
    return out


@reads("capabilities", "has_capabilities", "has_capability")
def capabilities(name, path, one=None):
    raw = _xattr(path, "security.capability")
    found = decode_capabilities(raw) if raw else []
    if one is not None:
        return any(c.partition("=")[0] in (one.lower(), "cap_" + one.lower()) for c in found)
    return " ".join(found) if name == "capabilities" else bool(found)


# Git


@lru_cache(65_536)
def _repository(folder: str) -> str | None:
    if os.path.lexists(os.path.join(folder, ".git")):
        return folder
    up = os.path.dirname(folder)
    return None if up == folder else _repository(up)


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, text=True, errors="replace", timeout=600).stdout


@lru_cache(64)
def _tracked(repo: str) -> set[str]:
    return set(_git(repo, "ls-files", "-z").split("\0"))


@lru_cache(64)
def _statuses(repo: str) -> dict[str, str]:
    """Status by path, of all that isn't clean."""
    out, parts = {}, _git(repo, "status", "--porcelain=v1", "-z", "--ignored", "--untracked-files=all").split("\0")
    i = 0
    while i < len(parts) and len(parts[i]) > 3:
        code, path = parts[i][:2], parts[i][3:]
        i += 2 if code[0] in "RC" else 1
        if code in ("DD", "AU", "UD", "UA", "DU", "AA", "UU"):
            kind = "conflicted"
        else:
            kind = "untracked" if code == "??" else "ignored" if code == "!!" else "staged" if code[0] != " " else "modified"
        out[path.rstrip("/")] = kind
    return out


@lru_cache(64)
def _commits(repo: str) -> dict[str, tuple[str, str, str]]:
    """The last commit of every path: hash, date and author, from one walk of the history."""
    out: dict[str, tuple[str, str, str]] = {}
    commit = ("", "", "")
    for line in _git(repo, "log", "--format=%x01%H%x02%cd%x02%an", "--date=format:%Y-%m-%d %H:%M:%S", "--name-only").splitlines():
        if line.startswith("\x01"):
            commit = tuple(line[1:].split("\x02"))
        elif line:
            out.setdefault(line, commit)
    return out


def _within(statuses: dict[str, str], path: str) -> str | None:
    while path:
        if path in statuses:
            return statuses[path]
        path = os.path.dirname(path)
    return None


@reads("is_git_repo", "is_git_tracked", "is_gitignored", "git_status", "git_branch", "git_last_commit_hash", "git_last_commit_date", "git_last_commit_author")
def git(name, path):
    if name == "is_git_repo":
        return os.path.exists(os.path.join(path, ".git"))
    repo = _repository(path if os.path.isdir(path) else os.path.dirname(path))
    if repo is None:
        return False if name.startswith("is_") else None
    rel = os.path.relpath(path, repo)
    if name == "git_branch":
        return _git(repo, "symbolic-ref", "--short", "-q", "HEAD").strip() or _git(repo, "rev-parse", "--short", "HEAD").strip()
    if name == "is_git_tracked":
        return rel in _tracked(repo)
    if name in ("git_status", "is_gitignored"):
        status = _within(_statuses(repo), rel) or ("clean" if rel in _tracked(repo) or os.path.isdir(path) else None)
        return status if name == "git_status" else status == "ignored"
    found = _commits(repo).get(rel)
    return found and found[("git_last_commit_hash", "git_last_commit_date", "git_last_commit_author").index(name)]


# Images, video and audio


def image_size(data: bytes | mmap.mmap) -> tuple[int, int] | None:
    if data[:4] == b"\x89PNG":
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = struct.unpack("<I", data[21:25])[0]
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        tags = tiff_tags(data)
        return (tags[256][0], tags[257][0]) if 256 in tags and 257 in tags else None
    if data[:256].lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"<" and (found := re.search(rb"<svg[^>]*>", data, re.S)):
        tag = found[0].decode("utf-8", "replace")
        w, h = (re.search(rf"\b{n}\s*=\s*[\"']([\d.]+)", tag) for n in ("width", "height"))
        if w and h:
            return int(float(w[1])), int(float(h[1]))
        box = re.search(r"viewBox\s*=\s*[\"']\s*[\d.-]+[\s,]+[\d.-]+[\s,]+([\d.]+)[\s,]+([\d.]+)", tag)
        return (int(float(box[1])), int(float(box[2]))) if box else None
    return None


def _boxes(data: bytes, start: int, end: int):
    """(kind, begin, end) of the boxes of an MP4 file."""
    while start + 8 <= end:
        size, kind = struct.unpack(">I4s", data[start : start + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[start + 8 : start + 16])[0], 16
        size = size or end - start
        if size < head:
            return
        yield kind, start + head, min(start + size, end)
        start += size


def mp4_facts(path: str) -> dict:
    """Width, height and seconds of an MP4, from its moov box wherever that is."""
    out, data = {}, _view(path)
    moov = next(((a, b) for kind, a, b in _boxes(data, 0, len(data)) if kind == b"moov"), (0, 0))
    for kind, a, b in _boxes(data, *moov):
        if kind == b"mvhd":
            scale, length = struct.unpack(">IQ", data[a + 20 : a + 32]) if data[a] else struct.unpack(">II", data[a + 12 : a + 20])
            out["duration"] = int(length / scale)
        elif kind == b"trak":
            for inner, c, _ in _boxes(data, a, b):
                if inner == b"tkhd":
                    w, h = struct.unpack(">II", data[c + (88 if data[c] else 76) : c + (96 if data[c] else 84)])
                    if w and h:
                        out |= {"width": w >> 16, "height": h >> 16}
    return out


def mkv_facts(data: bytes) -> dict:
    """Width, height and seconds of a Matroska file, from its elements; what holds the pictures is passed over."""
    out, scale = {}, 1_000_000

    def number(at, keep):
        n = 9 - data[at].bit_length()
        value = int.from_bytes(data[at : at + n], "big")
        return value if keep else value & ~(1 << 7 * n), at + n

    def walk(at, end):
        nonlocal scale
        while at < end:
            key, at = number(at, True)
            size, at = number(at, False)
            stop = min(at + size, end)
            if key in (0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0):
                walk(at, stop)
            elif key == 0x2AD7B1:
                scale = int.from_bytes(data[at:stop], "big")
            elif key == 0x4489:
                out["ticks"] = struct.unpack(">f" if stop - at == 4 else ">d", data[at:stop])[0]
            elif key in (0xB0, 0xBA):
                out.setdefault("width" if key == 0xB0 else "height", int.from_bytes(data[at:stop], "big"))
            at = stop

    try:
        walk(0, len(data))
    except IndexError:
        pass
    if "ticks" in out:
        out["duration"] = int(out["ticks"] * scale / 1e9)
    return out


@reads("width", "height")
def dimension(name, path):
    data = _view(path)
    if data[4:8] == b"ftyp":
        return mp4_facts(path).get(name)
    if data[:4] == b"\x1aE\xdf\xa3":
        return mkv_facts(data).get(name)
    found = image_size(data)
    return found and int(found[name == "height"])


# Bit rates and sampling rates of MPEG audio frames (layer III), and ID3v2 frames of the fields.
MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_FREQUENCIES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
ID3 = {"title": "TIT2", "artist": "TPE1", "album": "TALB", "audio_year": "TYER", "genre": "TCON", "comment": "COMM", "track": "TRCK", "disc": "TPOS"}


def _id3_text(body: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
    return body[1:].decode(code, "replace").strip("\0﻿ ")


@lru_cache(KEPT)
def audio_facts(path: str, stamp: int) -> dict:
    data, out, at = _view(path), {}, 0
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        import wave

        with wave.open(path) as w:
            rate = w.getframerate()
            return {"freq": rate, "duration": w.getnframes() // rate, "bitrate": rate * w.getsampwidth() * 8 * w.getnchannels() // 1000}
    if data[:3] == b"ID3":
        size = sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        frames, i = {}, 10
        while i + 10 < min(10 + size, len(data)) and data[i]:
            key = data[i : i + 4].decode("latin-1")
            n = sum(b << s for b, s in zip(data[i + 4 : i + 8], (21, 14, 7, 0), strict=True)) if data[3] == 4 else int.from_bytes(data[i + 4 : i + 8], "big")
            frames.setdefault(key, data[i + 10 : i + 10 + n])
            i += 10 + n
        for name, key in ID3.items():
            body = frames.get(key) or (frames.get("TDRC") if key == "TYER" else None)
            if body:
                out[name] = _id3_text(body if key != "COMM" else body[:1] + body[4:]).rpartition("\0")[2]
        at = 10 + size
    found = re.compile(rb"\xff[\xe0-\xff]").search(data, at)
    at = found.start() if found else len(data)
    if at + 4 <= len(data):
        version = data[at + 1] >> 3 & 3
        rate, freq = MP3_RATES[3 if version == 3 else 2][data[at + 2] >> 4], MP3_FREQUENCIES[version][data[at + 2] >> 2 & 3]
        out |= {"bitrate": rate, "freq": freq}
        if rate:
            out["duration"] = int((os.path.getsize(path) - at) * 8 / (rate * 1000))
    if "audio_year" in out:
        out["audio_year"] = int(out["audio_year"][:4])
    return out


@reads("duration", "bitrate", "freq", "title", "artist", "album", "audio_year", "genre", "comment", "track", "disc")
def audio(name, path):
    head = _head(path, 16)
    if name == "duration" and head[4:8] == b"ftyp":
        return mp4_facts(path).get(name)
    if name == "duration" and head.startswith(b"\x1aE\xdf\xa3"):
        return mkv_facts(_view(path)).get(name)
    if not (head.startswith((b"ID3", b"RIFF")) or head[:1] == b"\xff" and head[1] & 0xE0 == 0xE0):
        return None
    return audio_facts(path, os.stat(path).st_mtime_ns).get(name)


# Exif

# Tag numbers of the fields; those of the location are in a table of their own.
EXIF = {
    "exif_datetime": 306, "exif_datetime_original": 36867, "exif_make": 271, "exif_model": 272, "exif_software": 305, "exif_version": 36864, "exif_exposure_time": 33434, "exif_aperture": 37378, "exif_shutter_speed": 37377,
    "exif_f_number": 33437, "exif_iso_speed": 34867, "exif_sensitivity": 34855, "exif_focal_length": 37386, "exif_lens_make": 42035, "exif_lens_model": 42036, "exif_description": 270, "exif_artist": 315, "exif_copyright": 33432,
    "exif_orientation": 274, "exif_flash": 37385, "exif_color_space": 40961, "exif_exposure_program": 34850, "exif_exposure_bias": 37380, "exif_white_balance": 41987, "exif_metering_mode": 37383, "exif_scene_type": 41729,
    "exif_contrast": 41992, "exif_saturation": 41993, "exif_sharpness": 41994, "exif_body_serial": 42033, "exif_lens_serial": 42037, "exif_user_comment": 37510, "exif_image_width": 40962, "exif_image_height": 40963,
    "exif_max_aperture": 37381, "exif_digital_zoom": 41988,
}
GPS = {"exif_latitude": (1, 2), "exif_longitude": (3, 4), "exif_altitude": (5, 6)}
#: Tags whose values are read: those above, the size of a TIFF, and the directories of its Exif and its location.
WANTED = {*EXIF.values(), *range(1, 7), 256, 257, 0x8769, 0x8825}
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


def tiff_tags(data: bytes, at: int | None = None) -> dict[int, tuple]:
    """Values by tag of one directory of a TIFF block; rationals are floats, texts are bytes."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0] if at is None else at
    out = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        code = _SIZES.get(kind)
        if not code or tag not in WANTED:
            continue
        size = struct.calcsize(order + code) * n
        begin = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        raw = data[begin : begin + size]
        if code == "s":
            out[tag] = (raw,)
        elif len(code) == 2:
            pairs = struct.unpack(order + code * n, raw)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        else:
            out[tag] = struct.unpack(order + code * n, raw)
    return out


@lru_cache(KEPT)
def exif_tags(path: str, stamp: int) -> tuple[dict, dict]:
    data = _view(path)
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\0\0")
        data = data[at + 6 : at + 6 + (1 << 16)] if at >= 0 else b""  # a segment has a size of 16 bits
    if data[:2] not in (b"II", b"MM"):
        return {}, {}
    tags = tiff_tags(data)
    place = tiff_tags(data, tags[0x8825][0]) if 0x8825 in tags else {}
    tags |= tiff_tags(data, tags[0x8769][0]) if 0x8769 in tags else {}
    shown = {*EXIF.values()}
    return {t: v for t, v in tags.items() if t in shown}, place


@reads(*EXIF, *GPS)
def exif(name, path):
    tags, place = exif_tags(path, os.stat(path).st_mtime_ns)
    if name in GPS:
        ref, tag = GPS[name]
        value = place.get(tag)
        if not value:
            return None
        sign = place.get(ref, (b"",))[0]
        amount = value[0] if name == "exif_altitude" else sum(v / 60**i for i, v in enumerate(value))
        return -amount if sign in (b"S\0", b"W\0", b"S", b"W", 1) else amount
    value = tags.get(EXIF[name])
    if value is None:
        return None
    shown = value[0].rstrip(b"\0 ").decode("utf-8", "replace") if isinstance(value[0], bytes) else value[0] if len(value) == 1 else ", ".join(map(str, value))
    if "datetime" in name:
        return datetime.strptime(shown, "%Y:%m:%d %H:%M:%S")
    return shown if not isinstance(shown, (int, float)) or name in NUMERIC_EXIF else f"{shown:g}"


NUMERIC_EXIF = {"exif_exposure_time", "exif_aperture", "exif_shutter_speed", "exif_f_number", "exif_focal_length", "exif_exposure_bias", "exif_digital_zoom"}
_PLAIN: set = set()
