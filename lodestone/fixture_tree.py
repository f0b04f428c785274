"""A small file tree with one of everything, made where all executors see it, and what queries of it must find."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import stat
import struct
import subprocess
import tempfile
import wave
import zipfile
import zlib

from pyspark.sql import SparkSession

WALK = {".gitignore": "*.log\n", "a.txt": "one\ntwo\n", "b/c.py": "#!/usr/bin/python\nprint(1)\n", "b/d/.hidden": "", "b/d/e.log": "x" * 3000, "f.PNG": ""}
HG = {".hg/x": "", ".hgignore": "syntax: glob\n*.log\nsyntax: regexp\n^gone/\n", "ignored.log": "", "kept.txt": "", "gone/x": "", "d/y.log": ""}
DOCKER = {".dockerignore": "*.tmp\n**/cache\n!important.tmp\n", "a.tmp": "", "important.tmp": "", "s/b.tmp": "", "s/cache/x": ""}
CONTENTS = {
    "ascii": b"two words\nline\n", "utf8": "naïve café\r\nx\r\n".encode(), "bom": b"\xef\xbb\xbfhi there\n", "utf16": b"\xff\xfe" + "hé llo\n".encode("utf-16-le"), "latin": b"caf\xe9 x\n",
    "nul": b"a\0b\n", "mixed": b"a\nb\r\nc\rd", "cr": b"a\rb\r", "none": b"", "script": b"#!/bin/sh\n",
}
MODES = {"plain": 0o100640, "runs": 0o104755, "group": 0o102711, "shared": 0o041777, "nothing": 0o100000, "pipe": 0o010600, "socket": 0o140700, "capital": 0o107666}
CLASSES = ("a.zip", "b.MP3", "c.epub", "d.docx", "e.ttf", "f.png", "g.rs", "h.mkv", "i.m4p", "j.pdf", "k.txt", "l")
#: Access and modification times of a file, in nanoseconds: 2020-01-02 03:04:05.123456789 and 2021-02-03 04:05:06.987654321.
TIMES = (1577934245_123456789, 1612325106_987654321)


def png(w: int, h: int) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def directory(tags: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """A directory of (tag, type, count, bytes) at an offset of a little-endian TIFF block, with the values that it points to."""
    out, tail, end = struct.pack("<H", len(tags)), b"", at + 6 + 12 * len(tags)
    for tag, kind, n, raw in tags:
        out += struct.pack("<HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", end + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return out + b"\0\0\0\0" + tail


def tiff(tags: list, more: dict[int, list] | None = None) -> bytes:
    """A TIFF block; more: directories that tags of the first one point to."""
    more = more or {}
    pointed = lambda offsets: directory([*tags, *[(t, 4, 1, struct.pack("<I", offsets.get(t, 0))) for t in more]], 8)
    offsets, at, tail = {}, 8 + len(pointed({})), b""
    for tag, own in more.items():
        offsets[tag] = at + len(tail)
        tail += directory(own, offsets[tag])
    return struct.pack("<2sHI", b"II", 42, 8) + pointed(offsets) + tail


def box(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I4s", len(data) + 8, kind) + data


def _text(tag: int, value: str) -> tuple:
    return tag, 2, len(value) + 1, value.encode() + b"\0"


def _number(tag: int, kind: int, *values: int) -> tuple:
    return tag, kind, len(values) // (2 if kind in (5, 10) else 1), struct.pack("<" + {3: "H", 4: "I", 5: "I", 10: "i"}[kind] * len(values), *values)


#: Field, tag and what a query gives, of one photograph.
EXIF_TAGS = [
    ("exif_make", _text(271, "Maker"), "Maker"), ("exif_model", _text(272, "M1"), "M1"), ("exif_software", _text(305, "Soft 1.0"), "Soft 1.0"), ("exif_description", _text(270, "A view"), "A view"),
    ("exif_artist", _text(315, "Ann"), "Ann"), ("exif_copyright", _text(33432, "(c) Ann"), "(c) Ann"), ("exif_orientation", _number(274, 3, 6), "6"), ("exif_datetime", _text(306, "2020:01:02 03:04:05"), "2020-01-02 03:04:05"),
    ("exif_datetime_original", _text(36867, "2020:01:01 00:00:00"), "2020-01-01 00:00:00"), ("exif_version", (36864, 7, 4, b"0230"), "0230"), ("exif_exposure_time", _number(33434, 5, 1, 100), 0.01),
    ("exif_f_number", _number(33437, 5, 28, 10), 2.8), ("exif_exposure_program", _number(34850, 3, 2), "2"), ("exif_sensitivity", _number(34855, 3, 200), "200"), ("exif_iso_speed", _number(34867, 4, 400), "400"),
    ("exif_shutter_speed", _number(37377, 10, 13, 2), 6.5), ("exif_aperture", _number(37378, 5, 3, 1), 3.0), ("exif_exposure_bias", _number(37380, 10, -1, 2), -0.5), ("exif_max_aperture", _number(37381, 5, 3, 2), "1.5"),
    ("exif_metering_mode", _number(37383, 3, 5), "5"), ("exif_flash", _number(37385, 3, 16), "16"), ("exif_focal_length", _number(37386, 5, 50, 1), 50.0), ("exif_user_comment", _text(37510, "hello"), "hello"),
    ("exif_color_space", _number(40961, 3, 1), "1"), ("exif_image_width", _number(40962, 4, 640), "640"), ("exif_image_height", _number(40963, 4, 480), "480"), ("exif_scene_type", _number(41729, 3, 1), "1"),
    ("exif_white_balance", _number(41987, 3, 1), "1"), ("exif_digital_zoom", _number(41988, 5, 2, 1), 2.0), ("exif_contrast", _number(41992, 3, 0), "0"), ("exif_saturation", _number(41993, 3, 1), "1"),
    ("exif_sharpness", _number(41994, 3, 2), "2"), ("exif_body_serial", _text(42033, "B123"), "B123"), ("exif_lens_make", _text(42035, "Lens"), "Lens"), ("exif_lens_model", _text(42036, "L50"), "L50"), ("exif_lens_serial", _text(42037, "L456"), "L456"),
]
PLACE = [(1, 2, 2, b"N\0"), _number(2, 5, 52, 1, 30, 1, 0, 1), (3, 2, 2, b"W\0"), _number(4, 5, 13, 1, 15, 1, 0, 1), (5, 1, 1, b"\1"), _number(6, 5, 201, 2)]
ID3_TEXTS = {"title": (b"TIT2", "Song"), "artist": (b"TPE1", "Band"), "album": (b"TALB", "Disc one"), "audio_year": (b"TYER", "1999"), "genre": (b"TCON", "Jazz"), "track": (b"TRCK", "3"), "disc": (b"TPOS", "1")}


def media() -> dict[str, bytes]:
    first = sorted((t for _, t, _ in EXIF_TAGS if t[0] < 33434 or t[0] == 33432), key=lambda t: t[0])
    photo = tiff(first, {0x8769: sorted((t for _, t, _ in EXIF_TAGS if t not in first), key=lambda t: t[0]), 0x8825: PLACE})
    sizes = b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 20
    moov = box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 65000) + b"\0" * 80) + box(b"trak", box(b"tkhd", b"\0" * 76 + struct.pack(">II", 640 << 16, 480 << 16))))
    frame = lambda k, body: k + struct.pack(">I", len(body)) + b"\0\0" + body
    id3 = b"".join(frame(k, b"\x03" + v.encode()) for k, v in ID3_TEXTS.values()) + frame(b"COMM", b"\x03eng\0nice")
    element = lambda key, data: key + (0x4000 | len(data)).to_bytes(2, "big") + data
    filler = box(b"free", bytes(2 << 20))  # what follows lies beyond the first megabytes
    return {
        "a.png": png(12, 34), "b.gif": b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 20, "c.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8), "d.jpg": b"\xff\xd8" + sizes, "e.svg": b"<svg width='50' height='60'></svg>",
        "f.svg": b"<?xml version='1.0'?><!--" + b" " * 5000 + b"--><svg viewBox='0 0 70 80'/>", "g.tiff": tiff([_number(256, 3, 9), _number(257, 3, 10)]), "h.webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"),
        "i.mp4": box(b"ftyp", b"isom") + filler + moov, "j.mp3": b"ID3\x03\0\0" + bytes([0, 0, len(id3) >> 7, len(id3) & 127]) + id3 + b"\xff\xfb\x90\0" + b"\0" * 16000,
        "k.jpg": b"\xff\xd8\xff\xe1" + struct.pack(">H", len(photo) + 8) + b"Exif\0\0" + photo + sizes, "t.txt": b"hello",
        "m.mkv": b"\x1aE\xdf\xa3\x80" + element(b"\x18S\x80g", element(b"\x15I\xa9f", element(b"D\x89", struct.pack(">d", 5000.0))) + element(b"\x16T\xaek", element(b"\xae", element(b"\xe0", element(b"\xb0", b"\x01\x40") + element(b"\xba", b"\xf0"))))),
    }


def _write(top: str, files: dict) -> None:
    for path, content in files.items():
        full = os.path.join(top, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def make(top: str) -> None:
    at = lambda *p: os.path.join(top, *p)
    for name, files in (("walk", WALK), ("hg", HG), ("docker", DOCKER), ("contents", CONTENTS), ("media", media()), ("classes", dict.fromkeys(CLASSES, "")), ("ids", {"a": "1", "c": "2"}), ("times", {"t.txt": ""}), ("git/plain", {"x": ""})):
        _write(at(name), files)
    with zipfile.ZipFile(at("walk", "z.zip"), "w") as z:
        z.writestr("in/side.txt", "inside")
    os.symlink("b", at("walk", "link"))
    os.makedirs(at("walk", "empty"))
    os.makedirs(at("links/root"))
    _write(at("links"), {"hidden/deep.txt": "2", "root/a/file.txt": "1"})
    for link, to in (("root/link", "../hidden"), ("root/a/loop", "../a"), ("root/broken", "nowhere")):
        os.symlink(to, at("links", link))
    os.link(at("ids", "a"), at("ids", "b"))
    os.utime(at("times", "t.txt"), ns=TIMES)
    os.makedirs(at("modes"))
    for name, mode in MODES.items():
        kind = stat.S_IFMT(mode)
        if kind == stat.S_IFDIR:
            os.mkdir(at("modes", name))
        else:
            os.mknod(at("modes", name), mode)
        os.chmod(at("modes", name), stat.S_IMODE(mode))
    with wave.open(at("media", "l.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\0" * 32000)
    repo = at("git", "repo")
    _write(repo, {"a": "1", "b": "2", ".gitignore": "ign\n"})
    env = os.environ | {f"GIT_{who}_{k}": v for who in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Ann"), ("EMAIL", "a@b"), ("DATE", "2021-02-03T04:05:06+0000"))}
    git = lambda *a: subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *a], check=True, capture_output=True, env=env)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-qm", "first")
    _write(repo, {"b": "3", "c": "4", "d": "5", "ign": "6"})
    git("add", "d")


_made: dict[str, str] = {}


def fixture(spark: SparkSession) -> str:
    """The tree's top, made once: in spark.checkpoint.dir if that is a mounted folder, else (local runs) in a temporary one. It goes at the end of the process."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    shared = shared if shared.startswith("/") else tempfile.gettempdir()
    if shared not in _made:
        os.makedirs(shared, exist_ok=True)
        top = os.path.realpath(tempfile.mkdtemp(prefix="lodestone-tree-", dir=shared))
        os.chmod(top, 0o755)
        make(top)
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        _made[shared] = top
    return _made[shared]


def _sql(columns: list[str], rows: list[tuple]) -> str:
    """The rows as SQL."""

    def shown(v):
        if v is None or isinstance(v, bool):
            return {None: "NULL", True: "true", False: "false"}[v]
        if isinstance(v, (int, float)):
            return f"CAST({v!r} AS {'BIGINT' if isinstance(v, int) else 'DOUBLE'})"
        return f"CAST('{v[2:]}' AS TIMESTAMP)" if v.startswith("@@") else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


#: name: (query of the tree's top, SQL)
QUERIES: dict[str, tuple[str, str]] = {}


def _add(name: str, fields: str, source: str, rows: list[tuple], where: str = "", exprs: dict[str, str] | None = None) -> None:
    names = fields.split()
    shown = ", ".join(f"{(exprs or {}).get(n, n)} as f_{n}" for n in names)
    QUERIES[name] = (f"{shown} from {source}{' where ' + where if where else ''}", _sql([f"f_{n}" for n in names], rows))


_ALL = [".gitignore", "a.txt", "b", "b/c.py", "b/d", "b/d/.hidden", "b/d/e.log", "empty", "f.PNG", "link", "z.zip"]
_SIZES = {n: len(t) for n, t in WALK.items()}
_name = os.path.basename
_add("fs_scan", "path size fsize is_file is_symlink link_target is_hidden", "'{}/walk'", [(p, n, n, True, False, "", _name(p)[0] == ".") for p, n in _SIZES.items()] + [("link", 1, 1, False, True, "b", False)], "not is_dir and name != z.zip")
_add("fs_names", "path name filename ext dir is_dir", "'{}/walk'", [(".gitignore", ".gitignore", ".gitignore", "", "", False), ("a.txt", "a.txt", "a", "txt", "", False), ("b", "b", "b", "", "", True), ("b/c.py", "c.py", "c", "py", "b", False), ("b/d", "d", "d", "", "b", True), ("b/d/.hidden", ".hidden", ".hidden", "", "b/d", False), ("b/d/e.log", "e.log", "e", "log", "b/d", False), ("empty", "empty", "empty", "", "", True), ("f.PNG", "f.PNG", "f", "PNG", "", False), ("link", "link", "link", "", "", False), ("z.zip", "z.zip", "z", "zip", "", False)])
_add("fs_absolute", "abspath absdir", "'{}/walk'", [(f"/walk/{p}", os.path.dirname(f"/walk/{p}")) for p in _ALL], exprs={"abspath": "replace(abspath, '{}', '')", "absdir": "replace(absdir, '{}', '')"})
_add("fs_depth", "path", "'{}/walk' mindepth 2 maxdepth 2", [("b/c.py",), ("b/d",)])
_add("fs_symlinks", "path is_symlink link_target is_broken_symlink", "'{}/links/root' symlinks", [("a", False, "", False), ("a/file.txt", False, "", False), ("a/loop", True, "../a", False), ("broken", True, "nowhere", True), ("link", True, "../hidden", False), ("link/deep.txt", False, "", False)])
_add("fs_links_not_followed", "path is_symlink", "'{}/links/root'", [("a", False), ("a/file.txt", False), ("a/loop", True), ("broken", True), ("link", True)])
_add("fs_ignore", "path", "'{}/walk' gitignore", [(p,) for p in _ALL if p != "b/d/e.log"])
_add("fs_hgignore", "path", "'{}/hg' hgignore", [(".hgignore",), ("kept.txt",)], "is_file and path notlike '.hg/%'")
_add("fs_dockerignore", "path", "'{}/docker' dockerignore", [(".dockerignore",), ("important.tmp",), ("s/b.tmp",)], "is_file")
_add("fs_archives", "path size", "'{}/walk' archives", [*_SIZES.items(), ("in/side.txt", 6)], "is_file and name != z.zip")
_add("fs_depth_first", "path", "'{}/walk' dfs", [(p,) for p in _ALL])
_add("fs_regexp_roots", "path", "'{}/g.*/[rp].*' regexp", [(p,) for p in (".gitignore", "a", "b", "c", "d", "ign", "x")], "is_file and path notlike '.git/%'")
_add("fs_several_roots", "name", "'{}/ids', '{}/times'", [("a",), ("b",), ("c",), ("t.txt",)])
_add("fs_default_bfs_top", "path", "'{}/walk' depth 1 bfs", [(p,) for p in _ALL if "/" not in p])
_add("fs_empty", "path", "'{}/walk'", [("b/d/.hidden",), ("empty",), ("f.PNG",)], "is_empty")
QUERIES["fs_extensions"] = ("ext as ext, count(*) as n from '{}/walk' group by ext", _sql(["ext", "n"], [("", 6), ("PNG", 1), ("log", 1), ("py", 1), ("txt", 1), ("zip", 1)]))
_bit = {"user_read": 0o400, "user_write": 0o200, "user_exec": 0o100, "user_all": 0o700, "group_read": 0o40, "group_write": 0o20, "group_exec": 0o10, "group_all": 0o70, "other_read": 4, "other_write": 2, "other_exec": 1, "other_all": 7, "suid": 0o4000, "sgid": 0o2000, "is_sticky": 0o1000}
_add("fs_modes", f"name mode {' '.join(_bit)}", "'{}/modes'", [(n, stat.filemode(m), *[m & b == b for b in _bit.values()]) for n, m in MODES.items()])
_kind = {"is_dir": 0o040000, "is_file": 0o100000, "is_pipe": 0o010000, "is_socket": 0o140000, "is_char": 0o020000, "is_block": 0o060000}
_add("fs_types", f"name {' '.join(_kind)}", "'{}/modes'", [(n, *[stat.S_IFMT(m) == k for k in _kind.values()]) for n, m in MODES.items()])
_add("fs_times", "name accessed modified atime atime_nsec mtime mtime_nsec", "'{}/times'", [("t.txt", "@@2020-01-02 03:04:05.123456", "@@2021-02-03 04:05:06.987654", 1577934245, 123456789, 1612325106, 987654321)])
_add("fs_created", "name", "'{}/times'", [("t.txt",)], "created >= 2024-01-01 and ctime > 1700000000 and ctime_nsec >= 0")
_add("fs_ids", "name hardlinks", "'{}/ids'", [("a", 2), ("b", 2), ("c", 1)], "uid = current_uid and user = current_user and gid >= 0 and length(group) >= 0 and inode > 0 and device >= 0 and rdev >= 0 and blocks >= 0 and blksize > 0")
_counts = {"ascii": (2, 3, 15, "ASCII", False, "LF"), "utf8": (2, 3, 15, "UTF-8", False, "CRLF"), "bom": (1, 2, 9, "UTF-8", True, "LF"), "utf16": (1, 2, 7, "UTF-16LE", True, "LF"), "latin": (1, 2, 7, "ISO-8859-1", False, "LF"), "nul": (1, None, None, None, False, None), "mixed": (2, 4, 8, "ASCII", False, "mixed"), "cr": (0, 2, 4, "ASCII", False, "CR"), "none": (0, 0, 0, "ASCII", False, None), "script": (1, 1, 10, "ASCII", False, "LF")}
_add("fs_contents", "name line_count word_count char_count encoding has_bom line_ending is_shebang", "'{}/contents'", [(n, *v, n == "script") for n, v in _counts.items()])
_add("fs_digests", "name sha1 sha256 sha512 sha3", "'{}/contents'", [(n, *[hashlib.new(h, c).hexdigest() for h in ("sha1", "sha256", "sha512", "sha3_512")]) for n, c in CONTENTS.items()])
_add("fs_text_or_binary", "name is_text is_binary", "'{}/contents'", [(n, n not in ("nul", "utf16"), n in ("nul", "utf16")) for n in CONTENTS if n != "none"], "size > 0")
_add("fs_contains", "name", "'{}/contents'", [("bom",)], "contains('there')")
_in = {"is_archive": "a.zip", "is_audio": "b.MP3 i.m4p", "is_book": "c.epub j.pdf", "is_doc": "d.docx j.pdf", "is_font": "e.ttf", "is_image": "f.png", "is_source": "g.rs", "is_video": "h.mkv i.m4p"}
_add("fs_classes", f"name {' '.join(_in)}", "'{}/classes'", [(n, *[n in names.split() for names in _in.values()]) for n in CLASSES])
_dims = {"a.png": (12, 34), "b.gif": (5, 6), "c.bmp": (7, 8), "d.jpg": (40, 30), "e.svg": (50, 60), "f.svg": (70, 80), "g.tiff": (9, 10), "h.webp": (100, 50), "i.mp4": (640, 480), "k.jpg": (40, 30), "m.mkv": (320, 240)}
_add("fs_dimensions", "name width height", "'{}/media'", [(n, *v) for n, v in _dims.items()], "width > 0")
_add("fs_durations", "name duration", "'{}/media'", [("i.mp4", 65), ("j.mp3", 1), ("l.wav", 2), ("m.mkv", 5)], "duration > 0")
_add("fs_mime", "name mime", "'{}/media'", [("a.png", "image/png"), ("b.gif", "image/gif"), ("c.bmp", "image/bmp"), ("d.jpg", "image/jpeg"), ("e.svg", "image/svg+xml"), ("g.tiff", "image/tiff"), ("h.webp", "image/webp"), ("i.mp4", "video/mp4"), ("j.mp3", "audio/mpeg"), ("k.jpg", "image/jpeg"), ("l.wav", "audio/x-wav"), ("m.mkv", "video/x-matroska"), ("t.txt", "text/plain")], "name != f.svg")
_add("fs_audio", f"name bitrate freq comment {' '.join(ID3_TEXTS)}", "'{}/media'", [("j.mp3", 128, 44100, "nice", *[int(v) if k == "audio_year" else v for k, (_, v) in ID3_TEXTS.items()])], "name = j.mp3")
_add("fs_wave", "name bitrate freq", "'{}/media'", [("l.wav", 128, 8000)], "name = l.wav")
_add("fs_exif", f"name {' '.join(f for f, _, _ in EXIF_TAGS)}", "'{}/media'", [("k.jpg", *["@@" + v if "datetime" in f else v for f, _, v in EXIF_TAGS])], "name = k.jpg")
_add("fs_exif_place", "name exif_latitude exif_longitude exif_altitude", "'{}/media'", [("k.jpg", 52.5, -13.25, -100.5)], "name = k.jpg")
_add("fs_git", "name git_status is_git_tracked is_gitignored git_branch", "'{}/git/repo'", [("a", "clean", True, False, "main"), ("b", "modified", True, False, "main"), ("c", "untracked", False, False, "main"), ("d", "staged", True, False, "main"), ("ign", "ignored", False, True, "main"), (".gitignore", "clean", True, False, "main")], "is_file and path notlike '.git/%'")
_add("fs_git_commits", "name git_last_commit_date git_last_commit_author length", "'{}/git/repo'", [(n, "@@2021-02-03 04:05:06", "Ann", 40) for n in ("a", "b", ".gitignore")], "is_file and path notlike '.git/%' and is_git_tracked and name != d", {"length": "length(git_last_commit_hash)"})
_add("fs_git_repositories", "name is_git_repo", "'{}/git' depth 1", [("plain", False), ("repo", True)])
_add("fs_no_attributes", "name has_acl acl has_default_acl default_acl has_capabilities capabilities has_xattr has_acl_entry has_default_acl_entry has_capability", "'{}/ids'", [(n, False, "", False, "", False, "", False, False, False, False) for n in "abc"], exprs={"has_xattr": "has_xattr('user.x')", "has_acl_entry": "has_acl_entry('user:bob')", "has_default_acl_entry": "has_default_acl_entry('user:bob')", "has_capability": "has_capability('chown')"})
