"""The file source: traversal, fields, contents, ignore rules and archives, over trees made here."""

import hashlib
import os
import struct
import subprocess
import wave
import zipfile
import zlib

import pytest
from lodestone import cli
from lodestone.engine import Engine, QueryError
from lodestone.sinks.colors import Colors
from lodestone.sources import extract, ignore
from lodestone.sources.fsentries import Reader
from lodestone.streaming.files import counts, watch


def make(top, files):
    for path, content in files.items():
        full = top / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(content if isinstance(content, bytes) else content.encode())
    return top


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def paths(engine, query):
    return [r[0] for r in engine.sql(query).collect()]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = make(tmp_path_factory.mktemp("tree"), {"a.txt": "one\ntwo", "b/c.rs": "fn main() {}\n", "b/d/e.tar.gz": b"\x1f\x8b..", "b/d/.hid": "", "z/last": "x" * 5000, "noext": "#!/bin/sh\n"})
    (top / "empty").mkdir()
    return top


def test_traversal(engine, tree):
    assert paths(engine, f"path from {tree} order by path") == sorted(["a.txt", "b", "b/c.rs", "b/d", "b/d/.hid", "b/d/e.tar.gz", "empty", "noext", "z", "z/last"])
    assert paths(engine, f"path from {tree} depth 1 order by path") == ["a.txt", "b", "empty", "noext", "z"]
    assert paths(engine, f"path from {tree} mindepth 3 order by path") == ["b/d/.hid", "b/d/e.tar.gz"]
    assert paths(engine, f"path from {tree} mindepth 2 maxdepth 2 order by path") == ["b/c.rs", "b/d", "z/last"]
    by_seq = lambda query: [r.path for r in sorted(engine.table(engine.parse(query).roots[0])[0].collect(), key=lambda r: r._seq)]
    assert by_seq(f"path from {tree}") == ["a.txt", "b", "empty", "noext", "z", "b/c.rs", "b/d", "z/last", "b/d/.hid", "b/d/e.tar.gz"]
    assert by_seq(f"path from {tree} dfs") == ["a.txt", "b", "b/c.rs", "b/d", "b/d/.hid", "b/d/e.tar.gz", "empty", "noext", "z", "z/last"]
    assert sorted(paths(engine, f"name from {tree}/b/d, {tree}/z")) == [".hid", "e.tar.gz", "last"]
    assert sorted(paths(engine, f"name from '{tree.parent}/{tree.name[:-1]}[0-9]/[bz]' regexp")) == [".hid", "c.rs", "d", "e.tar.gz", "last"]
    assert paths(engine, f"path from (select * from {tree} where size > 100) where is_file") == ["z/last"]
    assert sorted(paths(engine, f"path from {tree} where name in (select name from {tree}/b)")) == ["b/c.rs", "b/d", "b/d/.hid", "b/d/e.tar.gz"]
    with pytest.raises(QueryError):
        engine.sql("name from /no/such/folder")


def test_fields(engine, tree):
    found = {r[0]: tuple(r)[1:] for r in engine.sql(f"name, filename, ext, dir, is_dir, is_file, is_hidden, is_empty, is_archive, is_source, size, mode from {tree}").collect()}
    assert found["e.tar.gz"][:10] == ("e.tar", "gz", "b/d", False, True, False, False, True, False, 4)
    assert found[".hid"][:7] == (".hid", "", "b/d", False, True, True, True) and found["noext"][:3] == ("noext", "", "")
    assert found["c.rs"][8] is True and found["empty"][3:7] == (True, False, False, True) and found["b"][6] is False and found["b"][10][0] == "d"
    os.chmod(tree / "a.txt", 0o4754)
    st = os.stat(tree / "a.txt")
    ((mode, ur, gw, oall, suid, uid, inode, links, mtime, nsec, ab, absdir, year),) = engine.sql(f"mode, user_read, group_write, other_all, suid, uid, inode, hardlinks, mtime, mtime_nsec, abspath, absdir, year(modified) from {tree} where name = a.txt").collect()
    assert (mode, ur, gw, oall, suid, uid, inode, links) == ("-rwsr-xr--", True, False, False, True, st.st_uid, st.st_ino, 1)
    assert (mtime * 10**9 + nsec, ab, absdir) == (st.st_mtime_ns, os.path.realpath(tree / "a.txt"), os.path.realpath(tree)) and year > 2000
    assert paths(engine, f"name from {tree} where modified = today and name = noext") == ["noext"]
    assert paths(engine, f"name from {tree} where size > 4k") and engine.sql(f"* from {tree}").columns == ["Mode", "User", "Group", "Size", "Modified", "Path"]


def test_contents(engine, tmp_path):
    files = {
        "ascii": b"two words\nline\n", "utf8": "naïve café\r\nx\r\n".encode(), "bom": b"\xef\xbb\xbfhi there\n", "utf16": "hé llo\n".encode("utf-16-le"), "latin": b"caf\xe9 x\n", "nul": b"a\0b\n", "mixed": b"a\nb\r\nc\rd", "none": b"", "cr": b"a\rb\r",
    }
    files["utf16"] = b"\xff\xfe" + files["utf16"]
    make(tmp_path, files)
    found = {r[0]: tuple(r)[1:] for r in engine.sql(f"name, line_count, word_count, char_count, encoding, has_bom, eol, is_shebang, sha1, sha256, sha512, sha3 from {tmp_path}").collect()}
    assert found["ascii"][:7] == (2, 3, 15, "ASCII", False, "LF", False) and found["utf8"][:6] == (2, 3, 15, "UTF-8", False, "CRLF")
    assert found["bom"][:6] == (1, 2, 9, "UTF-8", True, "LF") and found["utf16"][1:6] == (2, 7, "UTF-16LE", True, "LF")
    assert found["latin"][1:4] == (2, 7, "ISO-8859-1") and found["nul"][:4] == (1, None, None, None) and found["mixed"][5] == "mixed" and found["cr"][5] == "CR" and found["none"][:4] == (0, 0, 0, "ASCII")
    for name, content in files.items():
        assert found[name][7:] == tuple(hashlib.new(h, content).hexdigest() for h in ("sha1", "sha256", "sha512", "sha3_512"))
    assert sorted(paths(engine, f"name from {tmp_path} where contains('hi')")) == ["bom"] and paths(engine, f"name from {tmp_path} where line_count = 2 and is_text and word_count = 3 order by 1") == ["ascii", "utf8"]


def test_snapshot(spark, tree, tmp_path):
    own = Engine(spark, config={"us_dates": True})
    own.snapshot("listed", str(tree), str(tmp_path / "out"))
    assert sorted(paths(own, "path from listed where size > 100 and is_file and line_count = 0")) == ["z/last"]
    assert "listed" not in own.tables and paths(own, "path from listed depth 1 where modified < 12/31/2020") == []
    assert paths(own, "path from listed depth 1 order by path") == ["a.txt", "b", "empty", "noext", "z"]
    assert len(paths(own, "name from listed where modified > '1/31/2001'")) == 10


def test_links(engine, tmp_path):
    make(tmp_path, {"root/a/file.txt": "1", "hidden/deep.txt": "2"})
    os.symlink("../hidden", tmp_path / "root/link")
    os.symlink("../a", tmp_path / "root/a/loop")
    os.symlink("nowhere", tmp_path / "root/broken")
    r = tmp_path / "root"
    assert paths(engine, f"path from {r} order by path") == ["a", "a/file.txt", "a/loop", "broken", "link"]
    assert paths(engine, f"path from {r} symlinks order by path") == ["a", "a/file.txt", "a/loop", "broken", "link", "link/deep.txt"]
    assert [tuple(x) for x in engine.sql(f"name, link_target, is_broken_symlink from {r} where is_symlink order by name").collect()] == [("broken", "nowhere", True), ("link", "../hidden", False), ("loop", "../a", False)]


def test_archives(engine, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.jar", "w") as z:
        z.writestr("dir/in.txt", "12345")
        z.writestr("dir/sub/", "")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    found = [tuple(r) for r in engine.sql(f"path, name, size, is_dir, line_count from {tmp_path} archives order by path").collect()]
    assert found == [("bad.zip", "bad.zip", 10, False, 0), ("dir/in.txt", "in.txt", 5, False, None), ("dir/sub/", "sub", 0, True, None), ("x.jar", "x.jar", os.path.getsize(tmp_path / "x.jar"), False, found[3][4])]


def test_ignore_files(engine, tmp_path):
    make(tmp_path, {"g/.git/HEAD": "ref: x", "g/.gitignore": "*.log\n/top\n!keep.log\nbuild/\n", "g/a.log": "", "g/keep.log": "", "g/top": "", "g/s/top": "", "g/s/build/x": "", "g/s/.gitignore": "mine\n", "g/s/mine": ""})
    assert paths(engine, f"path from {tmp_path}/g gitignore where is_file and name != .gitignore order by path") == ["keep.log", "s/top"]
    assert "a.log" in paths(engine, f"path from {tmp_path}/g nogitignore")
    make(tmp_path, {"h/.hg/x": "", "h/.hgignore": "syntax: glob\n*.log\nsyntax: regexp\n^gone/\n", "h/ignored.log": "", "h/kept.txt": "", "h/gone/x": "", "h/d/y.log": ""})
    assert paths(engine, f"path from {tmp_path}/h hgignore where is_file and path notlike '.hg%' order by path") == ["kept.txt"]
    make(tmp_path, {"d/.dockerignore": "*.tmp\n**/cache\n!important.tmp\n", "d/a.tmp": "", "d/important.tmp": "", "d/s/b.tmp": "", "d/s/cache/x": ""})
    assert paths(engine, f"path from {tmp_path}/d dockerignore where is_file and name != .dockerignore order by path") == ["important.tmp", "s/b.tmp"]


@pytest.mark.parametrize(("glob", "path", "want"), [("*.c", "a.c", True), ("*.c", "s/a.c", False), ("**/a", "x/y/a", True), ("a/**", "a/b/c", True), ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("a\\*", "a*", True)])
def test_globs(glob, path, want):
    import re

    assert bool(re.fullmatch(ignore.glob_body(glob), path)) == want


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def tiff(tags):
    """A block with these (tag, type, count, bytes) entries, in one directory."""
    out, tail = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    at = 10 + 12 * len(tags) + 4
    for tag, kind, n, raw in tags:
        out += struct.pack("<HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return out + b"\0\0\0\0" + tail


def box(kind, data):
    return struct.pack(">I4s", len(data) + 8, kind) + data


def test_media(engine, tmp_path):
    jpeg = b"\xff\xd8\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 20
    exif = tiff([(271, 2, 6, b"Maker\0"), (274, 3, 1, struct.pack("<H", 6)), (306, 2, 20, b"2020:01:02 03:04:05\0"), (33437, 5, 1, struct.pack("<II", 28, 10))])
    moov = box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 65000) + b"\0" * 80) + box(b"trak", box(b"tkhd", b"\0" * 76 + struct.pack(">II", 640 << 16, 480 << 16))))
    id3 = b"".join(k + struct.pack(">I", len(v) + 1) + b"\0\0\x03" + v for k, v in ((b"TIT2", b"Song"), (b"TPE1", b"Band"), (b"TYER", b"1999")))
    mkv = lambda key, data: key + (0x4000 | len(data)).to_bytes(2, "big") + data
    make(tmp_path, {
        "a.png": png(12, 34), "b.gif": b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 20, "c.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8), "d.jpg": jpeg, "e.svg": "<svg width='50' height='60'></svg>", "f.svg": "<svg viewBox='0 0 70 80'/>",
        "g.tiff": tiff([(256, 3, 1, struct.pack("<H", 9)), (257, 3, 1, struct.pack("<H", 10))]), "h.webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"),
        "i.mp4": box(b"ftyp", b"isom") + box(b"free", b"\0" * 99) + moov, "j.mp3": b"ID3\x03\0\0" + bytes([0, 0, len(id3) >> 7, len(id3) & 127]) + id3 + b"\xff\xfb\x90\0" + b"\0" * 16000, "k.jpg": b"\xff\xd8\xff\xe1\0\0Exif\0\0" + exif, "t.txt": "hello",
        "m.mkv": b"\x1aE\xdf\xa3\x80" + mkv(b"\x18S\x80g", mkv(b"\x15I\xa9f", mkv(b"D\x89", struct.pack(">d", 5000.0))) + mkv(b"\x16T\xaek", mkv(b"\xae", mkv(b"\xe0", mkv(b"\xb0", b"\x01\x40") + mkv(b"\xba", b"\xf0"))))),
    })
    with wave.open(str(tmp_path / "l.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\0" * 32000)
    found = {r[0]: tuple(r)[1:] for r in engine.sql(f"name, width, height, duration, mime from {tmp_path}").collect()}
    sizes = {n: v[:2] for n, v in found.items() if v[0]}
    assert sizes == {"a.png": (12, 34), "b.gif": (5, 6), "c.bmp": (7, 8), "d.jpg": (40, 30), "e.svg": (50, 60), "f.svg": (70, 80), "g.tiff": (9, 10), "h.webp": (100, 50), "i.mp4": (640, 480), "m.mkv": (320, 240)}
    assert {n: v[2] for n, v in found.items() if v[2] is not None} == {"i.mp4": 65, "j.mp3": 1, "l.wav": 2, "m.mkv": 5}
    assert found["a.png"][3] == "image/png" and found["t.txt"][3] == "text/plain" and found["i.mp4"][3] == "video/mp4"
    assert [tuple(r) for r in engine.sql(f"title, artist, audio_year, bitrate, freq from {tmp_path} where name = j.mp3").collect()] == [("Song", "Band", 1999, 128, 44100)]
    ((make_, turned, when, f),) = engine.sql(f"exif_make, exif_orientation, exif_datetime, exif_f_number from {tmp_path} where name = k.jpg").collect()
    assert (make_, turned, str(when), f) == ("Maker", "6", "2020-01-02 03:04:05", 2.8)
    assert paths(engine, f"name from {tmp_path} where width < 10 order by name") == ["b.gif", "c.bmp", "g.tiff"] and "t.txt" in paths(engine, f"name from {tmp_path} where is_text")


def test_git(engine, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    make(tmp_path, {"a": "1", "b": "2", ".gitignore": "ign\n"})
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-qm", "first")
    make(tmp_path, {"b": "3", "c": "4", "d": "5", "ign": "6"})
    git("add", "d")
    found = {r[0]: tuple(r)[1:] for r in engine.sql(f"name, git_status, is_git_tracked, is_gitignored, git_branch, git_last_commit_author, length(git_last_commit_hash) from {tmp_path} where path notlike '.git/%'").collect()}
    assert {n: v[0] for n, v in found.items() if n not in (".git", ".gitignore")} == {"a": "clean", "b": "modified", "c": "untracked", "d": "staged", "ign": "ignored"}
    assert found["a"][1:] == (True, False, "main", "Ann", 40) and found["c"][1] is False and found["ign"][2] is True


def test_binary_attributes():
    entries = struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in ((1, 6, 0xFFFFFFFF), (2, 7, 4_000_000), (4, 4, 0xFFFFFFFF), (16, 5, 0xFFFFFFFF), (32, 0, 0xFFFFFFFF)))
    assert extract.decode_acl(entries) == ["user::rw-", "user:4000000:rwx", "group::r--", "mask::r-x", "other::---"]
    with pytest.raises(ValueError, match="no ACL"):
        extract.decode_acl(b"\x01\0\0\0")
    assert extract.decode_capabilities(struct.pack("<IIIII", 0x02000001, 1 << 10, 0, 0, 0)) == ["cap_net_bind_service=ep"]


def test_attributes(monkeypatch, tmp_path):
    """Attributes that not every file system has: what the system gives is decoded."""
    import fcntl

    acl = struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in ((1, 6, 0xFFFFFFFF), (2, 7, 4_000_000), (4, 4, 0xFFFFFFFF), (16, 5, 0xFFFFFFFF), (32, 0, 0xFFFFFFFF)))
    held = {"user.x": b"value", "system.posix_acl_access": acl, "system.posix_acl_default": acl, "security.capability": struct.pack("<IIIII", 0x02000001, 1 << 10, 0, 0, 0)}

    def get(path, name, follow_symlinks=True):
        if name not in held:
            raise OSError(61, "no data")
        return held[name]

    monkeypatch.setattr(os, "getxattr", get)
    monkeypatch.setattr(os, "listxattr", lambda path, follow_symlinks=True: list(held))
    monkeypatch.setattr(fcntl, "ioctl", lambda f, code, data: struct.pack("l", 0x10 | 0x20))
    path = str(tmp_path / "f")
    (tmp_path / "f").write_text("")
    read = lambda name, *args: extract.evaluate(name, path, *args)
    entries = "user::rw-,user:4000000:rwx,group::r--,mask::r-x,other::---"
    assert (read("has_xattrs"), read("xattr_count"), read("has_xattr", "x"), read("xattr", "user.x"), read("has_xattr", "y"), read("xattr", "y")) == (True, 4, True, "value", False, None)
    for kind in ("", "default_"):
        assert (read(f"has_{kind}acl"), read(f"{kind}acl"), read(f"has_{kind}acl_entry", "user:4000000"), read(f"{kind}acl_entry", "user:4000000"), read(f"{kind}acl_entry", "user"), read(f"has_{kind}acl_entry", "user:eve")) == (True, entries, True, "rwx", "rw-", False)
    assert (read("has_capabilities"), read("capabilities"), read("has_capability", "net_bind_service"), read("has_capability", "cap_chown")) == (True, "cap_net_bind_service=ep", True, False)
    assert (read("has_extattrs"), read("extattrs"), read("has_extattr", "i"), read("has_extattr", "d")) == (True, "ia", True, False)


def test_wide_and_deep_trees(engine, tmp_path):
    """More entries at the top than one task would take, and folders below the depth to which they are listed ahead; both orders are those of a plain walk."""
    for i in range(90):
        os.makedirs(tmp_path / f"d{i}" / "e" / "f")
        (tmp_path / f"d{i}" / "e" / "f" / "x.log").write_text("")
        (tmp_path / f"d{i}" / "keep").write_text("")
    (tmp_path / "d7" / ".gitignore").write_text("*.log\n")
    for i in range(17_000):
        (tmp_path / f"t{i}").touch()
    top = str(tmp_path)
    plain = sorted((os.path.relpath(os.path.join(at, n), top) for at, folders, files in os.walk(top) for n in folders + files), key=lambda p: p.split("/"))
    order = lambda query: [r.path for r in sorted(engine.table(engine.parse(query).roots[0])[0].select("path", "_seq").collect(), key=lambda r: r._seq)]
    assert order(f"path from {top} dfs") == plain
    assert order(f"path from {top}") == sorted(plain, key=lambda p: (p.count("/"), p.split("/")))
    assert order(f"path from {top} dfs gitignore") == [p for p in plain if p != "d7/e/f/x.log"]
    assert engine.table(engine.parse(f"path from {top} depth 1").roots[0])[0].rdd.getNumPartitions() < engine.table(engine.parse(f"path from {top}").roots[0])[0].rdd.getNumPartitions()


def test_attributes_of_plain_files(engine, tree):
    row = engine.sql(f"has_xattrs, xattr_count, has_acl, acl, has_capabilities, has_xattr('user.x'), xattr('x'), has_acl_entry('user:bob'), has_capability('chown') from {tree} where name = noext").collect()[0]
    assert tuple(row) == (False, 0, False, "", False, False, None, False, False)


def test_command_line(spark, tree, capsys):
    assert cli.main([f"name, size from {tree} where name = a.txt into csv"]) == 0 and capsys.readouterr().out == "a.txt,7\n"
    assert cli.main(["name", "from", str(tree), "where", "name", "=", "noext"]) == 0 and capsys.readouterr().out == "noext\n"
    assert cli.main(["name from /no/such/folder"]) == 1 and "no such folder" in capsys.readouterr().err
    for flag in ("--fields", "--functions", "--root-options", "--output-formats"):
        assert cli.main([flag]) == 0
    assert "line_count" in capsys.readouterr().out
    with pytest.raises(SystemExit) as ended:
        cli.main(["--version"])
    assert ended.value.code == 0 and capsys.readouterr().out.startswith("lodestone ")
    assert cli.main(["--nocolor", "--us-dates", "month('1/2/2024') as m from " + str(tree) + " where name = a.txt"]) == 0 and capsys.readouterr().out == "1\n"


def test_colours(engine, tmp_path):
    c = Colors("di=01;34:ln=36:or=31:ex=01;32:*.gz=35:*.tar.gz=33:ow=42:fi=0")
    assert c.paint("d", "drwxr-xr-x") == "\x1b[1;34md\x1b[0m" and c.paint("d", "drwxr-xrwx") == "\x1b[42md\x1b[0m" and c.paint("l", "lrwxrwxrwx") == "\x1b[36ml\x1b[0m" and c.paint("l", "lrwxrwxrwx", True) == "\x1b[31ml\x1b[0m"
    assert c.paint("run.gz", "-rwxr-xr-x") == "\x1b[1;32mrun.gz\x1b[0m" and c.paint("x.GZ", "-rw-r--r--") == "\x1b[35mx.GZ\x1b[0m" and c.paint("x.tar.gz", "-rw-r--r--") == "\x1b[33mx.tar.gz\x1b[0m"
    assert c.paint("x", "-rw-r--r--") == "x" and c.paint("x", "") == "x" and Colors().paint("d", "drwxr-xr-x") == "\x1b[1;34md\x1b[0m" and Colors("").style("p", "prw-r--r--") == "33"
    make(tmp_path, {"a.gz": "1", "d/b": "2"})
    os.symlink("nowhere", tmp_path / "gone")
    shown = lambda q: "".join(engine.stream(q, c))
    assert shown(f"name, size from {tmp_path} where is_file order by name") == "\x1b[35ma.gz\x1b[0m\t1\nb\t1\n" and shown(f"name as n from {tmp_path} where name = gone into lines") == "\x1b[31mgone\x1b[0m\n"
    assert shown(f"lower(name) from {tmp_path} where name = d") == "d\n" and shown(f"name from {tmp_path} where name = d into csv") == "d\n" and shown(f"name, count(*) from {tmp_path} where name = d group by name") == "d\t1\n"
    assert shown(f"x.name from {tmp_path} as x where x.name = d") == "\x1b[1;34md\x1b[0m\n" and cli.terminal_colors({}) is None


def test_reports_and_single_readings(tmp_path, capsys):
    make(tmp_path, {"bad.zip": "no archive", "a.txt": "one two"})
    for errors, said in ((True, True), (False, False)):
        reader = Reader({"path": str(tmp_path), "archives": True, "errors": errors})
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
        assert ("bad.zip" in capsys.readouterr().err) == said
    extract.scan_text.cache_clear()
    for name in ("word_count", "char_count", "encoding", "line_ending"):
        extract.evaluate(name, str(tmp_path / "a.txt"))
    assert extract.scan_text.cache_info().misses == 1


def test_extension_lists_of_the_configuration(spark, tmp_path):
    make(tmp_path, {"a.txt": "1", "b.RS": "2", "c.q+": "3"})
    with zipfile.ZipFile(tmp_path / "d.pack", "w") as z:
        z.writestr("inner.txt", "x")
    own = Engine(spark, config={"is_source": [".txt", ".q+"], "is_zip_archive": [".pack"], "is_audio": []})
    names = lambda e, q: sorted(r[0] for r in e.sql(q).collect())
    assert names(own, f"name from {tmp_path} where is_source") == ["a.txt", "c.q+"] and names(Engine(spark), f"name from {tmp_path} where is_source") == ["b.RS"]
    assert len(names(own, f"name from {tmp_path} archives")) == 5 and len(names(Engine(spark), f"name from {tmp_path} archives")) == 4
    assert names(own, f"name from {tmp_path} where is_audio") == []


def test_streams(spark, tmp_path):
    make(tmp_path / "in", {"a.txt": "1", "b.txt": "22"})
    out = watch(spark, str(tmp_path / "in"), "*.txt")
    run = out.select("name", "size").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("seen").collect()) == [("a.txt", 1), ("b.txt", 2)]
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    run = counts(events, "ts", "1 day", "1 hour", "event_type").writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sum(r.n for r in spark.table("counted").collect()) == 1000
