"""The fields of a file: names, types, costs, and how each is derived from the columns of a scan or of a table."""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.registry import format_size
from ..plans.values import BOOL, FLOAT, INT, STRING, TIME, Value, text

# Every field's names (the first is shown), its type, what it costs to find, and whether members of archives have it.
FIELD_LIST = [
    (("name",), STRING, 0, True),
    (("filename", "fname"), STRING, 0, True),
    (("ext", "extension"), STRING, 0, True),
    (("path",), STRING, 0, True),
    (("abspath",), STRING, 1, True),
    (("dir", "directory", "dirname"), STRING, 0, True),
    (("absdir",), STRING, 1, True),
    (("size",), INT, 1, True),
    (("fsize", "hsize"), INT, 1, True),
    (("uid",), INT, 1, False),
    (("gid",), INT, 1, False),
    (("user",), STRING, 1, False),
    (("group",), STRING, 1, False),
    (("created",), TIME, 1, False),
    (("accessed",), TIME, 1, False),
    (("modified",), TIME, 1, True),
    (("is_dir",), BOOL, 1, True),
    (("is_file",), BOOL, 1, True),
    (("is_symlink",), BOOL, 1, True),
    (("link_target", "symlink_target"), STRING, 1, True),
    (("is_broken_symlink", "is_broken_link"), BOOL, 1, True),
    (("is_pipe", "is_fifo"), BOOL, 1, True),
    (("is_char", "is_character"), BOOL, 1, True),
    (("is_block",), BOOL, 1, True),
    (("is_socket",), BOOL, 1, True),
    (("device",), STRING, 1, False),
    (("rdev",), STRING, 1, False),
    (("inode",), STRING, 1, False),
    (("blocks",), STRING, 1, False),
    (("blksize", "block_size"), STRING, 1, False),
    (("hardlinks",), STRING, 1, False),
    (("atime",), STRING, 1, False),
    (("atime_nsec",), STRING, 1, False),
    (("mtime",), STRING, 1, False),
    (("mtime_nsec",), STRING, 1, False),
    (("ctime",), STRING, 1, False),
    (("ctime_nsec",), STRING, 1, False),
    (("mode",), STRING, 1, True),
    (("user_read",), BOOL, 1, True),
    (("user_write",), BOOL, 1, True),
    (("user_exec",), BOOL, 1, True),
    (("user_all", "user_rwx"), BOOL, 1, True),
    (("group_read",), BOOL, 1, True),
    (("group_write",), BOOL, 1, True),
    (("group_exec",), BOOL, 1, True),
    (("group_all", "group_rwx"), BOOL, 1, True),
    (("other_read",), BOOL, 1, True),
    (("other_write",), BOOL, 1, True),
    (("other_exec",), BOOL, 1, True),
    (("other_all", "other_rwx"), BOOL, 1, True),
    (("suid", "is_suid"), BOOL, 1, True),
    (("sgid", "is_sgid"), BOOL, 1, True),
    (("is_sticky", "sticky"), BOOL, 1, True),
    (("is_hidden",), BOOL, 1, True),
    (("has_xattrs",), BOOL, 2, False),
    (("xattr_count",), INT, 2, False),
    (("extattrs",), STRING, 2, False),
    (("has_extattrs",), BOOL, 2, False),
    (("acl",), STRING, 2, False),
    (("has_acl",), BOOL, 2, False),
    (("default_acl",), STRING, 2, False),
    (("has_default_acl",), BOOL, 2, False),
    (("has_capabilities", "has_caps"), BOOL, 2, False),
    (("capabilities", "caps"), STRING, 2, False),
    (("is_shebang",), BOOL, 2, False),
    (("is_git_repo",), BOOL, 1, False),
    (("is_git_tracked", "git_tracked"), BOOL, 16, False),
    (("is_gitignored", "is_git_ignored"), BOOL, 16, False),
    (("git_status",), STRING, 16, False),
    (("git_branch",), STRING, 16, False),
    (("git_last_commit_hash", "git_commit_hash"), STRING, 1024, False),
    (("git_last_commit_date", "git_commit_date"), TIME, 1024, False),
    (("git_last_commit_author", "git_commit_author"), STRING, 1024, False),
    (("is_empty",), BOOL, 2, True),
    (("width",), INT, 16, False),
    (("height",), INT, 16, False),
    (("duration",), INT, 16, False),
    (("bitrate", "mp3_bitrate"), INT, 16, False),
    (("freq", "mp3_freq"), INT, 16, False),
    (("title", "mp3_title"), STRING, 16, False),
    (("artist", "mp3_artist"), STRING, 16, False),
    (("album", "mp3_album"), STRING, 16, False),
    (("audio_year", "mp3_year"), INT, 16, False),
    (("genre", "mp3_genre"), STRING, 16, False),
    (("comment", "mp3_comment"), STRING, 16, False),
    (("track", "mp3_track"), STRING, 16, False),
    (("disc", "mp3_disc"), STRING, 16, False),
    (("exif_datetime",), TIME, 16, False),
    (("exif_datetime_original", "exif_dto"), TIME, 16, False),
    (("exif_altitude", "exif_alt"), INT, 16, False),
    (("exif_latitude", "exif_lat"), INT, 16, False),
    (("exif_longitude", "exif_lon", "exif_lng"), INT, 16, False),
    (("exif_make",), STRING, 16, False),
    (("exif_model",), STRING, 16, False),
    (("exif_software",), STRING, 16, False),
    (("exif_version",), STRING, 16, False),
    (("exif_exposure_time", "exif_exptime"), INT, 16, False),
    (("exif_aperture",), INT, 16, False),
    (("exif_shutter_speed",), INT, 16, False),
    (("exif_f_number", "exif_f_num"), INT, 16, False),
    (("exif_iso_speed", "exif_iso"), STRING, 16, False),
    (("exif_sensitivity", "exif_photo_sensitivity"), STRING, 16, False),
    (("exif_focal_length", "exif_focal_len"), INT, 16, False),
    (("exif_lens_make",), STRING, 16, False),
    (("exif_lens_model",), STRING, 16, False),
    (("exif_description", "exif_desc"), STRING, 16, False),
    (("exif_artist",), STRING, 16, False),
    (("exif_copyright",), STRING, 16, False),
    (("exif_orientation",), STRING, 16, False),
    (("exif_flash",), STRING, 16, False),
    (("exif_color_space",), STRING, 16, False),
    (("exif_exposure_program", "exif_exp_program"), STRING, 16, False),
    (("exif_exposure_bias", "exif_exp_bias"), INT, 16, False),
    (("exif_white_balance", "exif_wb"), STRING, 16, False),
    (("exif_metering_mode",), STRING, 16, False),
    (("exif_scene_type", "exif_scene"), STRING, 16, False),
    (("exif_contrast",), STRING, 16, False),
    (("exif_saturation",), STRING, 16, False),
    (("exif_sharpness",), STRING, 16, False),
    (("exif_body_serial", "exif_serial"), STRING, 16, False),
    (("exif_lens_serial",), STRING, 16, False),
    (("exif_user_comment", "exif_comment"), STRING, 16, False),
    (("exif_image_width", "exif_width"), STRING, 16, False),
    (("exif_image_height", "exif_height"), STRING, 16, False),
    (("exif_max_aperture",), STRING, 16, False),
    (("exif_digital_zoom", "exif_dzoom"), INT, 16, False),
    (("mime",), STRING, 16, False),
    (("line_count",), INT, 1024, False),
    (("word_count", "words"), INT, 1024, False),
    (("char_count", "chars"), INT, 1024, False),
    (("encoding",), STRING, 1024, False),
    (("has_bom",), BOOL, 16, False),
    (("line_ending", "line_endings", "eol"), STRING, 1024, False),
    (("is_binary",), BOOL, 16, False),
    (("is_text",), BOOL, 16, False),
    (("is_archive",), BOOL, 0, True),
    (("is_audio",), BOOL, 0, True),
    (("is_book",), BOOL, 0, True),
    (("is_doc",), BOOL, 0, True),
    (("is_font",), BOOL, 0, True),
    (("is_image",), BOOL, 0, True),
    (("is_source",), BOOL, 0, True),
    (("is_video",), BOOL, 0, True),
    (("sha1",), STRING, 1024, False),
    (("sha256", "sha2_256"), STRING, 1024, False),
    (("sha512", "sha2_512"), STRING, 1024, False),
    (("sha3", "sha3_512"), STRING, 1024, False),
]
# Extensions of the classes of files.
EXTENSIONS = {
    "is_archive": [".7z", ".bz2", ".bzip2", ".gz", ".gzip", ".lz", ".rar", ".tar", ".xz", ".zip"],
    "is_audio": [".aac", ".aiff", ".amr", ".flac", ".gsm", ".m4a", ".m4b", ".m4p", ".mp3", ".ogg", ".wav", ".wma"],
    "is_book": [".azw3", ".chm", ".djv", ".djvu", ".epub", ".fb2", ".mobi", ".pdf"],
    "is_doc": [".accdb", ".doc", ".docm", ".docx", ".dot", ".dotm", ".dotx", ".mdb", ".odp", ".ods", ".odt", ".pdf", ".potm", ".potx", ".ppt", ".pptm", ".pptx", ".rtf", ".xlm", ".xls", ".xlsm", ".xlsx", ".xlt", ".xltm", ".xltx", ".xps"],
    "is_font": [".eot", ".fon", ".otc", ".otf", ".ttc", ".ttf", ".woff", ".woff2"],
    "is_image": [".bmp", ".exr", ".gif", ".heic", ".jpeg", ".jpg", ".jxl", ".png", ".psb", ".psd", ".svg", ".tga", ".tiff", ".webp"],
    "is_source": [".asm", ".awk", ".bas", ".c", ".cc", ".ceylon", ".clj", ".coffee", ".cpp", ".cs", ".d", ".dart", ".elm", ".erl", ".go", ".gradle", ".groovy", ".h", ".hh", ".hpp", ".java", ".jl", ".js", ".jsp", ".jsx", ".kt", ".kts", ".lua", ".nim", ".pas", ".php", ".pl", ".pm", ".py", ".qml", ".rb", ".rs", ".scala", ".sol", ".swift", ".tcl", ".ts", ".tsx", ".vala", ".vb", ".zig"],
    "is_video": [".3gp", ".avi", ".flv", ".m4p", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm", ".wmv"],
}
#: Extensions of archives that are read as folders.
ZIP_EXTENSIONS = [".zip", ".jar", ".war", ".ear"]
#: Lists of extensions that a configuration sets in place of these.
OWN_EXTENSIONS: ContextVar[dict[str, list[str]]] = ContextVar("own_extensions", default={})


@dataclass(frozen=True)
class Field:
    name: str
    names: tuple[str, ...]
    kind: str
    weight: int
    in_archives: bool


FIELDS = {n: Field(names[0], names, kind, weight, in_archives) for names, kind, weight, in_archives in FIELD_LIST for n in names}

#: Columns that a scan of files has, with their Spark types.
SCAN = {
    "_seq": "string", "_depth": "int", "_root": "string", "_archive": "string", "name": "string", "path": "string", "abspath": "string", "size": "long", "mode_bits": "int", "is_link": "boolean", "is_broken_symlink": "boolean",
    "link_target": "string", "empty_dir": "boolean", "uid": "long", "gid": "long", "user": "string", "group": "string", "device": "long", "rdev": "long", "inode": "long", "blocks": "long", "blksize": "long", "hardlinks": "long",
    "atime_ns": "long", "mtime_ns": "long", "ctime_ns": "long", "birth_ns": "long",
}

_FORMATS = {0o140000: "is_socket", 0o120000: "is_link", 0o100000: "is_file", 0o060000: "is_block", 0o040000: "is_dir", 0o020000: "is_char", 0o010000: "is_pipe"}
_LETTERS = {0o140000: "s", 0o120000: "l", 0o100000: "-", 0o060000: "b", 0o040000: "d", 0o020000: "c", 0o010000: "p"}
_BITS = {"user_read": 0o400, "user_write": 0o200, "user_exec": 0o100, "user_all": 0o700, "group_read": 0o040, "group_write": 0o020, "group_exec": 0o010, "group_all": 0o070, "other_read": 0o004, "other_write": 0o002, "other_exec": 0o001, "other_all": 0o007, "suid": 0o4000, "sgid": 0o2000, "is_sticky": 0o1000}


def _bits(mode: Column, mask: int) -> Column:
    return mode.bitwiseAND(F.lit(mask)) == mask


def mode_text(mode: Column) -> Column:
    """Ten characters, as ls writes them."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _LETTERS.items() for x in p]), mode.bitwiseAND(F.lit(0o170000))), F.lit("?"))
    parts = [kind]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        parts += [F.when(_bits(mode, 4 << shift), "r").otherwise("-"), F.when(_bits(mode, 2 << shift), "w").otherwise("-")]
        run = _bits(mode, 1 << shift)
        parts.append(F.when(_bits(mode, special) & run, letter).when(_bits(mode, special), letter.upper()).when(run, "x").otherwise("-"))
    return F.concat(*parts)


def stem(name: Column) -> Column:
    """Without the last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)\A.+\.([^.]*)\z", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def has_extension(name: Column, extensions: list[str]) -> Column:
    return F.lower(name).rlike(r"(?:" + "|".join(re.escape(e.lower()) for e in extensions) + r")\z") if extensions else F.lit(False)


def content_value(field: str, content: Column) -> Value | None:
    """Fields of a text column's contents; JVM expressions."""
    raw = F.encode(content, "UTF-8")
    if field in ("sha1", "sha256", "sha512"):
        return Value({"sha1": lambda: F.sha1(raw), "sha256": lambda: F.sha2(raw, 256), "sha512": lambda: F.sha2(raw, 512)}[field](), STRING)
    if field == "line_count":
        return Value((F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).cast("bigint"), INT)
    if field == "word_count":
        return Value(F.regexp_count(content, F.lit(r"(?U)\S+")).cast("bigint"), INT)
    if field == "char_count":
        return Value(F.char_length(content).cast("bigint"), INT)
    bom = F.startswith(content, F.lit("\ufeff"))
    if field == "has_bom":
        return Value(bom, BOOL)
    if field == "encoding":
        plain = ~content.rlike(r"[^\x00-\x7F]")
        return Value(F.when(bom, "UTF-8").when(content.contains("\0"), F.lit(None)).when(plain, "ASCII").otherwise("UTF-8"), STRING)
    if field == "line_ending":
        crlf, lf, cr = content.contains("\r\n"), content.rlike(r"(?<!\r)\n"), content.rlike(r"\r(?!\n)")
        kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
        return Value(F.when(kinds > 1, "mixed").when(crlf, "CRLF").when(lf, "LF").when(cr, "CR"), STRING)
    if field == "is_shebang":
        return Value(F.startswith(content, F.lit("#!")), BOOL)
    if field in ("is_text", "is_binary"):
        found = content.contains("\0")
        return Value(found if field == "is_binary" else ~found, BOOL)
    if field == "sha3":
        from .extract import text_call

        return Value(text_call("sha3", content), STRING)
    return None


def derive(field: Field, get, is_file: bool) -> Value | None:
    """A field from the columns that get(name) gives (a Value, or None); is_file: the row is a directory entry, whose contents can be read by path."""
    name, path, size, mode = get("name"), get("path"), get("size"), get("mode_bits")
    f = field.name
    out: Value | None = None
    if f in ("filename", "ext", "is_hidden", *EXTENSIONS) and name:
        n = text(name)
        if f in EXTENSIONS:
            out = Value(has_extension(n, OWN_EXTENSIONS.get().get(f, EXTENSIONS[f])), BOOL)
        else:
            out = {"filename": lambda: Value(stem(n), STRING), "ext": lambda: Value(extension(n), STRING), "is_hidden": lambda: Value(F.startswith(n, F.lit(".")), BOOL)}[f]()
    elif f == "dir" and path:
        out = Value(parent(text(path)), STRING)
    elif f == "absdir" and get("abspath"):
        out = Value(parent(text(get("abspath"))), STRING)
    elif f == "fsize" and size:
        out = Value(size.col, INT)
    elif mode and f in _BITS:
        out = Value(_bits(mode.col, _BITS[f]), BOOL)
    elif mode and f == "mode":
        out = Value(mode_text(mode.col), STRING)
    elif mode and f in _FORMATS.values():
        out = Value(mode.col.bitwiseAND(F.lit(0o170000)) == next(k for k, v in _FORMATS.items() if v == f), BOOL)
    elif f == "is_symlink" and get("is_link"):
        out = Value(get("is_link").col, BOOL)
    elif f in ("atime", "mtime", "ctime") and get(f + "_ns"):
        out = Value(F.floor(get(f + "_ns").col / 1_000_000_000).cast("bigint"), INT)
    elif f in ("atime_nsec", "mtime_nsec", "ctime_nsec") and get(f[:5] + "_ns"):
        out = Value(F.pmod(get(f[:5] + "_ns").col, F.lit(1_000_000_000)).cast("bigint"), INT)
    elif f in ("accessed", "modified", "created") and get({"accessed": "atime_ns", "modified": "mtime_ns", "created": "birth_ns"}[f]):
        ns = get({"accessed": "atime_ns", "modified": "mtime_ns", "created": "birth_ns"}[f])
        out = Value(F.timestamp_micros(F.floor(ns.col / 1000).cast("bigint")).cast("timestamp_ntz"), TIME)
    elif f == "is_empty" and size:
        out = Value(F.when(get("empty_dir").col.isNotNull(), get("empty_dir").col).otherwise(size.col == 0) if get("empty_dir") else size.col == 0, BOOL)
    elif is_file and get("abspath"):
        from .extract import file_call

        out = Value(file_call(f, field.kind if not f.startswith("exif_") or field.kind != INT else FLOAT, get("abspath").col), field.kind if not f.startswith("exif_") or field.kind != INT else FLOAT)
        if not field.in_archives:
            out.col = F.when(get("_archive").col.isNull(), out.col)
    elif get("content"):
        out = content_value(f, text(get("content")))
    if out:
        out.weight = field.weight
    return out
