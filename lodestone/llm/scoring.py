"""Operator 9: language-model scores by prediction by partial matching over bytes, beside a word unigram baseline."""

from __future__ import annotations

import io
import math
import mmap
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import column, materialize, scratch

#: Bytes of context.
ORDER = 5
#: One document in FOLDS is held out: that whose crc32 of the id leaves HELD.
FOLDS, HELD = 7, 2
#: Most words whose counts are broadcast, the most frequent; the counts of all others are joined by shuffle.
HEAD = 65_536
#: Words and n-grams that a task gathers before it passes them on, and bytes that are scored at once.
GATHERED, GRAMS, PIECE = 200_000, 500_000, 1 << 20
#: Paths of a slice of the trie, about: what one task builds at once.
SLICE = 1_000_000


def _buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, owner) of about PIECE bytes: every text's bytes behind ORDER bytes of context, zero at its start; owner is -1 on context."""
    parts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(texts):
        data = np.frombuffer(bytes(ORDER) + text, np.uint8)
        for at in range(ORDER, len(data), PIECE):
            part = data[at - ORDER : at + PIECE]
            owner = np.full(len(part), i, np.int32)
            owner[:ORDER] = -1
            parts.append(part)
            owners.append(owner)
            held += len(part)
            if held >= PIECE:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(owners)


def _mask(size: int) -> np.uint64:
    """The last `size` bytes of a path."""
    return np.uint64((1 << 8 * size) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """At each position from ORDER on, its byte and the ORDER bytes before as one number: a path of the trie."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out |= data[k : len(data) - ORDER + k].astype(np.uint64) << np.uint64(8 * (ORDER - k))
    return out


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def words_of(text: bytes) -> Counter:
    """Frequencies of the words of a text, A-Z lowered."""
    return Counter(text.lower().split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, gram, n): frequencies of the words and of the byte n-grams of a task's rows; gram -1 counts the rows."""
    names = ["word", "gram", "n"]
    words: Counter = Counter()
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def out_words():
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names)

    def out_grams():
        keys, n = _merged(grams)
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)), pa.array(n)], names)

    for batch in batches:
        rows += batch.num_rows
        for i in range(0, batch.num_rows, 256):
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(0).slice(i, 256).to_pylist()]
            for x in texts:
                words.update(x.lower().split())
            if len(words) > GATHERED:
                yield out_words()
                words.clear()
            for data, owner in _buffers(texts):
                grams.append(np.unique(_grams(data)[owner[ORDER:] >= 0], return_counts=True))
            if sum(len(k) for k, _ in grams) > 2 * GRAMS:
                grams[:] = [_merged(grams)]
                if len(grams[0][0]) > GRAMS:
                    yield out_grams()
                    grams.clear()
    if words:
        yield out_words()
    if grams:
        yield out_grams()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([-1], pa.int64()), pa.array([rows], pa.int64())], names)


class ByteModel:
    """Prediction by partial matching with contexts of up to ORDER bytes, pretrained.

    A context with n counts of d symbols gives a seen symbol count / (n + d) and keeps d / (n + d) for escape to the context that is one byte shorter; there the
    symbols already seen are excluded. Below order 0, unseen bytes share evenly. Symbols seen after a context are seen after every shorter one, so what is left there
    after exclusion depends on the longer context alone and is stored with it. The trie is kept level by level, as sorted arrays of its paths.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        """grams: paths of ORDER + 1 bytes as numbers, and their counts; pairs: counts of all 65,536 pairs of bytes (of the whole model, also for a slice of it)."""
        zero = pairs.reshape(256, 256).sum(axis=0)
        self.unseen = -np.log10(max(1, 256 - np.count_nonzero(zero)))
        self.levels = []
        below = None
        for k in range(ORDER + 1):
            if k > 1:
                keys, at = np.unique(grams & _mask(k + 1), return_inverse=True)
                own = np.bincount(at, counts, len(keys))
            else:
                table = pairs if k else zero
                keys = np.flatnonzero(table).astype(np.uint64)
                own = table[keys.astype(np.int64)].astype(np.float64)
            starts = np.flatnonzero(np.append(True, (keys[1:] >> np.uint64(8)) != (keys[:-1] >> np.uint64(8)))) if len(keys) else np.empty(0, np.int64)
            contexts = keys[starts] >> np.uint64(8)
            d = np.diff(np.append(starts, len(keys))).astype(np.float64)
            n = np.add.reduceat(own, starts) if len(keys) else np.empty(0)
            of = np.repeat(np.arange(len(starts)), d.astype(np.int64))
            level = {"keys": keys, "contexts": contexts, "seen": np.log10(own / (n + d)[of]).astype(np.float32), "count": np.log10(own).astype(np.float32), "escape": np.log10(d / (n + d)).astype(np.float32)}
            if k and len(keys):
                shorter = np.searchsorted(below["contexts"], contexts & _mask(k - 1))
                excluded = np.add.reduceat(below["own"][np.searchsorted(below["keys"], keys & _mask(k))], starts)
                rest = below["d"][shorter] - d
                left = below["n"][shorter] - excluded + rest
                with np.errstate(divide="ignore"):
                    level |= {"left": np.where(left > 0, np.log10(np.maximum(left, 1)), np.nan).astype(np.float32), "rest": np.log10(np.maximum(rest, 1)).astype(np.float32)}
            self.levels.append(level)
            below = {"keys": keys, "contexts": contexts, "own": own, "n": n, "d": d}

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each path after the bytes before it."""
        out, fresh, open_ = np.zeros(len(grams)), np.ones(len(grams), bool), np.ones(len(grams), bool)
        longer = np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            t = self.levels[k]
            if not len(t["keys"]):
                continue
            at = np.flatnonzero(open_)
            path = grams[at] & _mask(k + 1)
            ctx = path >> np.uint64(8)
            x = np.minimum(np.searchsorted(t["contexts"], ctx), len(t["contexts"]) - 1)
            known = t["contexts"][x] == ctx
            g = np.minimum(np.searchsorted(t["keys"], path), len(t["keys"]) - 1)
            found = t["keys"][g] == path
            new = fresh[at] & known
            if k < ORDER and "left" in self.levels[k + 1]:
                old = ~fresh[at]
                left, rest = (self.levels[k + 1][c][longer[at]] for c in ("left", "rest"))
                some = old & ~np.isnan(left)
                out[at] += np.where(some, np.where(found, t["count"][g], rest) - left, 0)
                done = some & found
            else:
                done = np.zeros(len(at), bool)
            out[at] += np.where(new, np.where(found, t["seen"][g], t["escape"][x]), 0)
            done |= new & found
            fresh[at[known]] = False
            longer[at] = x
            open_[at[done]] = False
        out[open_] += self.unseen
        return out

    @classmethod
    def of(cls, levels: list[dict], unseen: float) -> ByteModel:
        """A model from arrays that were written."""
        out = cls.__new__(cls)
        out.levels, out.unseen = levels, unseen
        return out


#: The arrays of a level of the trie, as they follow each other in a slice's file.
ARRAYS = ("keys", "contexts", "seen", "count", "escape", "left", "rest")


def dump(model: ByteModel, out) -> None:
    """Write a model's arrays, each at a multiple of 64 bytes."""
    at = 0
    for array in [np.array([model.unseen]), *[level.get(name, np.empty(0, np.float32)) for level in model.levels for name in ARRAYS]]:
        part = io.BytesIO()
        np.save(part, array)
        data = part.getvalue()
        out.write(data + bytes(-len(data) % 64))
        at += len(data)


def load(data: mmap.mmap | bytes) -> ByteModel:
    """A model whose arrays lie in these bytes; nothing is copied."""
    file, arrays = data if isinstance(data, mmap.mmap) else io.BytesIO(data), []
    file.seek(0)
    while file.tell() < len(data):
        np.lib.format.read_magic(file)
        (n,), _, kind = np.lib.format.read_array_header_1_0(file)
        arrays.append(np.frombuffer(data, kind, n, file.tell()))
        end = file.tell() + n * kind.itemsize
        file.seek(end + -end % 64)
    levels = [dict(zip(ARRAYS, arrays[1 + i : 1 + i + len(ARRAYS)], strict=True)) for i in range(0, len(arrays) - 1, len(ARRAYS))]
    return ByteModel.of([{k: x for k, x in level.items() if len(x) or k not in ("left", "rest")} for level in levels], float(arrays[0][0]))


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, for Python on any executor, and the path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


class Trie:
    """The slices of a trie in the shared folder. Each has the contexts that end in certain pairs of bytes, so one slice scores a byte.

    Where the folder is a mounted one, slices are mapped into memory read-only, and the system keeps what is in use; from other stores one slice at a time is read.
    """

    def __init__(self, folder: str, names: list[str], group: np.ndarray, unseen: float):
        """names: the file of each slice; group: the slice of each of the 65,536 pairs of bytes, -1 for none."""
        self.folder, self.names, self.group, self.unseen, self.open = folder, names, group, unseen, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def model(self, part: int) -> ByteModel:
        if part not in self.open:
            files, folder = store(self.folder)
            if isinstance(files, pafs.LocalFileSystem):
                with open(f"{folder}/{self.names[part]}", "rb") as f:
                    self.open[part] = load(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
            else:
                with files.open_input_stream(f"{folder}/{self.names[part]}") as f:
                    self.open = {part: load(f.read())}
        return self.open[part]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each path after the bytes before it. A pair that the trie has not seen leaves but order 0 and 1: any slice has these."""
        out = np.full(len(grams), self.unseen)
        if not self.names:
            return out
        part = self.group[(grams >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.append(part[order][1:] != part[order][:-1], True)) + 1
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            if b > a:
                out[order[a:b]] = self.model(max(0, int(part[order[a]]))).log10(grams[order[a:b]])
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text. There is no end symbol: it is the probability that a text begins so."""
        out = np.zeros(len(texts))
        for data, owner in _buffers(texts):
            own = owner[ORDER:] >= 0
            grams, at = np.unique(_grams(data)[own], return_inverse=True)
            out += np.bincount(owner[ORDER:][own], self.log10(grams)[at], len(texts))
        return out


def build(paths: DataFrame, most: int = SLICE) -> Trie:
    """The trie of paths (gram, n): executors build its slices of about `most` paths and write them to the shared folder.

    Of the whole trie the driver sees what there is for each pair of bytes, 65,536 rows at most, and the names of the slices. A pair is in one slice.
    """
    spark = paths.sparkSession

    def by_pair(pair, measure):
        out = np.zeros(1 << 16)
        for key, n in paths.groupBy(pair.cast("int").alias("pair")).agg(measure).toLocalIterator():
            out[key] = n
        return out

    pairs = by_pair(F.col("gram").bitwiseAND(0xFFFF), F.sum("n"))
    end = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    sizes = by_pair(end, F.count(F.lit(1)))
    parts = max(1, -(-int(sizes.sum()) // most))
    group, held = np.full(1 << 16, -1, np.int32), np.zeros(parts)
    for pair in np.argsort(-sizes)[: np.count_nonzero(sizes)]:  # the largest first, each to the part that holds least
        group[pair] = held.argmin()
        held[group[pair]] += sizes[pair]
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()

    def built(table: pa.Table) -> pa.Table:
        model = ByteModel(table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(np.float64), pairs)
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        name = uuid.uuid4().hex  # another attempt of the task writes another file, and one of them is named
        with files.open_output_stream(f"{path}/{name}") as out:
            dump(model, out)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "name": [name]})

    table = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group) if g >= 0], "pair int, part int")
    dealt = paths.join(F.broadcast(table), end.cast("int") == F.col("pair")).select("part", "gram", "n")
    names = dict(dealt.groupBy("part").applyInArrow(built, "part int, name string").collect())
    return Trie(folder, [names[i] for i in range(len(names))], group, -math.log10(256))


def score(docs: DataFrame, head: int = HEAD, paths: int = SLICE) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Every row that is not held out is learned from, whole; null texts count as empty, and rows with null ids are not held out. Tokens are words, A-Z
    lowered, and one end; base_score is their unigram score with one added to each count. score is the byte model's log10 probability of the text. Repeated rows are learned
    from each time. The counts of the most frequent words (`head` of them at most) are broadcast; the documents' other words are joined to the counts of all words.
    Without rows to learn from, counts are 0. An empty table gives an empty one. paths: how many paths of the trie a task builds at once, about.
    """
    spark = docs.sparkSession
    ship(spark)
    doc_id = column(docs, "doc_id", "long")
    rows = docs.select(doc_id.alias("doc_id"), column(docs, "text", "string").alias("text"), F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False)).alias("held_out"))
    counts = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, gram long, n long")
    counts = materialize(counts.groupBy("word", "gram").agg(F.sum("n").alias("n")))
    ends = counts.filter("gram = -1").agg(F.sum("n")).first()[0] or 0
    words = counts.filter("word is not null").select("word", "n")
    steps = {k: (n, m) for k, n, m in words.groupBy(F.floor(F.log2("n") * 4).cast("int")).agg(F.sum("n"), F.count(F.lit(1))).collect()}  # a row for each quarter power of 2
    total, size = sum(n for n, _ in steps.values()) + ends, sum(m for _, m in steps.values()) + (ends > 0)
    least, taken = max(steps, default=0) + 1, 0
    for k in sorted(steps, reverse=True):
        taken += steps[k][1]
        if taken > head:
            break
        least = k
    is_head = F.floor(F.log2("n") * 4) >= least
    known = spark.sparkContext.broadcast({bytes(r[0]): math.log10(r[1] + 1) for r in words.filter(is_head).toLocalIterator()})
    trie = spark.sparkContext.broadcast(build(counts.filter("gram >= 0").select("gram", "n"), paths))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, names = TaskContext.get().partitionId() << 40, ["row", "doc_id", "held_out", "n_words", "n_head", "head_score", "score", "tail", "tail_n"]
        of = known.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                marks = trie.value.score(texts)
                n, n_head, logs, tail, tail_n = [], [], [], [], []
                for x in texts:
                    found = words_of(x)
                    hits = [(of[w], f) for w, f in found.items() if w in of]
                    n.append(found.total())
                    n_head.append(sum(f for _, f in hits))
                    logs.append(math.fsum(a * f for a, f in hits))
                    tail.append([w for w in found if w not in of])
                    tail_n.append([found[w] for w in tail[-1]])
                ids = np.arange(row, row + len(texts))
                row += len(texts)
                columns = [pa.array(ids), part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(n_head, pa.int64()), pa.array(logs, pa.float64()), pa.array(marks), pa.array(tail, pa.list_(pa.binary())), pa.array(tail_n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = "row long, doc_id long, held_out boolean, n_words long, n_head long, head_score double, score double, tail array<binary>, tail_n array<long>"
    marked = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(scored, kind))
    tail = marked.select("row", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("tail_n").alias("f"))))
    tail = tail.join(words.filter(~is_head), "word").groupBy("row").agg(F.sum("f").alias("n_tail"), F.sum(F.col("f") * F.log10(F.col("n") + 1)).alias("tail_score"))
    joined = marked.drop("tail", "tail_n").join(tail, "row", "left")
    end = F.lit(math.log10(ends + 1))
    n_tokens = F.col("n_words") + 1
    return joined.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)) + end - n_tokens * F.lit(math.log10(total + size + 1))).alias("base_score"), "score",
    )
