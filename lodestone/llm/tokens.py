"""Operator 6: token counts by distinct pre-tokens, for the vocabulary of a word-level byte-pair tokenizer."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import column, materialize

#: Tokens that a document may have.
LIMIT = 2048
#: Pre-tokens whose counts are broadcast, at most, of so many characters at most; rows that they are looked for in, about.
HEAD, HEAD_LENGTH, HEAD_DOCS = 65_536, 64, 10_000
#: Characters of a text that are split at once; cuts are made at white space only.
PIECE = 1 << 20
#: Rows that are split at once.
ROWS = 256
#: Columns of what splitting gives: of a document (word is null, n counts tokens) or of a pre-token in it (n is its frequency).
NAMES = ["_id", "doc_id", "n_bytes", "word", "n"]


class PieceCounter:
    """Counts tokens of texts: each distinct pre-token is encoded once, and texts sum the counts of theirs by frequency."""

    _made: ClassVar[dict[int, PieceCounter]] = {}

    @classmethod
    def of(cls, vocabulary: str) -> PieceCounter:
        """A worker's own counter; it is made once."""
        if (key := hash(vocabulary)) not in cls._made:
            cls._made[key] = cls(vocabulary)
        return cls._made[key]

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("this counter needs NFC, white space and lower-case normalisers and a splitting pattern")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens of a text, and how many special tokens it holds."""
        parts = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for part in parts:
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            # One character at a time where the lower case would depend on its neighbours.
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
            at = 0
            while at < len(part):
                end = at + PIECE
                while end < len(part) and not part[end].isspace():
                    end += 1
                found.update(self.words.findall(part, at, end) if end - at < len(part) else self.words.findall(part))
                at = end
        return found, len(parts) - 1

    def pieces(self, words: list[str]) -> list[int]:
        """How many tokens each pre-token is."""
        out: list[int] = []
        for i in range(0, len(words), 10_000):
            out += map(len, self.tokenizer.encode_batch(words[i : i + 10_000], add_special_tokens=False))
        return out


def pieces_of(words: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(word, pieces) for distinct pre-tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(vocabulary.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.pieces(batch.column(0).to_pylist()), pa.int64())], ["word", "pieces"])

    return words.mapInArrow(counted, "word string, pieces long")


def frequent(rows: DataFrame, vocabulary: Broadcast) -> dict[str, int]:
    """Pieces of the HEAD short pre-tokens that are in the most documents of a sample of about HEAD_DOCS rows. Which ones these are decides what is shuffled, not what is counted."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(vocabulary.value)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                found = Counter(w for x in batch.column(0).slice(i, ROWS).to_pylist() for w in counter.pre_tokens(x)[0] if len(w) <= HEAD_LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    share = min(1.0, HEAD_DOCS / max(1, rows.count()))
    sample = rows.filter(F.rand(6) < share).select("text").mapInArrow(split, "word string, n long")
    head = sample.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HEAD).select("word")
    return {r.word: r.pieces for r in pieces_of(head, vocabulary).toLocalIterator()}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    n_tokens is what the tokenizers library gives for the whole text with the vocabulary file at path, without added special tokens; special strings inside texts
    count as the special tokens that they are by default. Pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies: those of
    the most frequent pre-tokens by a broadcast of at most HEAD of them, all others by shuffle. Ids are not kept. Null counts as empty. Repeated rows and null ids
    are rows like any others; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size; executors need no copy of it
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), column(docs, "doc_id", "long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    head = docs.sparkSession.sparkContext.broadcast(frequent(rows, vocabulary))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document, with the tokens of its frequent pre-tokens, and a row of each other pre-token of it."""
        counter, known = PieceCounter.of(vocabulary.value), head.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                tokens, ids, words, times = [], [], [], []
                for row, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found, n = counter.pre_tokens(x)
                    for w, k in found.items():
                        if (pieces := known.get(w)) is not None:
                            n += pieces * k
                        else:
                            ids.append(row)
                            words.append(w)
                            times.append(k)
                    tokens.append(n)
                none = pa.nulls(len(tokens), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), none, pa.array(tokens, pa.int64())], NAMES)
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), none, none, pa.array(words, pa.string()), pa.array(times, pa.int64())], NAMES)

    parts = materialize(rows.mapInArrow(split, ", ".join(f"{n} {'string' if n == 'word' else 'long'}" for n in NAMES)))
    rare = parts.filter(F.col("word").isNotNull()).select("_id", "word", "n")
    pieces = pieces_of(rare.select("word").distinct(), vocabulary)
    more = rare.join(pieces, "word").groupBy("_id").agg(F.sum(F.col("n") * F.col("pieces")).alias("_more"))
    found = parts.filter(F.col("word").isNull()).join(more, "_id", "left")
    n = (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n_tokens")
    return found.select("doc_id", "n_bytes", n, (n > limit).alias("over_limit"))
