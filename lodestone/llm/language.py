"""Operator 8: language identification by words first, backing off to character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import column

#: Documents to learn from, about, taken by hash of their id: what bounds the model. All their words count. And the longest n-grams.
TRAIN_DOCS, LONGEST = 10_000, 4
#: A word speaks for a language if it is known, or has a known n-gram of so many characters; the share of such words that a text of a known language has.
TRUSTED, EVIDENCE = 3, 0.1
#: One document in so many is held out, by crc32 of its id.
FOLDS = 5
#: What one step of backing off costs, as a factor of the likelihood; words whose scores a worker keeps.
BACKOFF, KEPT = 0.4, 100_000
#: Rows that are predicted at once.
ROWS = 256
#: Characters of a text that are split at once; cuts fall between words.
PIECE = 1 << 20

_WORDS = regex.compile(r"\p{L}+")


def words_of(text: str) -> Counter:
    """Frequencies of the lower-cased runs of letters of the whole text."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_WORDS.findall(text[at:end].lower()))
        at = end
    return found


class LanguageModel:
    """Log frequencies by language of words, and of the character n-grams (with word borders) of the words: a row of a matrix for each."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: (lang, word, n)."""
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words, grams = Counter(), [Counter() for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            words[word, at[lang]] += n
            framed = f" {word} "
            for k in range(1, LONGEST + 1):
                for i in range(len(framed) - k + 1):
                    grams[k][framed[i : i + k], at[lang]] += n
        self.words, self.word_logs = self._logs(words)
        self.grams: dict[str, int] = {}
        logs = []
        for k in range(1, LONGEST + 1):
            rows, own = self._logs(grams[k])
            self.grams |= {g: i + len(self.grams) for g, i in rows.items()}
            logs.append(own + (LONGEST - k + 1) * math.log(BACKOFF))
        self.gram_logs = np.concatenate(logs)
        self.known: dict[str, int] = {}
        self.logs = np.empty((0, len(self.langs)), np.float32)
        self.levels = np.empty(0, np.int8)

    def _logs(self, counts: Counter) -> tuple[dict[str, int], np.ndarray]:
        rows: dict[str, int] = {}
        for key, _ in counts:
            rows.setdefault(key, len(rows))
        table = np.zeros((len(rows), len(self.langs)))
        for (key, lang), n in counts.items():
            table[rows[key], lang] = n
        return rows, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(rows))).astype(np.float32)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores by language of words: of a known word its log frequency; else of its longest n-grams of which any is known, their mean, for each step at a cost. And
        the length of these n-grams: LONGEST + 1 for a known word, 0 if nothing is known."""
        out, levels = np.zeros((len(words), len(self.langs)), np.float32), np.zeros(len(words), np.int8)
        known = [(i, r) for i, w in enumerate(words) if (r := self.words.get(w)) is not None]
        if known:
            at, rows = map(list, zip(*known, strict=True))
            out[at] = self.word_logs[rows]
            levels[at] = LONGEST + 1
        at, sizes, flat, get = [], [], [], self.grams.get
        for i, w in enumerate(words):
            if w in self.words:
                continue
            framed = f" {w} "
            for k in range(min(LONGEST, len(framed)), 0, -1):
                found = [r for j in range(len(framed) - k + 1) if (r := get(framed[j : j + k])) is not None]
                if found:
                    at.append(i)
                    levels[i] = k
                    sizes.append(len(found))
                    flat += found
                    break
        if at:
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            out[at] = np.add.reduceat(self.gram_logs[flat], starts, axis=0) / np.array(sizes, np.float32)[:, None]
        return out, levels

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The language of each text, its probability and the share of words that speak for a language; ('und', 0, 0) for a text without letters or a model that has learned nothing."""
        if len(self.known) > KEPT:
            self.known, self.logs, self.levels = {}, self.logs[:0], self.levels[:0]
        found = [words_of(x or "") for x in texts]
        new = list({w for f in found for w in f if w not in self.known})
        self.known |= {w: len(self.logs) + i for i, w in enumerate(new)}
        logs, levels = self.score_words(new)
        self.logs, self.levels = np.concatenate([self.logs, logs]), np.concatenate([self.levels, levels])
        out = []
        for f in found:
            if not f or not self.langs:
                out.append(("und", 0.0, 0.0))
                continue
            rows, n = [self.known[w] for w in f], np.array(list(f.values()), np.float64)
            scores = n @ self.logs[rows].astype(np.float64)
            scores = np.exp(scores - scores.max())
            best = int(scores.argmax())
            out.append((self.langs[best], float(scores[best] / scores.sum()), float(n @ (self.levels[rows] >= TRUSTED) / n.sum())))
        return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame) -> LanguageModel:
    """Learn from rows with a lang and an id that isn't held out: at most about TRAIN_DOCS of them, the least by hash; their whole texts."""
    ship(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang")).filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, TRAIN_DOCS / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    found = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return LanguageModel(sorted(tuple(x) for x in found.toLocalIterator()))


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, raw (hash of its text), held_out, lang_pred, score, evidence (share of words that speak for a language).

    The prediction reads the whole text only. lang_pred is 'und' with score 0 if the text is null or has no letter, or nothing could be learned. Null ids are not held out, and
    not learned from. Repeated rows each give a row; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for i in range(0, batch.num_rows, ROWS) for x in model.value.predict(batch.column(1).slice(i, ROWS).to_pylist())]
            lang, *numbers = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), *[pa.array(x, pa.float64()) for x in numbers]], ["doc_id", "raw", "lang_pred", "score", "evidence"])

    text = column(docs, "text", "string")
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw"))
    return rows.mapInArrow(predicted, "doc_id long, raw long, lang_pred string, score double, evidence double").select("doc_id", "raw", held_out().alias("held_out"), "lang_pred", "score", "evidence")


def drop_unknown(docs: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """docs' columns, without the rows of no language: null texts, texts without letters, and texts of which less than the share `evidence` of the words speaks for any of the
    learned languages, by word or n-gram, so that the best of them is no answer. Without labels there is no language to reject a text for: all that have a letter stay."""
    text = column(docs, "text", "string")
    learned = train(docs)
    if not learned.langs:
        return docs.filter(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    model, at = docs.sparkSession.sparkContext.broadcast(learned), next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield part.filter(pa.array([lang != "und" and found >= evidence for lang, _, found in model.value.predict(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
