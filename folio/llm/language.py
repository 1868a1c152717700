"""Language identification: known words by their log frequency in each language, unseen words by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import dropped, table, written

TRAIN_DOCS = 8000
LONGEST = 5
FOLDS, FOLD = 3, 1
#: Bytes that a worker remembers unseen words in, and what an entry takes besides its numbers.
REMEMBERED, ENTRY = 64 << 20, 200
NONE = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall((text or "").lower())


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word between its borders; single characters without them."""
    whole = f"^{word}$" if size > 1 else word
    return [whole[i : i + size] for i in range(len(whole) - size + 1)]


@dataclass(frozen=True)
class Counts:
    """Names (words or n-grams) with a count for each language that has them: name i's are from starts[i] to starts[i + 1]."""

    names: list[str]
    starts: np.ndarray
    languages: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, languages: dict[str, int]) -> Counts:
        """From a table of language, name and count, a row for each pair."""
        codes = pa.compute.dictionary_encode(rows.column(1)).combine_chunks()
        at = codes.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(codes.dictionary))))).astype(np.int64)
        langs = np.array([languages[x] for x in rows.column(0).to_pylist()], np.int32)
        return cls(codes.dictionary.to_pylist(), starts, langs[order], rows.column(2).to_numpy().astype(np.int64)[order])

    def logs(self) -> np.ndarray:
        """What a count adds to the log of the half that every name has in every language."""
        return np.log1p(2.0 * self.counts)

    def base(self, chosen: np.ndarray, size: int) -> np.ndarray:
        """For each language, the log frequency of a name that it lacks, among the chosen names."""
        which = np.repeat(chosen, np.diff(self.starts))
        total = np.bincount(self.languages[which], self.counts[which], size)
        return np.log(0.5 / (total + 0.5 * (np.count_nonzero(chosen) + 1)))


@dataclass(frozen=True)
class Model:
    """The languages' shares of the documents learned from, and the counts of their words and n-grams."""

    languages: tuple[str, ...]
    shares: tuple[float, ...]
    words: Counts
    grams: Counts


class Scorer:
    """A model made ready on a worker. Unseen words are remembered in bounded memory."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.size = model, len(model.languages)
        size = self.size
        self.index = {w: i for i, w in enumerate(model.words.names)}
        self.known, self.most = len(self.index), max(16, remembered // (8 * max(1, size) + ENTRY))
        self.adds, self.word_base = model.words.logs(), model.words.base(np.ones(self.known, bool), size)
        self.grams = {g: i for i, g in enumerate(model.grams.names)}
        self.gram_adds = model.grams.logs()
        sizes = np.fromiter(map(len, model.grams.names), np.int64, len(self.grams))
        self.gram_base = [model.grams.base(sizes == n, size) for n in range(LONGEST + 1)]
        self.extra = np.zeros((256, size))
        self.prior = np.log(np.array(model.shares)) if size else np.zeros(0)

    def _sum(self, counts: Counts, adds: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = counts.starts[at]
        many = counts.starts[at + 1] - first
        places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(counts.languages[places], adds[places], self.size)

    def unseen(self, word: str) -> np.ndarray:
        """The mean over a word's known n-grams of the longest size that has any; zeros if not one letter is known."""
        for n in range(LONGEST, 0, -1):
            found = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if found:
                return self.gram_base[n] + self._sum(self.model.grams, self.gram_adds, np.array(found)) / len(found)
        return np.zeros(self.size)

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = words(text)
        if not self.size or not any(c.isalpha() for w in own for c in w):
            return NONE, 0.0
        fresh = [w for w in set(own) if w not in self.index]
        if len(self.index) - self.known + len(fresh) > self.most:
            self.index = {w: i for i, w in enumerate(self.model.words.names)}
            fresh = [w for w in set(own) if w not in self.index]
        total = self.prior.copy()
        if len(fresh) > self.most:  # a text with more new words than are remembered: by counts
            for w, k in Counter(own).items():
                total += k * (self.word_base + self._sum(self.model.words, self.adds, np.array([self.index[w]])) if w in self.index else self.unseen(w))
        else:
            while len(self.extra) < min(self.most, len(self.index) - self.known + len(fresh)):
                self.extra = np.concatenate((self.extra, np.zeros_like(self.extra)))
            for w in fresh:
                at = len(self.index)
                self.index[w] = at
                self.extra[at - self.known] = self.unseen(w)
            at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
            old = at < self.known
            total += np.count_nonzero(old) * self.word_base + self._sum(self.model.words, self.adds, at[old]) + self.extra[at[~old] - self.known].sum(0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == FOLD, F.lit(False))


def counted(rows: DataFrame, found: Callable[[str], Counter]) -> DataFrame:
    """lang, name, n: found(text) summed over all rows (lang, text, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            for lang, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(lang, Counter())
                for name, k in found(text).items():
                    own[name] += n * k
            for lang, counts in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "name", "n"])

    return rows.mapInArrow(run, "lang string, name string, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))


def all_grams(word: str) -> Counter:
    return Counter(g for n in range(1, LONGEST + 1) for g in grams(word, n))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from at most train_docs documents with text and language outside the held-out fold, those with the lowest hashed doc_ids.

    All words of their whole texts are counted, and all n-grams of these words; the driver gets a row
    for each pair of a language and a word or an n-gram of that sample.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    chosen = own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()
    ids = spark.createDataFrame([(r.doc_id,) for r in chosen], "doc_id long").distinct()
    some = own.join(F.broadcast(ids), "doc_id").select("lang", "text", F.lit(1).cast("long").alias("n"))
    some = written(some, texts=True, compression="zstd")
    shares = {r.lang: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spoken = written(counted(some, lambda text: Counter(words(text))))
    parts = written(counted(spoken.select("lang", "name", "n"), all_grams))
    languages, every = tuple(sorted(shares)), sum(shares.values())
    at = {x: i for i, x in enumerate(languages)}
    tables = [Counts.of(t.orderBy("name", "lang").toArrow(), at) for t in (spoken, parts)]
    dropped(some, spoken, parts)
    return Model(languages, tuple(shares[x] / every for x in languages), *tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language of the whole text and its probability.

    A text that is null or has no letter is `und` with score 0, as is every text if nothing could
    be learned. Ties go to the earlier language; very long texts are read whole. Rows stay, repeated
    ones too; other columns aren't read. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that is learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ready(sent)
        for batch in batches:
            found = [scorer(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


_ready: dict[object, Scorer] = {}


def ready(sent) -> Scorer:
    """One scorer a worker process, whatever number of tasks it runs."""
    key = sent._path or id(sent)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Scorer(sent.value)
    return _ready[key]


def op6_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = predict(docs, fit(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
