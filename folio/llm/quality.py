"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages. Each passage is encoded by a small layer over counts of its
characters and words; gated attention (tanh and sigmoid gates) weighs the passages, and the
weighted sum is scored. Only document labels are learned from, so a bad passage in a long
document is found without being marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table, written

PASSAGE_WORDS = 64
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 400_000  # of all documents learned from together
HELD_OUT = 5
LEAST = 0.3
HIDDEN, GATE = 12, 8

_CLASSES = 9


@lru_cache(maxsize=1)
def _byte_classes() -> np.ndarray:
    """Lower-case, upper-case, digit, white space, stops, loud marks, bars and bullets, other signs, non-ASCII."""
    out = np.full(256, 7, np.int64)
    out[128:] = 8
    for at, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\f\r", b".,;:'\"()-", b"!?", b"|>*=_~")):
        out[list(chars)] = at
    return out


FEATURES = _CLASSES + 7


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of the whole text; one row of zeros for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    first = np.arange(0, len(words), PASSAGE_WORDS)
    if len(first) > 1 and len(words) - first[-1] < PASSAGE_WORDS // 2:
        first = first[:-1]  # a short end belongs to the passage before it
    last = np.append(first[1:], len(words))
    out = np.zeros((len(first), FEATURES), np.float32)
    coded = _byte_classes()[np.frombuffer(line, np.uint8)]
    bag = np.repeat(np.arange(len(first)), np.append(starts[first[1:]], len(line)) - starts[first])
    counts = np.bincount(bag * _CLASSES + coded, minlength=len(first) * _CLASSES).reshape(-1, _CLASSES)
    out[:, :_CLASSES] = counts / counts.sum(1, keepdims=True)
    n = last - first
    total, square = np.add.reduceat(sizes, first), np.add.reduceat(sizes * sizes, first)
    mean = total / n
    out[:, _CLASSES] = np.log1p(n)
    out[:, _CLASSES + 1] = mean / 10
    out[:, _CLASSES + 2] = np.sqrt(np.maximum(0, square / n - mean * mean)) / 10
    out[:, _CLASSES + 3] = np.add.reduceat((sizes <= 3).astype(np.int64), first) / n
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        own = words[a:b]
        out[i, _CLASSES + 4] = len(set(own)) / len(own)
        out[i, _CLASSES + 5] = sum(map(eq, own, own[1:])) / len(own)
        out[i, _CLASSES + 6] = len(set(zip(own, own[1:], strict=False))) / max(1, len(own) - 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Model:
    """Means and scales of the features and the layers' weights; without labels, every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of documents whose passages begin at `starts`."""
        return _sigmoid(_forward(self.weights, (rows - self.mean) / self.scale, starts)["s"])


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "s": z @ w["c"] + w["c0"]}


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The layers' weights before learning."""
    return {"W": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": np.zeros(HIDDEN), "c0": np.zeros(1)}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, by all weights."""
    f = _forward(w, x, starts)
    bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
    ds = (_sigmoid(f["s"]) - y) / len(y)
    dz = ds[:, None] * w["c"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dg = de[:, None] * w["w"]
    dt, du = dg * g * (1 - t * t), dg * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * g).T @ de, "c": f["z"].T @ ds, "c0": ds.sum(keepdims=True)}


def learn(bags: list[np.ndarray], labels: np.ndarray, rounds: int = 250, rate: float = 0.03, decay: float = 1e-4, seed: int = 42) -> Model:
    """Fits all layers by full-batch Adam on the log loss of the documents' labels."""
    rows = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, FEATURES))
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    w = initial(np.random.default_rng(seed))
    if not bags:
        return Model(mean, scale, w)
    x, starts, y = ((rows - mean) / scale).astype(np.float32), np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])), labels.astype(np.float32)
    w = {k: p.astype(np.float32) for k, p in w.items()}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        grads = gradients(w, x, starts, y)
        step = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for k, p in w.items():
            d = grads[k] + decay * p
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            w[k] = p - np.float32(step) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> Model:
    """Learns labels.quality from a bounded sample of labelled documents, all passages of each.

    The sample is the documents with the lowest hashed doc_ids: at most train_docs, and no more than
    have train_passages passages together (the first one stays whatever it has). Held-out documents
    (crc32 of the doc_id as text, modulo 5, is 0) are never among them. Of a document's repeated
    labels the highest counts; null labels and null doc_ids are left out. Without labels every score
    is 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()
    if not chosen:
        return learn([], np.zeros(0))
    marked = spark.createDataFrame([(r.doc_id, r.quality) for r in chosen], "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "n", "rows"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = own.join(F.broadcast(marked), "doc_id").select("doc_id", "quality", "text")
    encoded = written(joined.mapInArrow(run, "doc_id long, quality int, n long, rows binary"))
    place, total, kept = {r.doc_id: i for i, r in enumerate(chosen)}, 0, []
    for r in sorted(encoded.groupBy("doc_id").agg(F.sum("n").alias("n")).collect(), key=lambda r: place[r.doc_id]):
        total += r.n
        if kept and total > train_passages:
            break
        kept.append(r.doc_id)
    found = sorted((r.doc_id, bytes(r.rows), r.quality) for r in encoded.where(F.col("doc_id").isin(kept)).collect())
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for _, b, _ in found]
    return learn(bags, np.array([q > 0 for _, _, q in found], np.float64))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column: the probability, from the whole text alone, that the document is good.

    Null, empty and blank texts are one passage of zeros; a long text has a passage for each 64
    words. Rows, repeated ones too, and other columns stay as they are; a column of the name given is
    replaced. An empty table gives an empty result.
    """
    def run(texts):
        import pandas as pd

        for some in texts:
            out = []
            for at in range(0, len(some), 256):
                bags = [passages(t) for t in some.iloc[at : at + 256]]
                starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
                out.append(model.score(np.concatenate(bags), starts))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    from collections.abc import Iterator as Many

    import pandas as pd

    run.__annotations__ = {"texts": Many[pd.Series], "return": Many[pd.Series]}
    return docs.withColumn(column, F.pandas_udf(run, "double")(F.col("text").cast("string")))


def accepted(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of docs whose score is at least `least`, as they are, whatever their columns' names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("item"), F.col("text").cast("string").alias("text"))
    return score(rows, model).where(F.col("score") >= least).select("item.*")


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= LEAST, 1).otherwise(0).alias("predicted"))
