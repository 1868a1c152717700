"""Packing documents into windows: non-negative least squares over shallow length combinations.

Every document gives whole windows and a rest. Combinations of two or three rests that fill a
window are enumerated; their repeat counts are solved against the histogram of rests by non-negative
least squares (an active set, to convergence), rounded to the nearest within what is there, and
solved again for what rounding left, until nothing more is placed. Residuals are packed greedily:
combinations that still fit, then end to end, longest first, cut at window ends. Where each rest
goes follows from its length and its rank among rests of that length, so no task sees more than
its own documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import longs, ranges, table, written
from folio.llm.tokens import encoder, in_slices, load, vocabulary

WINDOW = 1024
COLUMNS = 40_000  # combinations that are solved at once
SENT_CUTS = 50_000  # rows of seven numbers that a join may broadcast


def combinations(counts: np.ndarray, window: int, most: int = COLUMNS) -> np.ndarray:
    """Rows of two or three lengths (0: none) that fill the window and all occur.

    All pairs, and triples a <= b <= c: all of them, or where there are more than `most`, those
    with b a step apart; each length keeps its triples with the scarcest lengths' neighbours then.
    """
    there = counts > 0
    pairs = np.arange(1, window // 2 + 1)
    pairs = pairs[there[pairs] & there[window - pairs]]
    a, b = np.divmod(np.arange((window // 3 + 1) * (window // 2 + 1)), window // 2 + 1)
    c = window - a - b
    good = (a >= 1) & (b >= a) & (c >= b) & there[a] & there[b] & there[np.clip(c, 0, window - 1)]
    triples = np.stack([a, b, c], 1)[good]
    if len(triples) > most:
        step = -(-len(triples) // most)
        triples = triples[(triples[:, 1] + triples[:, 0]) % step == 0]
    return np.concatenate([np.stack([pairs, window - pairs, 0 * pairs], 1), triples]).astype(np.int64)


def non_negative_least_squares(rows: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """x >= 0 that minimises |w (A x - counts)|, where column j of A counts the lengths of rows[j] and w are the lengths, so that tokens count; by active sets.

    Each round takes in columns of the steepest descent that share no length, solves for the columns
    taken in, and drops columns whose counts would be negative until none would. It ends when no
    column outside descends, or after `rounds`.
    """
    size, x = len(counts), np.zeros(len(rows))
    inside, weight = np.zeros(len(rows), bool), np.arange(size) / size
    target = counts * weight
    scale = max(1.0, target.max(initial=0))
    places = np.full(size, -1)
    places[np.flatnonzero(counts)] = np.arange(np.count_nonzero(counts))
    places[0] = -1

    def solved(columns: np.ndarray) -> np.ndarray:
        part = np.zeros((len(columns), places.max() + 1))
        own, at = rows[columns].ravel(), np.repeat(np.arange(len(columns)), rows.shape[1])
        np.add.at(part, (at[own > 0], places[own[own > 0]]), weight[own[own > 0]])
        aim = target[places >= 0]
        if len(columns) <= part.shape[1]:
            return np.linalg.solve(part @ part.T + 1e-9 * np.eye(len(part)), part @ aim)
        return part @ np.linalg.solve(part.T @ part + 1e-9 * np.eye(part.shape[1]), aim)

    for _ in range(rounds):
        left = target - weight * np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), size)
        descent = (left * weight)[rows].sum(1)
        descent[inside] = 0
        steep = np.argsort(-descent, kind="stable")[:4096]
        steep = steep[descent[steep] > 1e-6 * scale]
        if not len(steep):
            break
        used, taken = bytearray(size), []
        for j, own in zip(steep.tolist(), rows[steep].tolist(), strict=True):
            if not (used[own[0]] or used[own[1]] or (own[2] and used[own[2]])):
                for v in own:
                    used[v] = 1
                taken.append(j)
        inside[taken] = True
        while inside.any():
            at = np.flatnonzero(inside)
            now = solved(at)
            if now.min() >= -1e-9 * scale:
                break
            inside[at[now < 0]] = False
        x[:] = 0
        at = np.flatnonzero(inside)
        x[at] = np.maximum(0, now) if len(at) else 0
    return x


def solve(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Combinations with how often each is used, never more of a length than there is; and how many of them (the first ones) were solved for."""
    left, chosen = counts.astype(np.int64).copy(), []
    left[0] = 0

    def use(lengths: tuple[int, ...], most: int | None) -> int:
        k = min(left[v] // lengths.count(v) for v in lengths)
        k = int(k if most is None else min(k, most))
        if k > 0:
            for v in lengths:
                left[v] -= k
            chosen.append((lengths, k))
        return max(k, 0)

    least = 0.5
    while len(rows := combinations(left, window)):
        repeats = non_negative_least_squares(rows, left)
        order = np.argsort(-repeats, kind="stable")
        placed = 0
        for j in order[: np.count_nonzero(repeats >= least)].tolist():
            placed += use(tuple(v for v in rows[j].tolist() if v), int(repeats[j] + 1 - least))
        if not placed:
            if least <= 0.1:
                break
            least -= 0.2  # small counts only: what is nearest to one goes first
    solved = len(chosen)
    for a in range(window // 2, 0, -1):  # what is left of the histogram
        if left[a]:
            use((a, window - a), None)
    for a in range(window // 3, 0, -1):
        b = a
        while left[a] and b <= (window - a) // 2:
            if left[b] and left[window - a - b]:
                use((a, b, window - a - b), None)
            b += 1
    return chosen, solved


class Plan:
    """Where the rest of each length and rank goes; sequences are numbered from 0, those solved for first, then greedy ones, then the stream."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window = window
        slots: dict[int, list[tuple[int, int, int]]] = {}
        taken = np.zeros(len(counts), np.int64)
        sequence = self.solved = 0
        chosen, solved = solve(counts, window)
        for i, (lengths, repeats) in enumerate(chosen):
            offset = 0
            for v in lengths:
                slots.setdefault(v, []).append((int(taken[v]), sequence, offset))
                taken[v] += repeats
                offset += v
            sequence += repeats
            self.solved += repeats if i < solved else 0
        self.slots = {v: np.array(x, np.int64) for v, x in slots.items()}
        self.taken, self.packed = taken, sequence
        left = counts - taken
        sizes = (left * np.arange(len(counts)))[::-1]
        self.stream = (np.cumsum(sizes) - sizes)[::-1]  # longest first
        #: At most so many rests are cut: one at each window's end of the stream.
        self.cuts = int(sizes.sum()) // window
        #: Sequences that hold rests, solved for or not.
        self.sequences = sequence - (-int(sizes.sum()) // window)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each rest, and how much of it fits there: less than its length if it is cut."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for v in np.unique(lengths).tolist():
            at = np.flatnonzero((lengths == v) & (ranks < self.taken[v]))
            if v and len(at):
                table = self.slots[v]
                entry = table[np.searchsorted(table[:, 0], ranks[at], "right") - 1]
                sequence[at], offset[at] = entry[:, 1] + ranks[at] - entry[:, 0], entry[:, 2]
        at = np.flatnonzero(ranks >= self.taken[lengths])
        place = self.stream[lengths[at]] + (ranks[at] - self.taken[lengths[at]]) * lengths[at]
        sequence[at], offset[at] = self.packed + place // self.window, place % self.window
        return sequence, offset, np.minimum(lengths, self.window - offset)


def tokenised(docs: DataFrame, definition: str, end_id: int, window: int, by_word: bool = True) -> DataFrame:
    """doc_id, row, n_tokens, crcs (of each whole window), rest_crc and rest (the ids after the last whole window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, size = encoder(definition, by_word), np.array([end_id], "<u4").tobytes(), 4 * window
        for some, coded in in_slices(batches, encode):
            n, crcs, rest = [], [], []
            for ids in coded:
                ids += end
                whole = len(ids) // size * size
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + size]) for i in range(0, whole, size)])
                rest.append(ids[whole:])
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array([zlib.crc32(x) for x in rest], pa.int64()), pa.array(rest, pa.binary())], ["doc_id", "n_tokens", "crcs", "rest_crc", "rest"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, crcs array<long>, rest_crc long, rest binary").withColumn("row", F.monotonically_increasing_id())


def pack(docs: DataFrame, definition: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    Null and empty texts are their end id alone. Each row of docs is a document of its own, with
    equal doc_ids too; null doc_ids come first. Only the last sequence may have padding. The driver sees
    the histogram of rests and one row for each range of documents. A very long text is encoded
    whole, by itself; its windows are told by their checksums only. Columns of other names aren't
    read. An empty table has no pieces.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, definition, end_id, window), texts=True, compression="zstd")
    rows = tokens.select("doc_id", "row", "n_tokens", "crcs", "rest_crc")
    part = rows.withColumn("tie", F.xxhash64("row"))
    part = part.withColumns({"range": ranges(part.select("doc_id", "tie"), "doc_id", F.col("tie")), "whole": F.size("crcs").cast("long"), "rest": F.col("n_tokens") % window})
    counted = written(part.groupBy("range", "rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")))

    full, base = 0, []
    for r in counted.groupBy("range").agg(F.sum("whole").alias("n")).orderBy("range").collect():
        base += [0] * (r["range"] - len(base)) + [full]
        full += r["n"]
    counts = np.zeros(window, np.int64)
    for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        counts[r["rest"]] = r["n"]
    counts[0] = 0
    plan = Plan(counts, window)

    earlier = Window.partitionBy("rest").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.select("range", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_range = Window.partitionBy("range").orderBy("doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    alike = Window.partitionBy("range", "rest").orderBy("doc_id", "tie", "row")
    local = part.withColumns({
        "first": F.coalesce(F.sum("whole").over(in_range), F.lit(0)) + F.get(longs(base or [0]), F.col("range")),
        "place": F.row_number().over(alike).cast("long") - 1,
    })
    local = local.join(ranked, ["range", "rest"]).withColumn("rank", F.col("before") + F.col("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            places = plan.place(lengths, ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, places)], ["rest", "rank", "doc_id", "row", "n_tokens", "crcs", "rest_crc", "first", "sequence", "offset", "fits"])

    chosen = local.select("rest", "rank", "doc_id", "row", "n_tokens", "crcs", "rest_crc", "first")
    schema = "rest long, rank long, doc_id long, row long, n_tokens long, crcs array<long>, rest_crc long, first long, sequence long, offset long, fits long"
    placed = written(chosen.mapInArrow(run, schema))

    ends = F.col("n_tokens") - F.col("rest")
    zero = F.lit(0).cast("long")
    wholes = placed.select("doc_id", "n_tokens", "first", F.posexplode("crcs").alias("i", "crc")).select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        (F.col("first") + F.col("i")).alias("sequence_id"), zero.alias("offset"))
    rests = placed.where("rest > 0 and fits = rest").select(
        "doc_id", ends.alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        (F.col("sequence") + full).alias("sequence_id"), "offset")

    # what is cut: its ids are read again, in two pieces
    cut = placed.where("fits < rest").select("row", "doc_id", "n_tokens", F.col("rest").alias("size"), "sequence", "offset", "fits")
    if plan.cuts <= SENT_CUTS:
        cut = F.broadcast(cut)
    cut = tokens.select("row", "rest").join(cut, "row")
    two = F.array(
        F.struct(zero.alias("at"), F.col("fits").alias("length"), F.col("sequence").alias("sequence"), F.col("offset").alias("offset")),
        F.struct(F.col("fits").alias("at"), (F.col("size") - F.col("fits")).alias("length"), (F.col("sequence") + 1).alias("sequence"), zero.alias("offset")),
    )
    ids = F.substring(F.col("rest"), (F.col("p.at") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    cuts = cut.withColumn("p", F.explode(two)).select(
        "doc_id", (F.col("n_tokens") - F.col("size") + F.col("p.at")).alias("start"), "p.length", F.crc32(ids).alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        (F.col("p.sequence") + full).alias("sequence_id"), "p.offset")
    return wholes.union(rests).union(cuts)


def op4_nnls_packing(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None, end_id: int = 0) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), load(vocabulary_path or vocabulary("byte_bpe_50k.json")), end_id)
