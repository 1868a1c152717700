"""Near-duplicate groups by SimHash fingerprints, searched through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import components, table, written

SEED = 42
PIVOTS = 16
KEPT = 3  # blocks of a key
SMALL = 512  # rows of a cell that are compared together with other cells'
HELD_ROWS = 1 << 16  # rows that are gathered before cells are looked into


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words, repeats included; a shorter text is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= size:
        return np.array([digest(b" ".join(parts), SEED)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(line[i:j], SEED) for i, j in cuts], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if more than half the hashes have it; zero without hashes. Signed, as Spark's long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


class PivotTable:
    """Hamming distances of fingerprints to fixed references, whole and by blocks of bits.

    The bits fall into radius + 3 blocks, so two fingerprints within the radius agree on three
    blocks at least, and there have equal distances to every reference. A cell is a choice of
    three blocks with the distances in them: such a pair shares a cell, whatever the data. In a
    cell, a pair whose distances to some reference differ by more than the radius is discarded by
    the triangle inequality, and what survives is verified.
    """

    def __init__(self, radius: int):
        self.radius, blocks = radius, radius + KEPT
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        self.masks = [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
        self.combos = list(combinations(range(blocks), KEPT))
        self.references = np.random.default_rng(SEED).integers(0, 2**64 - 1, PIVOTS, np.uint64, endpoint=True)
        sets = [sum(1 << g for g in c) for c in self.combos]
        #: For each choice, the bits outside its blocks in radius + 2 parts, of which two agree at least: by them a crowded cell is split.
        self.parts = []
        for combo in self.combos:
            rest = [x for x in range(64) if not any(edges[g] <= x < edges[g + 1] for g in combo)]
            cuts = [round(len(rest) * i / (radius + 2)) for i in range(radius + 3)]
            self.parts.append([np.uint64(sum(1 << x for x in rest[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)])
        #: For a set of agreeing blocks, the first choice inside it: each pair is looked at in one cell only.
        self.first = np.array([next((i for i, s in enumerate(sets) if s & m == s), len(sets)) for m in range(1 << blocks)], np.int32)

    def distances(self, prints: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints[:, None] ^ self.references[None, :]).astype(np.int8)

    def cells(self, prints: np.ndarray) -> np.ndarray:
        """A row of cell numbers for each fingerprint; the combination is in the lowest byte."""
        nibbles = np.uint64(4) * np.arange(PIVOTS, dtype=np.uint64)
        by_block = [(np.bitwise_count((prints[:, None] ^ self.references[None, :]) & m).astype(np.uint64) << nibbles).sum(1, dtype=np.uint64) for m in self.masks]
        out = np.empty((len(prints), len(self.combos)), np.uint64)
        for i, combo in enumerate(self.combos):
            mixed = np.full(len(prints), i + 1, np.uint64)
            for g in combo:
                mixed = (mixed ^ by_block[g]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            out[:, i] = mixed & ~np.uint64(255) | np.uint64(i)
        return out.view(np.int64)

    def split(self, combo: int, cells: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """For rows of crowded cells of one combination: a row of smaller cells' numbers, one for each choice of two parts of the other bits.

        A pair within the radius that agrees on the three blocks differs in at most `radius` of the
        radius + 2 parts, so it shares one of these cells.
        """
        nibbles = np.uint64(4) * np.arange(PIVOTS, dtype=np.uint64)
        by_part = [(np.bitwise_count((prints[:, None] ^ self.references[None, :]) & m).astype(np.uint64) << nibbles).sum(1, dtype=np.uint64) for m in self.parts[combo]]
        chosen = list(combinations(range(len(by_part)), 2))
        out = np.empty((len(prints), len(chosen)), np.uint64)
        for k, two in enumerate(chosen):
            mixed = cells.view(np.uint64) ^ np.uint64(k + 1)
            for g in two:
                mixed = (mixed ^ by_part[g]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            out[:, k] = mixed & ~np.uint64(255) | np.uint64(combo)
        return out.view(np.int64)

    def first_combo(self, differing: np.ndarray) -> np.ndarray:
        agree = np.zeros(differing.shape, np.int64)
        for g, m in enumerate(self.masks):
            agree |= ((differing & m) == 0).astype(np.int64) << g
        return self.first[agree]

    def linked(self, combo: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the links of one cell, as pairs of positions.

        Rows are in order of their distance to the first reference, so partners are in a window;
        each row leaves the search when it is reached, so memory and links stay linear in the cell.
        """
        table = self.distances(prints)
        order = np.argsort(table[:, 0], kind="stable")
        prints, table = prints[order], table[order]
        free, found = np.ones(len(prints), bool), []
        for root in range(len(prints)):
            if not free[root]:
                continue
            free[root], stack = False, [root]
            while stack:
                x = stack.pop()
                lo, hi = np.searchsorted(table[:, 0], [table[x, 0] - self.radius, table[x, 0] + self.radius + 1])
                near = lo + np.flatnonzero(free[lo:hi])
                near = near[np.abs(table[near] - table[x]).max(1, initial=0) <= self.radius]
                near = near[self.confirmed(combo, prints[near] ^ prints[x])]
                free[near] = False
                stack += near.tolist()
                found += [(order[x], order[y]) for y in near]
        return found

    def pairs(self, cells: np.ndarray, prints: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of rows in many cells at once; left: how many rows of its cell come after a row.

        All rows are compared with the next of their cells, then with the next but one, and so on.
        """
        table, found = self.distances(prints), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        rows, lag = np.flatnonzero(left > 0), 1
        while len(rows):
            for at in range(0, len(rows), 1 << 16):
                x = rows[at : at + (1 << 16)]
                x = x[np.abs(table[x] - table[x + lag]).max(1) <= self.radius]
                x = x[self.confirmed((cells[x] & 255).astype(np.int32), prints[x] ^ prints[x + lag])]
                found.append((x, x + lag))
            lag += 1
            rows = rows[left[rows] >= lag]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def confirmed(self, combo, differing: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(differing) <= self.radius) & (self.first_combo(differing) == combo)


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Those of the pairs that join what the ones before them haven't."""
    label: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := label.get(i, i)) != i:
            label[i] = i = label.get(up, up)
        return i

    kept_a, kept_b = [], []
    for x, y in zip(a, b, strict=True):
        i, j = root(x), root(y)
        if i != j:
            label[i] = j
            kept_a.append(x)
            kept_b.append(y)
    return kept_a, kept_b


@lru_cache(maxsize=8)
def pivot_table(radius: int) -> PivotTable:
    return PivotTable(radius)


BUCKETS = 1 << 16
CROWD = 4096


def bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def bucket_counts(rows: DataFrame, keys) -> np.ndarray:
    """How often the keys of all rows fall in each of 65,536 buckets; keys(batch) gives a batch's as long numbers. The driver sees one number a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for some in keys(batch):
                total += np.bincount(bucket(some), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    counted = rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out


def crowded(counts: np.ndarray, most: int) -> np.ndarray:
    """The buckets that have `most` rows more than usual: whatever key has so many rows is in one of them."""
    return counts > np.median(counts) + most


def _cells(radius: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        prints = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(prints), 8192):
            yield pivot_table(radius).cells(prints[at : at + 8192].view(np.uint64)).ravel()
    return keys


def _spread(radius: int, crowds: np.ndarray):
    """A row for each cell of each fingerprint; cells in a crowded bucket are split, whatever row they come from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pivot_table(radius)
        for batch in batches:
            nodes, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(nodes), 4096):
                part, own = prints[at : at + 4096].astype(np.int64), nodes[at : at + 4096].astype(np.int64)
                cells = pivots.cells(part.view(np.uint64))
                flat, row = cells.ravel(), np.repeat(np.arange(len(part)), cells.shape[1])
                full = crowds[bucket(flat)]
                out, rows = [flat[~full]], [row[~full]]
                for combo in np.unique(flat[full] & 255).tolist():
                    some = np.flatnonzero(full & ((flat & 255) == combo))
                    smaller = pivots.split(combo, flat[some], part.view(np.uint64)[row[some]])
                    out.append(smaller.ravel())
                    rows.append(np.repeat(row[some], smaller.shape[1]))
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(own[rows]), pa.array(part[rows])], ["cell", "node", "print"])
    return run


def _search(radius: int):
    """Links of each cell; rows arrive sorted by cell, and only the cell that is open is held."""
    def links(cells, nodes, prints) -> Iterator[pa.RecordBatch]:
        pivots = pivot_table(radius)
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(cells)])))
        left = np.repeat(starts + sizes - 1, sizes) - np.arange(len(cells))
        x, y = pivots.pairs(cells, prints, np.where(np.repeat(sizes, sizes) <= SMALL, left, 0))
        a, b = forest(x.tolist(), y.tolist())
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            for i, j in pivots.linked(int(cells[start] & 255), prints[start : start + size]):
                a.append(start + int(i))
                b.append(start + int(j))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    def columns(batch):
        cells, nodes, prints = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        return [cells, nodes, prints.view(np.uint64)]

    return _by_key(columns, links)


def _by_key(columns, made):
    """A function over batches in order of their first column: made(*columns) of stretches of about HELD_ROWS rows, no key of which goes on in the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                parts.append(columns(batch))
            if sum(len(p[0]) for p in parts) >= HELD_ROWS and parts[-1][0][-1] != parts[0][0][0]:
                held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                yield from made(*[x[:whole] for x in held])
                parts = [[x[whole:] for x in held]]
        if parts:
            yield from made(*[np.concatenate(x) for x in zip(*parts, strict=True)])
    return run


def close_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: pairs of (node, print) rows, prints distinct, within the radius: of each cell a spanning forest, so that components are those of all such pairs."""
    own = nodes.select("node", "print")
    crowds = crowded(bucket_counts(own, _cells(radius)), CROWD)
    cells = own.mapInArrow(_spread(radius, crowds), "cell long, node long, print long")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search(radius), "a long, b long")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and print (long). Null, empty and blank texts have print zero. Rows stay as they are; other columns of docs are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(shingle_hashes(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, print (long), component_id: documents whose SimHash differ in at most `radius` bits are linked.

    component_id is the smallest doc_id that links reach, the document itself included. Equal
    fingerprints are one node of the search, so a group of copies costs one row, however large. No
    pair is listed: a cell gives a spanning forest, with the same components; a cell that very many
    fingerprints share is split by further bits before it is shuffled.

    Empty texts are alike (fingerprint zero). A row with a null doc_id stays and takes the
    component of the rows with its fingerprint (null if there are none with a doc_id). Repeated
    doc_ids stay as rows; all their texts count as that document's. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    if not 0 <= radius <= 9:
        raise ValueError("radius must be from 0 to 9")
    prints = written(fingerprints(docs, size), texts=True)
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("node"))
    found = components(close_pairs(nodes.where("node is not null"), radius))
    named = nodes.join(found, "node", "left").select(F.col("print").alias("n_print"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, F.col("print") == F.col("n_print"), "left").select("doc_id", "print", "component_id")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
