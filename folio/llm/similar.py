"""Near-duplicate texts by the true similarity of their word shingles: links of close SimHash fingerprints first, then every pair that they leave apart.

Two sets with a Jaccard similarity of at least s share one of the first (1 - s) n + 1 members of
each in any common order. So what close fingerprints don't link is found by shared members of these
prefixes, rarest members first, and verified on the whole sets: no link is lost and none is guessed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, dropped, reached, released, small_batches, written
from folio.llm.simhash import _by_key, bucket, bucket_counts, close_pairs, crowded, shingle_hashes, simhash

ROUNDS, ROUND_LAGS = 2, 64
DENSE = 200  # rows of one shingle that bring their parities along
PARITIES = 1024
HOT = 50_000  # rows of one shingle that are compared in one task
HELD_PAIRS = 1 << 20  # pairs that a task gathers before it sums them up
HELD_MEMBERS = 2_000_000  # members of the sets that one task compares: 16 MB
SENT_NODES = 500_000  # numbers of texts that a join may broadcast


def prefix(members: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The members by which a set (sorted hashes) has to be looked up, rarest buckets first."""
    if not len(members):
        return members
    n = len(members) - int(np.ceil(least * len(members) - 1e-9)) + 1
    return members[np.argsort(counts[bucket(members)], kind="stable")[:n]]


def parities(members: np.ndarray, places: int = PARITIES) -> bytes:
    """Whether an odd number of a set's members falls in each of the places (a power of two): two sets differ in at least as many members as their parities differ."""
    shift = np.uint64(65 - places.bit_length())
    odd = np.bincount(((members * np.uint64(0x9FB21C651E98DF25)) >> shift).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_parities(members: np.ndarray) -> bytes | None:
    """Parities over twice to four times as many places as a set has members; None for sets that PARITIES places are enough for."""
    places = 1 << (2 * len(members) - 1).bit_length() if len(members) else 0
    return parities(members, places) if places > PARITIES else None


def parities_differ(x: bytes, y: bytes) -> int:
    """In how many places two sets' parities differ, the longer ones taken together to as few places as the shorter have."""
    x, y = sorted((np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y)), key=len)
    return int((np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1) ^ x).sum(dtype=np.int64))


def _shingles_of(words: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in batch.column(0):
            yield np.unique(shingle_hashes(text.as_py(), words))
    return keys


def _marks(size: int, words: int, least: float, sent):
    """For rows (row, text): row, print (fingerprint), key (a digest of the shingle set), the set's size, head (its prefix), odd (its parities) and wide (a large set's parities over more places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            prints, keys, sizes, heads, odd, wide = [], [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                members = np.unique(shingle_hashes(text, words))
                prints.append(simhash(shingle_hashes(text, size)))
                keys.append(xxhash.xxh3_128_digest(members.tobytes()))
                sizes.append(len(members))
                heads.append(prefix(members, counts, least).tobytes())
                odd.append(parities(members))
                wide.append(wide_parities(members))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *(pa.array(x, t) for x, t in ((keys, pa.binary()), (sizes, pa.int32()), (heads, pa.binary()), (odd, pa.binary()), (wide, pa.binary())))], ["row", "print", "key", "size", "head", "odd", "wide"])
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their first column, those whose key another row has too; one row is held back, however long a key's stretch is."""
    held, seen = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        same = keys[1:] == keys[:-1]
        keep = np.append(False, same) | np.append(same, False)
        keep[0] |= seen
        held, seen = batch.slice(len(keys) - 1), bool(keep[-1])
        yield batch.slice(0, len(keys) - 1).filter(pa.array(keep[:-1]))
    if seen:
        yield held


def _shared(nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """node, size, odd, tokens, places: each node's prefix without the shingles that no other prefix has, which make no pair.

    Shingles of hot buckets are kept unseen, so that no task gets all rows of one.
    """
    hot = nodes.sparkSession.sparkContext.broadcast(crowded(counts, HOT))  # one bit a bucket

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                heads = [np.frombuffer(x.as_py(), np.int64) for x in some.column(1)]
                many = np.array([len(h) for h in heads], np.int64)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                tokens = np.concatenate(heads)
                node = np.repeat(some.column(0).to_numpy(zero_copy_only=False), many)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(node), pa.array(place.astype(np.int32)), pa.array(hot.value[bucket(tokens)])], ["token", "node", "place", "hot"])

    entries = nodes.select("node", "head").mapInArrow(members, "token long, node long, place int, hot boolean")
    shared = entries.where("not hot").select("token", "node", "place").repartition("token").sortWithinPartitions("token").mapInArrow(_repeated, "token long, node long, place int")
    if hot.value.any():
        shared = shared.union(entries.where("hot").select("token", "node", "place"))
    lists = shared.groupBy("node").agg(F.collect_list(F.struct("token", "place")).alias("m"))
    return nodes.select("node", "size", "odd").join(lists, "node").select("node", "size", "odd", F.col("m.token").alias("tokens"), F.col("m.place").alias("places"))


def _entries(nodes: DataFrame, counts: np.ndarray, all_parities: bool) -> DataFrame:
    """token, node, known, size, place, odd: a row for each shared member of each node's prefix; the parities of all, or only for shingles of crowded buckets."""
    dense = nodes.sparkSession.sparkContext.broadcast(crowded(counts, DENSE) | all_parities)  # one bit a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                many = some.column(3).value_lengths().to_numpy(zero_copy_only=False)
                tokens, place = (some.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
                columns = [tokens, *(np.repeat(some.column(i).to_numpy(zero_copy_only=False), many) for i in range(3)), place]
                row = pa.array(np.repeat(np.arange(len(many)), many), mask=~dense.value[bucket(tokens)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), some.column(5).take(row)], ["token", "node", "known", "size", "place", "odd"])
    return nodes.select("node", "known", "size", "tokens", "places", "odd").mapInArrow(run, "token long, node long, known long, size int, place int, odd binary")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as join the same numbers: each with the smallest that it reaches."""
    nodes, least = reached(a, b)
    apart = nodes != least
    return least[apart], nodes[apart]


def least_partners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each b, its pair with the smallest a."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    first = np.append(True, b[1:] != b[:-1])
    return a[first], b[first]


def _summed_up(pairs, less):
    """pairs(batches), of which a task sends what less(a, b) leaves of all its pairs: in both uses fewer than the numbers that it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, most = [], 0, HELD_PAIRS
        for batch in pairs(batches):
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held += batch.num_rows
            if held > most:
                parts = [less(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
                held = len(parts[0][0])
                most = max(HELD_PAIRS, 2 * held)
        if held:
            a, b = less(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            for at in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (a, b)], ["a", "b"])
    return run


def _candidates(least: float, some_only: bool = False):
    """What pairs of one cell's rows sizes and places leave possible and that aren't in one group yet, as stars: the pairs' components, not the pairs.

    With some_only, each row gives its first such pair among the next ROUND_LAGS rows of a cell, and
    a task sends one pair of each text.
    Sets of the wanted similarity differ in (1 - s) / (1 + s) of their members together, and
    so do their parities at most. A pair's smaller set has the member within its first (1 - 2 s / (1 + s)) n places. In a large
    cell, a row leaves the search when a pair has reached it, and the rows of its largest group are
    compared with the others only: they are together already.
    """
    share = least / (1 + least)

    def possible(x, y, known, size, place, odd) -> np.ndarray:
        small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        overlap = np.minimum(size[x] - place[x], size[y] - place[y])
        good = (known[x] != known[y]) & (small >= least * large - 1e-9) & (overlap >= share * (size[x] + size[y]) - 1e-9)
        at = np.flatnonzero(good)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            differing = np.bitwise_count(odd[x[some]] ^ odd[y[some]]).sum(1, dtype=np.int64)
            good[some] = differing <= (1 - 2 * share) * (size[x[some]] + size[y[some]]) + 1e-9
        return good

    def across(first, last, known, size, place, odd) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A large cell: pairs that join the same rows as all its pairs do."""
        rows = np.arange(first, last)
        groups, which, counts = np.unique(known[rows], return_inverse=True, return_counts=True)
        own = which == counts.argmax()
        crowd, others = rows[own], rows[~own]
        while len(others):
            stack, others = [int(others[0])], others[1:]
            while stack:
                x, met = stack.pop(), []
                if len(others):
                    good = possible(np.full(len(others), x), others, known, size, place, odd)
                    met.append(others[good])
                    others = others[~good]
                if len(crowd) and not own[x - first]:
                    good = possible(np.full(len(crowd), x), crowd, known, size, place, odd)
                    met.append(crowd[good])
                    crowd = crowd[~good]
                if sum(map(len, met)):
                    y = np.concatenate(met)
                    yield np.full(len(y), x), y
                    stack += y.tolist()

    def made(cell, node, known, size, place, odd) -> Iterator[pa.RecordBatch]:
        early = size - place >= 2 * share * size - 1e-9  # could be the smaller one of a pair
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        ends = np.append(starts[1:], len(cell))
        sizes = ends - starts
        useful = (sizes > 1) & (np.maximum.reduceat(known, starts) != np.minimum.reduceat(known, starts)) & np.logical_or.reduceat(early, starts)
        found, held = [], 0

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        def add(x, y) -> None:
            nonlocal held
            found.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1))
            held += len(x)

        small = useful & (some_only | (sizes <= 256))
        left = np.where(np.repeat(small, sizes), np.repeat(ends - 1, sizes) - np.arange(len(cell)), 0)
        rows, lag = np.flatnonzero(left > 0), 1
        while len(rows):
            good = possible(rows, rows + lag, known, size, place, odd)
            if good.any():
                add(rows[good], rows[good] + lag)
            if held > HELD_PAIRS:
                yield out()
                found, held = [], 0
            lag += 1
            if some_only:
                rows = rows[~good] if lag <= ROUND_LAGS else rows[:0]
            rows = rows[left[rows] >= lag]
        for i in np.flatnonzero(useful & ~small).tolist():
            for x, y in across(int(starts[i]), int(ends[i]), known, size, place, odd):
                add(x, y)
                if held > HELD_PAIRS:
                    yield out()
                    found, held = [], 0
        if found:
            yield out()

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        odd, told = np.zeros((batch.num_rows, PARITIES // 64), np.uint64), batch.column(5)
        at = np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            odd[at] = np.frombuffer(b"".join(told.take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
        return [*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)), odd]

    return _summed_up(_by_key(columns, made), least_partners if some_only else stars)


def _any_hot(lists: DataFrame, counts: np.ndarray) -> bool:
    """Whether more than HOT of the prefixes have one shingle."""
    hot = crowded(counts, HOT)
    if not hot.any():
        return False
    sent = lists.sparkSession.sparkContext.broadcast(hot)  # one bit a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[sent.value[bucket(tokens)]])], ["token"])

    return lists.select("tokens").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") > HOT).limit(1).count() > 0


def _dealt(entries: DataFrame, counts: np.ndarray) -> DataFrame:
    """entries with `cell`: the shingle; where one group alone has more than HOT rows of it, that group's rows are dealt to cells of their own and the other rows go to each."""
    hot = crowded(counts, HOT)
    if not hot.any():
        return entries.withColumn("cell", F.col("token"))
    sent = entries.sparkSession.sparkContext.broadcast(hot)  # one bit a bucket

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.append_column("hot", pa.array(sent.value[bucket(tokens)]))

    marked = entries.mapInArrow(mark, "token long, node long, known long, size int, place int, odd binary, hot boolean")
    crowds = marked.where("hot").groupBy("token", "known").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    crowds = written(crowds.groupBy("token").agg(F.max(F.struct("n", "known")).alias("m")).select(F.col("token").alias("t"), F.col("m.known").alias("crowd"), F.ceil(F.col("m.n") / HOT).cast("int").alias("parts")))
    joined = marked.join(crowds, (F.col("token") == F.col("t")) & F.col("hot"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    to = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("known") == F.col("crowd"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = joined.withColumn("part", F.explode(to))
    return spread.select("token", "node", "known", "size", "place", "odd", F.when(F.col("part") == 0, F.col("token")).otherwise(F.xxhash64("token", "part")).alias("cell"))


def _tested(pairs: DataFrame, values, keep) -> DataFrame:
    """Those of the pairs (a, b) that keep(values of a, values of b) marks; values(wanted): node and value of the wanted nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(2), batch.column(3)), pa.bool_())).select([0, 1])

    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = written(values(F.broadcast(wanted) if wanted.count() <= SENT_NODES else wanted), texts=True)
    left, right = (own.select(F.col("node").alias(c), F.col("value").alias(f"m{c}")) for c in "ab")
    few = pairs.count() <= SENT_NODES
    out = written(left.join(F.broadcast(pairs) if few else pairs, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long"), texts=True)
    dropped(own, wanted)
    return out


def possibly_alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) without those whose parities differ in more places than sets of the wanted similarity may; nodes: node, size, odd, wide."""
    most = 1 - 2 * least / (1 + least)

    def keep(x: pa.StructArray, y: pa.StructArray) -> np.ndarray:
        sizes = x.field("size").to_numpy(zero_copy_only=False).astype(np.int64) + y.field("size").to_numpy(zero_copy_only=False)
        differ = [parities_differ(*both) for both in zip(x.field("odd").to_pylist(), y.field("odd").to_pylist(), strict=True)]
        return np.array(differ, np.int64) <= most * sizes + 1e-9

    return _tested(pairs, lambda wanted: nodes.join(wanted, "node", "left_semi").select("node", F.struct("size", F.coalesce("wide", "odd").alias("odd")).alias("value")), keep)


def _sets(words: int):
    """For rows (node, text): node and value, its set of shingles as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "value"])
    return run


def alike(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' shingle sets have a Jaccard similarity of at least `least`; texts: node, text."""
    def keep(left: pa.Array, right: pa.Array) -> list[bool]:
        marks = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            marks.append(shared > 0 and shared / (len(x) + len(y) - shared) >= least)
        return marks

    return _tested(pairs, lambda wanted: texts.join(wanted, "node", "left_semi").mapInArrow(_sets(words), "node long, value binary"), keep)


def joined_sets(node: np.ndarray, known: np.ndarray, part: np.ndarray, across: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of nodes of a Jaccard similarity of at least `least` that join the same groups (known) as all such pairs do, without pairs of one part that both are across: another cell has them.

    A group leaves the search when it is reached, so that a crowd of near copies costs a comparison each.
    Sets that parities leave possible are compared whole.
    """
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    odd = np.frombuffer(b"".join(parities(s) for s in sets), np.uint64).reshape(len(sets), -1)
    seen, most = np.zeros(int(flat.max(initial=-1)) + 1, bool), 1 - 2 * least / (1 + least)
    group = np.unique(known, return_inverse=True)[1].reshape(-1)
    by_group = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    rest, found = np.arange(len(sets)), []
    while len(rest):
        stack = by_group[group[rest[0]]].tolist()
        rest = rest[group[rest] != group[rest[0]]]
        while stack and len(rest):
            x = stack.pop()
            small, large = np.minimum(size[rest], size[x]), np.maximum(size[rest], size[x])
            near = rest[(small >= least * large - 1e-9) & ~(across[rest] & across[x] & (part[rest] == part[x]))]
            near = near[np.bitwise_count(odd[near] ^ odd[x]).sum(1, dtype=np.int64) <= most * (size[near] + size[x]) + 1e-9]
            if not len(near):
                continue
            own, met = flat[ends[x] - size[x] : ends[x]], set()
            seen[own] = True
            for y in near.tolist():
                if group[y] not in met:
                    shared = int(np.count_nonzero(seen[flat[ends[y] - size[y] : ends[y]]]))
                    if shared > 0 and shared / (size[x] + size[y] - shared) >= least:
                        met.add(group[y])
                        found.append((int(node[x]), int(node[y])))
                        stack += by_group[group[y]].tolist()
            seen[own] = False
            if met:
                rest = rest[~np.isin(group[rest], list(met))]
    return found


def joined_parities(node: np.ndarray, known: np.ndarray, part: np.ndarray, across: np.ndarray, size: np.ndarray, odd: list[bytes], least: float) -> list[tuple[int, int]]:
    """Pairs of nodes of different groups (known) that join the same nodes as all pairs that sizes and parities leave possible, without pairs of one part that both are across.

    Sets of possible pairs have parities over as many places, or one over twice as many as the other.
    """
    width = np.array([len(v) for v in odd], np.int64)
    full, half, at = {}, {}, np.zeros(len(odd), np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        at[rows] = np.arange(len(rows))
        full[w] = np.frombuffer(b"".join(odd[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1)
        if w // 2 in full:
            bits = (np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(odd[i], np.uint8)).reshape(-1, 2), axis=1) for i in rows.tolist())
            half[w] = np.frombuffer(b"".join(np.packbits(v).tobytes() for v in bits), np.uint64).reshape(len(rows), -1)

    def differ(x: int, rows: np.ndarray) -> np.ndarray:
        out, w = np.zeros(len(rows), np.int64), int(width[x])
        for other, own in ((w, full), (2 * w, half), (w // 2, full)):
            some = np.flatnonzero(width[rows] == other)
            if len(some):
                mine = (half if other < w else full)[w][at[x]]
                out[some] = np.bitwise_count(own[other][at[rows[some]]] ^ mine).sum(1, dtype=np.int64)
        return out

    most, rest, found = 1 - 2 * least / (1 + least), np.arange(len(odd)), []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            good = (known[rest] != known[x]) & (np.minimum(size[rest], size[x]) >= least * np.maximum(size[rest], size[x]) - 1e-9)
            good &= ~(across[rest] & across[x] & (part[rest] == part[x]))
            some = np.flatnonzero(good)
            good[some] = differ(x, rest[some]) <= most * (size[rest[some]] + size[x]) + 1e-9
            met = rest[good].tolist()
            found += [(int(node[x]), int(node[y])) for y in met]
            rest, stack = rest[~good], stack + met
    return found


def _joined_cells(joined):
    """joined(node, known, part, across, size, values) of each cell; rows (cell, node, known, part, across, size, value) in order of cells, of which the open one is held."""
    def links(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(1, 6)]
        return joined(*columns, [v.as_py() for b in held for v in b.column(6)])

    def sent(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            cells, found = batch.column(0).to_numpy(zero_copy_only=False), []
            cuts = [0, *(1 + np.flatnonzero(cells[1:] != cells[:-1])).tolist(), len(cells)] if len(cells) else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and cells[i] != cell:
                    found += links(held)
                    held = []
                cell = cells[i]
                held.append(batch.slice(i, j - i))
            if found:
                yield sent(found)
        if held:
            yield sent(links(held))
    return run


def _within(pairs: DataFrame, nodes: DataFrame, known: DataFrame, values, joined) -> DataFrame:
    """Pairs (a, b) that `joined` finds inside each component of the given pairs, whose rows are brought together.

    A component of more than HELD_MEMBERS numbers of 8 bytes is dealt into parts, and each two parts
    meet in a cell of their own. nodes: node, size, weight (8 bytes each); known: node, known (the groups
    so far); values(wanted): node and value of the wanted nodes.
    """
    clusters = written(components(pairs).join(nodes, "node"))
    wanted = clusters.select("node")
    own = written(values(F.broadcast(wanted) if wanted.count() <= SENT_NODES else wanted), texts=True)
    large = clusters.groupBy(F.col("component").alias("c")).agg(F.sum("weight").alias("n")).where(F.col("n") > HELD_MEMBERS)
    large = large.select("c", F.ceil(F.col("n") / HELD_MEMBERS).cast("int").alias("parts"))
    placed = clusters.join(known, "node", "left").join(large, F.col("component") == F.col("c"), "left").select("node", "component", F.coalesce("known", "node").alias("known"), F.col("size").cast("long").alias("size"), F.coalesce("parts", F.lit(1)).alias("parts"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.when(F.col("parts") == 1, F.col("component")).otherwise(F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")))
    placed = written(placed.select("node", cell.alias("cell"), "known", "part", (F.col("part") != F.col("other")).alias("across"), "size"))
    with small_batches(pairs.sparkSession):
        few = placed.count() <= SENT_NODES
        cells = own.join(F.broadcast(placed) if few else placed, "node").select("cell", "node", "known", "part", "across", "size", "value").repartition("cell").sortWithinPartitions("cell")
        links = written(cells.mapInArrow(_joined_cells(joined), "a long, b long"))
    dropped(clusters, own, placed)
    return links


def possible_within(pairs: DataFrame, nodes: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different groups that join the same texts as all those inside each component of the pairs that parities over as many places as large sets need leave possible; nodes: node, size, odd, wide."""
    value = F.coalesce("wide", "odd")

    def joined(*columns) -> list[tuple[int, int]]:
        return joined_parities(*columns, least)

    return _within(pairs, nodes.select("node", "size", (F.octet_length(value) / 8).alias("weight")), known, lambda wanted: nodes.join(wanted, "node", "left_semi").select("node", value.alias("value")), joined)


def linked_within(pairs: DataFrame, nodes: DataFrame, known: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) that join the same texts as all links inside each component of the pairs do: none is listed, each set goes to its component's task. nodes: node, size; texts: node, text."""
    def joined(node, known, part, across, size, values) -> list[tuple[int, int]]:
        return joined_sets(node, known, part, across, [np.frombuffer(v, np.uint64) for v in values], least)

    return _within(pairs, nodes.select("node", "size", F.col("size").alias("weight")), known, lambda wanted: texts.join(wanted, "node", "left_semi").mapInArrow(_sets(words), "node long, value binary"), joined)


def one_each(pairs: DataFrame) -> DataFrame:
    """For each b, its pair with the smallest a: as many pairs as texts, whatever their groups."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def similar_groups(docs: DataFrame, size: int = 3, radius: int = 6, likeness: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: row (a number of its own for each row of docs) and item (the row, a struct). groups: row, component.

    Rows are linked if the Jaccard similarity of their texts' sets of shingles of `words` words is at
    least `likeness`: every such pair is in one component, and no other link is made. Equal sets are
    one node, so that a crowd of copies is one row of the search; those without words are alike.
    Close SimHash fingerprints give the first links, one for each text, verified on parities first
    and then on the sets. Pairs of different groups are possible by those members of prefixes that
    others have too; they aren't listed: what they join is brought together, and its sets are compared
    in one task, or, if they are too many, part by part.
    """
    if not 0 < likeness <= 1:
        raise ValueError("likeness must be above 0 and at most 1")
    spark = docs.sparkSession
    item = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), item.alias("item")), compression="zstd")
    text = F.col("item.text").cast("string").alias("text")
    texts = rows.select(F.col("row").alias("node"), text)
    with small_batches(spark):
        counts = bucket_counts(rows.select(text), _shingles_of(words))
    sent = spark.sparkContext.broadcast(counts)
    marks = written(rows.select("row", text).mapInArrow(_marks(size, words, likeness, sent), "row long, print long, key binary, size int, head binary, odd binary, wide binary"), texts=True)
    firsts = written(marks.groupBy("key").agg(F.min("row").alias("node")))
    keys = written(marks.select("row", "key"))
    nodes = written(marks.select(F.col("row").alias("node"), "print", "size", "head", "odd", "wide").join(firsts.select("node"), "node", "left_semi"))
    dropped(marks)
    alone = nodes.groupBy("print").agg(F.min("node").alias("node"))
    close = close_pairs(alone, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = nodes.join(alone.select("print", F.col("node").alias("a")), "print").where("node <> a").select("a", F.col("node").alias("b"))
    near = written(one_each(close.union(same)))
    released(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        some = possibly_alike(pairs, nodes, likeness)
        out = alike(some, texts, words, likeness)
        dropped(some)
        return out

    seeds = verified(near)
    with small_batches(spark):
        lists = written(_shared(nodes, counts))
    released(spark)
    known = written(components(seeds).select("node", F.col("component").alias("known")))
    dropped(near)

    def candidates(known: DataFrame, some_only: bool, salt: int) -> DataFrame:
        grouped = lists.join(known, "node", "left").select("node", F.coalesce("known", "node").alias("known"), "size", "tokens", "places", "odd")
        with small_batches(spark):
            dealt = _dealt(_entries(grouped, counts, not some_only), counts).withColumn("turn", F.xxhash64("node", F.lit(salt)))
            dealt = dealt.repartition("cell").sortWithinPartitions("cell", "size", "turn").select("cell", "node", "known", "size", "place", "odd")
            return dealt.mapInArrow(_candidates(likeness, some_only), "a long, b long")

    # where a shingle is too frequent for one task, a few partners of each text first, so that a crowd of near copies is one group, which _dealt can spread
    for turn in range(ROUNDS if _any_hot(lists, counts) else 0):
        tried = written(one_each(candidates(known, True, turn)))
        released(spark)
        fresh = verified(tried)
        both = written(seeds.union(fresh))
        dropped(tried, fresh, seeds, known)
        seeds, known = both, written(components(both).select("node", F.col("component").alias("known")))
    pairs = written(candidates(known, False, ROUNDS))
    dropped(lists)
    some = possible_within(pairs, nodes, known, likeness)
    links = linked_within(some, nodes, known, texts, words, likeness)
    dropped(nodes, known, some)
    found = written(components(seeds.union(links)))
    named = firsts.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    groups = keys.join(named, "key").select("row", "component")
    dropped(pairs, seeds, links)
    return rows, groups


def deduplicated(docs: DataFrame, size: int = 3, radius: int = 6, likeness: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate group of texts: that with the smallest doc_id, null last, whatever ids repeat.

    Null, empty and blank texts are one group. Very long texts are compared whole. Other columns
    stay, whatever their names; an empty table gives an empty result.
    """
    rows, groups = similar_groups(docs, size, radius, likeness, words)
    ids = rows.select("row", F.col("item.doc_id").cast("long").alias("doc_id")).join(groups, "row")
    best = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    return rows.select("row", "item").join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select("item.*")
