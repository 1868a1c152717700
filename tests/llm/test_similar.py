"""The near-duplicate stage against the true similarity of five-word shingles of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from folio.llm import similar
from folio.llm.similar import deduplicated


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def groups(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(2))
def test_every_pair_by_true_similarity(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    common, texts = [rng.choice(words) for _ in range(30)], []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))] + common
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 35)):
                near[rng.randrange(len(near))] = "other"
            texts.append(" ".join(near))
    want = groups(texts)
    assert 60 < len(set(want)) < len(texts)
    got = deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_rows_with_repeated_and_null_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, x), (1, y), (2, y), (None, z), (None, z + " end"), (None, x + " end"), (3, None), (1, x)]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r.text or "")[:1] for r in got)
    assert texts == ["", "x", "y", "z"]
    assert {(r.doc_id, (r.text or "")[:1]) for r in got} == {(1, "x"), (1, "y"), (None, "z"), (3, "")}


def crowd(seed):
    """Texts round one long template, some of them similar to one another, some only to a few."""
    rng = random.Random(seed)
    base, out = [f"t{i}" for i in range(60)], []
    for i in range(260):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            text[rng.randrange(60)] = f"x{rng.randrange(2000)}"
        out.append(" ".join(text[rng.randint(0, 6) : 60 - rng.randint(0, 6)]))
    return out


@pytest.mark.parametrize("hot", [20, 50_000])
def test_crowds_of_one_template(spark, monkeypatch, hot):
    """A shingle that most texts share: rows are dealt over cells and bring their parities, and no link is lost."""
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "DENSE", 5)
    texts = crowd(3)
    want = groups(texts)
    assert 10 < len(set(want)) < len(texts)
    got = deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_hot_shingles_are_dealt(spark):
    rows = [(7, i, 1, 10, 0) for i in range(300)] + [(7, 1000 + i, 1000 + i, 10, 0) for i in range(5)] + [(i, i, i, 10, 1) for i in range(100, 400)]
    df = spark.createDataFrame([(*r, None) for r in rows], "token long, node long, known long, size int, place int, odd binary")
    counts = np.zeros(similar.bucket(np.array([0])).dtype.type(1) * (1 << 16), np.int64)
    np.add.at(counts, similar.bucket(np.array([r[0] for r in rows])), 1)
    before, similar.HOT = similar.HOT, 100
    try:
        got = similar._dealt(df, counts).collect()
    finally:
        similar.HOT = before
    cells = {}
    for r in got:
        cells.setdefault(r.cell, []).append(r.node)
    own = {c: x for c, x in cells.items() if any(n < 300 for n in x) and any(n >= 1000 for n in x)}
    assert len(own) == 3 and sorted(n for x in own.values() for n in x if n < 300) == list(range(300))
    assert all(sorted(n for n in x if n >= 1000) == list(range(1000, 1005)) for x in own.values())


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 3000, int(rng.integers(0, 900)))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        x, y = (int.from_bytes(similar.parities(s), "big") for s in (a, b))
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b)) and len(similar.parities(a)) == similar.PARITIES // 8


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 1 << 16)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, 1 + len(a) // 5)):], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 5))).astype(np.uint64))))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(similar.prefix(a, counts, 0.8), similar.prefix(b, counts, 0.8)))


def test_odd_rows_and_clashing_columns(spark):
    names = ["row", "item", "key", "print", "size", "head", "m", "node", "component", "known", "best", "__kept", "__place", "__id", "__key", "none"]
    x = " ".join(f"x{i}" for i in range(60))
    rows = [(1, x), (1, x), (2, x + " more"), (3, None), (4, ""), (None, " "), (5, "one two"), (6, "ONE  two"), (7, "w " * 50_000), (8, "w " * 50_001)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", *names])
    got = deduplicated(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 7]
    assert {tuple(r)[2:] for r in got.collect()} == {tuple(range(len(names)))}
    assert deduplicated(df.limit(0)).count() == 0


def test_parities_bound_what_sets_differ_in():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 512, 513, 3000, 9000):
        base = rng.integers(0, 2**63, n, np.int64).view(np.uint64)
        for share in (0.0, 0.05, 0.5, 1.0):
            other = np.concatenate([base[int(share * n):], rng.integers(0, 2**63, int(share * n * 1.2), np.int64).view(np.uint64)])
            found = [similar.wide_parities(np.unique(x)) or similar.parities(np.unique(x)) for x in (base, other)]
            differ = similar.parities_differ(*found)
            assert differ <= len(np.setxor1d(base, other)) and differ == similar.parities_differ(*found[::-1])
            if share == 1.0 and n >= 40:
                assert differ > 0.25 * (len(base) + len(other)), "sets without common members are told apart at every size"
    assert similar.parities_differ(similar.parities(base, 4096), similar.parities(base, 1024)) == 0


def test_keys_that_repeat_are_kept_whatever_batches_they_fall_in():
    rng = np.random.default_rng(6)
    for _ in range(200):
        keys = np.sort(rng.integers(0, 30, rng.integers(0, 40)))
        batch, at = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys)))], ["token", "node"]), 0
        parts = []
        while at < len(keys):
            step = int(rng.integers(0, 5))
            parts.append(batch.slice(at, step))
            at += step
        got = [n for b in similar._repeated(iter(parts)) for n in b.column(1).to_pylist()]
        assert got == [i for i, k in enumerate(keys) if (keys == k).sum() > 1]


def test_components_of_few_and_of_many_links(spark, monkeypatch):
    from folio.llm import common

    rng = np.random.default_rng(7)
    links = [*zip(*rng.integers(0, 900, (2, 500)).tolist(), strict=True), *((i, i + 1) for i in range(2000, 2300)), (5, 5), (-3, 2001), (2001, -3)]
    edges = spark.createDataFrame(links, "a long, b long")
    label = {}

    def root(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    want = {i: root(i) for i in label}
    asked, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, **o: asked.append(1) or write(df, **o))
    for few, most in ((len(links), 1), (0, 99)):  # few links take no rounds of queries
        monkeypatch.setattr(common, "FEW_LINKS", few)
        asked.clear()
        got = common.components(edges).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want) and len(asked) <= most
    monkeypatch.setattr(common, "FEW_LINKS", 9)
    assert common.components(edges.where("a = b")).collect() == []


@pytest.mark.parametrize("n", [100, 600])
def test_a_crowd_gives_fewer_rows_than_it_has_texts(n):
    """Rows of one group's cells: not its pairs, which grow with the square of its size, but what joins the same texts."""
    rng = np.random.default_rng(8)
    crowd = np.unique(rng.integers(0, 2**63, 300, np.int64).view(np.uint64))
    odd = [similar.parities(np.append(crowd[: 290 + i % 10], np.uint64(i))) for i in range(n)]
    odd += [similar.parities(rng.integers(0, 2**63, 300, np.int64).view(np.uint64)) for _ in range(20)]  # alike to none
    known = [i if i % 3 else 0 for i in range(n + 20)]
    cells = [(cell, i, known[i], 300, place, odd[i]) for cell, place in ((5, 0), (9, 1)) for i in range(n + 20)]
    names = ["cell", "node", "known", "size", "place", "odd"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells[at : at + 333], strict=True), kinds, strict=True)], names) for at in range(0, len(cells), 333)]
    pairs = [tuple(p.values()) for b in similar._candidates(0.8)(iter(batches)) for p in b.to_pylist()]
    assert len(pairs) == n - 1 and {x for p in pairs for x in p} == set(range(n))
    first = [tuple(p.values()) for b in similar._candidates(0.8, True)(iter(batches)) for p in b.to_pylist()]
    assert 0 < len(first) < n and len({b for _, b in first}) == len(first)


@pytest.mark.parametrize("held", [900, 2_000_000])
def test_links_of_a_component_in_one_cell_or_dealt(spark, monkeypatch, held):
    monkeypatch.setattr(similar, "HELD_MEMBERS", held)
    texts = crowd(4)[:120]
    sets = [shingles(t) for t in texts]
    n = len(texts)
    known = {i: i - i % 2 for i in range(0, 20)}
    nodes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, size int")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 100)] + [(100, i) for i in range(101, n)], "a long, b long")
    got = similar.linked_within(pairs, nodes, spark.createDataFrame(list(known.items()), "node long, known long"), spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5, 0.8)
    links = [tuple(r) for r in got.collect()]
    alike = {(j, i) for i in range(n) for j in range(i) if (i < 100) == (j < 100) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert {(min(p), max(p)) for p in links} <= alike and (held == 900 or len(links) < n)

    def named(pairs):
        label = list(range(n))
        for _ in range(n):
            before = list(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    assert named([*links, *known.items()]) == named([*alike, *known.items()])
    assert 10 < len(set(named([*links, *known.items()]))) < n


def test_parities_of_a_component_join_what_they_leave_possible():
    rng, seen = np.random.default_rng(9), 0
    for _ in range(40):
        n, bases = 20, [rng.integers(0, 2**63, k, np.int64).view(np.uint64) for k in (300, 520, 1000, 1100)]
        sets = []
        for _ in range(n):
            base = bases[rng.integers(4)].copy()
            gone = int(rng.integers(0, len(base) // 5))
            sets.append(np.unique(np.append(base[gone:], rng.integers(0, 2**63, gone // 2, np.int64).view(np.uint64))))
        odd, size = [similar.wide_parities(s) or similar.parities(s) for s in sets], np.array([len(s) for s in sets])
        known, part = np.arange(n) - np.arange(n) % 3 % 2, rng.integers(0, 2, n)
        possible = [(i, j) for i in range(n) for j in range(i) if known[i] != known[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and similar.parities_differ(odd[i], odd[j]) <= (size[i] + size[j]) / 9 + 1e-9]
        seen += len(possible)
        want = similar.stars(*np.array(possible).T)

        def found(rows, across, n=n, known=known, part=part, size=size, odd=odd):
            return similar.joined_parities(rows, known[rows], part[rows], np.full(len(rows), across), size[rows], [odd[i] for i in rows], 0.8)

        whole = found(np.arange(n), False)
        assert len(whole) < n and np.array_equal(similar.stars(*np.array(whole).T), want)
        dealt = [p for i in (0, 1) for p in found(np.flatnonzero(part == i), False)] + found(np.arange(n), True)
        assert np.array_equal(similar.stars(*np.array(dealt).T), want)
    assert seen > 500
