import random
import re
from collections import defaultdict

import numpy as np
import pytest
import pyarrow as pa
import xxhash
from folio.llm import simhash as module
from folio.llm.simhash import near_duplicates, op1_simhash_groups, pivot_table, simhash


def brute_print(text, size=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """prints: (doc_id, print) pairs; all pairs are compared."""
    nodes = defaultdict(list)
    for d, p in prints:
        nodes[p].append(d)
    keys = list(nodes)
    array, label = np.array(keys, np.uint64), list(range(len(keys)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(array[: i + 1] ^ array[i]) <= radius).tolist():
            label[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, k in enumerate(keys):
        least[root(i)] = min(least[root(i)], *nodes[k], 1 << 62)
    return {d: least[root(i)] for i, k in enumerate(keys) for d in nodes[k]}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(d, brute_print(t)) for d, t in texts]
    groups = brute_components(prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_groups(spark, sf).collect()}
    assert got == {d: (f"{p:016x}", groups[d]) for d, p in prints}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_cells_lose_no_pair(radius):
    rng = random.Random(radius)
    table = pivot_table(radius)
    a = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    b = a ^ np.array([sum(1 << x for x in rng.sample(range(64), rng.randint(0, radius))) for _ in a], np.uint64)
    first = table.first_combo(a ^ b)
    ca, cb = table.cells(a), table.cells(b)
    at = np.arange(len(a))
    assert (ca[at, first] == cb[at, first]).all()


def test_dense_groups_and_chains(spark):
    """Thousands of prints around a few centres share cells; the forest keeps all components."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(300):
        text = list(base) if i % 2 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == brute_components([(d, brute_print(t)) for d, t in docs], 3)


@pytest.mark.parametrize("small", [2, 512])
@pytest.mark.parametrize("radius", [3, 8])
def test_crowded_cells_over_batches(monkeypatch, radius, small):
    """Prints round a few centres, so that cells hold hundreds: the forest of all cells has the components of all pairs."""
    monkeypatch.setattr(module, "SMALL", small)
    monkeypatch.setattr(module, "HELD_ROWS", 1500)
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(120)})
    nodes = np.arange(len(prints))
    table = pivot_table(radius)
    cells = table.cells(np.array(prints, np.uint64))
    rows = sorted((int(c), int(n)) for n, own in zip(nodes, cells, strict=True) for c in own)
    flat = pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows]), pa.array([n for _, n in rows]), pa.array(np.array([prints[n] for _, n in rows], np.uint64).view(np.int64))], ["cell", "node", "print"])
    edges = [e for out in module._search(radius)(flat.slice(i, 997) for i in range(0, len(rows), 997)) for e in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    check_edges(edges, prints, radius)


@pytest.mark.parametrize("radius", [0, 3, 6, 9])
def test_split_cells_lose_no_link(radius):
    """All cells crowded: prints that share most of their blocks are found in the smaller cells."""
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    prints = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(500)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(prints))), pa.array(np.array(prints, np.uint64).view(np.int64))], ["node", "print"])
    all_cells, none = (pa.Table.from_batches(module._spread(radius, np.full(module.BUCKETS, x))([batch])) for x in (True, False))
    sizes = [max(c["counts"].as_py() for c in t.column("cell").value_counts()) for t in (all_cells, none)]
    assert sizes[0] < sizes[1] or radius != 3
    rows = all_cells.sort_by("cell").to_batches()
    edges = [e for out in module._search(radius)(rows) for e in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    check_edges(edges, prints, radius)


def test_crowded_buckets_hold_every_crowded_cell(spark):
    rng = random.Random(1)
    keys = [rng.getrandbits(63) for _ in range(20_000)] + [7] * 900 + [11] * 800
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    counts = module.bucket_counts(df, lambda batch: [batch.column(0).to_numpy()])
    assert counts.sum() == len(keys)
    full = module.crowded(counts, 500)
    assert full[module.bucket(np.array([7, 11]))].all() and full.sum() == 2


def check_edges(edges, prints, radius):
    assert all((prints[a] ^ prints[b]).bit_count() <= radius for a, b in edges)
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    assert {i: root(i) for i in range(len(label))} == brute_components(list(enumerate(prints)), radius)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "y"), (5, "one  TWO", "y"), (6, "É one", "y"), (6, "É one", "y"), (None, "one two", "z"), (7, "w " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == 4 and by[6] == 6 and by[None] == 4
    assert near_duplicates(df.limit(0)).count() == 0
