import math
import random

import duckdb
import numpy as np
import pytest
from folio.llm import mtree
from folio.llm.mtree import SQL, op7_mtree_top_k, quantised, top_k
from pyspark.sql import functions as F


def brute(rows, wanted, k):
    """rows: (vec_id, list of int or None)."""
    good = [(i, v) for i, v in rows if i is not None and v]
    out = {}
    for q, v in {(q, tuple(v)) for q, v in wanted if q is not None and v}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -s) for s, i in found]
    return {q: x for q, x in out.items() if x}


def read(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for x in got.values():
        x.sort()
        assert [n for n, _, _ in x] == list(range(1, len(x) + 1))
    return {q: [(i, s) for _, i, s in x] for q, x in got.items()}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    want = {}
    for q, _, i, s in duckdb.sql(f"select * from ({SQL}) order by 1, 2").fetchall():
        want.setdefault(q, []).append((i, s))
    assert read(op7_mtree_top_k(spark, sf)) == want


def test_vectors_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [0.5, -0.01]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, -inf]), (20, [0.999, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (40, [0.1, 0.2])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int").select("vec_id", quantised(F.col("embedding")).alias("v"), "score")
    assert {r.vec_id: r.v for r in df.where("v is not null").collect()}[0] == [32, -1]
    clean = [(r.vec_id, r.v) for r in df.collect()]
    assert read(top_k(df, df.where("vec_id % 20 = 0"), 20)) == brute(clean, [r for r in clean if r[0] is not None and r[0] % 20 == 0], 20)
    assert top_k(df.limit(0), df.limit(0), 3).count() == 0 and top_k(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_ties_groups_and_blocks(spark, seed):
    rng = random.Random(seed)
    spread = [1, 4, 40][seed]
    rows = [(i, [rng.randint(-spread, spread) for _ in range(4)]) for i in range(500)] + [(1000 + i, [3, 1, 2, -1]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = read(top_k(df, df.where("vec_id % 20 = 0"), 7, routes=(5, 40), group_rows=60, query_block=11))
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0], 7)


def group(vectors, ids=None):
    longest = float(mtree.squares(vectors).max()) * (1 + 1e-12) + 1
    made = mtree.pages(np.arange(len(vectors)) if ids is None else ids, vectors, longest, vectors[0])
    return made, longest


def test_pages_are_skipped():
    """Clustered vectors: stored distances keep most entries from being multiplied, in the first group that a query sees too."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (25, 16))
    vectors = centres[rng.integers(0, 25, 4000)] + rng.integers(-2, 3, (4000, 16))
    made, longest = group(vectors)
    assert sum(len(p.ids) for p in made) == 4000 and max(len(p.ids) for p in made) <= 2 * mtree.PAGE_ROWS
    for p in made:
        true = mtree.between(p.vectors, p.route, longest)
        assert np.allclose(true, p.near) and p.radius == p.near[-1] and np.isclose(p.parent, mtree.between(p.route[None], vectors[0], longest)[0])
    search = mtree.Search(made, vectors[0], longest, 5)
    row, ids, scores = search(np.arange(200), vectors[:200], np.full(200, mtree.LEAST))
    for q in range(200):
        true = vectors @ vectors[q]
        want = [i for i in np.lexsort((np.arange(4000), -true)).tolist() if i != q][:5]
        assert ids[row == q].tolist() == want and scores[row == q].tolist() == true[want].tolist()
    first = search.computed
    assert first < 0.4 * 200 * 4000
    floors = np.array([scores[row == q].min() for q in range(200)])
    search.computed = 0
    search(np.arange(200), vectors[:200], floors)
    assert search.computed <= first


@pytest.mark.parametrize("high", [1 << 20, 1 << 28, 1 << 36, 1 << 62])
def test_products_are_exact(high):
    rng = random.Random(high)
    a, b = ([[rng.randint(-high, high) for _ in range(7)] for _ in range(40)] for _ in range(2))
    got = mtree.products(np.array(a, np.int64), np.array(b, np.int64))
    clip = lambda x: max(mtree.LEAST + 1, min(-mtree.LEAST - 1, x))
    assert got.tolist() == [[clip(sum(p * q for p, q in zip(x, y, strict=True))) for y in b] for x in a]


@pytest.mark.parametrize("scale", [1e9, 3e6])
def test_large_components(spark, scale):
    """Scores beyond 2^53, one apart."""
    rng = random.Random(int(scale))
    rows = [(i, [rng.choice([-1, 1]) * (scale + rng.randint(0, 3) / 64), rng.uniform(-1, 1), float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", quantised(F.col("embedding")).alias("v"))
    clean = [(r.vec_id, r.v) for r in df.collect()]
    want = brute(clean, [r for r in clean if r[0] % 20 == 0], 20)
    if scale < 1e8:
        assert read(top_k(df, df.where("vec_id % 20 = 0"), 20, routes=(3, 9), group_rows=50)) == want
    else:
        clip = lambda s: max(mtree.LEAST + 1, min(-mtree.LEAST - 1, s))
        got = read(top_k(df, df.where("vec_id % 20 = 0"), 20))
        assert {q: [s for _, s in x] for q, x in got.items()} == {q: [clip(s) for _, s in x] for q, x in want.items()}


def test_shuffle_follows_the_visits(spark):
    """Blocks of queries copy only the groups that they come to."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8, dtype=int)[i % 8] * 5000 + rng.integers(-3, 4, 8)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = read(top_k(df, df.where("vec_id % 20 = 0"), 5, routes=(16, 16), group_rows=100, query_block=5))
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_repeated_rows(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [2, 2]), (1, [2, 2]), (2, [0, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert read(top_k(df, df.where("vec_id = 0"), 3)) == {0: [(1, 6), (1, 6), (2, 2)]}
