import random
from fractions import Fraction

import duckdb
import pytest
from folio.llm.mixing import SQL, apportioned, mix, mixed, numbered, op8_sainte_lague_mix, with_targets


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, size, source_size, target, taken from ({SQL})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in op8_sainte_lague_mix(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(g[:2] == want[d][:2] and g[3] == want[d][3] and g[2] == pytest.approx(want[d][2]) for d, g in got.items())


def test_sources_come_near_their_targets(spark):
    rows = op8_sainte_lague_mix(spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for t in {r.target for r in rows}:
        mine = [r for r in rows if r.target == t]
        n = len({r.source_size for r in mine})
        assert abs(sum(r.taken for r in mine) - n * t) <= n * 64


@pytest.mark.parametrize("seed", range(8))
def test_quotas_equal_the_quotient_table(spark, seed):
    rng = random.Random(seed)
    votes = [float(rng.choice([0, 1, 5, 5, rng.random() * 100, 10**rng.randint(0, 5)])) for _ in range(rng.randint(1, 30))]
    most = [rng.randint(0, 400) for _ in votes]
    seats = rng.randint(0, 500)
    table = sorted(((-Fraction(v) / (2 * k + 1), i) for i, (v, m) in enumerate(zip(votes, most, strict=True)) if v for k in range(m)))[:seats]
    parties = spark.createDataFrame([(i // 7, i % 7, v, m) for i, (v, m) in enumerate(zip(votes, most, strict=True))], "index long, shard long, votes double, most long")
    for listed in (0, 1000):
        got = {(r["index"], r.shard): r.seats for r in apportioned(parties, seats, listed).collect()}
        assert got == {(i // 7, i % 7): sum(j == i for _, j in table) for i in range(len(votes))}


def reshared(sizes, weights, share=1.5, most=2):
    """By hand: the sources above their limits are set to them, one round after another."""
    limits, out = [most * s for s in sizes], {}
    total = min(share * sum(sizes), sum(limits))
    while True:
        open_ = [i for i in range(len(sizes)) if i not in out]
        rest, all_ = total - sum(out.values()), sum(weights[i] for i in open_)
        over = [i for i in open_ if rest / all_ * weights[i] > limits[i]]
        if not over:
            return [out[i] if i in out else rest / all_ * weights[i] for i in range(len(sizes))]
        out |= {i: limits[i] for i in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 1000], [0, 4], [7], [1, 1, 1, 1, 1, 900], [5000, 3, 2, 1, 0, 80, 80], list(range(1, 60))])
def test_targets_reshare_the_excess(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "index long, source_size long")
    got, total = with_targets(rows)
    want = reshared(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))])
    assert {r["index"]: r.target for r in got.collect()} == pytest.approx(dict(enumerate(want))) and total == pytest.approx(sum(want))


def test_sources_are_numbered_by_code_points(spark):
    names = ["b", "B", "é", "", "z", "zz", "日", None, *[f"s{i}" for i in range(200)]]
    got = numbered(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5))
    order = [r.source for r in sorted(got.collect(), key=lambda r: r["index"])]
    assert order == [*sorted(n for n in names if n is not None), None] and sorted(r["index"] for r in got.collect()) == list(range(len(names)))


def test_edges_and_reruns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["b", "B", "é", None])) for i in range(200)]
    rows += [(3, "again and again", "b"), (None, "no id", "b"), (500, None, "empty"), (501, "", "empty"), (502, "v " * 90_000, "long")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, taken string").drop("size", "taken")
    a, b = (sorted(map(str, mix(x).collect())) for x in (df, df.repartition(9)))
    assert a == b and len(a) == len(rows)
    got = mix(df).collect()
    assert all(r.taken <= 2 * r["size"] for r in got) and {r.target for r in got if r.doc_id in (500, 501)} == {0.0}
    assert mix(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    names = ["size", "target", "index", "shard", "shards", "whole", "first", "taken", "words", "__source", "__key", "__row", "__text", "__end", "source_size"]
    df = spark.createDataFrame([(1, "a b c " * 30, "s", *range(len(names)))], ["doc_id", "text", "source", *names])
    assert mix(df).collect()[0]["size"] == 90
    got = mixed(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(names)))}


def test_many_shards(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 80), "hot" if i % 3 else f"s{i % 7}") for i in range(1500)], "doc_id long, text string, source string")
    rows = mix(df, shard_words=500).collect()
    for size in {r.source_size for r in rows}:
        mine = [r for r in rows if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 32 * (size // 500 + 2)
