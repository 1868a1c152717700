import bisect
import hashlib
import random

import pytest
import xxhash
from folio.llm.common import between
from folio.llm.sketch import containment, likeness, merged, op2_scaled_sketch, shingle_sketch, whole_hash, with_next
from pyspark.sql import functions as F


def h64(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def brute_sketch(text, size=5, zeros=2):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").lower().split()] or [xxhash.xxh64_intdigest(b"", 42)]
    if len(words) < size:
        a = 0
        for w in words:
            a = h64([a, w])
        hashes = {a}
    else:
        hashes = {h64(words[i : i + size]) for i in range(len(words) - size + 1)}
    return sorted(h for h in hashes if h >> 64 - zeros == 0)


def brute_rows(docs):
    """docs: (doc_id, text) with distinct ids."""
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(nxt)
        same = lambda x, y: x.lower().split() == y.lower().split()
        like = lambda x, y, e: 1.0 if e else len({*x} & {*y}) / len({*x, *y}) if x or y else 0.0
        out[d] = (n, hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:016x}" for x in a), "".join(f"{x:016x}" for x in b), like(a, b, same(t, edited)), like(a, c, same(t, nxt)))
    return out


def read(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint.split(":")[1], r.edited_fingerprint.split(":")[1], r.near_edited, r.near_next) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert read(op2_scaled_sketch(spark, f"/root/testdata/{sf}")) == brute_rows(docs)


def test_estimate_is_near_the_truth(spark):
    rows = op2_scaled_sketch(spark, "/root/testdata/sf0.01").where("n_chars > 3000").agg(F.avg("near_edited"), F.stddev("near_edited")).first()
    assert 0.42 < rows[0] < 0.58 and rows[1] < 0.12


def test_edges(spark, tmp_path):
    rng = random.Random(3)
    docs = [(-5, None), (0, ""), (3, " \n "), (4, "a"), (9, "Één 🎉🎉 zwei drei"), (12, "x " * 40000), (1 << 40, " ".join(rng.choice("abc") for _ in range(50)))]
    spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, hash string, __range int").write.parquet(f"{tmp_path}/documents.parquet")
    assert read(op2_scaled_sketch(spark, str(tmp_path))) == brute_rows(docs)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op2_scaled_sketch(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert read(op2_scaled_sketch(spark, f"{tmp_path}/one")) == brute_rows([(7, "a b c d e f")])


def test_repeated_and_null_ids_stay_as_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None), (2, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_scaled_sketch(spark, str(tmp_path)).count() == 5


def test_next_crosses_ranges(spark):
    ids = random.Random(1).sample(range(10**6), 997)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(7)
    got = {r.doc_id: r.next_doc_id for r in with_next(df, "doc_id", ["doc_id"], "doc_id", rows=10).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 5000])
def test_bounds_are_counted(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.sample(range(-10**6, 10**6), n))
    keys = [rng.randrange(-10**6, 10**6) for _ in range(300)] + bounds[:50] + [-(10**7), 10**7, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.n for r in df.select("k", between(F.col("k"), bounds).alias("n")).collect()}
    assert got == {k: 0 if k is None else bisect.bisect_right(bounds, k) for k in keys}


def test_containment_of_unequal_documents_and_merging(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words[1000:1400]), " ".join(words), " ".join(words[:2002]), " ".join(words[1998:]))], "part string, whole string, head string, tail string")
    s = {c: shingle_sketch(F.col(c)) for c in df.columns}
    row = df.select(containment(s["part"], s["whole"]).alias("c"), (merged(s["head"], s["tail"]) == s["whole"]).alias("m"), likeness(whole_hash(F.col("part")), s["part"], whole_hash(F.col("whole")), s["whole"]).alias("j")).first()
    assert row.c == 1.0 and row.m and 0.05 < row.j < 0.15
