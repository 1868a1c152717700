import hashlib
import random
import re

import pytest
from folio.llm import pii
from folio.llm.pii import KINDS, LABELERS, expectation_maximisation, fit, listed, masked, op9_weak_supervision_pii, personal_data, scanned
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, x):
    d = [int(c) for c in x if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if holds(k, m[0])]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        got = r.spans.split(",") if r.spans else []
        assert set(want) <= set(got)
        places = [(KINDS.index(a), int(b), int(c)) for a, b, c in (g.split(":") for g in got)]
        assert places == sorted(places) and all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(places, places[1:], strict=False))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    check(op9_weak_supervision_pii(spark, sf).collect(), texts)


def test_odd_strings(spark, tmp_path):
    rng = random.Random(1)
    pieces = ["@", ".", "a", "b-c", "1", "22", "300", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "(", ")", " ", "-", "é", "🎉", "x@y.z", "10.0.0.1", "+1 (212) 555-0100", "\n", "_", "%", "0" * 17, "user", ".com"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for i in range(1500)}
    texts |= {5000: None, 5001: "", 4999: "4-1 1-1-1 1-1-1-1-1-1-1-1-1-1-1", 5002: "a@b.c_d@e.f", 5003: "1.2.3.4.5.6.7.8.9", 5004: "9" * 50_000, 5005: "1 " * 50_000, 5006: "a" * 200_000, 5007: "a." * 50_000, 5008: "x@" + "a." * 30_000 + "a", 5009: "+1" + "(" * 50_000, 5010: "1.1.1.1 " * 3000, 5011: "a@b.cc " * 2000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op9_weak_supervision_pii(spark, str(tmp_path)).collect(), texts)


def test_method_adds_and_leaves(spark):
    good = [f"please call (212) 555-01{i:02d} or mail jane{i} (at) site{i} (dot) com, card 4111.1111.1111.1111" for i in range(30)]
    plain = [f"the version 1.2.{i} of section 12 has 1234567 entries and id 99-88" for i in range(30)]
    base = [f"mail jo{i}@mail.example.com and phone +1 (212) 555-01{i:02d}, card 4111 1111 1111 1111, from 10.1.2.{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(good + plain + base)), "doc_id long, text string")
    rows = {r.doc_id: r.s for r in personal_data(df).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert all("email:" in rows[i] and "phone:" in rows[i] for i in range(30)), rows[0]
    assert all(rows[i] == "" for i in range(30, 60)), rows[30]


def test_masking(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, 10.0.0.1!", "k"), (2, "none", "k"), (3, None, "k"), (4, "+1 (212) 555-0100", "k")], "doc_id long, text string, kind string")
    got = personal_data(df).select("doc_id", "kind", masked(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == ["é <EMAIL>, <IP>!", "none", None, "<PHONE>"]


def test_reliabilities_are_recovered():
    rng = random.Random(0)
    accuracy, counts = [0.95, 0.9, 0.8, 0.7, 0.55], {}
    for _ in range(20000):
        y = rng.random() < 0.4
        v = tuple((1 if (rng.random() < a) == y else -1) if rng.random() < 0.8 else 0 for a in accuracy)
        counts[v] = counts.get(v, 0) + 1
    _, told = expectation_maximisation(list(counts.items()))
    for a, t in zip(accuracy, told, strict=True):
        assert t[1][2] / (t[1][0] + t[1][2]) == pytest.approx(a, abs=0.03)


def test_posteriors_equal_a_plain_step():
    """The last round's posteriors, by Bayes' rule over the votes one by one."""
    rng = random.Random(6)
    counted = [(v, float(rng.randint(1, 50))) for v in {tuple(rng.choice([-1, 0, 1]) for _ in LABELERS) for _ in range(60)}]
    post, told = expectation_maximisation(counted, rounds=500)
    share = 1 + sum(n * p for (_, n), p in zip(counted, post, strict=True))
    prior = share / (2 + sum(n for _, n in counted))
    for (v, _), p in zip(counted, post, strict=True):
        yes, no = prior, 1 - prior
        for j, x in enumerate(v):
            yes, no = yes * told[j][1][x + 1], no * told[j][0][x + 1]
        assert p == pytest.approx(yes / (yes + no), abs=1e-4)
    for j in range(len(LABELERS)):
        for y in range(2):
            seen = [0.5 + (1.0 if x == (1 if y else -1) else 0.0) + sum(n * (p if y else 1 - p) for (v, n), p in zip(counted, post, strict=True) if v[j] == x) for x in (-1, 0, 1)]
            assert told[j][y] == pytest.approx([s / sum(seen) for s in seen], abs=1e-4)


def test_decisions_equal_the_classifier(spark):
    """Which added spans stay: the logistic of the weights of their votes, summed by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, f"call (212) 555-01{i:02d}, ip 10.1.2[.]{i}, mail jo{i} (at) site (dot) com or 4111.1111.1111.11{i:02d} v 1.2.3.{i}") for i in range(60)], "doc_id long, text string")
    both = docs.union(more)
    found = scanned(both, ["doc_id"])
    model = fit(found)
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in personal_data(both, model).collect()}
    decided = 0
    for r in found.collect():
        want = set()
        for c in r.found:
            v = c.votes.asDict()
            z = model.bias[c.kind] + model.lengths[c.kind][v["long"]] + sum(model.weights[c.kind][j][v[n] + 1] for j, n in enumerate(LABELERS))
            if c.base or z >= 0:
                want.add((c.kind, c.start, c.end))
            decided += not c.base
        assert got[r["item"].doc_id] == want
    assert decided > 100


def test_precision_and_recall_of_added_spans(spark):
    """Variants that the fixed patterns don't take, planted among look-alikes."""
    rng = random.Random(11)
    first = ["maria", "jo.ann", "k_lee", "peter", "zoe-x"]
    rows, planted = [], {}
    for i in range(400):
        parts, at, own = [], 0, []

        def put(x, kind=None):
            nonlocal at
            if kind:
                own.append((KINDS.index(kind), at, at + len(x)))
            parts.append(x)
            at += len(x)

        for _ in range(rng.randint(1, 4)):
            put(rng.choice(["some words here, ", "then we went on. ", "nothing to see "]))
            pick = rng.randrange(8)
            if pick == 0:
                put("contact ")
                put(f"{rng.choice(first)} (at) host{rng.randint(1, 99)} (dot) {rng.choice(['com', 'org', 'net'])}", "email")
            elif pick == 1:
                put("server ")
                put(f"{rng.randint(1, 223)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}[.]{rng.randint(1, 254)}", "ip")
            elif pick == 2:
                put("phone ")
                put(f"({rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}", "phone")
            elif pick == 3:
                put("card ")
                put("4111.1111.1111.1111", "card")
            elif pick == 4:
                put(f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}")
            elif pick == 5:
                put(f"order {rng.randint(10**6, 10**8)}")
            elif pick == 6:
                put(f"score {rng.randint(300, 999)}-{rng.randint(10, 99)}")
            else:
                put(f"mail x{i}@example.com and +1 (212) 555-{rng.randint(1000, 9999)}")
            put(". ")
        rows.append((i, "".join(parts)))
        planted[i] = set(own)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if not s.base} for r in personal_data(df).collect()}
    hit = sum(len(added[i] & planted[i]) for i in planted)
    assert hit >= 0.9 * sum(map(len, planted.values())) and hit >= 0.9 * sum(map(len, added.values()))


def test_columns_that_clash(spark):
    names = ["found", "item", "masked", "__spans", "kind", "votes"]
    df = spark.createDataFrame([(1, "mail a@b.cc", 11, *range(6)), (2, None, None, *range(6))], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    got = pii.redacted(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "mail <EMAIL>", 12, *range(6)), (2, None, None, *range(6))]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_weak_supervision_pii(spark, str(tmp_path)).count() == 0
