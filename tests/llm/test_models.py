"""Language identification and the quality classifier: held-out accuracy, inputs, edges."""

import math
import random
import zlib

import numpy as np
import pytest
from folio.llm import language, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out_accuracy(spark):
    truth = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = language.op6_word_backoff_language(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def counts_of(counts):
    return {name: {int(x): int(c) for x, c in zip(counts.languages[a:b], counts.counts[a:b], strict=True)} for name, a, b in zip(counts.names, counts.starts, counts.starts[1:], strict=False)}


def test_language_model_counts_all_words_of_its_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, train_docs=60)
    own = [r for r in docs.collect() if r.doc_id is not None and r.lang and r.text is not None and fold(r.doc_id, 3) != 1]
    order = {r.doc_id: i for i, r in enumerate(docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect())}
    sample = sorted(own, key=lambda r: order[r.doc_id])[:60]
    want, parts = {}, {}
    for r in sample:
        x = model.languages.index(r.lang)
        for w in language.words(r.text):
            want.setdefault(w, {}).setdefault(x, 0)
            want[w][x] += 1
            for n in range(1, 6):
                for g in language.grams(w, n):
                    parts.setdefault(g, {}).setdefault(x, 0)
                    parts[g][x] += 1
    assert counts_of(model.words) == want and counts_of(model.grams) == parts


def test_language_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, train_docs=25)
    scorer, size = language.Scorer(model), len(model.languages)
    told, parts = counts_of(model.words), counts_of(model.grams)
    sums = [sum(c.get(i, 0) for c in told.values()) for i in range(size)]
    tables = {n: {g: c for g, c in parts.items() if len(g) == n} for n in range(1, 6)}
    totals = {n: [sum(c.get(i, 0) for c in t.values()) + 0.5 * (len(t) + 1) for i in range(size)] for n, t in tables.items()}

    def word(w):
        if w in told:
            return [math.log((told[w].get(i, 0) + 0.5) / (sums[i] + 0.5 * (len(told) + 1))) for i in range(size)]
        for n in range(5, 0, -1):
            found = [tables[n][g] for g in language.grams(w, n) if g in tables[n]]
            if found:
                return [sum(math.log((c.get(i, 0) + 0.5) / totals[n][i]) for c in found) / len(found) for i in range(size)]
        return [0.0] * size

    for r in docs.select("text").limit(40).collect():
        text = r.text[:4000]
        total = [math.log(s) for s in model.shares]
        for w in language.words(text):
            total = [a + b for a, b in zip(total, word(w), strict=True)]
        best = max(range(size), key=total.__getitem__)
        assert scorer(text)[0] == model.languages[best]
        assert scorer(text)[1] == pytest.approx(1 / sum(math.exp(x - total[best]) for x in total), rel=1e-6)


def test_language_reads_text_only_and_edges(spark):
    rng = random.Random(1)
    words = {"en": ["the", "house", "with"], "de": ["das", "haus", "mit"]}
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(20)), x, "s", 0.5) for i in range(60) for x in [rng.choice(["en", "de"])]]
    extra = [(100, None, "en", "s", 0.5), (101, "", "de", "s", 0.5), (102, "123 !? 45 ½²", "en", "s", 0.5), (103, "das haus", None, "s", 0.5), (None, "the house", "en", "s", 0.5), (0, "with the", "de", "s", 0.5), (104, "日本", None, "s", 0.5), (105, "das " * 50_000, "de", "s", 0.5), (106, "hausmit", None, "s", 0.5)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, score double")
    model = language.fit(df)
    got = language.predict(df, model).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is None or r.doc_id >= 100}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[103][0] == by[105][0] == by[106][0] == "de" and by[None][0] == "en" and by[104][0] in ("de", "en")
    changed = df.withColumns({"lang": F.lit("xx"), "doc_id": F.col("doc_id") + 7})
    assert sorted(r.lang_pred for r in language.predict(changed, model).collect()) == sorted(r.lang_pred for r in got)
    nothing = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"} and language.predict(df.limit(0), model).count() == 0


def test_words_are_forgotten_within_bounds():
    import pyarrow as pa

    table = lambda rows: language.Counts.of(pa.table({"lang": [r[0] for r in rows], "name": [r[1] for r in rows], "n": [r[2] for r in rows]}), {"a": 0, "b": 1})
    told = [("a", "xx", 5), ("b", "xx", 1), ("a", "yy", 2), ("b", "yy", 9)]
    parts = {}
    for lang, w, n in told:
        for g, k in language.all_grams(w).items():
            parts[lang, g] = parts.get((lang, g), 0) + n * k
    model = language.Model(("a", "b"), (0.5, 0.5), table(told), table([(x, g, n) for (x, g), n in parts.items()]))
    small, large = language.Scorer(model, remembered=0), language.Scorer(model)
    assert small.most == 16
    rng = random.Random(3)
    texts = ["xx xy", "yx yy q", "xy", "xx", *[" ".join("".join(rng.choice("xyz") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 60))) for _ in range(60)]]
    for t in texts * 2:
        a, b = small(t), large(t)
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])
        assert len(small.index) <= 2 + 16


def test_quality_held_out_accuracy(spark):
    truth = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = quality.op10_attention_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)


def forward(w, rows, mean, scale):
    """One document's score by plain sums."""
    n = lambda m: np.asarray(m, float).tolist()
    W, b, V, U, aw, c, c0 = (n(w[k]) for k in ("W", "b", "V", "U", "w", "c", "c0"))
    sig = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    hidden, energies = [], []
    for row in rows:
        x = [(v - m) / s for v, m, s in zip(row, mean, scale, strict=True)]
        h = [math.tanh(sum(x[i] * W[i][j] for i in range(len(x))) + b[j]) for j in range(len(b))]
        t = [math.tanh(sum(h[i] * V[i][j] for i in range(len(h)))) for j in range(len(aw))]
        g = [sig(sum(h[i] * U[i][j] for i in range(len(h)))) for j in range(len(aw))]
        hidden.append(h)
        energies.append(sum(a * p * q for a, p, q in zip(aw, t, g, strict=True)))
    top = max(energies)
    weights = [math.exp(e - top) for e in energies]
    z = [sum(a * h[j] for a, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(c))]
    return sig(sum(p * q for p, q in zip(z, c, strict=True)) + c0[0])


def test_quality_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels, train_docs=200)
    some = docs.orderBy(F.length("text").desc()).limit(12).union(docs.limit(60))
    got = {r.doc_id: r.score for r in quality.score(some, model).collect()}
    for r in some.collect():
        assert got[r.doc_id] == pytest.approx(forward(model.weights, quality.passages(r.text).tolist(), model.mean.tolist(), model.scale.tolist()), abs=1e-4)


def test_quality_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    bags = [rng.normal(0, 1, (n, quality.FEATURES)) for n in (1, 3, 5, 2)]
    x, starts, y = np.concatenate(bags), np.cumsum([0, 1, 3, 5]), np.array([1.0, 0.0, 1.0, 0.0])
    w = {k: v.astype(float) for k, v in quality.initial(np.random.default_rng(2)).items()}

    def loss(weights):
        s = quality._forward(weights, x, starts)["s"]
        return float(np.mean(np.log1p(np.exp(s)) - y * s))

    grads = quality.gradients(w, x, starts, y)
    for k, p in w.items():
        for at in rng.integers(0, p.size, 6).tolist():
            step = np.zeros(p.size)
            step[at] = 1e-6
            step = step.reshape(p.shape)
            slope = (loss(w | {k: p + step}) - loss(w | {k: p - step})) / 2e-6
            assert grads[k].ravel()[at] == pytest.approx(slope, abs=1e-6)


def test_quality_learns_from_all_passages_of_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i, "word " * 64 * (i % 7 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    before = quality.learn
    try:
        quality.learn = lambda bags, y, **k: seen.append(sorted(map(len, bags))) or before(bags, y, **k)
        quality.fit(docs, labels)
        quality.fit(docs, labels, train_passages=20)
        quality.fit(docs, labels, train_passages=1)
    finally:
        quality.learn = before
    whole, some, one = seen
    assert whole == sorted(i % 7 + 1 for i in range(40) if fold(i, 5)) and 0 < sum(some) <= 20 and len(one) == 1


def test_quality_gradients():
    """The fitted loss falls far below that of a constant, and a bad passage among good ones is found."""
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(1, 12), quality.FEATURES))
        if i % 3 == 0:
            bag[rng.integers(len(bag)), :3] += 6
        bags.append(bag)
        labels.append(float(i % 3 != 0))
    model = quality.learn(bags[:200], np.array(labels[:200]), rounds=300)
    starts = np.cumsum([0, *[len(b) for b in bags[200:]]])[:-1]
    s = model.score(np.concatenate(bags[200:]), starts)
    assert ((s >= 0.5) == np.array(labels[200:])).mean() > 0.93


def test_passages_cover_the_whole_text():
    text = "word " * 640 + "BAD!! " * 64
    rows = quality.passages(text)
    assert len(rows) == 11 and rows[-1, 1] > 0.4 and (rows[:-1, 1] == 0).all()
    assert quality.passages(None).tolist() == quality.passages(" \n").tolist() == [[0.0] * quality.FEATURES]
    assert len(quality.passages("x " * 100_000)) > 1500


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "a b", 9.0), (3, "x " * 100_000, 9.0)], "doc_id long, text string, quality double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1), (99, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.quality == 9.0 for r in got)
    blank = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5} and quality.score(docs.limit(0), blank).count() == 0
