"""Each stage on its own input against brute force, and the whole on small tables."""

import re

import corpus_pipeline
import numpy as np
import pytest
from folio.llm import quality

from tests.llm.test_mixing import reshared
from tests.llm.test_models import forward
from tests.llm.test_pii import PATTERNS, holds
from tests.llm.test_similar import groups
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Inputs and outputs of all stages, written and read again."""
    top, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{top}/{i}")
        out.append(spark.read.parquet(f"{top}/{i}"))
    return out


def test_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_quality_rejects_by_the_score(spark, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in steps[0].collect()}
    good = {d for d, t in rows.items() if forward(model.weights, quality.passages(t).tolist(), model.mean.tolist(), model.scale.tolist()) >= 0.3}
    kept = {r.doc_id: r.text for r in steps[1].collect()}
    assert kept == {d: rows[d] for d in good}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(bad & kept.keys()) <= 0.1 * len(bad) and len(known & kept.keys()) >= 0.98 * len(known)


def test_one_of_each_group_stays(steps):
    """Groups by the true similarity of all pairs."""
    rows = sorted((r.doc_id, r.text) for r in steps[1].collect())
    want = {rows[i][0] for i in groups([t for _, t in rows])}
    assert {r.doc_id for r in steps[2].collect()} == want and len(want) < len(rows)


def test_personal_data_is_gone(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    assert before.keys() == after.keys()
    for d, r in after.items():
        text = before[d].text
        found = [m[0] for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]
        assert not any(x in r.text for x in found) and r.n_chars == len(r.text)
        if not found and "<" not in r.text:
            assert r.text == text


def test_mix_comes_near_targets(steps):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    before, taken, sizes = {r.doc_id: r for r in steps[3].collect()}, {}, {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    of = {}
    for r in steps[4].collect():
        own, whole = words(r.text), words(before[r.doc_id].text)
        assert own == whole[: len(own)] and before[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + len(own)
        of[r.doc_id] = of.get(r.doc_id, 0) + len(own)
    assert all(n <= 2 * len(words(before[d].text)) for d, n in of.items())
    names = sorted(sizes)
    want = reshared([sizes[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    assert all(abs(taken.get(s, 0) - t) <= 64 for s, t in zip(names, want, strict=True))


def test_packing_of_what_the_mix_gave(steps):
    rows, docs = steps[5].collect(), steps[4].collect()
    assert len({r.doc_id for r in docs}) < len(docs)  # repeated documents
    sizes = {}
    for r in rows:
        assert r.length > 0 and r.offset + r.length <= 1024
        sizes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sizes.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
    assert sum(sum(n for _, n in x) < 1024 for x in sizes.values()) <= 1
    single = {r.doc_id for r in docs} - {d for d in (x.doc_id for x in docs) if sum(y.doc_id == d for y in docs) > 1}
    alone = [r for r in docs if r.doc_id in single]
    ids = {r.doc_id: 0 for r in alone}
    for r in rows:
        if r.doc_id in ids:
            ids[r.doc_id] += r.length
            assert r.doc_tokens >= r.start + r.length
    assert check_packing  # the pieces themselves are held against the library in test_tokens
    assert all(ids.values())


def test_run_and_odd_rows(spark, tmp_path, steps):
    """Nulls, repeats, long texts, empty tables, and columns with the names that the stages use inside."""
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()
    names = ["__score", "score", "__spans", "spans", "found", "masked", "item", "row", "key", "component", "__kept", "__place", "__row", "__text", "__source", "__key", "index", "shard", "size", "target", "taken", "first", "whole", "words", "tie", "component_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    some = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "a b c d", "en", None, 7), (4, "mail me@x.org " + "w " * 20_000, "en", "s", 9)]
    rows = [(*r, *range(len(names))) for r in some]
    for name, own in (("odd", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{i}")
            if i < 4:
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
                assert {tuple(r)[5:] for r in docs.collect()} == ({tuple(range(len(names)))} if own else set())
        assert (docs.count() == 0) == (name == "none")
