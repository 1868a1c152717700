import random

import pytest
from folio.functions.udf import indel_ratio, tex_decoded
from folio.operators import ingest, linkage, stats
from folio.operators.library import Library, database, docs_without_refs, refs_without_docs, repeated, with_unique
from folio.sources import bibtex
from pyspark.sql import functions as F


def completion(keys, query):
    """By walking: the last key on the way from the query while only one character follows."""
    below = {k for k in keys if k.startswith(query)}
    if not below:
        return query
    at, last = query, query
    while True:
        if at in below:
            last = at
        following = {k[len(at)] for k in below if len(k) > len(at) and k.startswith(at)}
        if len(following) != 1:
            return last
        at += following.pop()


@pytest.mark.parametrize("seed", range(3))
def test_completions_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab" if seed else "abc") for _ in range(rng.randint(1, 7))) for _ in range(60)}
    asked = words | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    got = {r["query"]: r.longest for r in linkage.completions(frame(words), frame(asked)).collect()}
    assert got == {q: completion(words, q) for q in asked}
    assert {r["query"]: r.longest for r in linkage.completions(frame(words)).collect()} == {q: completion(words, q) for q in words}


def test_completion_cases(spark):
    frame = lambda *x: spark.createDataFrame([(w,) for w in x], "name string")
    one = lambda keys, q: linkage.completions(frame(*keys), frame(q)).first().longest
    assert one(["Doe, J", "Doe, John", "Doe, John K"], "Doe, J") == "Doe, John K"
    assert one(["Doe, J", "Doe, John", "Doe, John K", "Doe, Jane"], "Doe, J") == "Doe, J"
    assert one(["Doe, J"], "Roe") == "Roe"


@pytest.mark.parametrize("seed", range(3))
def test_nearest_strings(spark, seed):
    rng = random.Random(seed)
    word = lambda: "/".join("".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(2))
    known, lost = {word() for _ in range(60)}, {word() for _ in range(40)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    frame = lambda x, c: spark.createDataFrame([(w,) for w in x], f"{c} string")
    got = {r.missing: (r.distance, r["match"]) for r in linkage.nearest_strings(frame(lost, "missing"), frame(known, "known")).collect()}
    assert got == {m: min((distance(m, k), k) for k in known) for m in lost - known}
    assert linkage.nearest_strings(frame(lost, "missing"), frame(known, "known").limit(0)).count() == 0


def test_tags(spark):
    rows = spark.createDataFrame([(i, "Doe2005") for i in range(60)] + [(100, "Roe2001")], "row_id long, base string")
    got = [r.tag for r in linkage.allocate_tags(rows, "base", "row_id").orderBy("row_id").collect()]
    assert got[:3] == ["Doe2005", "Doe2005a", "Doe2005b"] and got[26:28] == ["Doe2005z", "Doe2005A"] and got[52:54] == ["Doe2005Z", "Doe200553"] and got[-1] == "Roe2001"
    have = spark.createDataFrame([("Doe2005",), ("Doe2005b",), ("Doe2005zz",)], "tag string")
    got = [r.tag for r in linkage.allocate_tags(rows, "base", "row_id", have).orderBy("row_id").collect()]
    assert got[:3] == ["Doe2005a", "Doe2005c", "Doe2005d"] and got[-1] == "Roe2001" and len(set(got)) == 61
    wanted = spark.createDataFrame([("Doe2005",), ("Moe1999",), ("a.c2000",)], "base string")
    tags = spark.createDataFrame([("Doe2005",), ("Doe2005a",), ("abc2000",)], "tag string")
    many = tags.union(spark.createDataFrame([("Doe200560",)], "tag string"))
    assert {r.base: r.next_tag for r in linkage.next_tags(wanted, many).collect()}["Doe2005"] == "Doe200561"
    assert {r.base: r.next_tag for r in linkage.next_tags(wanted, tags).collect()} == {"Doe2005": "Doe2005b", "Moe1999": "Moe1999", "a.c2000": "a.c2000"}


def test_numbering_over_ranges(spark):
    rows = [(f"p{i:03d}", None if i % 10 == 0 else i // 3) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, s long").select("path", F.timestamp_seconds("s").alias("create")).repartition(5)
    got = {r.path: r.n for r in ingest.numbered(df, rows=20).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {p: i for i, (p, _) in enumerate(order, 1)}
    assert ingest.numbered(df.limit(0)).count() == 0


def test_accents_and_names(spark):
    frame = spark.createDataFrame([("Muller",), ("Müller",), ("Mûller",), ("Øre",)], "name string")
    assert {r.name: r.canonical for r in linkage.canonical_names(frame).collect()} == {"Muller": "Müller", "Müller": "Müller", "Mûller": "Mûller", "Øre": "Øre"}
    refs = spark.createDataFrame([(1, "Doe, JKL and M{\\\"u}ller, A"), (2, "Muller, A and  Doe, JK"), (3, "SMITH-JONES, O'NEIL"), (4, "")], "row_id long, author string")
    names = linkage.author_map(refs)
    got = {r.original: r.proposed for r in names.collect()}
    assert got["Doe, JKL"] == "Doe, J. K. L." and got["Muller, A"] == "Müller, A." and got["M{\\\"u}ller, A"] == "Müller, A." and got["SMITH-JONES, O'NEIL"] == "Smith-Jones, O'Neil"
    lists = {r.row_id: r.author for r in linkage.mapped_authors(refs, names, "row_id").collect()}
    assert lists[1] == "Doe, J. K. L. and Müller, A." and lists[2].startswith("Müller, A. and Doe, J. K") and lists[4] == ""


def test_tex():
    for text, want in {r"Erd{\H o}s": "Erdős", r"G{\"o}del": "Gödel", r"G\"{o}del": "Gödel", r"\'e": "é", r"na\"{\i}ve": "naïve", r"{\c{c}}a": "ça", r"\ss{}x \o re": "ßx øre", "{A} b {{C}}": "A b C", "DOE, JOHN": "Doe, John", r"a \& b": "a & b", "plain": "plain", "{keep this}": "{keep this}"}.items():
        assert tex_decoded(text) == (want, False), text
    assert tex_decoded(r"\foo{x}")[1] and tex_decoded(None) == (None, False)


def test_ratio():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)


BIB = r"""Some preamble.
@book{one2013,
  title={The {First} Book},
  year={2013}
}

@Article{two,
 author = {M{\"o}ller, A and Doe, J},
 title     = {{Aligned {{deep}} braces}},
 journal = "Quoted, {a "b"} journal",
 year = 2014,
 abstract = {Well known,
   2K Google citations.},
 weird = {kept}
}
@misc{three, title={x}, year={1}, year={2}}
@comment without an entry
@inproceedings{four,
author={A, B and
  C, D},
title={“Quoted” – title},
year={2015},
edition={2nd}
}
"""


def test_bibtex_layouts(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB, encoding="utf-8")
    rows = bibtex.read_bibtex(spark, str(tmp_path / "a.bib")).orderBy("row_id").collect()
    assert [(r.row_id, r.type, r.tag) for r in rows] == [(1, "book", "one2013"), (2, "article", "two"), (3, "misc", "three"), (4, None, None), (5, "inproceedings", "four")]
    assert rows[0].fields == {"title": "The {First} Book", "year": "2013"}
    assert rows[1].fields["journal"] == 'Quoted, {a "b"} journal' and rows[1].fields["title"] == "{Aligned {{deep}} braces}" and rows[1].fields["year"] == "2014"
    assert rows[2].fields["year"] == "2" and rows[4].fields["author"] == "A, B and C, D" and rows[4].fields["title"] == '"Quoted" -- title'
    (tmp_path / "b.bib").write_text("@book{first, title={t}}\n@book{second, title={u}}", encoding="utf-8")
    assert [r.tag for r in bibtex.read_bibtex(spark, str(tmp_path / "b.bib")).orderBy("row_id").collect()] == ["first", "second"]
    entries = bibtex.read_bibtex(spark, str(tmp_path / "a.bib"))
    assert bibtex.failed(entries).count() == 1
    made = {r.row_id: r for r in ingest.ported(entries.where("type is not null")).collect()}
    assert made[2].author == "Möller, A. and Doe, J." and made[2].arc_citations == 2000 and made[2].tag == "Moller2014" and made[2].extra == {"weird": "kept"}
    assert made[5].edition == "Second" and made[1].tag == "NOTAGYYYY" and made[3].tag == "NOTAGYYYYa" and made[1].journal == ""


def test_bibtex_round_trip_and_errors(spark, tmp_path):
    refs = spark.createDataFrame([("book", "doe2001", "A {B} title", "2001", "P"), ("article", "roe2002", "Ü", "2002", "")], "type string, tag string, title string, year string, publisher string")
    bibtex.write_bibtex(refs, f"{tmp_path}/out", refs.columns)
    got = bibtex.read_bibtex(spark, f"{tmp_path}/out").collect()
    assert sorted((r.type, r.tag, r.fields["title"], r.fields["year"], r.fields.get("publisher")) for r in got) == [("article", "Roe2002", "{Ü}", "2002", None), ("book", "Doe2001", "{A {B} title}", "2001", "P")]
    for bad in [("book", "x", "", "2001"), ("novel", "x", "t", "2001"), ("book", "x", "t", None)]:
        with pytest.raises(Exception, match="not a valid entry"):
            bibtex.write_bibtex(spark.createDataFrame([bad], "type string, tag string, title string, year string"), f"{tmp_path}/bad", ["type", "tag", "title", "year"])


@pytest.fixture(scope="module")
def lib(spark):
    ref = spark.createDataFrame([("t1", "A, B and C, D", "T1", "J", "2020"), ("t2", "", "T2", "J", "2021"), ("t3", None, "T3", "K", "2022")], "tag string, author string, title string, journal string, year string")
    doc = spark.createDataFrame([("/p/a.pdf", "a.pdf", 5, 1), ("/p/b.pdf", "b.pdf", 6, 2), ("/p/c.pdf", "c.pdf", 7, 3)], "path string, name string, size long, mod long")
    doc = doc.withColumns({"create": F.col("mod"), "tpath": F.lit("p")})
    bridge = spark.createDataFrame([("t1", "/p/a.pdf"), ("t1", "/p/b.pdf"), ("t2", "/p/gone.pdf")], "tag string, path string")
    return Library(ref, doc, bridge)


def test_database(lib):
    db = database(lib.ref, lib.doc, lib.bridge)
    assert db.columns[:3] == ["tag", "path", "author"] and db.count() == 6
    rows = {(r.tag, r.author, r.path): (r.name, r["size"]) for r in db.collect()}
    assert rows["t1", "C, D", "/p/b.pdf"] == ("b.pdf", 6) and rows["t2", "", "/p/gone.pdf"] == (None, 0) and rows["t3", None, None] == (None, 0)


def test_orphans_agree_four_ways(lib):
    doc, bridge = lib.doc, lib.bridge
    a = {r.path for r in docs_without_refs(doc, bridge).collect()}
    b = {r.path for r in doc.select("path").exceptAll(bridge.select("path")).collect()}
    c = {r.path for r in doc.join(bridge, "path", "left").where("tag is null").collect()}
    d = {r.path for r in doc.collect()} - {r.path for r in bridge.collect()}
    assert a == b == c == d == {"/p/c.pdf"}
    assert [r.tag for r in refs_without_docs(lib.ref, bridge).collect()] == ["t3"]


def test_document_table_is_joined_only_when_it_is_named(lib, spark, tmp_path):
    lib.save(str(tmp_path))
    own = Library.load(spark, str(tmp_path), "/")
    plan = lambda text: own.query(text).df._jdf.queryExecution().toString()
    assert "/doc" not in plan("select year, -create order year") and "/doc" in plan("select year") and "/doc" in plan("recent") and "/doc" in plan("select -create where size > 1")
    assert own.query("select -create").total() == own.query("").total() == 6


def test_child_histogram(lib):
    rows = {r.measure: (r.references, r.documents) for r in stats.child_histogram(lib.ref, lib.doc, lib.bridge).collect()}
    assert rows == {"objects": (3, 3), "no children": (1, 1), "children": (2, 2), "1 child": (1, 2), "2 children": (1, 0), "3 children": (0, 0), "4+ children": (0, 0)}


def test_linked_files(lib, spark):
    refs = spark.createDataFrame([("t1", ":C\\:/p/a.pdf:pdf;x:y"), ("t2", ":C\\:/p/bb.pdf:pdf"), ("t3", "")], "tag string, file string")
    proto, wrong = linkage.file_fields(refs)
    assert {(r.tag, r.path) for r in linkage.linked_files(proto, lib.doc).collect()} == {("t1", "/p/a.pdf"), ("t2", "/p/b.pdf")}
    assert [(r.tag, r["item"]) for r in wrong.collect()] == [("t1", "x:y")]


def test_ranks_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aab"), None if i % 50 == 0 else rng.randint(0, 10**6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, g string, o long").repartition(5)
    for per_range in (100, 10**6):
        got = linkage.ranks(df, "g", "o", "place", per_range).collect()
        for g in "ab":
            own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
            assert [r.place for r in own] == list(range(len(own))) and [r.o or -1 for r in own] == sorted(r.o or -1 for r in own)


def test_tags_step_over_any_taken_slots(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["Doe2005", "Roe2001", "NOTAGYYYY"])) for i in range(400)]
    taken = {b + s for b in ("Doe2005", "Roe2001") for s in ["", "c", "d", "Z", "53", "54", "60", "070", "zz"]}
    endings = ["", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *map(str, range(53, 600))]
    want, free = {}, {b: iter([b + e for e in endings if b + e not in taken]) for b in ("Doe2005", "Roe2001", "NOTAGYYYY")}
    for i, b in rows:
        want[i] = next(free[b])
    frame, have = spark.createDataFrame(rows, "row_id long, base string").repartition(3), spark.createDataFrame([(t,) for t in taken], "tag string")
    for per_range in (50, 10**6):
        assert {r.row_id: r.tag for r in linkage.allocate_tags(frame, "base", "row_id", have, per_range=per_range).collect()} == want


def test_an_import_with_its_audits(spark):
    texts = [(1, "@book{one, title={A \\foo}, author={{\\bar}Doe, J}, year={2001}, file={:C\\:/a/x.pdf:pdf;odd}}"), (2, "@book{two, title={B}, editor={Roe, K}, year={in press}}"), (3, "no entry")]
    entries = bibtex.entries(spark.createDataFrame(texts, "row_id long, value string"))
    got = ingest.imported(entries.where("type is not null"), by_hand={"{\\bar}Doe, J": "Döe, J"})
    assert {r.original: r.tag for r in got.tags.collect()} == {"one": "Doe2001", "two": "Roein press" + "YYYY"}
    assert [tuple(r) for r in got.miscodes.collect()] == [("title", "A \\foo")]
    assert {r.proposed for r in got.authors.collect()} >= {"Döe, J."} and got.unread.first().item == "odd"
    assert [tuple(r) for r in got.links.collect()] == [("Doe2001", "/a/x.pdf")] and got.info.first().raw_entries == 2


def test_repeated_tags_are_errors(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "tag string, n int")
    assert [tuple(r) for r in repeated(rows, "tag").collect()] == [("a", 2)]
    with pytest.raises(Exception, match="tag is not unique: a"):
        with_unique(rows).collect()
    assert with_unique(rows.where("n < 3")).count() == 2


def test_documents_with_repeated_paths(spark):
    ref = spark.createDataFrame([("t", "Doe, J", "T", "J")], "tag string, author string, title string, journal string")
    doc = spark.createDataFrame([("p", "x", "2020", 1), ("p", "y", "2021", 2)], "path string, name string, `create` string, mod int")
    lib = Library(ref, doc, spark.createDataFrame([("t", "p")], "tag string, path string"))
    for some, n in ((lib, 2), (lib.checked(), 2), (Library(ref, doc.limit(1), lib.bridge).checked(), 1)):
        assert some.query("select name").df.count() == some.query("select -create").df.count() == n
