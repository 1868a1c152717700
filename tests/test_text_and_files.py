import hashlib
import os
import unicodedata
from pathlib import Path

import pyarrow as pa
import pyarrow.feather
import pytest
from folio.functions import text as X
from folio.functions import udf
from folio.operators import search, stats
from folio.sources import files, pdf
from folio.streaming import watch
from folio.types import LibraryConfig
from pyspark.sql import functions as F


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names(spark):
    assert one(spark, X.spaced_initials, "Doe, JKL", "Doe, JK", "Doe, JKLM", "Doe, SJ Bob") == ["Doe, J K L", "Doe, J K", "Doe, JKLM", "Doe, S J Bob"]
    assert one(spark, X.initial_periods, "Doe, J K L", "Doe, J", "De Groot, M") == ["Doe, J. K. L.", "Doe, J.", "De Groot, M."]
    assert one(spark, X.last_name_first, "Jane Q Doe", "Doe, Jane", "", "Doe") == ["Doe, Jane Q", "Doe, Jane", "", "Doe, "]


def test_citations(spark):
    texts = ["1000 citations", "2K GS citations", "1K-2K citations", "1,000 citations", "no citations", "5k Citation", "12+ Google citations", None]
    assert one(spark, X.citations, *texts) == [1000, 2000, 1500, 1000, 0, 5000, 12, 0]


def test_accents_are_those_of_unicode(spark):
    chars = [chr(i) for i in range(0xC0, 0x900) if not unicodedata.category(chr(i)).startswith("C")] + ["é", "Ǻ", "日本", "ø", "ß"]
    want = ["".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for s in chars]
    assert one(spark, X.remove_accents, *chars) == want


def test_titles_and_years(spark):
    assert one(spark, X.looks_like_title, "123-45", "abc", "A good title", "  12 34-5 ", None, "longword", "a b") == [False, False, True, False, False, False, False]
    assert one(spark, X.first_year, "vol 12, 1999", "12345", "in 2100 or 2001", None, "1899 1900") == ["1999", None, "2001", None, "1900"]
    assert one(spark, X.clean_title, " Microsoft Word - Plan", "Presentation title", "A") == ["Plan", "", "A"]
    assert one(spark, X.joined_hyphens, "hyphen-\nated célé-\nbré a - \nb") == ["hyphenated célébré a - \nb"]
    q = lambda s: X.lookup_query(s, F.lit("On the subject"), F.lit("file-name-1999"))
    assert one(spark, q, "A title of 2004", "x", None) == ["A title of 2004 2004", "On the subject 1999", "On the subject 1999"]
    best = lambda s: X.best_title(s, F.lit("The cover title here"), F.lit("a_b_c_d.pdf"), udf.ratio(s, F.lit("The cover title here")))
    assert one(spark, best, "The cover title here!", "short", "A considerably longer metadata title") == ["The cover title here!", "The cover title here", "A considerably longer metadata title"]


def test_sizes(spark):
    got = one(spark, lambda v: X.file_size(v.cast("long")), "500", "2048", "262143", "262144", "268435456", None)
    assert got == ["500B", "2KB", "255KB", "0MB", "0GB", None]


def test_paths(spark):
    assert one(spark, lambda c: X.relative_parent(c, "/lib"), "/lib/a/b/x.pdf", "/lib/x.pdf", "/other/x.pdf") == ["a/b", "", "other"]
    assert one(spark, X.stem, "/a.b/c.d.pdf", "/a/.hidden", "x") == ["c.d", ".hidden", "x"] and one(spark, X.suffix, "/a/c.d.pdf", "x") == [".pdf", ""]


def test_udfs(spark):
    assert one(spark, udf.title_case, "SMITH-JONES, O'NEIL", None) == ["Smith-Jones, O'Neil", None]
    assert one(spark, udf.composed, "é", None) == ["é", None]
    assert one(spark, lambda c: X.moment(c.cast("long")).cast("string"), "1700000000123456789", "-1") == ["2023-11-14 22:13:20.123456", "1969-12-31 23:59:59.999999"]


def test_moments_are_exact(spark):
    values = [1_700_000_000_000_000_000 + 7_777_777_777 * i for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "ns long")
    assert df.where(F.unix_micros(X.moment(F.col("ns"))) != F.expr("ns div 1000")).count() == 0


def test_metadata_of_files(spark, tmp_path):
    made = b"%PDF-1.4\n7 0 obj\n<< /Title (Microsoft Word - A \\(good\\) title) /Author <FEFF004A0061006E0065002000440159> /Subject (S \\101) >>\nendobj\ntrailer << /Info 7 0 R >>"
    (tmp_path / "some file 2004.pdf").write_bytes(made)
    (tmp_path / "other.pdf").write_bytes(b"none")
    rows = {Path(r.path).name: r for r in pdf.read_metadata(spark, str(tmp_path)).collect()}
    first = rows["some file 2004.pdf"]
    assert (first.title, first.author, first.subject, first.query) == ("A (good) title", "Dř, Jane", "S A", "A (good) title 2004")
    assert (rows["other.pdf"].title, rows["other.pdf"].author) == ("", "")


def test_search(spark):
    df = spark.createDataFrame([("b.md", "Über x\nx and X\n\nlast x"), ("a.md", "none"), ("c.md", "x\r\n"), ("d.md", None)], "file string, text string")
    rows = [tuple(r) for r in search.search(df, "x", "file", limit=-1).orderBy("file", "line_number").collect()]
    assert rows == [("b.md", 1, "Über x", [(6, 7)], 1), ("b.md", 2, "x and X", [(0, 1)], 2), ("b.md", 4, "last x", [(5, 6)], 3), ("c.md", 1, "x", [(0, 1)], 1)]
    assert search.search(df, "x", "file", limit=2).count() == 2 and search.search(df, "X", "file").count() == 1 and search.search(df, "über", "file", ignore_case=True).count() == 1
    edge = spark.createDataFrame([("e", "end\nnext a\rb")], "file string, text string")
    gaps = spark.createDataFrame([("g", "a\n\nb")], "file string, text string")
    for pattern in (r"a\s*+$", r"(?>a\s*)$", r"a\s*$", "a$"):
        assert search.search(gaps, pattern, "file").count() == 1, pattern
    for pattern, n in ((r"end(?!\s)", 1), (r"\Anext", 1), ("^next", 1), ("d$", 1), ("ab", 1), ("end.next", 0)):
        assert search.search(edge, pattern, "file").count() == n, pattern
    got = search.search(df, "and", "file", context=True).first()
    assert (got.before, got.after, got.submatches) == ("Über x", "", [(2, 5)])
    assert [(r.line_number, r.absolute_offset) for r in search.offsets(df.where("file = 'b.md'"), "file").orderBy("line_number").collect()] == [(1, 0), (2, 8), (3, 16), (4, 17)]
    assert one(spark, lambda c: search.tidy_name(c, "/t", "pdftotext"), "/t/a/b.pdf.pdftotext.md") == ["a/b.pdf"]


def test_statistics_edges(spark):
    df = spark.createDataFrame([("a", "", 0), ("a", None, 3), (None, "", 0)], "x string, y string, arc_citations int")
    assert {r.field: (r.distinct, r.missing) for r in stats.field_profile(df).collect()} == {"x": (1, 0), "y": (1, 2), "arc_citations": (2, 2)}
    assert {r.field: r.distinct for r in stats.field_profile(df, approximate=True).collect()} == {"x": 1, "y": 1, "arc_citations": 2}
    assert {r.column: (r.nonna, r.distinct) for r in stats.contents(df).collect()} == {"x": (2, 1), "y": (2, 1), "arc_citations": (3, 2)}
    assert stats.value_counts(df, "nope") is None and [tuple(r) for r in stats.value_counts(df, "x").collect()] == [("a", 2)]
    assert [r.y for r in stats.distinct_values(df, "y").collect()] == []
    got = stats.row_means(spark.createDataFrame([("1-3",), ("x",), (None,), ("4",)], "p string"), "p").collect()
    assert [r["mean"] for r in got] == [2.0, None, None, 4.0]


@pytest.fixture
def folder(tmp_path):
    for i, name in enumerate(["a.pdf", "sub/b c.pdf", "sub/note.txt"]):
        p = tmp_path / "docs" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (i + 1))
    return str(tmp_path / "docs")


def test_listing(spark, folder):
    rows = {r.name: r for r in files.with_stats(files.list_documents(spark, folder)).collect()}
    assert set(rows) == {"a.pdf", "b c.pdf"} and rows["a.pdf"]["size"] == 1 and rows["b c.pdf"].tpath == "sub" and rows["b c.pdf"].suffix == ".pdf"
    assert rows["a.pdf"].node == os.stat(f"{folder}/a.pdf").st_ino and rows["a.pdf"].links == 1
    assert files.list_documents(spark, folder, recursive=False).count() == 1
    hashes = {Path(r.path).name: r.hash for r in files.content_hashes(spark, folder).collect()}
    assert len(hashes["a.pdf"]) == 128 and hashes["a.pdf"] != hashes["b c.pdf"]
    docs = files.list_documents(spark, folder)
    texts = spark.createDataFrame([(f"/t{folder}/a.pdf.pdftotext.md",)], "path string")
    assert [r.name for r in files.missing_texts(docs, texts, "/t", "pdftotext").collect()] == ["b c.pdf"]


def test_new_documents_and_extraction(spark, folder, tmp_path):
    os.utime(f"{folder}/a.pdf")
    rows = files.new_documents(spark, folder).collect()
    assert sorted(r.n for r in rows) == [1, 2] and {r.name for r in rows} == {"a.pdf", "b c.pdf"}
    Path(f"{folder}/a.pdf").write_bytes("hyphen-\r\nated é".encode())
    texts = files.extract_texts(files.list_documents(spark, folder), command=("cat", "{path}"))
    assert {Path(r.path).name: r.text for r in texts.collect()} == {"a.pdf": "hyphenated é", "b c.pdf": "xx"}
    gone = files.extract_texts(files.list_documents(spark, folder), command=("no-such-program", "{path}")).collect()
    assert all(r.text is None and "no-such-program" in r.error for r in gone)
    files.write_texts(texts, f"{tmp_path}/texts")
    assert spark.read.parquet(f"{tmp_path}/texts").count() == 2


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    for more in ("", "c.pdf"):
        if more:
            (Path(folder) / more).write_bytes(b"yyyy")
        run = watch.append_new(spark, folder, f"{tmp_path}/table", f"{tmp_path}/state")
        run.awaitTermination(60)
    rows = spark.read.parquet(f"{tmp_path}/table")
    assert sorted(r.name for r in rows.collect()) == ["a.pdf", "b c.pdf", "c.pdf"]
    assert watch.daily_counts(rows).agg(F.sum("bytes")).first()[0] == 7


def test_feather_audit_and_settings(spark, tmp_path):
    pyarrow.feather.write_feather(pa.table({"tag": ["a", "b"], "n": [1, None]}), f"{tmp_path}/x.feather", compression="uncompressed")
    files.convert_feather(f"{tmp_path}/x.feather", f"{tmp_path}/x.parquet")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/x.parquet").collect()] == [("a", 1), ("b", None)]
    files.write_audit(spark.createDataFrame([("é",)], "x string"), f"{tmp_path}/a.csv")
    assert Path(f"{tmp_path}/a.csv").read_bytes().startswith(b"\xef\xbb\xbfx")
    with pytest.raises(ValueError):
        files.write_audit(spark.range(5).toDF("x"), f"{tmp_path}/b.csv", most=4)
    config = LibraryConfig("books", pdf_dir="/p")
    config.save(f"{tmp_path}/libs/books")
    config.save(f"{tmp_path}/libs/books")
    assert LibraryConfig.load(f"{tmp_path}/libs/books") == config and (tmp_path / "libs/books/config.json.bak").exists()
    assert files.list_libraries(spark, f"{tmp_path}/libs").first().name == "books"
    (tmp_path / "old.yaml").write_text("name: old\ndescription: d\npdf_dir_name: /q\nother: 1\n")
    assert tuple(files.list_libraries(spark, str(tmp_path), "*.yaml").first())[:3] == ("old", "d", "/q")
    texts = files.extract_texts(spark.createDataFrame([(f"{tmp_path}/old.yaml",)], "path string"), command=("cat", "{path}"))
    assert texts.first().text.startswith("name: old")
    both = files.compare_texts(texts.select("path"), ("cat", "{path}"), ("tac", "{path}")).first()
    assert both["first"] != both["second"] and both.same is False


def test_hashes_of_contents_in_parts(spark, folder):
    contents = {"b": b"\n", "c": b"x", "d": b"x\ny\r\n\n", "e": files.MARK, "f": files.MARK + b"z\n", "g": b"\n" + files.MARK, "h": bytes(range(256)) * 50_000, "i": os.urandom(3_000_000), "j.gz": b"no gzip\n", "k l%20": b"\xff\n"}
    for name, data in contents.items():
        Path(f"{folder}/sub/{name}.bin").write_bytes(data) if "gz" not in name else Path(f"{folder}/sub/{name}").write_bytes(data)
    want = {n if "gz" in n else f"{n}.bin": hashlib.blake2b(d).hexdigest() for n, d in contents.items()}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.parts.link./in", f"file://{folder}")
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # no longer file's contents may be one value
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        for at in (folder, "viewfs://parts/in"):
            found = files.content_hashes(spark, at, "*.{bin,gz}").collect()
            assert {Path(r.path).name: r.hash for r in found} == want and len(found) == len(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
