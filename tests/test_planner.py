from datetime import datetime

import pytest
from folio.plans.planner import java_pattern, query
from folio.types import QueryError, QueryTable


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("a1", "WÜTHRICH, Mario", "{A} {{title}}", "J1", "2020", 5, 1.5, datetime(2024, 5, 13, 10, 30), "", None),
        ("a2", "wang, r", "B", "J2", "2019", 0, 2.5, datetime(2024, 6, 1), "", None),
        ("a3", "Doe, J", "C", None, "2021", 7, None, None, "", None),
        ("a4", None, "D", "J1", "2020", 9, 0.5, datetime(2023, 1, 2), "", None),
    ]
    df = spark.createDataFrame(rows, "tag string, author string, title string, journal string, year string, arc_citations long, weight double, mod timestamp_ntz, blank string, nothing string")
    return QueryTable(df, ("tag", "author", "title", "absent"), "author", "mod", ("tag",))


def tags(table, text, **options):
    return [r.tag for r in query(table, text, **options).df.collect()]


def test_columns(table):
    columns = lambda text: query(table, text).df.columns
    assert columns("") == ["tag", "author", "title"]
    assert columns("select journal, year, journal, tag, none") == ["tag", "author", "title", "journal", "year"]
    assert columns("select *, -blank, -nothing, -mod") == ["tag", "author", "title", "journal", "year", "arc_citations", "weight"]
    assert columns("select year, *") == ["tag", "author", "title", "year"]
    assert columns("recent") == ["mod", "tag", "author", "title"]
    assert columns("select arc-citations, -author") == ["tag", "title", "arc_citations"]


def test_regex_ignores_case_in_any_script_and_null_never_matches(table):
    assert tags(table, "! wüthrich") == ["a1"]
    assert tags(table, "author ~ /nan|none|null/") == []
    assert tags(table, "journal ~ .") == ["a1", "a2", "a4"]
    assert tags(table, "arc-citations ~ ^[57]$") == ["a1", "a3"]
    assert tags(table, r"author ~ /^\w+, \w/ and year ~ 20$") == ["a1"]


def test_invalid_regex_is_left_out_with_a_message(table):
    got = query(table, "! /(/ and journal ~ J2")
    assert [r.tag for r in got.df.collect()] == ["a2"] and len(got.messages) == 1
    assert len(query(table, "! /(?<=a+)b/").messages) == 1  # no such lookbehind


def test_unknown_names(table):
    for text in ("nope ~ x", "where nope == 1", "order nope", "where mod.dt.nope == 1"):
        with pytest.raises(QueryError):
            query(table, text)


def test_literals_follow_the_columns_type(table):
    assert tags(table, "where year == 2020") == tags(table, 'where year == "2020"') == ["a1", "a4"]
    assert tags(table, "where year >= 2020 order year") == ["a1", "a4", "a3"]
    assert tags(table, 'where arc-citations > "4" and weight < 2') == ["a1", "a4"]
    assert tags(table, "where weight >= 1.5") == ["a1", "a2"]
    for text, want in {"2024": ["a1", "a2"], "2024-06": ["a2"], "2024-05-14": ["a2"], "2024-05-13 10:30": ["a1", "a2"], '"2024-05-13 10:31"': ["a2"]}.items():
        assert sorted(tags(table, f"where mod >= {text}")) == want
    assert tags(table, "where mod.dt.day == 13") == ["a1"] and tags(table, "where mod.dt.weekday == 0 order tag") == ["a1", "a4"]
    for text in ("where mod > 05-13", "where mod > 10:30", "where weight > abc"):
        with pytest.raises(QueryError):
            query(table, text)


def test_order(table):
    assert tags(table, "order weight") == ["a4", "a1", "a2", "a3"]
    assert tags(table, "order -weight") == ["a2", "a1", "a4", "a3"]
    assert tags(table, "order -year, -tag") == ["a3", "a4", "a1", "a2"]
    assert tags(table, "order tag recent") == ["a2", "a1", "a4", "a3"]
    assert tags(table, "order year") == ["a2", "a1", "a4", "a3"]  # ties by key


def test_top_and_counts(table):
    assert tags(table, "top 2") == ["a1", "a2"]
    for n in (0, -5):
        assert len(tags(table, f"top {n}")) == 4
    got = query(table, "top 2 where year >= 2020")
    assert got.total() == 3 and got.caption() == "2 of 3 rows, 3 columns"


def test_braces_go_after_filter_and_sort(table):
    assert [r.title for r in query(table, "title ~ [{]").df.collect()] == ["A title"]
    assert query(table, "top 1 order -title").df.first().title == "A title"


def test_drop_empty(table):
    got = query(table, "select blank, nothing", drop_empty=True).df.columns
    assert got == ["tag", "author", "title", "nothing"]
    assert query(table, "select blank where year == 1", drop_empty=True).df.columns == ["tag", "author", "title", "blank"]


def test_patterns_in_javas_dialect():
    assert java_pattern("(?P<a>x)(?P=a)") == r"(?iu)(?<a>x)\k<a>"
    assert java_pattern(r"\w\Z") == r"(?iuU)\w\z" and java_pattern("x", ignore_case=False) == "x"


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    rows = query(QueryTable(df, ("o_orderkey",), "o_orderpriority", "o_orderdate", ("o_orderkey",)), "top 5 where o_orderdate >= 1996 and o_orderkey < 100 order -o_totalprice").df
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderkey" in plan and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
