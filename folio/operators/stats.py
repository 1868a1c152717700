"""Statistics of a library: distinct values, profiles of fields, counts of values and of children, variants and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import remove_accents, wide_characters
from folio.operators.library import split_authors, without_match


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Values that are neither null nor '', in order."""
    return df.select(column).where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct().orderBy(column)


def distinct_authors(df: DataFrame, column: str = "author") -> DataFrame:
    return df.select(F.explode(split_authors(F.col(column))).alias(column)).select(F.trim(column).alias(column)).distinct().orderBy(column)


def _long(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value (as text), a row for each: every field is counted in the same two shuffles, however many there are."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields])
    return df.select(F.explode(pairs).alias("p")).select("p.field", "p.value")


def field_profile(df: DataFrame, fields: list[str] | None = None, zero_is_missing: tuple[str, ...] = ("arc_citations",), approximate: bool = False) -> DataFrame:
    """field, distinct (values that aren't null, '' among them), missing ('' or, for some fields, 0)."""
    fields = fields or df.columns
    blank = F.when(F.col("field").isin(*zero_is_missing), F.lit("0")).otherwise("")
    if approximate:
        return _long(df, fields).groupBy("field").agg(F.approx_count_distinct("value").alias("distinct"), F.count_if(F.col("value") == blank).alias("missing"))
    counted = _long(df, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("field").agg(F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value") == blank, F.col("n"))), F.lit(0)).alias("missing"))


def contents(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """column, nonna (values that aren't null), distinct."""
    counted = _long(df, fields or df.columns).groupBy("field", "value").agg(F.count("value").alias("n"))
    return counted.groupBy(F.col("field").alias("column")).agg(F.sum("n").alias("nonna"), F.count("value").alias("distinct"))


def value_counts(df: DataFrame, column: str, most: int = 20) -> DataFrame | None:
    """The commonest values with their counts, ties by value; None for a field that isn't there."""
    if column not in df.columns:
        return None
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


MEASURES = ("objects", "no children", "children", "1 child", "2 children", "3 children", "4+ children")


def _children(parents: DataFrame, bridge: DataFrame, key: str, name: str) -> DataFrame:
    counts = parents.select(key).join(bridge.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    tests = (F.lit(True), F.col("n") == 0, F.col("n") > 0, F.col("n") == 1, F.col("n") == 2, F.col("n") == 3, F.col("n") >= 4)
    row = counts.agg(F.array(*[F.count_if(t) for t in tests]).alias("a"))
    return row.select(F.posexplode(F.arrays_zip(F.array(*map(F.lit, MEASURES)).alias("measure"), F.col("a").alias("n"))).alias("at", "p")).select("at", "p.measure", F.col("p.n").alias(name))


def child_histogram(ref: DataFrame, doc: DataFrame, bridge: DataFrame) -> DataFrame:
    """measure, references, documents: how many references have how many documents, and the other way round."""
    a, b = _children(ref, bridge, "tag", "references"), _children(doc, bridge, "path", "documents")
    return a.join(b.drop("measure"), "at").orderBy("at").select("measure", "references", "documents")


def zero_children(parents: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    return without_match(parents, bridge, key)


def name_variants(names: DataFrame, column: str = "proposed") -> DataFrame:
    """last, n, set: last names that occur with more than one row, and their distinct rests."""
    parts = F.split(F.col(column), ",", 2)
    rows = names.select(F.get(parts, F.lit(0)).alias("last"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("rest"))
    return rows.groupBy("last").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("rest")).alias("set")).where("n > 1")


def duplicate_content(df: DataFrame, column: str = "hash") -> DataFrame:
    """Values that more than one row has, with their counts."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def accent_groups(names: DataFrame, column: str = "name") -> DataFrame:
    """bare, accented, variants: names that occur with and without accents, and the highest form of each."""
    rows = names.select(F.col(column).alias("v"), remove_accents(F.col(column)).alias("bare")).distinct()
    return rows.groupBy("bare").agg(F.max("v").alias("accented"), F.count("*").alias("variants")).where("variants > 1")


def row_means(df: DataFrame, column: str, by: str = "-", name: str = "mean") -> DataFrame:
    """The mean of the numbers that a text's parts are; null without one."""
    numbers = F.filter(F.transform(F.split(F.col(column), by), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return df.withColumn(name, F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)))


def merge_audit(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each key, each field's least value that isn't null (rows have no order) and whether all its values agree."""
    out = []
    for c in fields:
        out += [F.min(c).alias(c), (F.count_distinct(c) <= 1).alias(f"{c}_same")]
    return rows.groupBy(key).agg(F.count("*").alias("versions"), *out)


def all_fields(rows: DataFrame, column: str = "fields") -> DataFrame:
    """Names of the fields that occur in a column of maps."""
    return rows.select(F.explode(F.map_keys(column)).alias("field")).distinct().orderBy("field")


def all_wide_characters(rows: DataFrame, column: str) -> DataFrame:
    """The characters beyond ASCII that occur in a column."""
    return rows.select(F.explode(wide_characters(F.col(column))).alias("character")).distinct()
