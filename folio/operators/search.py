"""Full-text search by lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import unix_lines
from folio.plans.planner import java_pattern


def lines(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, line_number (from 1), line, without carriage returns; a text's last line break ends its last line."""
    whole = F.regexp_replace(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n$", "")
    return docs.select(key, *keep, F.posexplode(F.split(whole, "\n")).alias("at", "line")).select(key, *keep, (F.col("at") + 1).cast("long").alias("line_number"), "line")


def submatches(line: Column, pattern: str) -> Column:
    """Byte offsets of all matches in a line, as an array of start and end."""
    parts = F.struct(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("m"), F.split(line, pattern, -1).alias("g"))

    def build(p: Column) -> Column:
        def upto(n: Column, extra: Column) -> Column:
            both = F.zip_with(F.slice(p["g"], F.lit(1), n), F.slice(p["m"], F.lit(1), n), lambda a, b: F.octet_length(a) + F.octet_length(F.coalesce(b, F.lit(""))))
            return F.aggregate(both, F.lit(0), lambda s, x: s + x) + extra

        def one(m: Column, i: Column) -> Column:
            start = upto(i, F.octet_length(F.get(p["g"], i)))
            return F.struct(start.cast("long").alias("start"), (start + F.octet_length(m)).cast("long").alias("end"))

        return F.transform(p["m"], one)

    return F.get(F.transform(F.array(parts), build), F.lit(0))


#: What can't reach over a line's end, greedy: characters, escaped signs, digits, words and borders, classes of listed characters, groups.
_INSIDE = re.compile(r"(?:[^\\\[\](){}^$*+?\n\r]|\\[dwb]|\\[^A-Za-z0-9\s]|\[[^\^\\\[\]\n\r&][^\\\[\]\n\r&]*\]|\((?:\?:)?|\)|[\^$]|(?<=[^|(])(?:[*+?]|\{\d+(?:,\d*)?\})(?![*+?{]))*")


def search(docs: DataFrame, pattern: str, key: str, text: str = "text", limit: int = 10, ignore_case: bool = False, context: bool = False) -> DataFrame:
    """key, line_number, line, submatches, ordinal (of the match in its document); with context, the lines before and after.

    Exactly `limit` rows in the order of key and line, or all with -1. Case matters unless told
    otherwise. Offsets are bytes. Documents without a match are dropped before they are split.
    """
    java = java_pattern(pattern, ignore_case)
    # what a pattern may see beyond its line, or takes for the text's ends, can't be looked for in whole texts
    whole = bool(_INSIDE.fullmatch(pattern))
    rows = lines(docs.where(unix_lines(F.col(text)).rlike(f"(?m){java}")) if whole else docs, key, text)
    own = Window.partitionBy(key).orderBy("line_number")
    extra = []
    if context:
        rows = rows.withColumns({"before": F.lag("line").over(own), "after": F.lead("line").over(own)})
        extra = ["before", "after"]
    found = rows.where(F.col("line").rlike(java)).withColumn("ordinal", F.row_number().over(own).cast("long"))
    found = found.select(key, "line_number", F.rtrim("line").alias("line"), submatches(F.col("line"), java).alias("submatches"), "ordinal", *extra)
    return found.orderBy(key, "line_number").limit(limit) if limit >= 0 else found


def offsets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_number, line, absolute_offset: the byte at which each line starts."""
    rows = lines(docs, key, text)
    before = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("absolute_offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long"))


def tidy_name(path: Column, text_dir: str, extractor: str) -> Column:
    """A text file's document: without the folder and the ending of the extractor."""
    rest = F.regexp_replace(path, f".{extractor}.md$".replace(".", r"\."), "")
    return F.when(rest.startswith(text_dir), F.regexp_replace(F.substring(rest, F.lit(len(text_dir) + 1), F.char_length(rest)), r"^[/\\]+", "")).otherwise(rest)


def find(rows: DataFrame, column: str, pattern: str, year: str = "year") -> DataFrame:
    """Rows whose field has the pattern, latest years first, then by the field."""
    return rows.where(F.col(column).rlike(java_pattern(pattern))).orderBy(F.col(year).desc_nulls_last(), F.col(column).asc_nulls_last())
