"""BibTeX: reading entries, writing them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import plain_characters

# The entry types that are written, and what every entry needs.
TYPES = ("article", "book", "incollection", "inproceedings", "manual", "misc", "phdthesis", "report", "techreport", "unpublished")
REQUIRED = ("type", "tag", "title", "year")

_HEAD = re.compile(r"\s*@?\s*(\w+)\s*\{\s*([^,\s{}]+)\s*(?:,|(?=\}))")
_KEY = re.compile(r"[\s,]*([A-Za-z][\w\-]*)\s*=\s*")
_BARE = re.compile(r"[^,}\n]*")


def _value(text: str, at: int) -> tuple[str, int] | None:
    """A value in balanced braces, in quotes or bare, and where it ends; None if it doesn't end."""
    if at < len(text) and text[at] == "{":
        depth, i = 0, at
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[at + 1 : i], i + 1
            i += 1
        return None
    if at < len(text) and text[at] == '"':
        depth, i = 0, at + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c in "{}":
                depth += 1 if c == "{" else -1
            elif c == '"' and not depth:
                return text[at + 1 : i], i + 1
            i += 1
        return None
    found = _BARE.match(text, at)
    return found[0].strip(), found.end()


def parse_entry(text: str) -> tuple[str, str, dict[str, str]] | None:
    """type, tag and fields of one entry, white space in values made even; None if it has no header. Of a repeated field the last counts."""
    head = _HEAD.match(text)
    if not head:
        return None
    fields, at = {}, head.end()
    while key := _KEY.match(text, at):
        got = _value(text, key.end())
        if got is None:
            break
        fields[key[1]], at = " ".join(got[0].split()), got[1]
    return head[1].lower(), head[2], fields


@F.pandas_udf(T.StructType([T.StructField("type", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))
def _parsed(texts: pd.Series) -> pd.DataFrame:
    rows = [parse_entry(t or "") or (None, None, {}) for t in texts]
    return pd.DataFrame({"type": [r[0] for r in rows], "tag": [r[1] for r in rows], "fields": [r[2] for r in rows]})


def entries(texts: DataFrame, value: str = "value") -> DataFrame:
    """row_id, type, tag, fields of each text that is one entry, with or without its @; others have null type and stay."""
    parsed = texts.withColumn("__p", _parsed(plain_characters(F.col(value))))
    return parsed.select("row_id", "__p.type", "__p.tag", "__p.fields", F.col(value).alias("source"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files. Files are cut at lines that start with @, so no file has to fit in a row.

    row_id numbers entries from 1 in each file's order. Text before the first entry is left out.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = Window.partitionBy("file").orderBy("at")
    rows = raw.withColumn("n", F.row_number().over(first)).where((F.col("n") > 1) | F.col("value").startswith("@"))
    return entries(rows.withColumn("row_id", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long")))


def failed(rows: DataFrame) -> DataFrame:
    return rows.where("type is null").select("row_id", "source")


def entry_text(row: dict[str, Column]) -> Column:
    """One entry's BibTeX from columns by field name; fields that are null or '' are left out. Null if it can't be written (invalid())."""
    tag, title = row["tag"], row["title"]
    head = F.concat(F.lit("@"), row["type"], F.lit("{"), F.upper(F.left(tag, F.lit(1))), F.substring(tag, F.lit(2), F.char_length(tag)), F.lit(",\ntitle = {{"), title, F.lit("}}"))
    rest = []
    for name, c in row.items():
        if name not in ("type", "tag", "title"):
            text = c.cast("string")
            rest.append(F.when(text.isNotNull() & (text != ""), F.concat(F.lit(f"{name} = {{"), text, F.lit("}"))))
    return F.when(~invalid(row), F.concat(F.concat_ws(",\n", head, *rest), F.lit(",\n}")))


def invalid(row: dict[str, Column]) -> Column:
    """Whether a required field is missing or the type isn't one that is written."""
    lacking = F.lit(False)
    for name in REQUIRED:
        lacking = lacking | (F.coalesce(row[name].cast("string"), F.lit("")) == "")
    return lacking | ~row["type"].isin(*TYPES)


def write_bibtex(refs: DataFrame, path: str, fields: list[str]) -> None:
    """Writes every valid row; a job fails on rows that can't be written."""
    row = {c: F.col(c) for c in fields}
    text = F.when(invalid(row), F.raise_error(F.concat(F.lit("not a valid entry: "), F.coalesce(F.col("tag"), F.lit("?"))))).otherwise(entry_text(row))
    refs.select(text.cast("string").alias("value")).write.mode("overwrite").text(path)
