"""Bibliographic messages in JSON, mapped to references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.udf import ratio
from folio.operators.linkage import allocate_tags, surname, tag_base

MESSAGE = (
    "type string, title array<string>, author array<struct<family:string,given:string>>, editor array<struct<family:string,given:string>>, "
    "issued struct<`date-parts`:array<array<int>>>, DOI string, URL string, ISBN array<string>, edition string, `container-title` array<string>, "
    "volume string, issue string, page string, publisher string, chapter string, `report-number` string, number string"
)

# Message types and the entry types they become.
TYPES = {
    "journal-article": "article", "book": "book", "book-chapter": "inbook", "proceedings-article": "inproceedings", "posted-content": "unpublished",
    "report": "techreport", "reference-entry": "misc", "dataset": "misc", "book-section": "incollection", "dissertation": "phdthesis", "manual": "manual",
}


def people(c: Column) -> Column:
    """`Family, Given and Family, Given`."""
    name = lambda p: F.trim(F.concat(F.coalesce(p["family"], F.lit("")), F.lit(", "), F.coalesce(p["given"], F.lit(""))))
    return F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<family:string,given:string>>")), name), " and ")


def first(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def references(messages: DataFrame, column: str = "message") -> DataFrame:
    """messages with a struct column `ref`: type, title, year, doi, url, author, editor, edition, isbn and what the type has of its own."""
    m = F.from_json(F.col(column), MESSAGE)
    rows = messages.withColumn("__m", m)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.lower("__m.type")), F.lit("misc"))
    text = lambda name: F.coalesce(F.col(f"__m.{name}"), F.lit(""))
    rows = rows.withColumn("__k", kind)

    def only(types: tuple[str, ...], value: Column) -> Column:
        return F.when(F.col("__k").isin(*types), value).otherwise("")

    ref = F.struct(
        F.col("__k").alias("type"), first(F.col("__m.title")).alias("title"), F.get(F.get(F.col("__m.issued.`date-parts`"), F.lit(0)), F.lit(0)).alias("year"),
        text("DOI").alias("doi"), text("URL").alias("url"), people(F.col("__m.author")).alias("author"), people(F.col("__m.editor")).alias("editor"),
        text("edition").alias("edition"), first(F.col("__m.ISBN")).alias("isbn"),
        only(("article",), first(F.col("__m.`container-title`"))).alias("journal"),
        only(("inbook", "incollection", "inproceedings"), first(F.col("__m.`container-title`"))).alias("booktitle"),
        only(("article",), text("volume")).alias("volume"),
        F.when(F.col("__k") == "article", text("issue")).when(F.col("__k") == "techreport", F.coalesce(F.col("__m.`report-number`"), text("number"))).otherwise("").alias("number"),
        only(("article", "inbook", "incollection", "inproceedings"), text("page")).alias("pages"),
        only(("book", "inbook", "incollection", "inproceedings"), text("publisher")).alias("publisher"),
        only(("inbook",), text("chapter")).alias("chapter"), only(("manual",), text("publisher")).alias("organization"),
        only(("phdthesis",), text("publisher")).alias("school"), only(("techreport",), text("publisher")).alias("institution"),
    )
    return rows.withColumn("ref", ref).drop("__m", "__k")


def tagged(refs: DataFrame, order: str, existing: DataFrame | None = None, column: str = "message") -> DataFrame:
    """refs with `tag`: surname of the first author or editor, or else the message's hash, and the year; the next free one beside existing tags."""
    hashed = F.left(F.md5(F.col(column)), F.lit(12))
    base = tag_base(F.col("ref.author"), F.coalesce(F.nullif(surname(F.col("ref.editor")), F.lit("")), hashed), F.lpad(F.col("ref.year").cast("string"), 4, "0"))
    return allocate_tags(refs.withColumn("__base", base), "__base", order, existing).drop("__base")


def by_doi(refs: DataFrame, doi: str) -> DataFrame:
    """The references with a DOI, case aside; `refs` has the column `ref` of references()."""
    return refs.where(F.lower("ref.doi") == doi.lower())


def by_title(refs: DataFrame, title: str, most: int = 1) -> DataFrame:
    """The references whose titles are most like the given one, best first."""
    like = ratio(F.lower("ref.title"), F.lower(F.lit(title)))
    return refs.withColumn("similarity", like).orderBy(F.desc("similarity"), "ref.doi").limit(most)


def matching(refs: DataFrame, title: str | None = None, author: str | None = None, most: int = 20) -> DataFrame:
    """References by words of title and author, all of which have to occur."""
    for field, words in (("ref.title", title), ("ref.author", author)):
        for word in (words or "").split():
            refs = refs.where(F.contains(F.lower(field), F.lit(word.lower())))
    return refs.orderBy(F.desc("ref.year"), "ref.doi").limit(most)
