"""From parsed entries to a library's reference table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import citations, edition, integer_text
from folio.functions.udf import tex_to_unicode
from folio.operators.library import with_unique
from folio.operators.linkage import allocate_tags, author_map, file_fields, linked_files, mapped_authors, tag_base
from folio.types import REF_COLUMNS

# Fields that an import leaves out, and text fields whose TeX is decoded.
OMITTED = ("abstract", "annote", "issn", "isbn", "archivePrefix", "arxivId", "eprint", "pmid", "primaryClass", "series", "chapter", "school", "organization", "howpublished", "keywords")
DECODED = ("title", "journal", "publisher", "booktitle", "institution", "address", "editor", "mendeley-tags")


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def reference_rows(entries: DataFrame, source: str = "import") -> DataFrame:
    """Entries (row_id, type, tag, fields) as reference rows with all columns, '' where an entry has none, and `extra` for other fields."""
    own = [c for c in REF_COLUMNS if c not in ("type", "tag", "arc_citations", "arc_source")]
    names = [c.replace("_", "-") if c == "mendeley_tags" else c for c in own]
    used = F.array(*[F.lit(x) for x in [*names, *OMITTED]])
    return entries.select(
        "row_id", "type", "tag", *[_field(n).alias(c) for n, c in zip(names, own, strict=True)],
        citations(_field("abstract")).alias("arc_citations"), F.lit(source).alias("arc_source"),
        F.map_filter("fields", lambda k, v: ~F.array_contains(used, k) & v.isNotNull() & (v != "")).alias("extra"),
    )


def decoded(rows: DataFrame, columns: tuple[str, ...], by_hand: dict[str, str] | None = None) -> DataFrame:
    """rows with TeX in text columns decoded; by_hand has texts that the decoder fails on, and what they become."""
    return rows.withColumns({c: tex_to_unicode(F.col(c), by_hand)["text"] for c in columns if c in rows.columns})


def _decoded_columns() -> tuple[str, ...]:
    return tuple(c.replace("-", "_") for c in DECODED)


def undecoded(rows: DataFrame, by_hand: dict[str, str] | None = None) -> DataFrame:
    """field, miscode: the distinct texts of decoded columns in which TeX commands stay."""
    known = list(by_hand or {})
    texts = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("miscode")) for c in _decoded_columns()])).alias("t")).select("t.*").distinct()
    return texts.where(~F.col("miscode").isin(known) & tex_to_unicode(F.col("miscode"))["undecoded"])


def ported(entries: DataFrame, source: str = "import", by_hand: dict[str, str] | None = None) -> DataFrame:
    """The whole import: canonical authors, decoded texts, citations, editions and unique tags; a job fails if a tag comes twice."""
    rows = reference_rows(entries, source)
    rows = mapped_authors(rows, author_map(rows, by_hand=by_hand), "row_id")
    rows = decoded(rows, _decoded_columns(), by_hand).withColumn("edition", edition(F.col("edition")))
    return with_unique(allocate_tags(rows.withColumn("__base", tag_base(F.col("author"), F.col("editor"), integer_text(F.col("year")))).drop("tag"), "__base", "row_id").drop("__base"))


@dataclass(frozen=True)
class Import:
    """An import with what it changed: references, old and new tags, authors' names, texts that TeX is left in, its size, and links to files."""

    refs: DataFrame
    tags: DataFrame
    authors: DataFrame
    miscodes: DataFrame
    info: DataFrame
    links: DataFrame
    unread: DataFrame


def imported(entries: DataFrame, docs: DataFrame | None = None, source: str = "import", by_hand: dict[str, str] | None = None) -> Import:
    """ported() with its audits. links: (tag, path) of the files named, or of the nearest ones among docs, if given."""
    rows, refs = reference_rows(entries, source), ported(entries, source, by_hand)
    tags = rows.select("row_id", F.col("tag").alias("original")).join(refs.select("row_id", "tag", "author", "editor", "year", "title"), "row_id")
    named, unread = file_fields(refs)
    links = named.select("tag", F.col("vfile").alias("path")) if docs is None else linked_files(named, docs)
    info = entries.agg(F.count("*").alias("raw_entries"), F.count_if(F.col("type").isNull()).alias("unreadable")).withColumn("source", F.lit(source))
    return Import(refs, tags, author_map(rows, by_hand=by_hand), undecoded(rows, by_hand), info, links, unread)


def numbered(docs: DataFrame, create: str = "create", rows: int = 100_000) -> DataFrame:
    """Documents with numbers from 1, newest first, ties by path; documents without a time come last.

    Times fall into ranges at approximate quantiles. Rows are numbered within their range, and the
    driver adds up the ranges' sizes, so no task sees all rows.
    """
    moment = F.unix_micros(F.col(create).cast("timestamp"))
    n = docs.count()
    parts = max(1, min(2000, n // rows))
    bounds = []
    if parts > 1:
        bounds = sorted(set(docs.agg(F.percentile_approx(moment, [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first()["b"] or []))
    # range 0 is the newest, the last one has no time
    at = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b > moment)) if bounds else F.lit(0)
    ranged = docs.withColumn("__range", F.when(moment.isNull(), len(bounds) + 1).otherwise(at))
    before, bases = 0, [0] * (len(bounds) + 2)
    for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        bases[r["__range"]] = before
        before += r["n"]
    own = Window.partitionBy("__range").orderBy(F.col(create).desc_nulls_last(), "path")
    return ranged.withColumn("n", F.row_number().over(own) + F.get(F.lit(bases).cast("array<bigint>"), F.col("__range"))).drop("__range")


def cover(spans: DataFrame, key: str = "path") -> DataFrame:
    """key, cover_title, cover_author: of (key, size, text) the largest text, and the next three."""
    ranked = spans.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), F.desc("text")))).where("at <= 4")
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))).alias("l"))
    return rows.select(key, F.get("l", F.lit(0))["text"].alias("cover_title"), F.transform(F.slice("l", 2, 3), lambda x: x["text"]).alias("cover_author"))
