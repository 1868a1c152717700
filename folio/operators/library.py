"""The three tables of a library, their denormalised join, and what links or misses between them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import relative_parent
from folio.plans.parser import parse
from folio.plans.planner import matches, plan, resolve
from folio.types import QueryResult, QueryTable


def split_authors(c: Column, by: str = " and ") -> Column:
    """A list's names, white space made even; '' is one empty name."""
    return F.split(F.regexp_replace(c, r"\s+", " "), by)


def database(ref: DataFrame, doc: DataFrame, bridge: DataFrame, authors: str = "author", by: str = " and ", with_doc: bool = True) -> DataFrame:
    """One row for each reference, author and document: bridge, reference and document columns.

    References without documents stay with null document columns; documents without references
    go. With with_doc off, the document table isn't read: right only where its paths are unique, as
    no row depends on it then.
    """
    rows = ref.withColumn(authors, F.explode_outer(split_authors(F.col(authors), by))).join(bridge, "tag", "left")
    names = [*bridge.columns, *[c for c in ref.columns if c not in bridge.columns]]
    if not with_doc:
        return rows.select(*names)
    counts = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("node", "links", "size") if c in doc.columns}
    joined = rows.join(doc, "path", "left")
    return joined.select(*names, *[counts.get(c, F.col(c)) for c in doc.columns if c not in names])


def without_match(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key right doesn't have."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def lacking(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose field is null or ''."""
    return rows.where(F.coalesce(F.col(column).cast("string"), F.lit("")) == "")


def sampled(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About a share of the rows, chosen by a hash of the seed and the key: the same ones whenever it is asked, however rows are spread."""
    place = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), F.lit(8)), 16, 10).cast("long")
    return rows.where(place < int(share * (1 << 32)))


def with_match(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key right has, each once."""
    return left.join(right.select(on), on, "left_semi")


def refs_without_docs(ref: DataFrame, bridge: DataFrame) -> DataFrame:
    return without_match(ref, bridge, "tag")


def docs_without_refs(doc: DataFrame, bridge: DataFrame) -> DataFrame:
    return without_match(doc, bridge, "path")


def paths_to_open(rows: DataFrame, bridge: DataFrame, pattern: str) -> DataFrame:
    """Distinct paths of the documents whose tag is in a result and matches."""
    tags = rows.where(matches(F.col("tag"), pattern)).select("tag")
    return bridge.join(tags, "tag", "left_semi").select("path").where("path is not null").distinct()


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with their counts; a null key counts like any other."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def with_unique(rows: DataFrame, key: str = "tag") -> DataFrame:
    """rows; a job over them fails, naming the key, if a key comes twice. Null keys fail too."""
    seen = rows.groupBy(key).agg(F.count("*").alias("__n")).withColumnRenamed(key, "__key")
    told = F.concat(F.lit(f"{key} is not unique: "), F.coalesce(F.col("__key").cast("string"), F.lit("null")))
    good = seen.where(F.when((F.col("__n") > 1) | F.col("__key").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
    return rows.join(good.select("__key"), rows[key].eqNullSafe(good["__key"]), "left_semi")


def without_file(ref: DataFrame, base_cols: list[str], file: str = "file") -> DataFrame:
    return ref.where(F.col(file) == "").select(*base_cols)


def merged_libraries(a: DataFrame, b: DataFrame, key: str = "tag") -> DataFrame:
    """Both tables' rows, columns that one lacks filled with nulls; of a key in both, a's rows stay."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


@dataclass(frozen=True)
class Library:
    """References, documents and the bridge, with their query tables.

    unique_paths says that no path has two documents; queries leave out the document table only then.
    """

    ref: DataFrame
    doc: DataFrame
    bridge: DataFrame
    unique_paths: bool = False

    @classmethod
    def load(cls, spark: SparkSession, directory: str, pdf_dir: str = "") -> Library:
        ref, doc, bridge = (spark.read.parquet(f"{directory}/{n}") for n in ("ref", "doc", "ref_doc"))
        return cls(ref, doc.withColumn("tpath", relative_parent(F.col("path"), pdf_dir)), bridge).checked()

    def checked(self) -> Library:
        """The same library, its paths looked at: a job over one column."""
        return replace(self, unique_paths=repeated(self.doc, "path").isEmpty())

    def save(self, directory: str) -> None:
        for name, df in (("ref", self.ref), ("doc", self.doc.drop("tpath")), ("ref_doc", self.bridge)):
            df.write.mode("overwrite").parquet(f"{directory}/{name}")

    def table(self, name: str, with_doc: bool = True) -> QueryTable:
        if name == "ref":
            return QueryTable(self.ref, ("tag", "author", "title", "journal"), "author", "year", ("tag",))
        if name == "doc":
            return QueryTable(self.doc, ("name", "create", "size", "tpath"), "name", "mod", ("path",))
        if name == "ref_doc":
            return QueryTable(self.bridge, ("tag", "path"), "path", "tag", ("tag", "path"))
        if name == "database":
            rows = database(self.ref, self.doc, self.bridge, with_doc=with_doc)
            return QueryTable(rows, ("tag", "author", "title", "journal", "create"), "author", "mod", ("tag", "author", "path"))
        raise ValueError(f"no table {name!r}")

    def query(self, text: str, table: str = "database", drop_empty: bool = False) -> QueryResult:
        """Runs a query; where paths are unique, the document table is joined only if the query names one of its columns."""
        spec = parse(text)
        if table != "database":
            return plan(self.table(table), spec, drop_empty)
        whole = self.table("database")
        own = set(self.doc.columns) - set(self.bridge.columns) - set(self.ref.columns)
        named = {*spec.include, *(n for n, _ in spec.sort), *(n for n, _ in spec.regex if n), *(c.column.split(".dt.")[0] for c in spec.where)}
        used = {resolve(whole.df, n) for n in named} | ({"create"} if "create" not in {resolve(whole.df, n) for n in spec.exclude} else set())
        needs = not self.unique_paths or "*" in spec.include or "recent" in spec.flags or bool(used & own)
        return plan(whole if needs else self.table("database", with_doc=False), spec, drop_empty)
