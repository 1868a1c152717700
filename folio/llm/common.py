"""What the operators of this subpackage share: tables cut from their lineage, order over ranges, graph components."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
FEW_LINKS = 2_000_000  # links that one task may join: 32 MB

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session that names none gets a local folder if it has no executors of its own, and an error if it has."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="folio-"))
    return _own[0]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For rows that are whole texts or documents' ids: fewer of them are sent to a worker at once."""
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame, texts: bool = False, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
    with small_batches(spark) if texts else nullcontext():
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, and lets Spark clear the shuffle files of jobs that are done."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_folio_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for spark in {id(df.sparkSession): df.sparkSession for df in tables}.values():
        released(spark)


def released(spark: SparkSession) -> None:
    """Shuffle files go when the driver finds their plans unused: it holds the last job's until another has run, and looks when it collects its garbage."""
    spark.range(1).count()
    spark._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ranges(df: DataFrame, key: str, tie: Column, rows: int = 4096) -> Column:
    """A column that numbers consecutive ranges of a long key and, among equal keys, of `tie`: about `rows` rows each.

    The bounds are approximate quantiles and are fixed here, on the driver; whatever they are,
    every row has one range, and ranges follow the order of key (nulls first) and tie, a long that
    is spread evenly, such as a hash. A key that many rows have, null too, has as many ranges as
    quantiles fall on it. At most 20,000 bounds.
    """
    seen = df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("none")).first()
    parts = max(1, min(20_000, seen["n"] // rows))
    if parts == 1:
        return F.lit(0)
    size = seen["n"] / parts
    known, nulls = seen["n"] - seen["none"], ceil(seen["none"] / size)
    at = [i * size / known for i in range(1, parts) if i * size < known] if known else []
    found = (df.agg(F.percentile_approx(key, at, max(10_000, 4 * parts)).alias("at")).first()["at"] or []) if at else []
    bounds = sorted(set(found))
    many = Counter(found)
    share = (tie / F.lit(2.0**64) + 0.5).cast("double")  # of the range of longs that is below tie

    def part(of: Column) -> Column:
        return F.least(of - 1, F.floor(share * of).cast("int"))

    first = nulls if seen["none"] else 0
    if not bounds:
        return F.when(F.col(key).isNull(), part(F.lit(first))).otherwise(F.lit(first)) if first else F.lit(0)
    # the bound at or below a key; rows that equal it take as many ranges as it was found, the others the one after these
    place, taken, bases, sizes = between(F.col(key), bounds), first + 1, [first], [0]
    for b in bounds:
        own = many[b] if many[b] > 1 else 0
        bases.append(taken)
        sizes.append(own)
        taken += own + 1
    base, split = F.get(longs(bases), place).cast("int"), F.get(longs(sizes), place).cast("int")
    equal = F.get(longs([0, *bounds]), place) == F.col(key)
    inner = F.when(split == 0, base).when(equal, base + part(split)).otherwise(base + split)
    return F.when(F.col(key).isNull(), part(F.lit(max(1, first)))).otherwise(inner)


def longs(values: list[int]) -> Column:
    """A constant array of long numbers, however many: one literal that the optimiser unfolds once."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def between(key: Column, bounds: list[int], step: int = 128) -> Column:
    """How many of the sorted bounds are at most key: steps of bounds first, then the bounds of one step. 0 for null."""
    if not bounds:
        return F.lit(0)
    at = F.size(F.filter(longs(bounds[::step]), lambda b: b <= key))
    inner = F.size(F.filter(F.slice(longs(bounds), (at - 1) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(key.isNull() | (at == 0), 0).otherwise((at - 1) * step + inner)


def reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of undirected links (a, b), in order, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))  # never after the node itself
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if links:
        nodes, least = reached(*(np.concatenate(c) for c in zip(*links, strict=True)))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (nodes, least)], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): node, component (the smallest node it reaches).

    Up to FEW_LINKS different links are one task's work, as a round of queries costs the driver
    more than they do. More are joined in alternating large and small stars, which end after a
    number of rounds that grows with the logarithm of the size. Each round is written to the shared
    folder; only two numbers a round come to the driver. Loops and repeated links are allowed; nodes
    without links aren't returned.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.count() <= FEW_LINKS:
        return links.coalesce(1).mapInArrow(_joined, "node long, component long")
    before, older = None, []
    while True:
        seen = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before:
            dropped(*older)
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = seen
        older.append(links)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y"))
        links = written(least.select("a", F.col("m").alias("b")).union(
            small.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).where("a <> b").distinct())
