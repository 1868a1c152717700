"""Documents on disk: listings, hashes, texts that are missing, converters."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import file_name, joined_hyphens, relative_parent, suffix, text_path, unix_lines
from folio.functions.udf import composed
from folio.operators.ingest import numbered
from folio.operators.library import Library
from folio.types import LibraryConfig

STATS = "create timestamp, access timestamp, node long, links long"


def list_documents(spark: SparkSession, directory: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, name, suffix, mod, size, tpath of each file; the contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(directory).drop("content")
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), F.col("modificationTime").alias("mod"), F.col("length").alias("size")).select(
        "path", file_name(F.col("path")).alias("name"), suffix(F.col("path")).alias("suffix"), "mod", "size", relative_parent(F.col("path"), directory).alias("tpath"))


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with times, node and links of files on a file system that all executors see; nulls for files that are gone. Rows stay as they are."""
    @F.pandas_udf(STATS)
    def stat(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for path in paths:
            try:
                s = os.stat(path)
                rows.append((datetime.fromtimestamp(s.st_ctime, UTC), datetime.fromtimestamp(s.st_atime, UTC), s.st_ino % (1 << 63), s.st_nlink))
            except (OSError, TypeError, ValueError):
                rows.append((None, None, None, None))
        out = pd.DataFrame(rows, columns=["create", "access", "node", "links"])
        return out.astype({"create": "datetime64[us, UTC]", "access": "datetime64[us, UTC]", "node": "Int64", "links": "Int64"})
    return docs.withColumn("__stat", stat("path")).select(*docs.columns, "__stat.*")


def content_hashes(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """path, hash: BLAKE2b of each file's contents, of which a part at a time is in memory.

    Files of a local file system, which all executors see, are opened where they are. Those of
    other stores come through Spark's reader of lines; there a stretch without a line feed, or a
    file that this reader would unpack, is read whole. Spark lists no empty files.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(directory)
    if at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).getUri().getScheme() != "file":
        return _line_hashes(spark, directory, pattern)

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        def of(path: str) -> str:
            with open(path, "rb") as file:
                return hashlib.file_digest(file, hashlib.blake2b).hexdigest()
        return paths.map(of)

    path = F.regexp_replace("path", "^file:/+", "/")
    return _listed(spark, "binaryFile", pattern).load(directory).select(path.alias("path"), digest(path).alias("hash"))


def _listed(spark: SparkSession, kind: str, pattern: str) -> DataFrameReader:
    return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")


MARK = b"\xef\xbb\xbf"  # the reader of lines leaves it out at the start of a file
PACKED = r"\.(bz2|deflate|gz|lz4|snappy|zst)$"


def _line_hashes(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """content_hashes by Spark's readers alone: a file's lines come to one task in their order, as the hash needs them."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, read, plain, marked = None, 0, 0, None, None

        def ended() -> pa.RecordBatch:
            rest = size - read
            if rest not in (0, 1, len(MARK), len(MARK) + 1):
                raise ValueError(f"{name}: {read} of {size} bytes read")
            done = marked if rest >= len(MARK) else plain
            done.update(b"\n" * (rest % len(MARK)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([done.hexdigest()])], ["file", "hash"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for run in pc.run_end_encode(batch.column(0)).values.to_pylist():
                some = batch.filter(pc.equal(batch.column(0), run))
                lines = b"\n".join(some.column(2).to_pylist())
                if run == name:
                    lines = b"\n" + lines
                else:
                    if name is not None:
                        yield ended()
                    name, size, read, plain, marked = run, some.column(1)[0].as_py(), 0, hashlib.blake2b(), hashlib.blake2b(MARK)
                read += len(lines)
                plain.update(lines)
                marked.update(lines)
        if name is not None:
            yield ended()

    file, size = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
    whole = F.udf(lambda b: hashlib.blake2b(b).hexdigest(), "string")
    lines = _listed(spark, "text", pattern).option("lineSep", "\n").load(directory).where(~F.col("_metadata.file_path").rlike(PACKED))
    lines = lines.select(file, size, F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = lines.repartition("file").sortWithinPartitions("file", "block", "n").select("file", "size", "line").mapInArrow(digests, "file string, hash string")
    files = _listed(spark, "binaryFile", pattern).load(directory)
    packed = files.where(F.col("_metadata.file_path").rlike(PACKED)).select(file, whole("content").alias("hash"))
    mark = F.when(F.col("size") == len(MARK), hashlib.blake2b(MARK).hexdigest())  # a mark alone gives no line
    return files.select("path", file, size).join(lines.union(packed), "file", "left").select("path", F.coalesce("hash", mark, F.raise_error(F.concat("path", F.lit(": no bytes read")))).alias("hash"))


def missing_texts(docs: DataFrame, texts: DataFrame, text_dir: str, extractor: str) -> DataFrame:
    """Documents whose extracted text isn't among the listed files."""
    return docs.withColumn("__text", text_path(F.col("path"), text_dir, extractor)).join(texts.select(F.col("path").alias("__text")), "__text", "left_anti").drop("__text")


def new_documents(spark: SparkSession, directory: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """n (from 1, newest first), name, path, create, mod, size of the files of a folder."""
    docs = numbered(with_stats(list_documents(spark, directory, pattern, recursive)))
    return docs.select("n", "name", "path", "create", "mod", "size")


#: Ways to run the usual extractor: in reading order, or as the page is laid out.
EXTRACTORS = {"raw": ("pdftotext", "-raw", "-nopgbrk", "{path}", "-"), "layout": ("pdftotext", "-layout", "-nopgbrk", "{path}", "-")}


def compare_texts(docs: DataFrame, first: tuple[str, ...] = EXTRACTORS["raw"], second: tuple[str, ...] = EXTRACTORS["layout"]) -> DataFrame:
    """path, first, second, same: each file's text by two programs, and whether they have the same words; null if one gives none. `docs` has each path once."""
    a, b = (extract_texts(docs, c).select("path", F.col("text").alias(n)) for c, n in ((first, "first"), (second, "second")))
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return a.join(b, "path").withColumn("same", bare("first") == bare("second"))


def extract_texts(docs: DataFrame, command: tuple[str, ...] = EXTRACTORS["raw"], seconds: int = 120) -> DataFrame:
    """path, text, error: each file's text by an outside program, lines and hyphens mended, in normal form C.

    A program that is missing, fails or takes too long leaves a null text and the reason.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = []
            for path in some["path"]:
                try:
                    done = subprocess.run([a.replace("{path}", path) for a in command], capture_output=True, timeout=seconds, check=True)
                    rows.append((path, done.stdout.decode("utf-8", errors="replace"), None))
                except (OSError, subprocess.SubprocessError) as wrong:
                    rows.append((path, None, str(wrong)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])
    raw = docs.select("path").mapInPandas(run, "path string, text string, error string")
    return raw.withColumn("text", composed(joined_hyphens(unix_lines(F.col("text")))))


def write_texts(texts: DataFrame, path: str) -> None:
    """Extracted texts as one Parquet table; a file for each text is what large stores can't take."""
    texts.where("text is not null").select("path", "text").write.mode("append").parquet(path)


def convert_feather(source: str, target: str) -> None:
    """One Feather file as Parquet, batch by batch, on the machine that calls it: for moving a desktop library, whose tables are small."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    with pa.memory_map(source) as file:
        reader = pa.ipc.open_file(file)
        with pq.ParquetWriter(target, reader.schema) as out:
            for i in range(reader.num_record_batches):
                out.write_batch(reader.get_batch(i))


def write_audit(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One CSV with a byte-order mark, for spreadsheet programs, written by the driver; at most `most` rows, more are an error."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"an audit file holds at most {most} rows")
    rows.to_csv(path, encoding="utf-8-sig", index=False)


def read_tables(spark: SparkSession, ref: str, doc: str, bridge: str, scratch: str) -> Library:
    """A library from three Feather files: converted in the folder `scratch`, then read as Parquet."""
    for name, source in (("ref", ref), ("doc", doc), ("ref_doc", bridge)):
        Path(scratch).mkdir(parents=True, exist_ok=True)
        convert_feather(source, f"{scratch}/{name}")
    return Library.load(spark, scratch)


def list_libraries(spark: SparkSession, directory: str, pattern: str = "*/config.json") -> DataFrame:
    """name, description, pdf_dir, text_dir, extractor, columns of each library under a folder; a pattern like *.yaml lists settings in YAML."""
    found = [LibraryConfig.load(str(p)) for p in sorted(Path(directory).glob(pattern))]
    return spark.createDataFrame([(c.name, c.description, c.pdf_dir, c.text_dir, c.extractor, len(c.ref_columns)) for c in found], "name string, description string, pdf_dir string, text_dir string, extractor string, columns int")


def config_rows(df: DataFrame, key: str) -> DataFrame:
    """A wide row as field and value rows."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in rest]).unpivot([key], rest, "field", "value")
