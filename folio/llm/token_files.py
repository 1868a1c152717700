"""Token ids in Parquet: list columns, dictionary-encoded, with row groups and page indexes for selective reads.

A part holds consecutive documents in ascending doc_id order: doc_id, part, start (ids before the
document in its part), n_tokens and the ids. Reading the totals touches the metadata columns only;
a range of doc_ids reads only the row groups and pages that hold it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import longs, shared_dir, small_batches, table
from folio.llm.tokens import encoder, in_slices, load, vocabulary

SCHEMA = "doc_id long, part int, start long, n_tokens long, ids array<int>"
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a column's dictionary grows too large
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
}


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int, by_word: bool = True) -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending doc_id order.

    Null and empty texts are their end id alone. Equal doc_ids are ordered by text; null ones come
    first. Other columns aren't read. An empty table writes no rows. A very long text is one row
    of its own; ids of several texts are put together up to 16 MB only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start, end = encoder(definition, by_word), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for some, coded in in_slices(batches, encode):
            coded = [x + end for x in coded]
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), lists], ["doc_id", "part", "start", "n_tokens", "ids"])
            start += int(ends[-1])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; with first or last, only those doc_ids.

    The parts' totals, one row a part, come to the driver from the metadata columns.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, bases = 0, []
    for part, n in totals:
        bases += [0] * (part - len(bases)) + [before]
        before += n
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    base = F.get(longs(bases), F.col("part")) if bases else F.lit(0).cast("long")
    return rows.select("doc_id", (F.col("start") + base).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            at = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None, end_id: int = 2) -> DataFrame:
    definition = load(vocabulary_path or vocabulary("word_bpe_49k.json"))
    path = f"{shared_dir(spark)}/folio-tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, definition, end_id)
    return with_crc(read_tokens(spark, path))
