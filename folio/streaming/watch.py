"""New documents as a stream: each file of a watched folder once, with what its listing says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions.text import file_name, suffix

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name, suffix, mod, size of files as they come; contents aren't kept."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), file_name(path).alias("name"), suffix(path).alias("suffix"), F.col("modificationTime").alias("mod"), F.col("length").alias("size"))


def append_new(spark: SparkSession, directory: str, table: str, checkpoint: str, pattern: str = "*.pdf") -> StreamingQuery:
    """Appends new files to a Parquet table, each exactly once over restarts, and ends when there are no more."""
    return watched(spark, directory, pattern).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def daily_counts(files: DataFrame, late: str = "7 days") -> DataFrame:
    """How many files of how many bytes a day brought; days are final when `late` has passed."""
    return files.withWatermark("mod", late).groupBy(F.window("mod", "1 day").alias("day"), "suffix").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
