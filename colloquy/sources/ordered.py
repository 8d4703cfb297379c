"""Lines of files in their order: row numbers, batches with a number of rows skipped, and the same as a stream that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from .files import exists


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, value) of the lines that aren't blank; row: the place among those of its file, from 0.

    Spark reads a file in blocks. A line's place in its block is the distance of its increasing id from the block's
    first; the lines of the blocks before are counted, a row per block, and added. Lines themselves are never shuffled.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, row long, value string")
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = text.where(F.rlike("value", F.lit(r"(?U)\S"))).withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("row"), "value")


def in_sequence(rows: DataFrame) -> DataFrame:
    """numbered_lines with `place`: the row among all files in order of their names. A row per file is windowed."""
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("file", before.alias("before")), "file").withColumn("place", F.col("before") + F.col("row")).drop("before")


def batches(spark: SparkSession, path: str, size: int, skip: int = 0) -> DataFrame:
    """(batch, place, value): lines in order, the first `skip` left out, `size` to a batch, from batch 0; the last may be shorter."""
    if size < 1 or skip < 0:
        raise ValueError(f"a batch holds 1 row or more and 0 or more are skipped, not {size} and {skip}")
    own = in_sequence(numbered_lines(spark, path)).where(F.col("place") >= skip)
    return own.select(F.floor((F.col("place") - skip) / size).alias("batch"), "place", "value")


def stream_batches(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Hands a folder's files on as (value) in batches, as they are there, then ends. A run with the same checkpoint goes on after the last batch that was handled.

    A batch whose handling failed is handed on again, with its number, so `handle` should write by that number.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where(F.rlike("value", F.lit(r"(?U)\S")))
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
