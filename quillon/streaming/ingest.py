"""Resumable ingest of records into chunks, by Structured Streaming: its checkpoint says which files are done, so a stopped run goes on where it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import chunk_of
from ..operators.sinks import valid_records


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, size: int = 125000, files: int = 1000) -> int:
    """Adds the valid records of the Parquet files in `source` that are not yet ingested to zstd Parquet at `out`, a folder per chunk of heights.

    `files`: files of one micro-batch at most; a run takes as many batches as there are files for. Returns how many records it read. The file sink's log makes each batch count once,
    also if the run is killed between writing and committing it.
    """
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)
    rows = valid_records(rows).where("reason is null").drop("reason").withColumn("chunk_id", chunk_of(F.col("height"), size))
    stream = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("chunk_id").trigger(availableNow=True).start()
    stream.awaitTermination()
    return sum(p.numInputRows for p in stream.recentProgress)


def tail_breaks(df: DataFrame, order: str, name: str, prev: str, last: int = 100) -> DataFrame:
    """Of the `last` rows in order, those whose prev is not the name of the row before them."""
    tail = df.select(order, name, prev).orderBy(F.col(order).desc()).limit(last + 1)  # `last` is the feature: a check of what came in lately
    before = Window.orderBy(order)
    tail = tail.withColumn("expected", F.lag(name).over(before)).withColumn("first_", F.row_number().over(before) == 1)
    return tail.where(~F.col("first_") & ~F.col(prev).eqNullSafe(F.col("expected"))).drop("first_")
