"""Chunks and daily windows of a stream of records, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import chunk_of
from ..operators.shared import new_folder


def _stream(spark: SparkSession, path: str) -> DataFrame:
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def _all_now(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """The last state of each key of an aggregated stream, of all that is there now.

    Each batch adds the keys that it changed to a table in the shared folder, in which its number says which state is the last; a batch that runs again writes the same."""
    spark, out = rows.sparkSession, new_folder(rows.sparkSession, name)
    add = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    q = rows.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    values = [c for c in rows.columns if c not in keys]
    got = spark.read.schema(rows.schema.add("batch", "long")).parquet(out)
    return got.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def counted(spark: SparkSession, path: str, key: str, size: int) -> DataFrame:
    """Records of each chunk of `size` keys: the file is read as a stream, all that is there now, with state kept by chunk."""
    rows = _stream(spark, path).groupBy(chunk_of(F.col(key), size).alias("chunk")).agg(F.count("*").alias("records"))
    return _all_now(rows, "chunks", "chunk")


def windowed(spark: SparkSession, path: str, ts: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Count and sum of a value per key and day of event time, as a stream with a watermark (beyond what the measurement suite has): state of days
    that are more than `late` behind is dropped, and so are rows that come in for them later.

    ts is a time without zone; days are its own, whatever the session's zone is."""
    at = F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"))
    rows = _stream(spark, path).withColumn("w_at", at).withWatermark("w_at", late)
    rows = rows.groupBy(key, F.window("w_at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return _all_now(rows.select(key, F.date_from_unix_date(F.expr("cast(unix_seconds(w.start) div 86400 as int)")).alias("day"), "n", "total"), "windows", key, "day")
