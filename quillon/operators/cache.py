"""Records by key from several sources in order of priority, and a shared cache that keeps what the others gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sinks import hadoop_path


def read_through(wanted: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """A row for each wanted key that is not null: the record of the first source that has it, and the source's name (null where none has).

    A source is joined with the keys that those before it lack, so records move only if they are taken. Records of a source that share a key all come.
    Sources have the same columns.
    """
    left = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    out = None
    for name, df in sources:
        got = left.join(df, key).withColumn("source", F.lit(name))
        out = got if out is None else out.unionByName(got)
        left = left.join(df.select(key), key, "left_anti")
    none = left.withColumn("source", F.lit(None).cast("string"))
    return none if out is None else out.unionByName(none, allowMissingColumns=True)


def fill(wanted: DataFrame, key: str, path: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The wanted records of the cache at `path`, after those that it lacked were added from the sources. Keys that no source has stay out."""
    spark = wanted.sparkSession
    at, files = hadoop_path(spark, path)
    if files.exists(at):
        wanted = wanted.join(spark.read.parquet(path).select(key), key, "left_anti")
    found = read_through(wanted, key, sources).where("source is not null").drop("source")
    found.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def prefetch(spark, key: str, start: int, end: int, path: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Fills the cache with keys start..end (inclusive) and returns these records."""
    wanted = spark.range(start, end + 1).withColumnRenamed("id", key)
    return fill(wanted, key, path, sources).where(F.col(key).between(start, end))


def first_readable(spark, paths: list[str]) -> str | None:
    """The first of some paths (globs too) that has a file or folder; for result files and data folders with several possible places."""
    for path in paths:
        at, files = hadoop_path(spark, path)
        if files.globStatus(at):
            return path
    return None
