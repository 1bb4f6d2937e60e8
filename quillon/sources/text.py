"""Readers of measurement text: pipe tables, bracketed times, section headers, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nanoseconds of each unit's name.
UNITS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "ms": 1e6, "s": 1e9}


def pipe_cell(line, i: int) -> Column:
    """The number in cell i (from 1) of a table line; thousands separators and marks are left out."""
    return F.expr(f"try_cast(regexp_replace(get(split({line}, '[|]'), {i}), '[^0-9.]', '') as double)")


def quoted_name(line) -> Column:
    return F.regexp_extract(line, "`([^`]+)`", 1)


def bracket_ns(line) -> Column:
    """The middle one of three times in `time: [lo u mid u hi u]`, in nanoseconds."""
    pattern = r"time:\s*\[\s*[0-9.]+\s*\S+\s+([0-9.]+)\s*(\S+)"
    unit = F.regexp_extract(line, pattern, 2)
    factor = F.lit(None).cast("double")
    for name, ns in UNITS.items():
        factor = F.when(unit == name, F.lit(ns)).otherwise(factor)
    return F.expr(f"try_cast(regexp_extract({line}, '{pattern.replace(chr(92), chr(92) * 2)}', 1) as double)") * factor


def numeric(text) -> Column:
    """A JSON number as a double, else null."""
    return F.when(F.col(text).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.expr(f"try_cast({text} as double)"))


def first_number_cell(line) -> Column:
    """The first cell of a table line that is a number other than 0, else the line's first number."""
    cells = F.transform(F.split(line, "[|]"), lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double"))
    known = F.get(F.filter(cells, lambda c: c > 0), F.lit(0))
    return F.coalesce(known, F.regexp_extract(line, r"[0-9]+(\.[0-9]+)?", 0).try_cast("double"))


def comma_cell(line, i: int) -> Column:
    """The number in cell i (from 1) of `name , v1, v2`."""
    return F.trim(F.get(F.split(line, ","), F.lit(i))).try_cast("double")


def log_value(line, before: str, after: str) -> Column:
    """The number between two pieces of text of a log line, else null."""
    return F.regexp_extract(line, rf"{before}\s*([0-9]+(?:\.[0-9]+)?)\s*{after}", 1).try_cast("double")


def headed_times(df: DataFrame, order: str, line: str, *keys: str) -> DataFrame:
    """name and ns of each `time: [..]` line: the name is the last part of the header (`Benchmarking a/b:`) before it.

    A header names one time line alone: the first after it. Lines are ordered by `order` within keys (a file)."""
    w = Window.partitionBy(*keys).orderBy(order)
    header = F.when(F.col(line).rlike("^Benchmarking "), F.regexp_extract(line, r"^Benchmarking (?:.*/)?([^/:]+)", 1))
    d = df.withColumn("t_head", header).withColumn("t_ns", bracket_ns(line)).where("t_head is not null or t_ns is not null")
    return d.withColumn("name", F.lag("t_head").over(w)).where("t_ns is not null and name is not null").select(*keys, order, "name", F.col("t_ns").alias("ns"))


def manifest_features(spark: SparkSession, path: str) -> DataFrame:
    """features_of() the manifest files at a path."""
    return features_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def features_of(d: DataFrame) -> DataFrame:
    """A row per manifest (file, value): its features, those that are default ones, and how many are not. Features are the names of section [features]."""
    section = F.regexp_extract("value", r"(?s)(?:^|\n)\s*\[features\]\s*\n(.*?)(?:\n\s*\[|\z)", 1)
    names = F.filter(F.regexp_extract_all(section, F.lit(r"(?m)^\s*([A-Za-z0-9_-]+)\s*="), F.lit(1)), lambda n: n != "default")
    default = F.regexp_extract_all(F.regexp_extract(section, r"(?m)^\s*default\s*=\s*\[([^\]]*)\]", 1), F.lit('"([^"]+)"'), F.lit(1))
    d = d.select("file", names.alias("features"), default.alias("default"))
    return d.select("file", "features", "default", F.size("features").alias("total_features"), F.size("default").alias("default_features"), (F.size("features") - F.size("default")).alias("optional_features"))


def build_options(text) -> Column:
    """Names of `option(NAME ...` lines."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*option\s*\(\s*([A-Za-z0-9_]+)"), F.lit(1))
