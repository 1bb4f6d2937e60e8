"""Latency summaries with exact nearest-rank percentiles."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of values for each doubling; an offset that keeps bins of positive values above 0.
PER_OCTAVE, ABOVE = 64, 1 << 20


def _bin(value: str) -> Column:
    """A whole number that never falls as the value rises: values of a bin differ by about a hundredth. Infinity and NaN share the last bin."""
    v = F.col(value).cast("double")
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * PER_OCTAVE) + ABOVE
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -size).otherwise(size)


def _same(keys: list[str]) -> Column:
    return functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys), F.lit(True))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """Per key: n, and p{q}: the value at 0-based place floor(n * q / 100) of the sorted ones. Null values do not count; keys without others have no row."""
    return _ranked(df, keys, value, percents).drop("total", "least", "most")


def _ranked(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """nearest_rank() with the sum, least and greatest value of each key.

    Equal values are counted before they move, and bins of values are summed in order to find those that hold a wanted place: only the values
    of these bins are sorted, so that a key with most of the rows is no task of its own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c")).withColumn("bin_", _bin(value))
    w = Window.partitionBy(*keys)
    place = lambda q: F.expr(f"least(n * {q} div 100, n - 1)")
    bins = counts.groupBy(*keys, "bin_").agg(F.sum("c").alias("held"), F.sum(F.col(value) * F.col("c")).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    bins = bins.withColumn("total", F.sum("total").over(w)).withColumn("least", F.min("least").over(w)).withColumn("most", F.max("most").over(w))
    bins = bins.withColumn("upto", F.sum("held").over(w.orderBy("bin_"))).withColumn("n", F.sum("held").over(w))
    wanted = functools.reduce(operator.or_, ((F.col("upto") > place(q)) & (F.col("upto") - F.col("held") <= place(q)) for q in percents))
    bins = bins.where(wanted).select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("bin_").alias("wanted_"), (F.col("upto") - F.col("held")).alias("before"), "n", "total", "least", "most")
    near = counts.join(bins, _same(keys) & (F.col("bin_") == F.col("wanted_")))
    near = near.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "bin_").orderBy(value)))
    return near.groupBy(*keys).agg(*(F.max(x).alias(x) for x in ("n", "total", "least", "most")), *(F.min(F.when(F.col("upto") > place(q), F.col(value))).alias(f"p{q}") for q in percents))


def summary(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 90, 95), average=lambda mean: F.round(mean, 2)) -> DataFrame:
    """Average, least, greatest, count and percentiles per key, as of nearest_rank(), in one reading of df. `average`: what is made of the mean."""
    ranks = _ranked(df, keys, value, percents)
    return ranks.select(*keys, average(F.col("total") / F.col("n")).alias("avg_value"), F.col("least").alias("min_value"), F.col("most").alias("max_value"), "n", *(f"p{q}" for q in percents))


def concurrency(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """summary() of the samples that are not 0, with the whole part of the average; a key whose samples are all 0 has a row of zeros."""
    own = summary(df.where(F.col(value) != 0), keys, value, percents, lambda mean: F.floor(mean).cast("long"))
    every = df.select(*keys).distinct()
    same = functools.reduce(operator.and_, (every[k].eqNullSafe(own[k]) for k in keys))
    return every.join(own, same, "left").select(*(every[k] for k in keys), *(F.coalesce(own[c], F.lit(0).cast(t)).alias(c) for c, t in own.dtypes if c not in keys))
