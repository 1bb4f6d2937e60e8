"""Side-by-side comparison, regression classes and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair(df: DataFrame, key: str, side: Column, value: str, sides: tuple[str, str] = ("core", "commons")) -> DataFrame:
    """One row per key with the average of each side (null where it has none): a full outer pairing in one aggregation."""
    return df.groupBy(key).agg(*(F.round(F.avg(F.when(side == s, F.col(value))), 4).alias(f"{s}_time_ms") for s in sides))


def judged(df: DataFrame, a: str = "core_time_ms", b: str = "commons_time_ms") -> DataFrame:
    """Adds the faster side and its speedup; a tie is the first side's. Null where not both times are positive."""
    first, second = F.col(a), F.col(b)
    both = (first > 0) & (second > 0)
    return df.withColumn("winner", F.when(both, F.when(first > second, "commons").otherwise("core"))).withColumn("speedup", F.when(both, F.round(F.greatest(first, second) / F.least(first, second), 2)))


def winner(df: DataFrame, a: str = "core_time_ms", b: str = "commons_time_ms") -> DataFrame:
    """judged() rows whose times are both positive."""
    return judged(df.where((F.col(a) > 0) & (F.col(b) > 0)), a, b)


def regressions(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, threshold: float = 0.10) -> DataFrame:
    """current and baseline values of the keys that both have, change_percent (two places), status and speedup.

    The change is rounded before it meets the threshold, and must exceed it."""
    j = current.select(*keys, F.col(value).alias("current_value")).join(baseline.select(*keys, F.col(value).alias("baseline_value")), keys)
    j = j.where((F.col("baseline_value") > 0) & F.col("current_value").isNotNull())
    j = j.withColumn("change_percent", F.round((F.col("current_value") - F.col("baseline_value")) / F.col("baseline_value") * 100, 2))
    status = F.when(F.col("change_percent") > threshold * 100, "regression").when(F.col("change_percent") < -threshold * 100, "improvement").otherwise("unchanged")
    return j.withColumn("status", status).withColumn("speedup", F.when(F.col("status") != "unchanged", F.round(F.try_divide("baseline_value", "current_value"), 2)))


def trend(df: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """First and last value by (ts, tie), and the change in percent, as it is, where both are positive."""
    at = F.struct(ts, tie)
    t = df.groupBy(*keys).agg(F.count("*").alias("data_points"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    return t.withColumn("change_percent", F.when((F.col("first_value") > 0) & (F.col("last_value") > 0), (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100))


def speedup_text(ratio: Column) -> Column:
    """A ratio as `0.88x`; null stays null."""
    return F.concat(F.round(ratio, 2).cast("decimal(38,2)").cast("string"), F.lit("x"))


def regression_document(report: DataFrame, threshold: float = 0.10) -> DataFrame:
    """One row with the report as JSON: its threshold in percent, counts by status, and the rows of each status in order of their keys.

    report: regressions(). The lists are a suite's measurements, not data."""
    keys = [c for c in report.columns if c not in ("current_value", "baseline_value", "change_percent", "status", "speedup")]
    row = F.struct(*keys, F.col("baseline_value").alias("baseline_time_ms"), F.col("current_value").alias("current_time_ms"), "change_percent", speedup_text(F.col("speedup")).alias("speedup"))
    names = {"regression": "regressions", "improvement": "improvements", "unchanged": "unchanged"}
    lists = [F.sort_array(F.collect_list(F.when(F.col("status") == s, row))).alias(n) for s, n in names.items()]
    counts = F.struct(*(F.size(n).alias(n) for n in names.values())).alias("summary")
    return report.agg(*lists).select(F.to_json(F.struct(F.lit(threshold * 100).alias("regression_threshold_percent"), counts, *names.values())).alias("report"))


def history_point(doc: Column) -> Column:
    """core_time_ms and commons_time_ms of a consolidated entry: of the first case in each side's list, else the side's own."""
    of = lambda s: F.coalesce(F.get_json_object(doc, f"$.{s}.benchmarks[0].time_ms"), F.get_json_object(doc, f"$.{s}.time_ms")).try_cast("double")
    return F.struct(of("core").alias("core_time_ms"), of("commons").alias("commons_time_ms"))


def entry_time(doc: Column) -> Column:
    """The time that a regression check compares of a consolidated entry: the comparison's, else a case's, else a side's own; the first side before the second each time."""
    paths = [f"$.{p}" for p in ("comparison.core.time_ms", "comparison.commons.time_ms", "core.benchmarks[0].time_ms", "commons.benchmarks[0].time_ms", "core.time_ms", "commons.time_ms")]
    return F.coalesce(*(F.get_json_object(doc, p).try_cast("double") for p in paths))


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds position: a row's place (from 0) among those of its keys in the order that they were appended in.

    Days of the first order column are counted, the counts are summed over the days, and places are given in each day, so that a long series is not sorted in one task."""
    from pyspark.sql import Window

    d = df.withColumn("i_day", F.to_date(order[0]))
    days = d.groupBy(*keys, "i_day").agg(F.count("*").alias("i_n"))
    days = days.withColumn("i_base", F.coalesce(F.sum("i_n").over(Window.partitionBy(*keys).orderBy("i_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("i_n")
    d = d.withColumn("i_at", F.row_number().over(Window.partitionBy(*keys, "i_day").orderBy(*order)) - 1)
    return d.join(days, [*keys, "i_day"]).withColumn("position", F.col("i_base") + F.col("i_at")).drop("i_day", "i_at", "i_base")
