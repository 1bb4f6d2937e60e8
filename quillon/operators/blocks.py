"""Ordered records: chunks, checkpoints, verdicts, spends, and folds with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_of(height: Column, size: int, start: int = 0) -> Column:
    return F.floor((height - start) / size).cast("long")


def clamp_range(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The part of start..end that lies in low..high, as a struct; null if there is none. A null bound does not bind."""
    a, b = F.greatest(start, low), F.least(end, high)
    return F.when(a <= b, F.struct(a.alias("start"), b.alias("end")))


def with_height(df: DataFrame, *order: str, start: int = 0, rows_per_range: int = 1 << 20) -> DataFrame:
    """Adds height: each row's place in the order, from `start`.

    The first order column must be a whole number: rows are counted in ranges of it, the counts are summed over the ranges, and places are given in
    each range, so that no task sorts the whole table."""
    d = df.withColumn("h_range", F.floor(F.col(order[0]) / rows_per_range))
    w = Window.orderBy("h_range").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("h_range").agg(F.count("*").alias("h_n")).select("h_range", F.coalesce(F.sum("h_n").over(w), F.lit(0)).alias("h_base"))
    d = d.withColumn("h_at", F.row_number().over(Window.partitionBy("h_range").orderBy(*order)))
    return d.join(base, "h_range").withColumn("height", F.col("h_base") + F.col("h_at") - 1 + start).drop("h_range", "h_at", "h_base")


def slice_heights(df: DataFrame, first: int, last: int, *order: str, every: int = 0, rows_per_range: int = 1 << 20) -> DataFrame:
    """The rows of heights first..last (inclusive; with `every`, only each such height), with height. Ranges are counted first, and only the rows of ranges that hold wanted heights are sorted."""
    d = df.withColumn("h_range", F.floor(F.col(order[0]) / rows_per_range))
    counts = d.groupBy("h_range").agg(F.count("*").alias("h_n"))
    w = Window.orderBy("h_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.withColumn("h_base", F.coalesce(F.sum("h_n").over(w), F.lit(0)))
    d = d.join(counts.where((F.col("h_base") <= last) & (F.col("h_base") + F.col("h_n") > first)), "h_range")
    d = d.withColumn("height", F.col("h_base") + F.row_number().over(Window.partitionBy("h_range").orderBy(*order)) - 1)
    d = d.where(F.col("height").between(first, last)).drop("h_range", "h_n", "h_base")
    return d.where(F.col("height") % every == 0) if every else d


def spend_verdicts(outputs: DataFrame, spends: DataFrame, *key: str) -> DataFrame:
    """Each spend (key, height) with valid: its output (key, height) exists from a lower height, and no spend of a lower height, nor an earlier one of this height, took it.

    Keys name one output at most. Several spends of one height are in order of `at`."""
    first = spends.groupBy(*key).agg(F.min(F.struct("height", "at")).alias("f_first"))
    made = outputs.select(*key, F.col("height").alias("f_made"))
    d = spends.join(made, list(key), "left").join(first, list(key))
    ok = (F.col("f_made") < F.col("height")) & (F.struct("height", "at") == F.col("f_first"))
    return d.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("f_made", "f_first")


def output_set(outputs: DataFrame, spends: DataFrame, *key: str, size: int, parity: bool = False) -> DataFrame:
    """chunk, unspent: how many outputs are unspent at the end of each chunk of `size` heights, as a fold over the heights in order would have it.

    A height with an invalid spend ends the fold: later chunks have no row, and its own one the state before it. With `parity` the state goes on over invalid spends, which take nothing.
    """
    verdicts = spend_verdicts(outputs, spends, *key)
    made, taken = outputs.select("height", F.lit(1).alias("n")), verdicts.where("valid").select("height", F.lit(-1).alias("n"))
    steps = made.union(taken)
    if not parity:
        stop = verdicts.where("not valid").agg(F.min("height").alias("stop"))  # one row
        steps = steps.where(F.coalesce(F.col("height") < stop.scalar(), F.lit(True)))
    chunks = steps.groupBy(chunk_of(F.col("height"), size).alias("chunk")).agg(F.sum("n").alias("n"))
    return chunks.select("chunk", F.sum("n").over(Window.orderBy("chunk")).alias("unspent"))  # a row per chunk


def validate_chunks(df: DataFrame, height: str, size: int, first: int = 5) -> DataFrame:
    """chunk, tested, matched, divergences and the heights of the `first` divergences of each chunk of `size` heights. df: verdict_match(); a null verdict fails its
    chunk, which then has `failed` true and no counts, and no chunk waits for another."""
    d = df.withColumn("chunk", chunk_of(F.col(height), size))
    d = d.groupBy("chunk").agg(F.bool_or(F.col("matches").isNull()).alias("failed"), F.count("*").alias("t"), F.count_if("matches").alias("m"), F.array_sort(F.collect_list(F.when(~F.col("matches"), F.col(height)))).alias("h"))
    own = lambda c: F.when(~F.col("failed"), c)
    return d.select("chunk", "failed", own(F.col("t")).alias("tested"), own(F.col("m")).alias("matched"), own(F.col("t") - F.col("m")).alias("divergences"), own(F.slice("h", 1, first)).alias("first_divergences"))


def running_rate(df: DataFrame, key: str, ts: str, tie: str, rows: int = 100) -> DataFrame:
    """Adds in_window and seconds (rows and time of the last `rows` rows of a key), per_second of these, running (rows so far) and total_per_second since the key's first row; null within the first moment."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    last = w.rowsBetween(1 - rows, 0)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    d = df.withColumn("in_window", F.count("*").over(last)).withColumn("seconds", F.round(at - F.min(at).over(last), 6)).withColumn("running", F.row_number().over(w).cast("long"))
    since = F.round(at - F.min(at).over(w), 6)
    per = lambda n, s: F.round(F.try_divide(n, F.when(s > 0, s)), 9)
    return d.withColumn("per_second", per(F.col("in_window"), F.col("seconds"))).withColumn("total_per_second", per(F.col("running"), since))


def fold_groups(df: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """A running set of unspent amounts per key, as a stateful fold over each key's rows in order: last state and rejected steps.

    Rows are sorted by Spark and stream through the fold: a key of any size is held as its state alone."""

    def fold(frames):
        at, steps, rejected, state = None, 0, 0, 0.0
        done = []
        for pdf in frames:
            for k, x in zip(pdf[key].tolist(), pdf[amount].tolist(), strict=True):
                if steps and k != at:
                    done.append((at, steps, rejected, round(state, 4)))
                    steps, rejected, state = 0, 0, 0.0
                at, steps = k, steps + 1
                if state + x < 0:
                    rejected += 1
                else:
                    state += x
            yield pd.DataFrame(done, columns=[key, "steps", "rejected", "state"])
            done = []
        if steps:
            yield pd.DataFrame([(at, steps, rejected, round(state, 4))], columns=[key, "steps", "rejected", "state"])

    rows = df.select(key, order, amount).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(fold, f"{key} {dict(df.dtypes)[key]}, steps long, rejected long, state double")


def verdict_match(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Adds matches: both verdicts valid or both not; reasons do not count."""
    return df.withColumn("a_valid", a).withColumn("b_valid", b).withColumn("matches", a == b)


def divergence(reason: Column) -> Column:
    """What a divergence says: which side accepts, which rejects, and why. For rows of verdict_match() that do not match."""
    return F.concat(F.when(F.col("a_valid"), "a accepts, b rejects: ").otherwise("a rejects, b accepts: "), reason)
