"""Suites of measurements: speed classes, categories of names, run summaries, statistics of a measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measurements of each speed class; any other is medium.
SPEED = {
    "fast": "block-validation-bench transaction-validation-bench mempool-operations-bench ripemd160-bench base58-bech32-bench duplicate-inputs-bench transaction-id-bench hash-micro-bench merkle-root-bench standard-tx-bench transaction-sighash-bench script-verification-bench utxo-caching-bench mempool-acceptance-bench mempool-bench".split(),
    "medium": "block-serialization-bench transaction-serialization-bench compact-block-encoding-bench mempool-rbf-bench segwit-bench performance-rpc-http memory-efficiency-fair concurrent-operations-fair block-assembly-bench connectblock-bench merkle-tree-bench merkle-tree-precomputed-bench parallel-block-validation-bench".split(),
    "slow": "deep-analysis-bench node-sync-rpc-bench".split(),
}
#: Categories of names; a name may be in several.
CATEGORIES = {"mempool": "mempool|complex", "transaction": "transaction|tx", "block": "block|connect", "script": "script|verify", "hash": "hash|sha|ripemd|merkle", "encoding": "base58|bech32|encode|decode", "utxo": "utxo|coin"}


def speed_of(name) -> Column:
    """The class of a measurement, whichever side its name starts with."""
    base = F.regexp_replace(F.regexp_replace(name, "^core-", ""), "^commons-", "")
    out = F.lit("medium")
    for speed in ("fast", "slow"):
        out = F.when(base.isin(SPEED[speed]), speed).otherwise(out)
    return out


def of_class(speed: str) -> list[str]:
    """All measurements of a class in order."""
    return sorted(SPEED.get(speed, []))


def selected(df: DataFrame, name: str, which: str) -> DataFrame:
    """The measurements that a suite runs: all of them, those of one side, or (fair, fair-fast) those that belong to a side."""
    sides = {"all": "", "fair": "^(core|commons)-", "fair-fast": "^(core|commons)-", "core-only": "^core-", "commons-only": "^commons-"}
    if which not in sides:
        raise ValueError(f"no suite {which}")
    return df.where(F.col(name).rlike(sides[which])) if sides[which] else df


def categories(name, table: dict[str, str] = CATEGORIES) -> Column:
    """An array of the categories that fit a name, in the table's order; letters fit in either case."""
    return F.array_compact(F.array(*(F.when(F.col(name).rlike(f"(?i){p}"), F.lit(c)) for c, p in table.items())))


def run_summary(df: DataFrame, name: str, done: Column) -> DataFrame:
    """One row for a suite's run: how many measurements were completed and failed, and their names in order (names are a suite's, not data)."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(name))))
    return df.agg(F.count_if(done).alias("benchmarks_completed"), F.count_if(~done).alias("benchmarks_failed"), names(done).alias("completed"), names(~done).alias("failed"))


def estimates(doc) -> Column:
    """The statistics of an estimates document; what it lacks is null. Percentiles may be named "0.75" or p75."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(doc, p).try_cast("double") for p in paths))

    def point(k):
        ci = f"$.{k}.confidence_interval"
        interval = F.struct(get(f"{ci}.lower_bound").alias("lower_bound"), get(f"{ci}.upper_bound").alias("upper_bound"), get(f"{ci}.confidence_level").alias("confidence_level"))
        return F.struct(get(f"$.{k}.point_estimate").alias("point_estimate"), interval.alias("confidence_interval"), get(f"$.{k}.standard_error").alias("standard_error")).alias(k)

    tail = [get(f"$.percentiles['{q}']", f"$.percentiles.{p}").alias(p) for p, q in (("p75", "0.75"), ("p90", "0.90"), ("p95", "0.95"), ("p99", "0.99"), ("p999", "0.999"))]
    single = [get(f"$.{k}.point_estimate").alias(k) for k in ("std_dev", "median_abs_dev", "min", "max")]
    return F.struct(point("mean"), point("median"), F.struct(get("$.median.point_estimate").alias("p50"), *tail).alias("percentiles"), *single, get("$.sample_count").cast("long").alias("sample_count"))


def synthetic(median: Column, error_percent: Column) -> Column:
    """Statistics made of a median and its median absolute error in percent: bounds at 95% and 105%, one spread for all."""
    spread = median * error_percent / 100
    return F.struct(median.alias("median"), (median * 0.95).alias("lower_bound"), (median * 1.05).alias("upper_bound"), F.lit(0.95).alias("confidence_level"), spread.alias("standard_error"), spread.alias("std_dev"), spread.alias("median_abs_dev"))


def rates(df: DataFrame) -> DataFrame:
    """Adds instructions a cycle, and misses of caches and branches in percent; null where the divisor is 0."""
    percent = lambda a, b: F.try_divide(F.col(a) * 100.0, F.when(F.col(b) > 0, F.col(b)))
    ipc = F.try_divide(F.col("instructions").cast("double"), F.when(F.col("cycles") > 0, F.col("cycles")))
    return df.withColumn("ipc", ipc).withColumn("cache_miss_percent", percent("cache_misses", "cache_references")).withColumn("branch_miss_percent", percent("branch_misses", "branches"))


#: Which cases of a suite of measurements each measurement runs (patterns of case names), where not all of them.
FILTERS = {"base58-bech32": "Base58|Bech32|GCSFilterDecode", "block-assembly": "AssembleBlock", "block-serialization": "BlockToJsonVerboseWrite|DeserializeAndCheckBlockTest|DeserializeBlockTest", "block-validation": "ConnectBlockAllSchnorr|ConnectBlockMixedEcdsaSchnorr|ConnectBlockAllEcdsa", "compact-block-encoding": "BlockEncoding", "duplicate-inputs": "DuplicateInputs", "mempool-operations": "ComplexMemPool|MempoolCheck|MempoolEviction|MempoolAccept", "merkle-tree": "MerkleRoot", "ripemd160": "BenchRIPEMD160", "script-verification": "VerifyScriptBench|VerifyNestedIfScript", "segwit": "ConnectBlock", "transaction-id": "TransactionIdCalculation", "transaction-serialization": "TransactionSerialization", "transaction-sighash": "TransactionSighashCalculation", "transaction-validation": "DeserializeAndCheckBlockTest", "utxo-caching": "CCoinsCaching|UTXOGet|UTXOInsert|UTXORemove"}


def filter_table(spark, filters: dict[str, str] = FILTERS) -> DataFrame:
    """measurement, pattern: a row for each entry."""
    return spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in filters.items() for x in kv))).alias("measurement", "pattern"))


def cases_of(cases: DataFrame, name: str, filters: DataFrame, most: int | None = None) -> DataFrame:
    """measurement and case: the distinct case names that each measurement's pattern fits; with `most`, the first so many in order of name. Names are a suite's, not data."""
    found = cases.select(F.col(name).alias("case")).where("case is not null").distinct()
    found = found.join(F.broadcast(filters), F.rlike("case", F.col("pattern"))).groupBy("measurement").agg(F.sort_array(F.collect_list("case")).alias("cases"))
    return found.select("measurement", F.explode(F.slice("cases", 1, most) if most else F.col("cases")).alias("case"))


def best_known(estimate: Column, shown: Column) -> Column:
    """A case's time from its estimates, or, where they lack it or say 0, the one that was shown; 0 if neither has one."""
    return F.coalesce(F.when(estimate != 0, estimate), F.when(shown != 0, shown), F.lit(0.0))
