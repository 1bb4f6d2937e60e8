"""Measurement documents of several JSON shapes -> one long table, its pairing into one row per measurement, and the reports made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_number, first_time
from ..operators.compare import judged
from ..operators.suite import estimates

#: Where each side's documents keep their time, in the order of trust; `section` is the side's block-validation part, a top-level
#: key that ends in SECTION[side]; the last field's unit is milliseconds, or nanoseconds where it ends in _ns.
SECTION = {"core": "core_block_validation", "commons": "commons_block_validation"}
IN_SECTION = {"core": ("primary_comparison.time_per_block_ms", "connect_block_mixed_ecdsa_schnorr.time_per_block_ms"), "commons": ("connect_block.time_per_block_ms",)}
ANYWHERE = ("benchmarks[0].time_ms", "benchmarks[0].time_per_block_ms", "benchmarks[0].time_ns", "time_ms", "time_per_block_ms", "time_ns")
#: Where a two-sided document has its sides, besides its top level.
TWO_SIDED = ("concurrent_operations_fair", "rpc_performance", "memory_efficiency_fair")
#: Names of files that are no measurements; measurements that reports know by another name.
NOT_DOCUMENTS = r"(summary\.json$|consolidated|/history-|/trends-|timeseries\.json$|/history/)"
RENAMED = {"performance-rpc-http": "rpc-performance", "parallel-block-validation-bench": "parallel-block-validation"}
#: The header of the flat report.
CSV_HEADER = ("Benchmark", "Implementation", "Time (ms)", "Time (ns)", "Mean (ns)", "Median (ns)", "Std Dev (ns)", "CI Lower (ns)", "CI Upper (ns)", "Confidence Level", "Ops/sec", "Winner", "Speedup")


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, doc: every JSON file below a folder."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def named(docs: DataFrame) -> DataFrame:
    """file, doc, impl, bench_key, run_ts (from the name's -YYYYmmdd-HHMMSS) of those files (file, doc) whose names say that they are measurements of a side."""
    d = docs.where(~F.col("file").rlike(NOT_DOCUMENTS))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.json$", 1), r"-\d{8}-\d{6}$", "")
    d = d.withColumn("run_ts", F.expr("try_to_timestamp(regexp_extract(file, '-([0-9]{8}-[0-9]{6})[.]json$', 1), 'yyyyMMdd-HHmmss')"))
    d = d.withColumn("impl", F.regexp_extract(stem, "^(core|commons)-", 1)).where("impl <> ''")
    return d.withColumn("bench_key", renamed(F.regexp_replace(stem, "^(core|commons)-", "")))


def renamed(key: Column) -> Column:
    """A measurement's name in reports."""
    key = F.regexp_replace(key, "-fair$", "")
    for old, new in RENAMED.items():
        key = F.when(key == old, new).otherwise(key)
    return key


def scan(spark: SparkSession, path: str) -> DataFrame:
    """named(files(...)): every measurement file below a folder."""
    return named(files(spark, path))


def known_time(doc: Column, impl: str) -> Column:
    """The first place of a side's list that has a number, in milliseconds; 0 counts as one."""
    section = F.get(F.filter(F.json_object_keys(doc), lambda k: k.endswith(SECTION[impl])), F.lit(0))
    inside = [F.call_function("get_json_object", doc, F.concat(F.lit("$."), section, F.lit(f".{p}"))).try_cast("double") for p in IN_SECTION[impl]]
    return F.coalesce(*inside, *(F.get_json_object(doc, f"$.{p}").try_cast("double") / (1e6 if p.endswith("_ns") else 1) for p in ANYWHERE))


def time_of(doc: Column, impl: str) -> Column:
    """known_time; where that is missing or 0, the first positive number under a time-like key at any depth, else the first number between 0 and a million."""
    known = known_time(doc, impl)
    searched = F.when(known.isNull() | (known == 0), doc)  # others are not searched
    return F.coalesce(F.when(known != 0, known), first_time(searched), first_number(searched))


def measurements(docs: DataFrame) -> DataFrame:
    """bench_key, impl, run_ts, file, doc, error, time_ms, of named() files. The newest run of a key and side counts; invalid JSON and error documents have no time."""
    newest = F.max_by(F.struct("run_ts", "file", "doc"), F.struct("run_ts", "file")).alias("m")
    d = docs.groupBy("bench_key", "impl").agg(newest).select("bench_key", "impl", "m.*")
    d = d.withColumn("error", F.when(F.expr("try_parse_json(doc) is null"), "invalid JSON").otherwise(F.get_json_object("doc", "$.error")))
    good = F.when(F.col("error").isNull(), F.col("doc"))
    return d.withColumn("time_ms", F.when(F.col("impl") == "core", time_of(good, "core")).otherwise(time_of(good, "commons")))


def sides(doc: Column) -> Column:
    """core and commons of a two-sided document as JSON texts: a top-level key that is the side's name or ends in _ and that, or such a key in one of the TWO_SIDED parts; {} if none has it."""

    def side(name):
        def under(part):
            own = F.get_json_object(doc, f"$.{part}") if part else doc
            key = F.get(F.filter(F.json_object_keys(own), lambda k: (k == name) | k.endswith(f"_{name}")), F.lit(0))
            return F.call_function("get_json_object", own, F.concat(F.lit("$."), key))

        return F.coalesce(*map(under, ("", *TWO_SIDED)), F.lit("{}"))

    return F.struct(side("core").alias("core"), side("commons").alias("commons"))


def not_empty(doc: Column) -> Column:
    """Whether a JSON text is an object with a key."""
    return F.coalesce(F.size(F.json_object_keys(doc)) > 0, F.lit(False))


def _sided(rows: DataFrame, **parts: Column) -> DataFrame:
    """One row per bench_key: both sides' times (null where a side is missing), winner, speedup, and for each part a column {side}_{part} of that side."""
    parts = {"time_ms": F.col("time_ms"), **parts}
    own = [F.max(F.when(F.col("impl") == s, c)).alias(f"{s}_{name}") for s in SECTION for name, c in parts.items()]  # a row for each key and side
    return judged(rows.groupBy("bench_key").agg(*own))


def consolidated(rows: DataFrame) -> DataFrame:
    """One row per bench_key of measurements() with both sides' times (null where a side is missing), winner and speedup."""
    return _sided(rows)


def report_entries(rows: DataFrame) -> DataFrame:
    """bench_key and entry: a measurement's part of the consolidated report as JSON, in order of key. rows: measurements(). Fields without a value are left out."""
    part = F.struct("time_ms", F.col("file").alias("source_file"), "error", F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    d = _sided(rows, part=part)
    comparison = F.when(F.col("winner").isNotNull(), F.struct("winner", "speedup", "core_time_ms", "commons_time_ms"))
    entry = F.struct(F.col("bench_key").alias("name"), F.col("core_part").alias("core"), F.col("commons_part").alias("commons"), comparison.alias("comparison"))
    return d.select("bench_key", F.to_json(entry).alias("entry")).orderBy("bench_key")


def report_summary(rows: DataFrame) -> DataFrame:
    """One row: how many measurements there are, of each side, and how many can be compared."""
    d = _sided(rows, there=F.lit(1))
    return d.agg(F.count("*").alias("total_benchmarks"), F.count("core_there").alias("core_benchmarks"), F.count("commons_there").alias("commons_benchmarks"), F.count("winner").alias("comparisons"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The flat report (CSV_HEADER) of measurements(): a row per side, and one for the comparison where there is one. Statistics are those of the first case in a document's list."""
    statistics = F.get_json_object("doc", "$.benchmarks[0].statistics")
    spread = F.get_json_object(statistics, "$.std_dev").try_cast("double")
    ns = F.coalesce(F.get_json_object("doc", "$.benchmarks[0].time_ns").try_cast("double"), F.col("time_ms") * 1e6)
    none = F.lit(None).cast("double")
    names = ("key", "side", "ms", "ns", "mean", "median", "std_dev", "low", "high", "level", "ops", "winner", "speedup")
    row = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    mean = F.col("s.mean.confidence_interval")
    side = row(
        F.col("bench_key"), F.initcap("impl"), F.col("time_ms"), ns, F.col("s.mean.point_estimate"), F.col("s.median.point_estimate"), F.coalesce("s.std_dev", spread), mean["lower_bound"], mean["upper_bound"], mean["confidence_level"],
        F.when(F.col("time_ms") > 0, F.round(1000 / F.col("time_ms"), 2)), F.lit(None).cast("string"), none,
    )
    d = _sided(rows.withColumn("s", estimates(statistics)), row=side)
    comparison = F.when(F.col("winner").isNotNull(), row(F.col("bench_key"), F.lit("Comparison"), *[none] * 9, F.col("winner"), F.col("speedup")))
    return d.select(F.inline(F.array_compact(F.array("core_row", "commons_row", comparison)))).toDF(*CSV_HEADER)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line: text files line by line, numbered."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return d.where("line <> ''")


def key_values(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """`key=value` lines (file, line), a row per file with a column per wanted key; comments (#) are skipped, files without all keys are left out."""
    d = lines.select("file", F.trim("line").alias("line")).where("line not like '#%' and line like '%=%'")
    d = d.select("file", F.trim(F.split("line", "=", 2)[0]).alias("k"), F.trim(F.split("line", "=", 2)[1]).alias("v"))
    return d.groupBy("file").agg(*(F.max(F.when(F.col("k") == w, F.col("v"))).alias(w) for w in wanted)).dropna(subset=wanted)


def settings(texts: DataFrame) -> DataFrame:
    """file, section, key, value of configuration files (file, text): `key = value` lines below `[section]` lines ("" before the first), quotes and comments taken off."""
    part = F.split(F.concat(F.lit("[]\n"), F.col("text")), r"(?m)^\s*\[(?=[^\]\n]*\]\s*$)")
    d = texts.select("file", F.posexplode(part).alias("n", "part")).where("n > 0")
    d = d.select("file", F.regexp_extract("part", r"^([^\]\n]*)\]", 1).alias("section"), F.explode(F.split("part", "\n")).alias("line"))
    pattern = r"^\s*([A-Za-z0-9_.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^#]*?))\s*(?:#.*)?$"
    value = F.concat(*(F.regexp_extract("line", pattern, i) for i in (2, 3, 4)))
    return d.where(F.col("line").rlike(pattern)).select("file", "section", F.regexp_extract("line", pattern, 1).alias("key"), value.alias("value"))


def counters(lines: DataFrame, events: dict[str, str], first: bool = False) -> DataFrame:
    """Counter lines (file, n, line: `value,unit,event`): a row per file with a column for each name -> part of the event's name; what is no number is 0.

    Of several lines of an event the greatest counts, or with `first` the first one (by n) that starts with a number."""
    d = lines.select("file", "n", F.split("line", ",").alias("c"))
    d = d.select("file", "n", F.expr("try_cast(get(c, 0) as bigint)").alias("v"), F.array_join(F.slice("c", 2, 9), ",").alias("event"))
    of = lambda part: F.contains("event", F.lit(part))
    if first:
        return d.groupBy("file").agg(*(F.min_by(F.when(of(p), F.col("v")), F.when(of(p) & F.col("v").isNotNull(), F.col("n"))).alias(name) for name, p in events.items()))
    return d.groupBy("file").agg(*(F.max(F.when(of(p), F.coalesce("v", F.lit(0)))).alias(name) for name, p in events.items()))


def nanobench(doc: Column) -> Column:
    """Statistics of the first case of a results document (a list, or an object whose `results` is one): bounds at 95% and 105% of the median, one spread; null if it has none."""
    case = F.coalesce(F.get_json_object(doc, "$[0]"), F.get_json_object(doc, "$.results[0]"))
    get = lambda k: F.get_json_object(case, f"$['{k}']").try_cast("double")
    median = F.coalesce(get("median(elapsed)"), F.lit(0.0))
    spread = F.coalesce(get("medianAbsolutePercentError(elapsed)"), F.lit(0.0)) * median / 100
    mean = F.coalesce(get("median(elapsed)"), get("mean(elapsed)"), F.lit(0.0))
    own = F.struct(mean.alias("mean"), median.alias("median"), (median * 0.95).alias("lower_bound"), (median * 1.05).alias("upper_bound"), F.lit(0.95).alias("confidence_level"), spread.alias("standard_error"), spread.alias("std_dev"), spread.alias("median_abs_dev"), get("min(elapsed)").alias("min"), get("max(elapsed)").alias("max"), get("epochs").cast("long").alias("sample_count"))
    return F.when(case.isNotNull(), own)
