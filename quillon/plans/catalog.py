"""The registered queries: each an operator over whole tables, beside its DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import blocks, cache, compare, headers, latency, suite
from ..sources import frames
from ..sources import text as lines
from ..streaming import chunks as stream

_QUERIES, _SQL = {}, {}
IMPL_SQL = "CASE WHEN user_id % 2 = 0 THEN 'core' ELSE 'commons' END"
HALF = "2024-01-16"
NR = "list_sort(list({v}))[least(count(*) * {q} // 100, count(*) - 1)::INT + 1]"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def runs(self):
        """events with the side that each was measured on."""
        return self.events.withColumn("impl", F.when(F.col("user_id") % 2 == 0, "core").otherwise("commons"))


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _nr(v, *qs):
    return ", ".join(f"{NR.format(v=v, q=q)} AS p{q}" for q in qs)


# latency


@query(f"SELECT event_type, round(avg(value), 2) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n, {_nr('value', 50, 90, 95)} FROM events GROUP BY event_type")
def latency_summary(t):
    return latency.summary(t.events, ["event_type"], "value")


@query(f"SELECT user_id % 3 AS level, floor(avg(value))::BIGINT AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n, {_nr('value', 50, 95, 99)} FROM events WHERE value <> 0 GROUP BY 1")
def latency_nonzero_levels(t):
    return latency.concurrency(t.events.withColumn("level", F.col("user_id") % 3), ["level"], "value")


# comparison

_PAIR = f"SELECT event_type, round(avg(CASE WHEN {IMPL_SQL} = 'core' THEN value END), 4) AS core_time_ms, round(avg(CASE WHEN {IMPL_SQL} = 'commons' THEN value END), 4) AS commons_time_ms FROM events GROUP BY event_type"


@query(_PAIR)
def pair_impl(t):
    return compare.pair(t.runs, "event_type", F.col("impl"), "value")


@query(f"SELECT *, CASE WHEN core_time_ms > commons_time_ms THEN 'commons' ELSE 'core' END AS winner, round(greatest(core_time_ms, commons_time_ms) / least(core_time_ms, commons_time_ms), 2) AS speedup FROM ({_PAIR}) WHERE core_time_ms > 0 AND commons_time_ms > 0")
def winner_speedup(t):
    return compare.winner(pair_impl(t))


def _periods(t):
    avg = lambda d: d.groupBy("event_type", "impl").agg(F.round(F.avg("value"), 4).alias("v"))
    return avg(t.runs.where(f"ts >= '{HALF}'")), avg(t.runs.where(f"ts < '{HALF}'"))


_REG = f"""SELECT *, CASE WHEN status <> 'unchanged' THEN round(baseline_value / current_value, 2) END AS speedup FROM (
SELECT *, CASE WHEN change_percent > 10 THEN 'regression' WHEN change_percent < -10 THEN 'improvement' ELSE 'unchanged' END AS status FROM (
SELECT event_type, impl, c.v AS current_value, b.v AS baseline_value, round((c.v - b.v) / b.v * 100, 2) AS change_percent FROM
(SELECT event_type, {IMPL_SQL} AS impl, round(avg(value), 4) AS v FROM events WHERE ts >= '{HALF}' GROUP BY ALL) c JOIN
(SELECT event_type, {IMPL_SQL} AS impl, round(avg(value), 4) AS v FROM events WHERE ts < '{HALF}' GROUP BY ALL) b USING (event_type, impl) WHERE b.v > 0))"""


@query(_REG)
def regression_report(t):
    return compare.regressions(*_periods(t), ["event_type", "impl"], "v")


@query(f"SELECT status, count(*) AS n FROM ({_REG}) GROUP BY status")
def regression_summary(t):
    return regression_report(t).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS data_points, arg_min(value, {'t': ts, 'e': event_id}) AS first_value, arg_max(value, {'t': ts, 'e': event_id}) AS last_value, CASE WHEN arg_min(value, {'t': ts, 'e': event_id}) > 0 AND arg_max(value, {'t': ts, 'e': event_id}) > 0 THEN (arg_max(value, {'t': ts, 'e': event_id}) - arg_min(value, {'t': ts, 'e': event_id})) / arg_min(value, {'t': ts, 'e': event_id}) * 100 END AS change_percent FROM events GROUP BY event_type")
def trend_first_last(t):
    return compare.trend(t.events, ["event_type"], "ts", "event_id", "value")


@query(f"SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(CASE WHEN {IMPL_SQL} = 'core' THEN value END), 9) AS core_time_ms, round(avg(CASE WHEN {IMPL_SQL} = 'commons' THEN value END), 9) AS commons_time_ms FROM events GROUP BY ALL")
def series_points(t):
    d = t.runs.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return d.groupBy("event_type", "day").agg(*(F.round(F.avg(F.when(F.col("impl") == s, F.col("value"))), 9).alias(f"{s}_time_ms") for s in ("core", "commons")))


# windows, chunks, verdicts


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS in_window, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events")
def running_rate(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.count("*").over(w.rowsBetween(-99, 0)).alias("in_window"), F.row_number().over(w).cast("long").alias("running"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_linenumber = lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) + 1, true) AS linked FROM lineitem")
def lag_integrity(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.col("l_linenumber") == F.lag("l_linenumber").over(w) + 1, F.lit(True)).alias("linked"))


def _heights(t):
    return blocks.with_height(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", rows_per_range=4096)


_H = "(SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS height FROM orders)"


@query(f"SELECT o_orderkey, height FROM {_H}")
def assign_height(t):
    return _heights(t).select("o_orderkey", "height")


@query(f"SELECT o_orderkey, height FROM {_H} WHERE height % 100 = 0 OR height = 1")
def every_nth(t):
    """Progress of a range: its second row and each hundredth one."""
    d = t.orders.select("o_orderkey")
    pick = lambda first, last, **kw: blocks.slice_heights(d, first, last, "o_orderkey", rows_per_range=4096, **kw)
    return pick(0, 1 << 62, every=100).union(pick(1, 1)).select("o_orderkey", "height")


@query(f"SELECT height // 1000 AS chunk, min(height) AS start_height, max(height) AS end_height, count(*) AS tested FROM {_H} GROUP BY 1")
def chunk_assign(t):
    d = _heights(t).withColumn("chunk", blocks.chunk_of(F.col("height"), 1000))
    return d.groupBy("chunk").agg(F.min("height").alias("start_height"), F.max("height").alias("end_height"), F.count("*").alias("tested"))


@query("SELECT sum(tested)::BIGINT AS tested, sum(matched)::BIGINT AS matched, round(sum(tested) / sum(seconds), 4) AS per_second FROM (SELECT o_orderkey // 1000 AS c, count(*) AS tested, count(CASE WHEN o_totalprice > 50000 THEN 1 END) AS matched, (1 + o_orderkey // 1000 % 7)::DOUBLE AS seconds FROM orders GROUP BY ALL)")
def chunk_summary(t):
    d = t.orders.groupBy(blocks.chunk_of(F.col("o_orderkey"), 1000).alias("c")).agg(F.count("*").alias("tested"), F.count_if(F.col("o_totalprice") > 50000).alias("matched"))
    d = d.withColumn("seconds", (1 + F.col("c") % 7).cast("double"))
    return d.agg(F.sum("tested").alias("tested"), F.sum("matched").alias("matched"), F.round(F.sum("tested") / F.sum("seconds"), 4).alias("per_second"))


@query(f"SELECT o_orderkey FROM {_H} WHERE height BETWEEN 250 AND 749")
def range_slice(t):
    return blocks.slice_heights(t.orders.select("o_orderkey"), 250, 749, "o_orderkey", rows_per_range=4096).select("o_orderkey")


@query(f"SELECT chunk, (sum(n) OVER (ORDER BY chunk))::BIGINT AS upto FROM (SELECT height // 1000 AS chunk, count(*) AS n FROM {_H} GROUP BY 1)")
def checkpoint_cumulative(t):
    return chunk_assign(t).select("chunk", F.sum("tested").over(Window.orderBy("chunk")).alias("upto"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def utxo_unspent(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice > 100000)")
def missing_inputs(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")


_VERDICT = "(SELECT o_orderkey, o_totalprice > 30000 AS a_valid, coalesce(s, 0) > 40000 AS b_valid, (o_totalprice > 30000) = (coalesce(s, 0) > 40000) AS matches FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query(f"SELECT * FROM {_VERDICT}")
def verdict_match(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    j = t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return blocks.verdict_match(j, F.col("o_totalprice") > 30000, F.coalesce("s", F.lit(0)) > 40000).select("o_orderkey", "a_valid", "b_valid", "matches")


@query(f"SELECT o_orderkey, CASE WHEN a_valid THEN 'b rejects' ELSE 'a rejects' END AS description FROM {_VERDICT} WHERE NOT matches ORDER BY o_orderkey LIMIT 10")
def divergences_topk(t):
    return verdict_match(t).where("not matches").orderBy("o_orderkey").limit(10).select("o_orderkey", F.when(F.col("a_valid"), "b rejects").otherwise("a rejects").alias("description"))


@query(f"SELECT count(*) AS total, count(CASE WHEN a_valid THEN 1 END) AS passed, count(CASE WHEN NOT a_valid THEN 1 END) AS failed, count(CASE WHEN matches THEN 1 END) AS matches, count(CASE WHEN NOT matches THEN 1 END) AS divergences FROM {_VERDICT}")
def diff_test_summary(t):
    c = F.count_if
    return verdict_match(t).agg(F.count("*").alias("total"), c("a_valid").alias("passed"), c(~F.col("a_valid")).alias("failed"), c("matches").alias("matches"), c(~F.col("matches")).alias("divergences"))


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_rows(t):
    return t.documents.groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


# names, classes, categories

#: Fixed classes of this catalogue's names; any other is medium.
CLASSES = {"click": "fast", "view": "fast", "purchase": "slow"}


@query("SELECT event_type, coalesce(speed, 'medium') AS speed FROM (SELECT DISTINCT event_type FROM events) LEFT JOIN (VALUES ('click', 'fast'), ('view', 'fast'), ('purchase', 'slow')) c(event_type, speed) USING (event_type)")
def speed_class(t):
    dim = t.spark.createDataFrame(sorted(CLASSES.items()), "event_type string, speed string")
    return t.events.select("event_type").distinct().join(F.broadcast(dim), "event_type", "left").withColumn("speed", F.coalesce("speed", F.lit("medium")))


_TAGS = {"sized": "small|medium|large", "small": "small", "large": "large", "cheap": "econ|promo", "none": "steel"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS category, count(*) AS n FROM part WHERE regexp_matches(p_type, '(?i){v}') HAVING count(*) > 0" for k, v in _TAGS.items()))
def category_counts(t):
    tags = F.array_compact(F.array(*(F.when(F.col("p_type").rlike(f"(?i){v}"), F.lit(k)) for k, v in _TAGS.items())))
    return t.part.select(F.explode(tags).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_type FROM part")
def distinct_names(t):
    return t.part.select("p_type").distinct()


@query("SELECT regexp_replace(regexp_replace(c_name, '[0-9]+$', ''), '#$', '') AS key, count(*) AS n FROM customer GROUP BY 1")
def key_derive(t):
    return t.customer.groupBy(F.regexp_replace(F.regexp_replace("c_name", "[0-9]+$", ""), "#$", "").alias("key")).agg(F.count("*").alias("n"))


# JSON, numbers, units


@query("SELECT event_id, coalesce(json_extract_string(props, '$.zz'), json_extract_string(props, '$.k')) AS v FROM events")
def json_coalesce(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.zz"), F.get_json_object("props", "$.k")).alias("v"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_entries(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))


@query("SELECT count(*) AS docs, count(CASE WHEN NOT json_valid(props) THEN 1 END) AS errors, count(CASE WHEN json_extract_string(props, '$.timestamp') IS NULL THEN 1 END) AS no_timestamp FROM events")
def json_quality(t):
    return t.events.agg(F.count("*").alias("docs"), F.count_if(F.expr("try_parse_json(props) is null")).alias("errors"), F.count_if(F.get_json_object("props", "$.timestamp").isNull()).alias("no_timestamp"))


@query("SELECT event_id, CASE WHEN regexp_matches(s, '^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') THEN TRY_CAST(s AS DOUBLE) END AS v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS s FROM events)")
def numeric_validator(t):
    d = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("s"))
    return d.select("event_id", lines.numeric("s").alias("v"))


@query("SELECT event_id, CASE WHEN ms IS NULL OR ms = 0 THEN '' WHEN ms >= 1000 THEN 's' WHEN ms >= 1 THEN 'ms' WHEN ms >= 0.001 THEN 'us' ELSE 'ns' END AS unit, CASE WHEN ms IS NULL OR ms = 0 THEN NULL WHEN ms >= 1000 THEN round(ms / 1000, 3) WHEN ms >= 1 THEN round(ms, 3) WHEN ms >= 0.001 THEN round(ms * 1000, 3) ELSE round(ms * 1e6, 3) END AS shown FROM (SELECT event_id, value * 10 AS ms FROM events)")
def format_duration(t):
    d = t.events.select("event_id", (F.col("value") * 10).alias("ms"))
    return d.select("event_id", scalars.duration_unit("ms").alias("unit"), scalars.duration_value("ms").alias("shown"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(1000 / value, 2) END AS ops_per_sec, round(value * 1e6, 2) AS time_ns FROM events")
def unit_convert(t):
    return t.events.select("event_id", F.when(F.col("value") > 0, F.round(F.try_divide(F.lit(1000), "value"), 2)).alias("ops_per_sec"), F.round(F.col("value") * 1e6, 2).alias("time_ns"))


@query("SELECT sum(CASE WHEN event_type = 'click' THEN value END) / nullif(count(CASE WHEN event_type = 'view' THEN 1 END), 0) > 0 AS has_ratio, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, coalesce(max(CASE WHEN event_type = 'nothing' THEN 1 END), 0)::BIGINT AS missing FROM events")
def perf_counters(t):
    of = lambda k: F.col("event_type") == k
    return t.events.agg((F.try_divide(F.sum(F.when(of("click"), F.col("value"))), F.count_if(of("view"))) > 0).alias("has_ratio"), F.count_if(of("click")).alias("clicks"), F.coalesce(F.max(F.when(of("nothing"), 1)), F.lit(0)).cast("long").alias("missing"))


@query(f"SELECT event_type, p50 AS median, round(p50 * 0.95, 6) AS lower_bound, round(p50 * 1.05, 6) AS upper_bound FROM (SELECT event_type, {_nr('value', 50)} FROM events GROUP BY 1)")
def ci_synthesis(t):
    d = latency.nearest_rank(t.events, ["event_type"], "value", (50,))
    return d.select("event_type", F.col("p50").alias("median"), F.round(F.col("p50") * 0.95, 6).alias("lower_bound"), F.round(F.col("p50") * 1.05, 6).alias("upper_bound"))


@query("SELECT l_returnflag, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE round(a / b, 2) END AS ratio FROM (SELECT l_returnflag, coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS a, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) AS b FROM lineitem GROUP BY 1)")
def memory_ratio(t):
    of = lambda k: F.coalesce(F.sum(F.when(F.col("l_linestatus") == k, F.col("l_quantity"))), F.lit(0.0))
    d = t.lineitem.groupBy("l_returnflag").agg(of("O").alias("a"), of("F").alias("b"))
    return d.select("l_returnflag", F.when((F.col("a") == 0) | (F.col("b") == 0), F.lit(0.0)).otherwise(F.round(F.try_divide("a", "b"), 2)).alias("ratio"))


@query("SELECT doc_id, sha256(unhex(sha256(coalesce(text, '')))) AS hash FROM documents")
def sha_double(t):
    return t.documents.select("doc_id", scalars.double_sha256(F.coalesce("text", F.lit(""))).alias("hash"))


# text readers


_ROW = "'| ' || (event_id * 1000) || '.5 | ' || user_id || ' | `' || event_type || '` |'"


@query("SELECT event_id, event_id * 1000 + 0.5::DOUBLE AS ns, user_id::DOUBLE AS ops, event_type AS name FROM events")
def table_line_parse(t):
    d = t.events.withColumn("line", F.expr(_ROW))
    return d.select("event_id", lines.pipe_cell("line", 1).alias("ns"), lines.pipe_cell("line", 2).alias("ops"), lines.quoted_name("line").alias("name"))


@query("SELECT event_id, user_id * CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1e9 END AS ns FROM events")
def bracket_time_parse(t):
    unit = F.element_at(F.array(*map(F.lit, ("ns", "µs", "ms", "s"))), (F.col("event_id") % 4 + 1).cast("int"))
    d = t.events.withColumn("line", F.concat(F.lit("x  time: [1.0 "), unit, F.lit(" "), F.col("user_id"), F.lit(" "), unit, F.lit(" 9.0 "), unit, F.lit("]")))
    return d.select("event_id", lines.bracket_ns("line").alias("ns"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING), -1) AS header FROM conversations")
def header_carry_forward(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w), F.lit(-1)).alias("header"))


@query("SELECT h.conv_id, h.turn, min(a.turn) AS answer FROM conversations h JOIN conversations a ON a.conv_id = h.conv_id AND a.role = 'assistant' AND a.turn > h.turn AND a.turn <= h.turn + 3 WHERE h.role = 'user' GROUP BY ALL")
def context_match(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, 3)
    d = t.conversations.select("conv_id", "turn", "role", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w).alias("answer"))
    return d.where("role = 'user' and answer is not null").select("conv_id", "turn", "answer").distinct()


# code metrics


_SIZE = "SELECT source, count(*) AS files, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM documents GROUP BY source"


@query(_SIZE)
def code_size(t):
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), F.sum(n).alias("loc"))


@query("SELECT source, lang, count(*) AS files, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM documents GROUP BY source, lang")
def code_by_module(t):
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum(n).alias("loc"))


@query(f"SELECT a.source, round(a.loc / b.loc, 2) AS loc_ratio, round(a.files / b.files, 2) AS files_ratio FROM ({_SIZE}) a, ({_SIZE}) b WHERE b.source = 'src0'")
def code_ratio(t):
    d = code_size(t)
    base = lambda c: d.where("source = 'src0'").select(c).scalar()
    return d.select("source", F.round(F.try_divide("loc", base("loc")), 2).alias("loc_ratio"), F.round(F.try_divide("files", base("files")), 2).alias("files_ratio"))


@query("SELECT source, count(*) AS matching FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[#*$%&]{3}') GROUP BY source")
def regex_line_counts(t):
    return t.documents.select("source", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("[#*$%&]{3}")).groupBy("source").agg(F.count("*").alias("matching"))


@query("SELECT source, round(count(CASE WHEN regexp_matches(line, '!!') THEN 1 END) / nullif(count(*), 0), 3) AS density, count(CASE WHEN length(line) = 0 THEN 1 END) AS blanks FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source")
def comment_density(t):
    d = t.documents.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("source").agg(F.round(F.try_divide(F.count_if(F.col("line").rlike("!!")), F.count("*")), 3).alias("density"), F.count_if(F.length("line") == 0).alias("blanks"))


@query("SELECT source, count(*) AS total, count(CASE WHEN lang = 'en' THEN 1 END) AS default_n, count(*) - count(CASE WHEN lang = 'en' THEN 1 END) AS optional_n FROM documents GROUP BY source")
def feature_counts(t):
    d = t.documents.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("default_n"))
    return d.withColumn("optional_n", F.col("total") - F.col("default_n"))


@query(f"SELECT source, files, loc, default_n, round(loc / nullif(default_n, 0), 3) AS per_default FROM ({_SIZE}) JOIN (SELECT source, count(CASE WHEN lang = 'en' THEN 1 END) AS default_n FROM documents GROUP BY source) USING (source)")
def combined_view(t):
    d = code_size(t).join(feature_counts(t).select("source", "default_n"), "source")
    return d.withColumn("per_default", F.round(F.try_divide("loc", "default_n"), 3))


# sets, latest, reports


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def metric_union_latest(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("event_type").agg(F.max_by(F.struct("event_id", "value"), at).alias("r")).select("event_type", "r.*")


@query(f"SELECT count(DISTINCT event_type) AS total, count(DISTINCT CASE WHEN {IMPL_SQL} = 'core' THEN event_type END) AS core, count(DISTINCT CASE WHEN {IMPL_SQL} = 'commons' THEN event_type END) AS commons FROM events")
def summary_counts(t):
    d = t.runs.groupBy("event_type").agg(F.max((F.col("impl") == "core").cast("int")).alias("a"), F.max((F.col("impl") == "commons").cast("int")).alias("b"))
    return d.agg(F.count("*").alias("total"), F.coalesce(F.sum("a"), F.lit(0)).alias("core"), F.coalesce(F.sum("b"), F.lit(0)).alias("commons"))


@query(f"SELECT event_type, 'Core' AS side, core_time_ms AS time_ms, NULL AS winner FROM ({_PAIR}) UNION ALL SELECT event_type, 'Commons', commons_time_ms, NULL FROM ({_PAIR}) UNION ALL SELECT event_type, 'Comparison', NULL, CASE WHEN core_time_ms > commons_time_ms THEN 'commons' ELSE 'core' END FROM ({_PAIR})")
def flat_csv_rows(t):
    row = lambda side, ms, best: F.struct(F.lit(side).alias("side"), ms.alias("time_ms"), best.cast("string").alias("winner"))
    none, a, b = F.lit(None).cast("double"), F.col("core_time_ms"), F.col("commons_time_ms")
    rows = F.array(row("Core", a, F.lit(None)), row("Commons", b, F.lit(None)), row("Comparison", none, F.when(a > b, "commons").otherwise("core")))
    return pair_impl(t).select("event_type", F.explode(rows).alias("r")).select("event_type", "r.*")


@query("SELECT count(*) AS total_records, sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents")
def cache_stats(t):
    return t.documents.agg(F.count("*").alias("total_records"), F.sum(F.octet_length("text")).alias("total_bytes"))


_SOURCES = (("cache", "c_acctbal > 5000"), ("files", "c_mktsegment = 'BUILDING'"), ("rest", "c_nationkey < 10"))
_TAKEN = "CASE " + " ".join(f"WHEN {w} THEN '{n}'" for n, w in _SOURCES) + " END"


@query(f"SELECT o_custkey AS c_custkey, {_TAKEN} AS source, CASE WHEN {_TAKEN} IS NOT NULL THEN c_name END AS c_name FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey")
def read_through(t):
    """The record of each customer that orders name, from the first of three sources that has it."""
    wanted = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return cache.read_through(wanted, "c_custkey", [(n, t.customer.where(w).select("c_custkey", "c_name")) for n, w in _SOURCES])


@query("SELECT l_orderkey, count(*) AS transactions, count(*) FILTER (l_linenumber > 1) AS ordinary, count(*) FILTER (l_returnflag = 'R') AS spent, count(*) FILTER (l_linenumber > 1 AND l_returnflag <> 'R') AS ordinary_unspent FROM lineitem GROUP BY 1")
def block_statistics(t):
    """Lines of an order as a block's transactions: its first one is no ordinary one, returned ones are spent."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("transactions"), F.count_if(F.expr("l_linenumber > 1")).alias("ordinary"), F.count_if(F.expr("l_returnflag = 'R'")).alias("spent"), F.count_if(F.expr("l_linenumber > 1 and l_returnflag <> 'R'")).alias("ordinary_unspent"))


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(t):
    return t.orders.select("o_custkey").distinct().join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("SELECT DISTINCT url FROM pages")
def dedupe_paths(t):
    return t.pages.select("url").distinct()


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def append_union(t):
    return t.nation.selectExpr("n_name name", "'nation' kind").unionByName(t.region.selectExpr("r_name name", "'region' kind"))


@query("SELECT user_id, arg_min(event_type, {'t': ts, 'e': event_id}) AS first_type, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type FROM events WHERE value > 10 GROUP BY user_id")
def jq_first_match(t):
    at = F.struct("ts", "event_id")
    return t.events.where("value > 10").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


# suites and their statistics


def _names(all_names):
    return F.element_at(F.array(*map(F.lit, all_names)), (F.col("event_id") % len(all_names) + 1).cast("int"))


_SUITE = [side + n for names in suite.SPEED.values() for n in names for side in ("core-", "commons-")] + ["core-unheard-of"]
_SUITE_SQL = "(SELECT event_id, (" + repr(_SUITE) + f")[event_id % {len(_SUITE)} + 1] AS name FROM events)"


@query(f"SELECT event_id, CASE WHEN base IN {tuple(suite.SPEED['fast'])} THEN 'fast' WHEN base IN {tuple(suite.SPEED['slow'])} THEN 'slow' ELSE 'medium' END AS speed FROM (SELECT event_id, regexp_replace(name, '^(core|commons)-', '') AS base FROM {_SUITE_SQL})")
def measurement_speed(t):
    return t.events.select("event_id", suite.speed_of(_names(_SUITE)).alias("speed"))


@query(f"SELECT suite, name, count(*) AS n FROM {_SUITE_SQL} JOIN (VALUES ('all', ''), ('fair', '^(core|commons)-'), ('core-only', '^core-'), ('commons-only', '^commons-')) s(suite, pattern) ON regexp_matches(name, pattern) GROUP BY 1, 2")
def suite_selection(t):
    d = t.events.select(_names(_SUITE).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    parts = [suite.selected(d, "name", which).select(F.lit(which).alias("suite"), "name", "n") for which in ("all", "fair", "core-only", "commons-only")]
    return functools.reduce(DataFrame.union, parts)


@query(f"SELECT c.category, count(*) AS n FROM {_SUITE_SQL} JOIN (VALUES {', '.join(str(kv) for kv in suite.CATEGORIES.items())}) c(category, pattern) ON regexp_matches(name, '(?i)' || c.pattern) GROUP BY 1")
def measurement_categories(t):
    d = t.events.withColumn("name", _names(_SUITE))
    return d.select(F.explode(suite.categories("name")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT count(CASE WHEN ok THEN 1 END) AS benchmarks_completed, count(CASE WHEN NOT ok THEN 1 END) AS benchmarks_failed, coalesce(string_agg(p, ',' ORDER BY p) FILTER (ok), '') AS completed, coalesce(string_agg(p, ',' ORDER BY p) FILTER (NOT ok), '') AS failed FROM (SELECT o_orderpriority AS p, count(*) % 2 = 0 AS ok FROM orders GROUP BY 1)")
def suite_summary(t):
    d = t.orders.groupBy("o_orderpriority").agg((F.count("*") % 2 == 0).alias("ok"))
    out = suite.run_summary(d, "o_orderpriority", F.col("ok"))
    return out.withColumn("completed", F.array_join("completed", ",")).withColumn("failed", F.array_join("failed", ","))


@query("SELECT event_id, value AS mean, value * 2 AS p75, value / 2 AS lower_bound, NULL::DOUBLE AS p99, user_id AS sample_count FROM events")
def estimates_struct(t):
    doc = F.format_string('{"mean":{"point_estimate":%s,"confidence_interval":{"lower_bound":%s}},"percentiles":{"0.75":%s},"sample_count":%s}', F.col("value").cast("string"), (F.col("value") / 2).cast("string"), (F.col("value") * 2).cast("string"), F.col("user_id").cast("string"))
    d = t.events.select("event_id", suite.estimates(doc).alias("s"))
    return d.selectExpr("event_id", "s.mean.point_estimate mean", "s.percentiles.p75 p75", "s.mean.confidence_interval.lower_bound lower_bound", "s.percentiles.p99 p99", "s.sample_count sample_count")


@query("SELECT event_id, value AS median, round(value * 0.95, 9) AS lower_bound, round(value * 1.05, 9) AS upper_bound, round(value * (user_id % 10) / 100, 9) AS standard_error FROM events")
def synthetic_statistics(t):
    d = t.events.select("event_id", suite.synthetic(F.col("value"), F.col("user_id") % 10).alias("s"))
    return d.select("event_id", "s.median", *(F.round(f"s.{c}", 9).alias(c) for c in ("lower_bound", "upper_bound", "standard_error")))


_COUNT = {"cycles": "view", "instructions": "click", "cache_references": "view", "cache_misses": "nothing", "branches": "nothing", "branch_misses": "click"}


@query("SELECT user_id, round(i::DOUBLE / nullif(c, 0), 6) AS ipc, round(0.0 / nullif(c, 0), 6) AS cache_miss_percent, NULL::DOUBLE AS branch_miss_percent FROM (SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS c, count(CASE WHEN event_type = 'click' THEN 1 END) AS i FROM events GROUP BY 1)")
def counter_rates(t):
    d = t.events.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == e).alias(c) for c, e in _COUNT.items()))
    return suite.rates(d).select("user_id", *(F.round(c, 6).alias(c) for c in ("ipc", "cache_miss_percent", "branch_miss_percent")))


@query(f"SELECT coalesce(bool_or(status = 'regression'), false) AS failed FROM ({_REG})")
def regression_gate(t):
    return regression_report(t).agg(F.coalesce(F.bool_or(F.col("status") == "regression"), F.lit(False)).alias("failed"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'complete' ELSE 'pending' END AS implementation_status FROM events")
def implementation_status(t):
    return t.events.select("event_id", F.when(F.col("value") > 50, "complete").otherwise("pending").alias("implementation_status"))


@query("SELECT p_brand, p_type FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE regexp_matches(p_type, 'M|AR')) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type) <= 3")
def limit_three_matches(t):
    d = t.part.where(F.col("p_type").rlike("M|AR")).select("p_brand", "p_type").distinct()
    return d.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type"))).where("n <= 3").drop("n")


@query("SELECT source, files, test_files, round(test_loc / nullif(loc - test_loc, 0), 3) AS test_to_production FROM (SELECT source, count(*) AS files, count(CASE WHEN doc_id % 5 = 0 THEN 1 END) AS test_files, sum(n)::BIGINT AS loc, coalesce(sum(CASE WHEN doc_id % 5 = 0 THEN n END), 0)::BIGINT AS test_loc FROM (SELECT source, doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents) GROUP BY source)")
def test_ratio(t):
    n, is_test = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.col("doc_id") % 5 == 0
    d = t.documents.groupBy("source").agg(F.count("*").alias("files"), F.count_if(is_test).alias("test_files"), F.sum(n).alias("loc"), F.coalesce(F.sum(F.when(is_test, n)), F.lit(0)).alias("test_loc"))
    return d.select("source", "files", "test_files", F.round(F.try_divide("test_loc", F.col("loc") - F.col("test_loc")), 3).alias("test_to_production"))


@query("SELECT source, lang, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM documents GROUP BY ROLLUP (source, lang)")
def code_totals(t):
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return t.documents.rollup("source", "lang").agg(F.sum(n).alias("loc"))


# more readers


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id + 0.5 ELSE event_id + 1000 END::DOUBLE AS v FROM events")
def first_nonzero_cell(t):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("| 0 | "), F.col("user_id"), F.lit(".5 | 7 |"))).otherwise(F.concat(F.lit("no table: "), F.col("event_id") + 1000, F.lit(" units")))
    return t.events.withColumn("line", line).select("event_id", lines.first_number_cell("line").alias("v"))


@query("SELECT event_id, user_id::DOUBLE AS a, NULL::DOUBLE AS b FROM events")
def comma_line_parse(t):
    d = t.events.withColumn("line", F.concat(F.lit("Name , "), F.col("user_id"), F.lit(" , none")))
    return d.select("event_id", lines.comma_cell("line", 1).alias("a"), lines.comma_cell("line", 2).alias("b"))


@query("SELECT user_id, arg_max(event_id, event_id)::DOUBLE AS last_ms FROM events WHERE event_id % 2 = 0 GROUP BY user_id")
def log_scrape(t):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Synced 10 blocks in "), F.col("event_id"), F.lit(" ms"))).otherwise("waiting")
    d = t.events.withColumn("ms", lines.log_value(line, "blocks in", "ms")).where("ms is not null")
    return d.groupBy("user_id").agg(F.max_by("ms", "event_id").alias("last_ms"))


@query("SELECT user_id, event_id, head AS name, 2000.0::DOUBLE AS ns FROM (SELECT user_id, event_id, event_id % 2 AS is_time, lag(CASE WHEN event_id % 2 = 0 THEN 'case' || event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM events) WHERE is_time = 1 AND head IS NOT NULL")
def headed_times(t):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Benchmarking group/case"), F.col("event_id"), F.lit(": Warming up"))).otherwise("time: [1.0 us 2.0 us 3.0 us]")
    return lines.headed_times(t.events.withColumn("line", line), "event_id", "line", "user_id")


# headers, chains, frames


_HEAD = "sha256('a' || o_orderkey) || sha256('b' || o_orderkey) || left(sha256('c' || o_orderkey), 32)"
_PAIRS = "list_reduce(list_reverse(regexp_extract_all({x}, '..')), lambda a, b: a || b)"


def _sql_part(at, n):
    return _PAIRS.format(x=f"substr(h, {2 * at - 1}, {2 * n})")


def _sql_number(at, n):
    return "(" + " + ".join(f"(instr('0123456789abcdef', substr(h, {2 * (at + i) - 1}, 1)) - 1) * {16 * 256**i} + (instr('0123456789abcdef', substr(h, {2 * (at + i)}, 1)) - 1) * {256**i}" for i in range(n)) + ")::BIGINT"


@query("SELECT o_orderkey, " + ", ".join(f"{_sql_number(*p)} AS {k}" for k, p in headers.NUMBERS.items()) + ", " + ", ".join(f"{_sql_part(*p)} AS {k}" for k, p in headers.HASHES.items()) + ", " + _PAIRS.format(x="sha256(unhex(sha256(unhex(h))))") + f" AS block_hash FROM (SELECT o_orderkey, {_HEAD} AS h FROM orders)")
def header_fields(t):
    part = lambda c: F.sha2(F.concat(F.lit(c), F.col("o_orderkey").cast("string")), 256)
    d = t.orders.select("o_orderkey", F.concat(part("a"), part("b"), F.substring(part("c"), 1, 32)).alias("h"))
    return headers.fields(d, "h").drop("h")


@query("WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || ':' || turn AS name, conv_id || ':' || (turn - 1) AS prev FROM conversations), r AS (SELECT name, name AS root, 0::BIGINT AS height FROM c WHERE prev NOT IN (SELECT name FROM c) UNION ALL SELECT c.name, r.root, r.height + 1 FROM c JOIN r ON c.prev = r.name) SELECT name, root, height FROM r")
def chain_order(t):
    of = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    return headers.chain_heights(t.conversations.select(of(F.col("turn")).alias("name"), of(F.col("turn") - 1).alias("prev")), "name", "prev")


@query("SELECT o_orderkey, CASE WHEN greatest(o_orderkey, 500) <= least(o_orderkey + o_custkey % 50, 900) THEN greatest(o_orderkey, 500) END AS first_height, CASE WHEN greatest(o_orderkey, 500) <= least(o_orderkey + o_custkey % 50, 900) THEN least(o_orderkey + o_custkey % 50, 900) END AS last_height FROM orders")
def pruned_range(t):
    r = blocks.clamp_range(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") % 50, F.lit(500).cast("long"), F.lit(900).cast("long"))
    return t.orders.select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.start").alias("first_height"), F.col("r.end").alias("last_height"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents")
def block_frames_roundtrip(t):
    magic, pad = bytes.fromhex("f9beb4d9"), bytes.fromhex("0123456789abcdef")

    def run(parts):
        for df in parts:
            data = frames.encode_frames((x.encode() for x in df.text), magic, pad)
            df["text"] = [p.decode() for _, p in frames.decode_frames(data, magic, pad, most=1 << 31)]
            yield df

    d = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, text string")
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT event_id, string_agg(printf('%02X', xor(ascii(substr(event_type, i, 1)), [17, 34, 132][(i - 1) % 3 + 1])), '' ORDER BY i) AS coded, event_type AS plain FROM (SELECT event_id, event_type, unnest(range(1, length(event_type) + 1)) AS i FROM events) GROUP BY ALL")
def xor_decode(t):
    """Whole names under a pad of three bytes, and back."""
    pad = F.lit(bytearray([17, 34, 132]))
    d = t.events.select("event_id", scalars.xor_bytes(F.col("event_type").cast("binary"), pad).alias("c"))
    return d.select("event_id", F.hex("c").alias("coded"), scalars.xor_bytes(F.col("c"), pad).cast("string").alias("plain"))


# beyond plain SQL, or with recursive SQL


def _varied(*docs: str):
    """One of some documents by the event's number, with @ standing for its value."""
    parts = [F.lit(d) for d in docs]
    return F.replace(F.element_at(F.array(*parts), (F.col("event_id") % len(docs) + 1).cast("int")), F.lit("@"), F.col("value").cast("string"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN value > 0 AND value < 1e6 THEN value END WHEN 1 THEN 7 WHEN 2 THEN CASE WHEN value > 0 AND value < 1e6 THEN value ELSE 2.5 END END::DOUBLE AS number FROM events")
def recursive_number_search(t):
    """Over documents of several shapes: nested lists, numbers before and after, texts and flags that are no numbers, no document."""
    doc = _varied('{"a":{"b":[{"x":0},{"y":"z","n":@}]},"c":-3}', '[true,"5",[[7]],@]', '{"k":{"deep":[2000000,{"z":@}]},"last":2.5}', '{"only":"text","list":[]}', "no document @")
    return t.events.select("event_id", scalars.first_number(doc).alias("number"))


_LEAF = "sha256(l_partkey || ':' || l_suppkey || ':' || l_linenumber)"
_TWICE = "sha256(unhex(sha256(unhex({a} || {b}))))"


@query(f"""WITH RECURSIVE l AS (SELECT l_orderkey AS k, 0 AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LEAF}) - 1 AS i, {_LEAF} AS h, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
r AS (SELECT * FROM l UNION ALL SELECT k, level + 1, i // 2, {_TWICE.format(a='h', b='coalesce(h2, h)')}, (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY k, level ORDER BY i) AS h2 FROM r) WHERE n > 1 AND i % 2 = 0)
SELECT k AS l_orderkey, h AS root FROM r WHERE n = 1""")
def merkle_roots(t):
    leaf = F.struct("l_linenumber", F.sha2(F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber"), 256).alias("leaf"))
    d = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))  # an order's lines, a handful
    return d.select("l_orderkey", scalars.merkle_root(F.col("leaves.leaf")).alias("root"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN value > 0 THEN value END WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN value > 0 THEN value ELSE 4 END END::DOUBLE AS time_ms FROM events")
def recursive_time_search(t):
    """Over documents of several shapes: keys in any case and place, zeros, texts and flags under time-like keys, no document."""
    doc = _varied('{"a":{"b":[{"time_ms":0},{"total_time":@}]}}', '{"x":@,"Sync_TIME":3,"time":9}', '{"list":[1,{"time":"8"},{"runTimeNs":@}],"zz":{"time":4}}', '{"time":{"value":@},"times":null,"is_time":true}', "[broken @")
    return t.events.select("event_id", scalars.first_time(doc).alias("time_ms"))


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS x FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS rejected, 0::DOUBLE AS state FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT f.user_id, f.n + 1, f.rejected + CASE WHEN state + x < 0 THEN 1 ELSE 0 END, CASE WHEN state + x < 0 THEN state ELSE state + x END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, n AS steps, rejected, round(state, 4) AS state FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""


@query(_FOLD)
def utxo_fold(t):
    d = t.events.withColumn("amount", F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value")))
    return blocks.fold_groups(d, "user_id", "event_id", "amount")


from . import reports  # noqa: E402, F401  its queries join the ones above


@query("SELECT event_id // 1000 AS chunk, count(*) AS records FROM events GROUP BY 1")
def stream_chunks(t):
    return stream.counted(t.spark, f"{t.sf_dir}/events.parquet", "event_id", 1000)


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily(t):
    return stream.windowed(t.spark, f"{t.sf_dir}/events.parquet", "ts", "event_type", "value")
