import json
import struct

import pytest

from quillon.operators import blocks, cache, sinks, suite
from quillon.sources import documents
from quillon.streaming import ingest


def test_documents(spark, tmp_path):
    put = lambda name, doc: (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))
    (tmp_path / "history").mkdir()
    put("core-hash-20240101-000000.json", {"benchmarks": [{"time_ms": 9}]})
    put("core-hash-20240102-000000.json", {"benchmarks": [{"time_ms": 8}]})
    put("commons-hash-20240101-000000.json", {"benchmarks": [{"time_ns": 2e6}]})
    put("core-block-20240101-000000.json", {"a_block_validation": {"primary_comparison": {"time_per_block_ms": 66.25}}})
    put("commons-block-20240101-000000.json", {"b_block_validation": {"connect_block": {"time_per_block_ms": 10.8}}})
    put("commons-deep-20240101-000000.json", {"x": [{"y": {"total_time": 3}}]})
    put("core-bad-20240101-000000.json", "{not json")
    put("core-err-20240101-000000.json", {"error": "no binary", "time_ms": 5})
    put("summary.json", {})
    put("history/core-old-20240101-000000.json", {})
    rows = documents.measurements(documents.scan(spark, str(tmp_path)))
    got = {(r.bench_key, r.impl): (r.time_ms, r.error) for r in rows.collect()}
    assert got == {("hash", "core"): (8.0, None), ("hash", "commons"): (2.0, None), ("block", "core"): (66.25, None), ("block", "commons"): (10.8, None), ("deep", "commons"): (3.0, None), ("bad", "core"): (None, "invalid JSON"), ("err", "core"): (None, "no binary")}
    pairs = {r.bench_key: (r.winner, r.speedup) for r in documents.consolidated(rows).collect()}
    assert pairs["block"] == ("commons", 6.13) and pairs["hash"] == ("commons", 4.0) and pairs["deep"] == (None, None)


def test_key_values_and_counters(spark, tmp_path):
    (tmp_path / "a.meta").write_text("# c\ntotal_blocks=10\nnum_chunks = 2\n")
    (tmp_path / "b.meta").write_text("total_blocks=10\n")
    got = documents.key_values(documents.lines_of(spark, str(tmp_path / "*.meta")), ["total_blocks", "num_chunks"]).collect()
    assert [(r.total_blocks, r.num_chunks) for r in got] == [("10", "2")]
    (tmp_path / "p.csv").write_text("100,,cycles\n200,,instructions\n<not counted>,,cache-misses\n")
    r = documents.counters(documents.lines_of(spark, str(tmp_path / "p.csv")), {"cycles": "cycles", "instructions": "instr", "misses": "cache-misses"}).first()
    assert (r.cycles, r.instructions, r.misses) == (100, 200, 0)


def test_chunks(spark, tmp_path):
    rec = lambda version, n: bytearray(struct.pack("<I", version) + b"x" * (n - 4))
    rows = [(0, rec(1, 88)), (1, rec(1, 87)), (2, rec(0, 88)), (3, rec(0x7FFFFFFF, 90)), (4, rec(0x80000000, 90)), (12, rec(2, 100))]
    d = spark.createDataFrame(rows, "height long, payload binary")
    assert {r.height: r.reason for r in sinks.valid_records(d).collect()} == {0: None, 1: "size", 2: "version", 3: None, 4: "version", 12: None}
    sinks.write_chunks(d, str(tmp_path / "c"), 10)
    assert sorted(r.height for r in sinks.read_range(spark, str(tmp_path / "c"), 3, 12, 10).collect()) == [3, 12]


def test_history_and_baseline(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0)], "k string, v double")
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        sinks.append_history(d, str(tmp_path / "h"), "abc", "main", at)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    bad = spark.createDataFrame([("a", "regression")], "k string, status string")
    at = str(tmp_path / "b")
    assert sinks.baseline(spark, at) is None and sinks.rotate_baseline(d, None, at)
    assert not sinks.rotate_baseline(d, bad, at) and sinks.rotate_baseline(sinks.baseline(spark, at).selectExpr("k", "v + 1 v"), bad.limit(0), at)
    (tmp_path / "b" / "version=3").mkdir()  # a write that was cut off
    assert sinks.baseline(spark, at).first().v == 2.0
    assert sinks.rotate_baseline(d, bad, at, force=True) and sinks.baseline(spark, at).first().v == 1.0
    sinks.report_json(d, str(tmp_path / "j"))
    sinks.report_csv(d, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first().k == "a"


@pytest.mark.parametrize("parts", [1, 3])
def test_fold(spark, parts):
    rows = [("a", 1, 5.0), ("a", 3, -9.0), ("a", 2, -2.0), ("b", 1, -1.0)]
    d = spark.createDataFrame(rows, "k string, n long, x double").repartition(parts)
    got = {r.k: (r.steps, r.rejected, r.state) for r in blocks.fold_groups(d, "k", "n", "x").collect()}
    assert got == {"a": (3, 1, 3.0), "b": (1, 1, 0.0)}


def test_heights(spark):
    d = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "k long")
    got = sorted((r.k, r.height) for r in blocks.with_height(d, "k", rows_per_range=9, start=5).collect())
    assert got == [(i, i + 5) for i in range(100)]


def test_read_through(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    sources = [("a", frame((1, "a1"), (2, "a2"))), ("b", frame((2, "b2"), (3, "b3"), (None, "b")))]
    wanted = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,)], "k long")
    got = {(r.k, r.v, r.source) for r in cache.read_through(wanted, "k", sources).collect()}
    assert got == {(1, "a1", "a"), (2, "a2", "a"), (3, "b3", "b"), (4, None, None)}
    assert [tuple(r) for r in cache.read_through(wanted.limit(0), "k", []).collect()] == []
    at = str(tmp_path / "cache")
    assert {r.k for r in cache.prefetch(spark, "k", 1, 2, at, sources).collect()} == {1, 2}
    gone = [("b", sources[1][1])]  # what is in the cache needs its source no more, and does not change
    assert sorted((r.k, r.v) for r in cache.prefetch(spark, "k", 1, 4, at, gone).collect()) == [(1, "a1"), (2, "a2"), (3, "b3")]
    assert cache.first_readable(spark, [str(tmp_path / "none*"), at]) == at and cache.first_readable(spark, [str(tmp_path / "x")]) is None


def test_ingest_resumes(spark, tmp_path):
    rec = lambda version: bytearray(struct.pack("<I", version) + b"x" * 90)
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    put = lambda *rows: spark.createDataFrame(list(rows), "height long, payload binary").coalesce(1).write.mode("append").parquet(src)
    put((0, rec(1)), (1, rec(0)), (11, rec(2)))
    assert ingest.ingest(spark, src, out, log, 10) == 3
    put((12, rec(1)), (25, rec(1)))
    assert ingest.ingest(spark, src, out, log, 10) == 2 and ingest.ingest(spark, src, out, log, 10) == 0
    assert sorted((r.height, r.chunk_id) for r in spark.read.parquet(out).collect()) == [(0, 0), (11, 1), (12, 1), (25, 2)]


def test_tail_breaks(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "c", "x"), (4, "d", "c"), (5, "e", None)], "h int, name string, prev string")
    find = lambda last: [(r.h, r.expected) for r in ingest.tail_breaks(d, "h", "name", "prev", last).orderBy("h").collect()]
    assert find(100) == [(3, "b"), (5, "d")] and find(2) == [(5, "d")]


def test_suites(spark):
    d = spark.createDataFrame([("core-a",), ("commons-a",), ("both-fair",)], "name string")
    got = {w: sorted(r.name for r in suite.selected(d, "name", w).collect()) for w in ("all", "fair-fast", "core-only")}
    assert got == {"all": ["both-fair", "commons-a", "core-a"], "fair-fast": ["commons-a", "core-a"], "core-only": ["core-a"]}
    with pytest.raises(ValueError):
        suite.selected(d, "name", "none")
