"""Operators of the report queries on small cases: hashes with known values, chunk files, settings, series, spends, reports."""

import hashlib
import json
import struct

import duckdb
import pytest

from quillon.functions import scalars
from quillon.operators import blocks, compare, latency, shared, sinks, suite
from quillon.plans import catalog
from quillon.sources import documents
from quillon.sources.frames import FrameSource, decode_stream, listed
from quillon.streaming import chunks

F = scalars.F


def test_ripemd160(spark):
    known = {b"": "9c1185a5c5e9fc54612808977ee8f548b2258d31", b"abc": "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc", b"a" * 1000000: "52783243c1697bdbe16d37f97f68f08325dc1528", b"1234567890" * 8: "9b752e45573d4b39f4dbd3323cab82bf63326bfb"}
    assert {k: scalars.ripemd160(k).hex() for k in known} == known
    d = spark.createDataFrame([(b"x",), (None,)], "b binary")
    want = scalars.ripemd160(hashlib.sha256(b"x").digest()).hex()
    assert [r.h for r in d.select(scalars.hash160("b").alias("h")).collect()] == [want, None]


def test_bytes_under_a_pad(spark):
    d = spark.createDataFrame([(b"", b"k"), (b"abcd", b"\1\2\3"), (None, b"k"), (b"a", None), (b"a", b"")], "b binary, k binary")
    got = [None if r.x is None else bytes(r.x) for r in d.select(scalars.xor_bytes("b", "k").alias("x")).collect()]
    assert got == [b"", bytes([97 ^ 1, 98 ^ 2, 99 ^ 3, 100 ^ 1]), None, None, None]


def test_durations_and_maps(spark):
    d = spark.createDataFrame([(1500.0, {"a": "1", "b": "2"}), (2.5, None), (0.0042, {}), (0.0, {"c": "9"}), (None, None), (5e-7, None)], "ms double, m map<string,string>")
    got = d.select(scalars.duration_text("ms").alias("t"), scalars.merged(F.col("m"), F.create_map(F.lit("b"), F.lit("new"))).alias("m")).collect()
    assert [r.t for r in got] == ["1.500s", "2.500ms", "4.200us", "", "", "0.500ns"]
    assert [r.m for r in got][:4] == [{"a": "1", "b": "new"}, {"b": "new"}, {"b": "new"}, {"c": "9", "b": "new"}]


def test_chunk_writer(spark, tmp_path):
    rows = [(i * 3, bytearray(struct.pack("<I", i) + b"x" * (90 + i))) for i in range(25)]
    d = spark.createDataFrame(rows, "height long, payload binary").repartition(4)
    got = sinks.write_frames(d, str(tmp_path / "a"), 10, str(tmp_path / "b")).orderBy("chunk").collect()
    assert [(r.chunk, r.records) for r in got] == [(0, 10), (1, 10), (2, 5)]
    assert (tmp_path / "a" / "chunks.meta").read_text().startswith("total_blocks=25\nnum_chunks=3\n")
    assert [f.rsplit("/", 1)[-1] for f in listed(f"{tmp_path}/b/*")] == [f"chunk_{i}.bin.zst" for i in range(3)]
    assert all((tmp_path / "b" / f"chunk_{i}.bin.zst").read_bytes() == (tmp_path / "a" / f"chunk_{i}.bin.zst").read_bytes() for i in range(3))
    (tmp_path / "a" / "chunk_1.bin.zst").unlink()
    (tmp_path / "a" / "chunk_9.bin.zst").write_bytes(b"1234567")  # too short for a record: left out before it is opened
    spark.dataSource.register(FrameSource)
    read = spark.read.format("frames").options(path=f"{tmp_path}/a/chunk_*.zst", zstd="true", per_file="10", missing="warn").load().collect()
    assert sorted(r.height for r in read if r.payload is not None) == [*range(10), *range(20, 25)]
    assert [(r.height, r.corrupt) for r in read if r.corrupt] == [(10, "missing")]
    assert sinks.write_frames(d.limit(0), str(tmp_path / "none"), 10).count() == 0


def test_settings(spark):
    text = "a = 1 # one\n[s t]\nb= \"x # y\"\nc ='z'\nnothing\n#d = 4\n[e.f]\ng=\n"
    d = spark.createDataFrame([("f", text), ("empty", ""), ("null", None)], "file string, text string")
    got = sorted((r.section, r.key, r.value) for r in documents.settings(d).collect())
    assert got == [("", "a", "1"), ("e.f", "g", ""), ("s t", "b", "x # y"), ("s t", "c", "z")]


def test_documents_of_all_kinds(spark):
    """Sections by top-level keys alone, 0 and null in the chain, one side missing."""
    shapes = [('{"text":"own_core_block_validation","a":{"own_core_block_validation":{"primary_comparison":{"time_per_block_ms":5}}},"time_ms":7}', 7.0), ('{"own_core_block_validation":{"connect_block_mixed_ecdsa_schnorr":{"time_per_block_ms":4}}}', 4.0), ('{"benchmarks":[{"time_ms":null,"time_per_block_ms":3}]}', 3.0), ('{"benchmarks":[{"time_ms":0}],"n":8}', 8.0), ("[]", None), ("{}", None), ("null", None), ('{"benchmarks":[{"time_ms":"6"}]}', 6.0)]
    d = spark.createDataFrame([(f"/r/core-{i}-20240101-00000{i}.json", doc) for i, (doc, _) in enumerate(shapes)], "file string, doc string")
    rows = documents.measurements(documents.named(d))
    assert {int(r.bench_key): r.time_ms for r in rows.collect()} == {i: t for i, (_, t) in enumerate(shapes)}
    entries = {r.bench_key: json.loads(r.entry) for r in documents.report_entries(rows).collect()}
    assert list(entries) == sorted(entries) and entries["0"]["core"]["time_ms"] == 7 and "commons" not in entries["0"] and "comparison" not in entries["0"]
    assert documents.report_summary(rows).first().asDict() == {"total_benchmarks": 8, "core_benchmarks": 8, "commons_benchmarks": 0, "comparisons": 0}
    assert documents.csv_rows(rows).columns == list(documents.CSV_HEADER)
    assert documents.report_summary(rows.limit(0)).first().total_benchmarks == 0


def test_regression_document(spark):
    base = spark.createDataFrame([("r", 66.2), ("i", 10.8), ("u", 100.0)], "k string, v double")
    now = spark.createDataFrame([("r", 75.5), ("i", 9.2), ("u", 101.0)], "k string, v double")
    doc = json.loads(compare.regression_document(compare.regressions(now, base, ["k"], "v")).first().report)
    assert doc["summary"] == {"regressions": 1, "improvements": 1, "unchanged": 1} and doc["regression_threshold_percent"] == 10.0
    assert doc["regressions"] == [{"k": "r", "baseline_time_ms": 66.2, "current_time_ms": 75.5, "change_percent": 14.05, "speedup": "0.88x"}]
    assert "speedup" not in doc["unchanged"][0] and doc["improvements"][0]["speedup"] == "1.17x"


def test_states(spark):
    out = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 5)], "k string, height long")
    spends = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("c", 1, 1), ("d", 6, 0), ("gone", 7, 0)], "k string, height long, at long")
    got = {(r.k, r.height): r.valid for r in blocks.spend_verdicts(out, spends, "k").collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("c", 1): False, ("d", 6): True, ("gone", 7): False}
    go = lambda **kw: [(r.chunk, r.unspent) for r in blocks.output_set(out, spends, "k", size=4, **kw).orderBy("chunk").collect()]
    assert go(parity=True) == [(0, 2), (1, 2)] and go() == [(0, 2)]
    assert [(r.chunk, r.unspent) for r in blocks.output_set(out, spends.limit(0), "k", size=4).orderBy("chunk").collect()] == [(0, 3), (1, 4)]


@pytest.mark.parametrize("first,last,every", [(0, 9, 0), (250, 749, 0), (995, 2000, 0), (2000, 3000, 0), (0, 1 << 40, 100)])
def test_slices_of_heights(spark, first, last, every):
    d = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k long")
    got = sorted((r.k, r.height) for r in blocks.slice_heights(d, first, last, "k", every=every, rows_per_range=64).collect())
    assert got == [(i, i) for i in range(1000) if first <= i <= last and (not every or i % every == 0)]


def test_zero_samples(spark):
    d = spark.createDataFrame([("a", 2.0), ("a", 0.0), ("a", 5.0), ("z", 0.0), (None, 0.0)], "k string, v double")
    got = {r.k: (r.avg_value, r.min_value, r.max_value, r.n, r.p50, r.p99) for r in latency.concurrency(d, ["k"], "v").collect()}
    assert got == {"a": (3, 2.0, 5.0, 2, 5.0, 5.0), "z": (0, 0.0, 0.0, 0, 0.0, 0.0), None: (0, 0.0, 0.0, 0, 0.0, 0.0)}


def test_streams_in_several_batches(spark, tmp_path):
    """State goes on over batches: the last one of each key is the result, and rows that are too late are dropped."""
    for i, days in enumerate(([1, 1, 2], [2, 20], [1])):
        d = spark.createDataFrame([("k", day, 1.0) for day in days], "key string, day int, v double")
        d.selectExpr("key", "to_timestamp_ntz(concat('2024-01-', lpad(day, 2, '0'), ' 10:00:00')) ts", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = stream.groupBy("key").agg(F.count("*").alias("n"))
    assert [tuple(r) for r in chunks._all_now(rows, "test", "key").collect()] == [("k", 6)]


def test_shared_folder(spark):
    at = shared.new_folder(spark, "x")
    assert at != shared.new_folder(spark, "x") and at.startswith(shared.shared_folder(spark))


def test_cases(spark):
    d = spark.createDataFrame([("UTXOGet",), ("UTXOGet",), ("UTXOInsert",), (None,), ("other",)], "n string")
    table = suite.filter_table(spark, {"u": "UTXO", "none": "zzz"})
    assert sorted(tuple(r) for r in suite.cases_of(d, "n", table).collect()) == [("u", "UTXOGet"), ("u", "UTXOInsert")]
    assert [tuple(r) for r in suite.cases_of(d, "n", table, 1).collect()] == [("u", "UTXOGet")]


def test_two_four_byte_pads():
    """A pad of two words that take turns is one of eight bytes."""
    import io

    from quillon.sources.frames import encode_frames

    a, b, magic = b"\1\2\3\4", b"\x99\0\xff\7", bytes.fromhex("f9beb4d9")
    data = encode_frames([b"r" * 101, b"s" * 90], magic, a + b)
    plain = bytes(x ^ (a if i // 4 % 2 == 0 else b)[i % 4] for i, x in enumerate(data))
    assert plain == encode_frames([b"r" * 101, b"s" * 90], magic) and [p for _, p, _ in decode_stream(io.BytesIO(data), magic, a + b)] == [b"r" * 101, b"s" * 90]


@pytest.mark.parametrize("name", ["estimates_first", "registered_functions"])
def test_values_of_zero(spark, tmp_path, name):
    """Queries whose documents are made of values, against their SQL where values are 0 or less."""
    rows = [(i, ("view", "click")[i % 2], (0.0, 2.5, 1e-5, 3e7, -2.5)[i // 4 % 5]) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    df = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]}) order by event_id").fetchall()
    assert [tuple(r) for r in df.orderBy("event_id").collect()] == want


def test_best_known(spark):
    """An estimate of 0 is none, and neither is a shown 0."""
    d = spark.createDataFrame([(5.0, 7.0), (0.0, 7.0), (None, 7.0), (0.0, 0.0), (0.0, None), (5.0, None)], "e double, s double")
    assert [r.t for r in d.select(suite.best_known(F.col("e"), F.col("s")).alias("t")).collect()] == [5, 7, 7, 0, 0, 5]
