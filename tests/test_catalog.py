"""Every registered query of the catalogue that has SQL, against DuckDB on the same small tables; and operator cases."""

import glob
import os
import random

import duckdb
import pytest

from quillon.functions import scalars
from quillon.operators import compare, latency
from quillon.plans import catalog
from quillon.sources import text as lines
from quillon.sources.frames import FrameSource, decode_frames, encode_frames, xor

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    fix = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    want = duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(got) == plain(want)


def test_nearest_rank(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "k string, v double")
    r = latency.nearest_rank(d, ["k"], "v", (50, 90, 95, 100)).first()
    assert (r.n, r.p50, r.p90, r.p95, r.p100) == (20, 11, 19, 20, 20)


def test_nearest_rank_brute(spark):
    rng = random.Random(7)
    values = {"a": [rng.choice((-1, 1)) * rng.lognormvariate(0, 9) for _ in range(400)], None: [rng.randint(-3, 3) / 1.0 for _ in range(99)], "hot": [5.0] * 300 + [5.01, 0.0, float("inf")], "one": [-2.5], "none": [None]}
    d = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double").repartition(3)
    got = {r.k: tuple(r)[1:] for r in latency.summary(d, ["k"], "v", (0, 1, 50, 99, 100)).select("k", "n", "p0", "p1", "p50", "p99", "p100").collect()}
    place = lambda vs, q: sorted(vs)[min(len(vs) * q // 100, len(vs) - 1)]
    assert got == {k: (len(vs), *(place(vs, q) for q in (0, 1, 50, 99, 100))) for k, vs in values.items() if k != "none"}
    assert latency.summary(d.limit(0), ["k"], "v").count() == 0


def test_winner_and_regressions(spark):
    d = spark.createDataFrame([("x", 66.25, 10.8), ("tie", 5.0, 5.0), ("zero", 0.0, 1.0)], "k string, core_time_ms double, commons_time_ms double")
    assert {(r.k, r.winner, r.speedup) for r in compare.winner(d).collect()} == {("x", "commons", 6.13), ("tie", "core", 1.0)}
    base = spark.createDataFrame([("r", 66.2), ("edge", 100.0), ("near", 100.0), ("gone", 1.0)], "k string, v double")
    now = spark.createDataFrame([("r", 75.5), ("edge", 110.0), ("near", 110.004), ("new", 1.0)], "k string, v double")
    got = {r.k: (r.change_percent, r.status, r.speedup) for r in compare.regressions(now, base, ["k"], "v").collect()}
    assert got == {"r": (14.05, "regression", 0.88), "edge": (10.0, "unchanged", None), "near": (10.0, "unchanged", None)}


def test_text_readers(spark):
    d = spark.createDataFrame([("| 57,927,463.00 | 17.26 | `Add` |", "x time: [1.0 µs 2.0 µs 3.0 µs]", "-1.5e3"), ("", "", "1.")], "a string, b string, c string")
    r = d.select(lines.pipe_cell("a", 1).alias("ns"), lines.quoted_name("a").alias("name"), lines.bracket_ns("b").alias("t"), lines.numeric("c").alias("v")).first()
    assert (r.ns, r.name, r.t, r.v) == (57927463.0, "Add", 2000.0, -1500.0)


def test_scalars(spark):
    d = spark.createDataFrame([('{"a":[{"x_time":0},{"Time":{"deep_time":3}}],"time":5}',), ("no json",), (None,)], "j string")
    assert [r.t for r in d.select(scalars.first_time("j").alias("t")).collect()] == [5.0, None, None]
    assert d.select(scalars.reversed_hex(d.j.substr(0, 0)).alias("h"), scalars.reversed_hex(scalars.F.lit("0a0B0c")).alias("r")).first().r == "0c0B0a"


def test_frames(spark, tmp_path):
    records = [b"a" * 90, b"", bytes(range(256))]
    magic, key = bytes.fromhex("f9beb4d9"), bytes.fromhex("0102030405060708")
    data = encode_frames(records, magic, key)
    assert [p for _, p in decode_frames(data, magic, key)] == records and xor(xor(data, key), key) == data
    assert [n for n, _ in decode_frames(data + b"tail", magic, key, least=1)] == [0]
    (tmp_path / "f.dat").write_bytes(data)
    spark.dataSource.register(FrameSource)
    got = spark.read.format("frames").options(path=str(tmp_path), magic=magic.hex(), key=key.hex()).load().orderBy("record").collect()
    assert [bytes(r.payload) for r in got] == records


def test_fold(spark):
    rows = catalog.queries()["utxo_fold"](spark, SF).collect()
    assert sum(r.steps for r in rows) == 1000
