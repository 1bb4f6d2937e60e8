"""Framed records from files, headers, chains, suites and manifests."""

import hashlib
import struct

import pytest
import zstandard

from quillon.functions import scalars
from quillon.operators import blocks, headers, suite
from quillon.plans import catalog
from quillon.sources import text as lines
from quillon.sources.frames import FrameSource, decode_frames, decode_stream, encode_frames, listed

MAGIC, PAD = bytes.fromhex("f9beb4d9"), bytes.fromhex("0102030405060708")
F = scalars.F


def load(spark, **options):
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").options(**options).load()


def test_damage(tmp_path):
    import io

    read = lambda data, **o: list(decode_stream(io.BytesIO(data), MAGIC, **o))
    two = encode_frames([b"a" * 90, b"b" * 90], MAGIC)
    assert [w for _, _, w in read(two)] == [None, None]
    assert read(two[:-1])[-1] == (1, None, "cut") and read(two + b"tail")[-1] == (2, None, "magic")
    assert read(two, least=91) == [(0, None, "length")]
    assert [p for _, p, _ in read(two, least=91, resync=True)] == [b"a" * 90, b"b" * 90]
    assert list(decode_frames(b"")) == [] and list(decode_frames(encode_frames([b"x"], counted=True), counted=True)) == [(0, b"x")]
    with pytest.raises(ValueError):
        list(decode_frames(struct.pack("<Q", 2) + encode_frames([b"x"]), counted=True))


@pytest.mark.parametrize("size", [1, 7, 1 << 20, (1 << 20) + 5, 3 << 20])
def test_long_records_over_buffers(size):
    records = [bytes([i]) * (size + i) for i in range(4)]
    data = encode_frames(records, MAGIC, PAD)
    assert [p for _, p in decode_frames(data, MAGIC, PAD)] == records
    assert [p for _, p in decode_frames(data, MAGIC, PAD, most=0, resync=True)] == records
    assert [p for _, p in decode_frames(encode_frames(records, MAGIC), MAGIC, PAD)] == records  # not under the pad


def test_chunk_files(spark, tmp_path):
    for chunk in (0, 1, 3):
        data = encode_frames([struct.pack("<I", chunk * 10 + i) + b"x" * 84 for i in range(10)])
        (tmp_path / f"chunk_{chunk}.bin.zst").write_bytes(zstandard.compress(data))
    (tmp_path / "chunks.meta").write_text("total_blocks=40\n")
    assert len(listed(f"{tmp_path}/*.zst")) == len(listed(f"file://{tmp_path}/*.zst")) == 3
    for root in ("", "file://"):
        got = load(spark, path=f"{root}{tmp_path}/chunk_*.zst", zstd="true", per_file="10", start="7", limit="26", least="88").collect()
        # chunk 2 is missing: its heights are, and no others
        assert sorted(r.height for r in got) == [*range(7, 20), *range(30, 33)]
        assert all(struct.unpack("<I", r.payload[:4])[0] == r.height for r in got)


def test_headers(spark):
    raw = struct.pack("<I", 2) + bytes(range(32)) + bytes(range(32, 64)) + struct.pack("<III", 1231006505, 0x1D00FFFF, 2083236893)
    r = headers.fields(spark.createDataFrame([(raw.hex(),), (None,)], "h string"), "h").collect()
    assert (r[0].version, r[0].time, r[0].bits, r[0].nonce) == (2, 1231006505, 0x1D00FFFF, 2083236893)
    assert r[0].prev_hash == bytes(range(32))[::-1].hex() and r[0].merkle_root == bytes(range(32, 64))[::-1].hex()
    assert r[0].block_hash == hashlib.sha256(hashlib.sha256(raw).digest()).digest()[::-1].hex()
    assert r[1].version is None


def test_chains(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(37)] + [("b5", "gone"), ("b6", "b5"), ("b7", "b5")]
    d = spark.createDataFrame(rows, "name string, prev string").repartition(3)
    got = {r.name: (r.root, r.height) for r in headers.chain_heights(d, "name", "prev").collect()}
    assert got == {f"a{i}": ("a0", i) for i in range(37)} | {"b5": ("b5", 0), "b6": ("b5", 1), "b7": ("b5", 1)}
    assert headers.chain_heights(d.limit(0), "name", "prev").count() == 0
    with pytest.raises(ValueError):
        headers.chain_heights(spark.createDataFrame([("x", "y"), ("y", "x")], "name string, prev string"), "name", "prev", most=3)


def test_numbers_and_roots(spark):
    d = spark.createDataFrame([(bytes([7]),), (b"\xfd\x01\x02",), (b"\xfe\x01\x00",), (b"",), (None,), (b"\xff" + b"\1" + bytes(7),)], "b binary")
    assert [r.n for r in d.select(scalars.varint("b").alias("n")).collect()] == [7, 513, None, None, None, 1]
    twice = lambda b: hashlib.sha256(hashlib.sha256(b).digest()).digest()
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    d = spark.createDataFrame([([a.hex(), b.hex(), c.hex()],), ([a.hex()],), ([],), (None,)], "x array<string>")
    assert [r.r for r in d.select(scalars.merkle_root("x").alias("r")).collect()] == [twice(twice(a + b) + twice(c + c)).hex(), a.hex(), None, None]
    d = spark.createDataFrame([('{"a":[0,1000000,"7",{"b":2.5}],"c":1}',), ("[true]",), ("{",)], "j string")
    assert [r.n for r in d.select(scalars.first_number("j").alias("n")).collect()] == [2.5, None, None]
    r = spark.range(1).select(blocks.clamp_range(F.lit(1), F.lit(9), F.lit(4), F.lit(None).cast("int")).alias("r"), blocks.clamp_range(F.lit(1), F.lit(3), F.lit(4), F.lit(8)).alias("n")).first()
    assert tuple(r.r) == (4, 9) and r.n is None


def test_merkle_query(spark):
    rows = catalog.queries()["merkle_roots"](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.where("length(root) <> 64").isEmpty()


def test_suite(spark):
    assert [len(v) for v in suite.SPEED.values()] == [15, 13, 2] and suite.of_class("slow") == ["deep-analysis-bench", "node-sync-rpc-bench"]
    d = spark.createDataFrame([("core-mempool-bench", 1), ("commons-deep-analysis-bench", 0), ("other", 1)], "n string, ok int")
    assert [r.s for r in d.select(suite.speed_of("n").alias("s")).collect()] == ["fast", "slow", "medium"]
    r = suite.run_summary(d, "n", F.col("ok") == 1).first()
    assert (r.benchmarks_completed, r.benchmarks_failed, r.failed) == (2, 1, ["commons-deep-analysis-bench"])
    e = spark.createDataFrame([('{"median":{"point_estimate":5},"percentiles":{"p95":9},"min":{"point_estimate":1}}',), ("{}",), ("bad",)], "d string")
    r = [x.s for x in e.select(suite.estimates("d").alias("s")).collect()]
    assert (r[0].percentiles.p50, r[0].percentiles.p95, r[0].min, r[0].mean.point_estimate) == (5, 9, 1, None)
    assert r[1].median.point_estimate is None and r[2].sample_count is None


def test_manifests(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[package]\nname = "x"\n[features]\ndefault = ["std", "fast"]\nstd = []\nfast = ["std"]\n slow-2 = []\n\n[deps]\nserde = "1"\n')
    (tmp_path / "b.toml").write_text('[package]\nname = "y"\n')
    a, b = lines.manifest_features(spark, str(tmp_path / "*.toml")).orderBy("file").collect()
    assert (a.features, a.default, a.optional_features) == (["std", "fast", "slow-2"], ["std", "fast"], 1)
    assert (b.total_features, b.default_features) == (0, 0)
    d = spark.createDataFrame([("option(WITH_A \"a\" ON)\n  option (B off)\n# option(C)\n",)], "t string")
    assert d.select(lines.build_options("t").alias("o")).first().o == ["WITH_A", "B"]
