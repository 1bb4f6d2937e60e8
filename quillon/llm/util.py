"""Shared pieces of the training-data operators: words as exact numbers and as 64-bit names, Arrow batches of bounded size, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t\n\v\f\r (ASCII white space, as bytes.split()).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that numpy works on at once, and that Spark sends to Python at once (one row at least).
SLICE_BYTES, BATCH_BYTES = 1 << 20, 2 << 20

_U = np.uint64
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0] : o[-1]]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most `limit` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def numbered(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the strings that follow each other in data (equal numbers: equal bytes), and the distinct strings by number."""
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def renumbered(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for distinct whole numbers."""
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers from 0 on (equal numbers: equal pairs)."""
    return renumbered(a * (int(b.max(initial=0)) + 1) + b)


class Words:
    """The words of a slice of texts: row, first byte and end byte of each, `number` (equal: equal words) and, by number, the distinct ones."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        n = len(raw)
        self.ink = ink = ~_WS[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = ink.copy(), ink.copy()
        if n:
            first[1:] &= ~ink[:-1] | edge[1:n]
            last[:-1] &= ~ink[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.number, self.distinct = numbered(raw[ink], self.end - self.start)

    def names(self, seed: int = 0) -> np.ndarray:
        """A 64-bit name of each word: XXH64 of its bytes."""
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w, seed) for w in self.distinct.to_pylist()], np.uint64)[self.number]


def chained(names: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """A 64-bit name of names[start:end] for each span of `most` names or fewer, in their order."""
    h = mix((end - start).astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    for k in range(most):
        on = np.flatnonzero(start + k < end)
        h[on] = mix(h[on] ^ names[start[on] + k]) if len(on) < len(h) else mix(h ^ names[start + k])
    return h


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of BATCH_BYTES for the session at most: neither side holds more of a task's rows than that, or one long text."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column `times` says (which becomes `copy`: 0, 1, ...); no array for it is longer than 4096 or a 4096th of that."""
    parts = df.where(F.col(times) > 0).withColumn("part", F.explode(F.expr(f"sequence(0L, ({times} - 1) div 4096)")))
    copy = F.explode(F.expr(f"sequence(part * 4096, least(part * 4096 + 4096, cast({times} as long)) - 1)"))
    return parts.withColumn("copy", copy).drop("part", times)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a session within one process (tests) gets a temporary one; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors cost no rerun of what came before."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_key(text="text"):
    """SHA-256 of a text (equal: equal texts), and a long made of it to join by."""
    digest = F.sha2(F.col(text), 256)
    return F.xxhash64(digest), digest
