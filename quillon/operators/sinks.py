"""Sinks: reports as JSON or CSV, an append-only history, versioned baselines, and compressed record chunks. Spark's commit protocol makes each write whole."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import frames
from .blocks import with_height


def report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_history(df: DataFrame, path: str, commit: str, branch: str, at: str) -> None:
    """Adds a run's rows with who and when; partitioned by day."""
    ts = F.lit(at).cast("timestamp")
    df.withColumn("git_commit", F.lit(commit)).withColumn("git_branch", F.lit(branch)).withColumn("stored_at", ts).withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def hadoop_path(spark, path: str):
    """A path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark, path: str) -> list[int]:
    """Versions that were written to their end."""
    at, files = hadoop_path(spark, f"{path}/version=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in files.globStatus(at) or [])


def rotate_baseline(current: DataFrame, report: DataFrame | None, path: str, force: bool = False) -> bool:
    """Makes the current rows the baseline if there is none yet, if nothing regressed, or by force; says whether it did.

    Each baseline is a version of its own: the one before stays whole while the next is written, which may read it.
    """
    done = _versions(current.sparkSession, path)
    if done and not force and (report is None or not report.where("status = 'regression'").isEmpty()):
        return False
    current.write.mode("overwrite").parquet(f"{path}/version={max(done, default=0) + 1}")
    return True


def baseline(spark, path: str) -> DataFrame | None:
    """The newest whole baseline; None before the first."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={done[-1]}") if done else None


#: The sizes and versions that a record may have.
LEAST, MOST, VERSIONS = 88, 10 << 20, (1, 0x7FFFFFFF)


def valid_records(df: DataFrame) -> DataFrame:
    """Adds reason: null for a record to keep, else why it is not one. The version is the first four bytes, little-endian."""
    size = F.octet_length("payload")
    version = F.conv(F.concat(*(F.hex(F.substring("payload", i, 1)) for i in (4, 3, 2, 1))), 16, 10).cast("long")
    return df.withColumn("reason", F.when(~size.between(LEAST, MOST), "size").when(~version.between(*VERSIONS), "version"))


def write_chunks(df: DataFrame, path: str, size: int = 125000) -> None:
    """Valid records as zstd Parquet, a folder per chunk of `size` heights, so that a range of heights reads its chunks alone."""
    d = valid_records(df).where("reason is null").drop("reason").withColumn("chunk_id", F.floor(F.col("height") / size).cast("long"))
    d.repartition("chunk_id", F.floor(F.col("height") / 1000)).write.mode("overwrite").option("compression", "zstd").partitionBy("chunk_id").parquet(path)


def rejected(df: DataFrame) -> DataFrame:
    """How many records valid_records() rejects for each reason."""
    return valid_records(df).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def write_frames(df: DataFrame, path: str, per_file: int = 125000, second: str | None = None) -> DataFrame:
    """Records (height, payload) in order of height as zstd streams of framed records, `per_file` in each chunk_{n}.bin.zst but the last; file, records and bytes of each.

    A file is written under a name of its own and then moved, so that a task that runs again leaves one file; its size is read back and compared, as is that of a copy
    in the folder `second`. chunks.meta names the counts when all files are there. A task holds a batch of records and a write buffer.
    """
    spark = df.sparkSession
    d = with_height(df.select(F.col("height").alias("h_key"), "payload"), "h_key").select(F.floor(F.col("height") / per_file).cast("long").alias("chunk"), "height", "payload")

    def run(batches):
        import zstandard

        where, folder = frames.filesystem(path)
        where.create_dir(folder)
        now = temp = sink = out = None
        done = []

        def close():
            sink.close()
            out.close()
            target = f"{folder}/chunk_{now}.bin.zst"
            where.move(temp, target)
            size = where.get_file_info(target).size
            if second:
                there, copies = frames.filesystem(second)
                there.create_dir(copies)
                pa.fs.copy_files(target, f"{copies}/chunk_{now}.bin.zst", source_filesystem=where, destination_filesystem=there)
                if there.get_file_info(f"{copies}/chunk_{now}.bin.zst").size != size:
                    raise OSError(f"the copy of chunk {now} has another size")
            done.append((now, count, size))

        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                if chunk != now:
                    if now is not None:
                        close()
                    now, count, temp = chunk, 0, f"{folder}/.part-{uuid.uuid4().hex}"
                    out = where.open_output_stream(temp, compression=None)
                    sink = zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False)
                sink.write(frames.encode_frames([payload.as_buffer().to_pybytes()]))
                count += 1
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done, strict=True) if done else ([], [], []))], names=["chunk", "records", "bytes"])

    rows = d.repartition("chunk").sortWithinPartitions("chunk", "height").select("chunk", "payload").mapInArrow(run, "chunk long, records long, bytes long").collect()  # a row per file
    where, folder = frames.filesystem(path)
    where.create_dir(folder)
    with where.open_output_stream(f"{folder}/chunks.meta") as meta:
        meta.write(f"total_blocks={sum(r.records for r in rows)}\nnum_chunks={len(rows)}\nblocks_per_chunk={per_file}\ncompression=zstd\n".encode())
    return spark.createDataFrame([tuple(r) for r in rows], "chunk long, records long, bytes long")


def read_range(spark, path: str, start: int, end: int, size: int = 125000) -> DataFrame:
    """Records of heights start..end (inclusive); other chunks are not opened."""
    return spark.read.parquet(path).where(F.col("chunk_id").between(start // size, end // size) & F.col("height").between(start, end))
