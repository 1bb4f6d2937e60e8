"""Packed headers and chains of them: fields by SQL functions, order by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import double_sha256, reversed_hex
from .shared import shared_folder

#: First byte (from 1) and bytes of each field of an 80-byte header; numbers are little-endian, hashes are shown in reverse.
NUMBERS = {"version": (1, 4), "time": (69, 4), "bits": (73, 4), "nonce": (77, 4)}
HASHES = {"prev_hash": (5, 32), "merkle_root": (37, 32)}


def le_number(hex_col) -> Column:
    """A little-endian number in hex (7 bytes at most) as a long."""
    return F.conv(reversed_hex(hex_col), 16, 10).cast("long")


def fields(df: DataFrame, header_hex: str) -> DataFrame:
    """Adds version, prev_hash, merkle_root, time, bits, nonce and block_hash of a header in hex (160 digits)."""
    part = lambda at, n: F.substring(F.lower(header_hex), 2 * at - 1, 2 * n)
    out = df
    for name, place in NUMBERS.items():
        out = out.withColumn(name, le_number(part(*place)))
    for name, place in HASHES.items():
        out = out.withColumn(name, reversed_hex(part(*place)))
    return out.withColumn("block_hash", reversed_hex(double_sha256(F.unhex(part(1, 80)))))


def linked(df: DataFrame, order: str, name: str, prev: str, *keys: str) -> DataFrame:
    """Adds linked: whether a row's prev is the name of the row before it (null for a first row)."""
    return df.withColumn("linked", F.col(prev) == F.lag(name).over(Window.partitionBy(*keys).orderBy(order)))


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def chain_heights(df: DataFrame, name: str, prev: str, most: int = 40) -> DataFrame:
    """(name, root, height): how many links a row is from the first row of its chain, and that row's name.

    A first row's prev is null or no row's name. Each round doubles the reach of every row's pointer, so a chain of n rows takes
    log2(n) joins on the names and no row ever walks it. Names must be unique and not null; a cycle is an error.
    """
    names = df.select(F.col(name).alias("up"), F.lit(True).alias("known"))
    at = df.select(F.col(name).alias("name"), F.col(prev).alias("up")).join(names, "up", "left")
    at = _cut(at.select("name", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), F.col("up")).otherwise(F.col("name")).alias("root"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("height")))
    for _ in range(most):
        if at.where("up is not null").isEmpty():
            return at.select("name", "root", "height")
        other = at.select(F.col("name").alias("up"), F.col("up").alias("next"), F.col("root").alias("next_root"), F.col("height").alias("more"))
        j = at.join(other, "up", "left")
        at = _cut(j.select("name", F.col("next").alias("up"), F.coalesce("next_root", "root").alias("root"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height")))
    raise ValueError("a chain has a cycle")
