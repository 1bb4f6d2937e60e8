"""Scalar functions over columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double_sha256(col) -> Column:
    return F.sha2(F.unhex(F.sha2(col, 256)), 256)


def reversed_hex(hex_col) -> Column:
    """Hex of the bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(hex_col, F.lit("[0-9a-fA-F]{2}"), F.lit(0))), "")


def duration_unit(ms) -> Column:
    ms = F.col(ms)
    return F.when(ms.isNull() | (ms == 0), "").when(ms >= 1000, "s").when(ms >= 1, "ms").when(ms >= 0.001, "us").otherwise("ns")


def duration_value(ms) -> Column:
    c = F.col(ms)
    return F.when(c.isNull() | (c == 0), None).when(c >= 1000, F.round(c / 1000, 3)).when(c >= 1, F.round(c, 3)).when(c >= 0.001, F.round(c * 1000, 3)).otherwise(F.round(c * 1e6, 3))


def _search(doc, key_has: str):
    stack = [doc]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if key_has in k.lower() and isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0:
                    return float(v)
            stack += reversed([v for v in x.values() if isinstance(v, (dict, list))])
        elif isinstance(x, list):
            stack += reversed(x)
    return None


@F.pandas_udf(T.DoubleType())
def first_time(docs: pd.Series) -> pd.Series:
    """The first positive number under a key that has "time" in it, in document order, at any depth; null for no JSON."""

    def one(s):
        try:
            return _search(json.loads(s), "time")
        except (TypeError, ValueError):
            return None

    return docs.map(one).astype("float64")


@F.pandas_udf(T.DoubleType())
def first_number(docs: pd.Series) -> pd.Series:
    """The first number between 0 and a million (both left out) in document order, at any depth; null for no JSON."""

    def one(s):
        try:
            stack = [json.loads(s)]
        except (TypeError, ValueError):
            return None
        while stack:
            x = stack.pop()
            if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x < 1e6:
                return float(x)
            stack += reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else [])
        return None

    return docs.map(one).astype("float64")


@F.pandas_udf(T.BooleanType())
def has_positive(docs: pd.Series) -> pd.Series:
    """Whether a JSON document has a number above 0 at any depth; null for no JSON."""

    def one(s):
        try:
            stack = [json.loads(s)]
        except (TypeError, ValueError):
            return None
        while stack:
            x = stack.pop()
            if isinstance(x, (int, float)) and not isinstance(x, bool) and x > 0:
                return True
            stack += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        return False

    return pd.Series([one(s) for s in docs], dtype=object)


@F.pandas_udf(T.LongType())
def varint(data: pd.Series) -> pd.Series:
    """The variable-length number that bytes start with (1, 3, 5 or 9 bytes, little-endian); null if they are too few."""

    def one(b):
        n = {0xFD: 2, 0xFE: 4, 0xFF: 8}.get(b[0], 0) if b else None
        if n is None or len(b) <= n:
            return None
        return int.from_bytes(b[1 : 1 + n], "little") if n else b[0]

    return pd.Series([one(b) for b in data], dtype="Int64")


@F.pandas_udf(T.StringType())
def merkle_root(leaves: pd.Series) -> pd.Series:
    """The root of a tree of double SHA-256 over hashes in hex (an array in order); an odd level repeats its last one; null for no leaf."""
    import hashlib

    twice = lambda b: hashlib.sha256(hashlib.sha256(b).digest()).digest()

    def one(hexes):
        level = [bytes.fromhex(h) for h in hexes] if hexes is not None else []
        while len(level) > 1:
            level += level[-1:] if len(level) % 2 else []
            level = [twice(level[i] + level[i + 1]) for i in range(0, len(level), 2)]
        return level[0].hex() if level else None

    return leaves.map(one)


#: Constants of the two lines of RIPEMD-160, and how far each of its rounds turns for each word of a block.
_LEFT, _RIGHT = (0, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xA953FD4E), (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0x7A6D76E9, 0)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
_TURNS = ((11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8), (12, 13, 11, 15, 6, 9, 9, 7, 12, 15, 11, 13, 7, 8, 7, 7), (13, 15, 14, 11, 7, 7, 6, 8, 13, 14, 13, 12, 5, 5, 6, 9), (14, 11, 12, 14, 8, 6, 5, 5, 15, 12, 15, 14, 9, 9, 8, 6), (15, 12, 13, 13, 9, 5, 8, 6, 14, 11, 12, 11, 8, 6, 5, 5))
_RHO = (7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8)


def ripemd160(data: bytes) -> bytes:
    """RIPEMD-160, as not every build of OpenSSL has it. The order of words in round j is _RHO applied j times, in the second line to 9 i + 5 modulo 16."""
    import struct

    turn = lambda x, n: (x << n | x >> (32 - n)) & 0xFFFFFFFF
    mixes = (lambda x, y, z: x ^ y ^ z, lambda x, y, z: (x & y) | (~x & z), lambda x, y, z: (x | ~y) ^ z, lambda x, y, z: (x & z) | (y & ~z), lambda x, y, z: x ^ (y | ~z))
    padded = data + b"\x80" + b"\0" * (-(len(data) + 9) % 64) + struct.pack("<Q", 8 * len(data))
    state = list(_START)
    for at in range(0, len(padded), 64):
        words, ends = struct.unpack("<16I", padded[at : at + 64]), []
        for constants, order, kinds in ((_LEFT, list(range(16)), mixes), (_RIGHT, [(9 * i + 5) % 16 for i in range(16)], mixes[::-1])):
            a, b, c, d, e = state
            for j in range(5):
                for w in order:
                    t = turn((a + kinds[j](b, c, d) + words[w] + constants[j]) & 0xFFFFFFFF, _TURNS[j][w])
                    a, b, c, d, e = e, (t + e) & 0xFFFFFFFF, b, turn(c, 10), d
                order = [_RHO[w] for w in order]
            ends.append((a, b, c, d, e))
        left, right = ends
        state = [(state[(i + 1) % 5] + left[(i + 2) % 5] + right[(i + 3) % 5]) & 0xFFFFFFFF for i in range(5)]
    return struct.pack("<5I", *state)


@F.pandas_udf(T.StringType())
def hash160(data: pd.Series) -> pd.Series:
    """RIPEMD-160 of SHA-256 of bytes, in hex; null stays null."""
    import hashlib

    return pd.Series([None if b is None else ripemd160(hashlib.sha256(b).digest()).hex() for b in data], dtype=object)


@F.pandas_udf(T.BinaryType())
def xor_bytes(data: pd.Series, key: pd.Series) -> pd.Series:
    """Bytes under a repeated key; null where either is null or the key is empty."""
    import numpy as np

    def one(b, k):
        if b is None or not k:
            return None
        pad = np.frombuffer((k * (len(b) // len(k) + 1))[: len(b)], np.uint8)
        return (np.frombuffer(b, np.uint8) ^ pad).tobytes()

    return pd.Series([one(b, k) for b, k in zip(data, key, strict=True)], dtype=object)


def duration_text(ms) -> Column:
    """A number of milliseconds as `1.234s`, `1.234ms`, `1.234us` or `1.234ns`; empty for null and 0."""
    shown = duration_value(ms).cast("decimal(38,3)").cast("string")
    return F.coalesce(F.concat(shown, duration_unit(ms)), F.lit(""))


def elapsed_ms(start, end) -> Column:
    """Milliseconds from one number of nanoseconds to another."""
    return (F.col(end) - F.col(start)) / 1e6


def megabytes(kilobytes) -> Column:
    return F.round(F.col(kilobytes) / 1024, 2)


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key, the right one's value counts. A null map is empty."""
    kind = "map<string,string>"
    empty = F.create_map().cast(kind)
    left, right = F.coalesce(left.cast(kind), empty), F.coalesce(right.cast(kind), empty)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def register(spark) -> None:
    """Makes the functions of this module that SQL lacks callable in spark.sql: first_time, first_number, varint, merkle_root, hash160, xor_bytes."""
    for f in (first_time, first_number, varint, merkle_root, hash160, xor_bytes):
        spark.udf.register(f.__name__, f)
