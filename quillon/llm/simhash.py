"""SimHash near-dedup with bit-sliced comparison.

Two fingerprints of `radius` differing bits or fewer agree on all but `radius` of any set of bit blocks. Each distinct fingerprint goes to the
bucket of every choice of blocks that may be the equal ones; more blocks are taken as there are more fingerprints, which keeps buckets small and loses no link.
In a bucket, bit planes are stored vertically (a word holds one bit of 64 fingerprints), so that one XOR updates 64 distances;
distances are counted by carry-save bitwise counters, and a block (the 64 fingerprints of a word) is abandoned once all its distances exceed the radius. The members of a
bucket larger than a tile go to the buckets of further blocks, which cut the bits crosswise: near ones agree on some of these too. What is then still larger than a tile
is compared as pairs of tiles, each a task of bounded size. A tile gives a star of each group that it finds, not its pairs; the stars' components are found by joins.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import discard, in_batches, row_slices, text_buffers, written

_U = np.uint64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TILE = 2048


def majority(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Of each group h[edge[i]:edge[i + 1]] the bits that are set in over half of its hashes; zero for an empty one."""
    out = np.zeros(len(edge) - 1, np.uint64)
    for i, j in row_slices(edge, 1 << 16):
        ones = np.zeros((j - i, 64), np.int64)
        for a in range(int(edge[i]), int(edge[j]), 1 << 16):  # a long group comes in several parts
            b = min(a + (1 << 16), int(edge[j]))
            bits = np.unpackbits(h[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = np.clip(edge[i : j + 1] - a, 0, b - a)
            some = np.flatnonzero(at[1:] > at[:-1])
            ones[some] += np.add.reduceat(bits, at[:-1][some], axis=0, dtype=np.int64)
        out[i:j] = np.packbits(2 * ones > np.diff(edge[i : j + 1])[:, None], axis=1).view(">u8")[:, 0]
    return out


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of a text, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    digest, count = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return [digest(joined[a:b], 42) for a, b in zip(starts[:count].tolist(), (ends[len(words) - count :] - 1).tolist(), strict=True)]


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            for i, j in row_slices(offs):
                hashes = [shingle_hashes(raw[offs[k] : offs[k + 1]].tobytes(), shingle) for k in range(i, j)]
                fp = majority(np.array([x for h in hashes for x in h], np.uint64), np.r_[0, np.cumsum([len(h) for h in hashes])])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("text_hash").slice(i, j - i), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return run


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit i of word w of plane k is bit k of fingerprint 64 w + i."""
    pad = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    pad[: len(fps)] = fps
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64).reshape(64, -1)


def within(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of `radius` differing bits at most, the member being later than the query if both are one set (n < 0)."""
    width, bits = sliced.shape[1], (radius + 1).bit_length()
    members = abs(n)
    over = np.zeros((len(queries), width), np.uint64)
    if members % 64:
        over[:, -1] = ~_U((1 << (members % 64)) - 1)
    if n < 0:
        q = np.arange(len(queries))
        over[np.arange(width)[None, :] < (q // 64)[:, None]] = ~_U(0)
        over[q, q // 64] |= ~_U(0) >> (_U(63) - (q % 64).astype(np.uint64))
    counter = [np.zeros_like(over) for _ in range(bits)]
    limit, cols = radius + 1, np.arange(width)
    for k in range(64):
        carry = sliced[k, cols][None, :] ^ (_U(0) - ((queries >> _U(k)) & _U(1)))[:, None]
        for c in counter:  # carry-save: the sum stays in the counter, the carry goes on
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if k % 8 == 7:
            if limit == 1 << (bits - 1):
                over |= counter[-1]
            else:  # counters at the limit or above
                ge, eq = np.zeros_like(over), np.full_like(over, ~_U(0))
                for j in range(bits - 1, -1, -1):
                    if limit >> j & 1:
                        eq = eq & counter[j]
                    else:
                        ge |= eq & counter[j]
                        eq = eq & ~counter[j]
                over |= ge | eq
            alive = (over != ~_U(0)).any(0)
            if not alive.any():
                z = np.zeros(0, np.int64)
                return z, z
            if alive.sum() <= 0.75 * len(cols):  # blocks whose distances all exceed the radius are left out of the other planes
                cols, over, counter = cols[alive], over[:, alive], [c[:, alive] for c in counter]
    hit_q, hit_w = np.nonzero(~over)
    bit = np.unpackbits((~over[hit_q, hit_w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, i = np.nonzero(bit)
    return hit_q[at], cols[hit_w[at]] * 64 + i


class _Forest:
    """Roots of the groups that links join; the smaller place is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> None:
        while not ((up := self.up[self.up]) == self.up).all():
            self.up = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.flatten()
            ra, rb = self.up[a], self.up[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            todo = low < high
            a, b = a[todo], b[todo]
            np.minimum.at(self.up, high[todo], low[todo])


def stars(fps: np.ndarray, left: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what `radius` joins: all pairs where `left` is all true, else between the left and the other ones."""
    forest = _Forest(len(fps))
    a, b = (np.arange(len(fps)),) * 2 if left.all() else (np.flatnonzero(left), np.flatnonzero(~left))
    for i in range(0, len(a), block):
        q = a[i : i + block]
        if left.all():
            own = b[i:]
            x, y = within(fps[q], planes(fps[own]), -len(own), radius)
        else:
            own = b
            x, y = within(fps[q], planes(fps[own]), len(own), radius)
        forest.link(q[x], own[y])
    forest.flatten()
    away = np.flatnonzero(forest.up != np.arange(len(fps)))
    return fps[away], fps[forest.up[away]]


def _compare(radius: int):
    """Rows sorted by bucket and tile pair -> links. Small buckets are compared together: a link is one wherever it is found."""

    def work(fps, left):
        a, b = stars(fps, left, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        fps, left, key = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)

        def ready(last):
            nonlocal fps, left, key
            edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            stop, i, ends = len(edge) - 1 - (not last), 0, 0
            while i < stop:
                j = i + 1
                if left[edge[i] : edge[i + 1]].all():
                    while j < stop and edge[j + 1] - edge[i] <= 256 and left[edge[j] : edge[j + 1]].all():
                        j += 1
                f, side = fps[edge[i] : edge[j]], left[edge[i] : edge[j]]
                if side.all():  # several buckets may hold one fingerprint
                    f = np.unique(f)
                    side = np.ones(len(f), bool)
                if len(f) > 1:
                    yield work(f, side)
                ends, i = edge[j], j
            fps, left, key = fps[ends:], left[ends:], key[ends:]

        for b in batches:
            fps = np.r_[fps, b.column("fp").to_numpy().view(np.uint64)]
            left = np.r_[left, b.column("is_left").to_numpy(zero_copy_only=False)]
            key = np.r_[key, b.column("task").to_numpy()]
            yield from ready(False)
        yield from ready(True)

    return run


def _to_buckets(df: DataFrame, bucket, masks: list[int]) -> DataFrame:
    """fp, and a bucket for each mask: the one of those that agree with it on the mask's bits and on `bucket`."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(signed)))
    return df.select("fp", bucket.alias("inside"), F.explode(keys).alias("k")).select("fp", F.xxhash64("inside", "k.t", "k.v").alias("bucket"))


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, n: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) -> (a, b): links whose components are those of all pairs of `radius` differing bits or fewer."""
    n = fps.count() if n is None else n
    blocks = radius + 1
    # mean bucket size n / 2**(bits of the equal blocks); blocks are added while that is over 256
    while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > 256:
        blocks += 1
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in c) for c in itertools.combinations(range(blocks), blocks - radius)]
    crosswise = [sum(1 << k for k in range(i, 64, radius + 1)) for i in range(radius + 1)]
    sized = lambda d: d.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    keyed = _to_buckets(fps, F.lit(0), masks)
    sizes = written(sized(keyed), "buckets")
    finer = written(_to_buckets(keyed.join(sizes.where(F.col("size") > tile), "bucket"), F.col("bucket"), crosswise), "finer")
    keyed = keyed.join(sizes.where(F.col("size") <= tile), "bucket").union(finer.join(written(sized(finer), "buckets"), "bucket").select("bucket", "fp", "size"))
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", "bucket"), F.col("tiles")).cast("int")
    placed = keyed.withColumn("tiles", tiles).withColumn("own", own)
    # tile pairs (i, j), i <= j: a fingerprint of tile t takes part in each pair that has t
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = placed.select("fp", "bucket", "own", other).select("fp", (F.col("own") <= F.col("other")).alias("is_left"), F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    return in_batches(pairs.repartition("task").sortWithinPartitions("task"), _compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """A row for each row of docs: doc_id, fp (long), component_id, text_hash (Spark's xxhash64 of the text).

    Texts are lower-cased (A-Z), cut into words, and their shingles hashed by XXH64 (seed 42); a text of fewer words is one shingle,
    one without words (null, empty) has fingerprint zero. component_id is the smallest doc_id reachable by links, the row's own included. Rows of a null
    doc_id link others too; a component of these alone has a null id. Repeated rows come back as often.
    """
    own = in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash"), _fingerprints(shingle), "doc_id long, text_hash long, fp long")
    return grouped(written(own, "fingerprints"), lambda fps: links(fps, radius))


def grouped(own: DataFrame, linked) -> DataFrame:
    """own(doc_id, text_hash, fp) with the component_id of each row; linked: distinct fingerprints -> links (a, b)."""
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(linked(distinct.select("fp")))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    member = written(member, "members")
    low = written(member.groupBy("root").agg(F.min("low").alias("component_id")), "low")  # a table, so that a large component's members can be split
    named = written(member.join(low, "root").select("fp", "component_id"), "named")
    discard(distinct, member, low)
    return own.join(named, "fp").select("doc_id", "fp", "component_id", "text_hash")


def one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """A row of docs, all columns, for each group of near-duplicates: one of the group's smallest doc_id, of several the one of least text hash.

    A group of null doc_ids alone keeps one row for each fingerprint. Equal rows count as one.
    """
    return one_row_each(docs, near_duplicates(docs, radius, shingle))


def one_row_each(docs: DataFrame, near: DataFrame) -> DataFrame:
    """one_of_each by the groups that near (as near_duplicates gives it) has."""
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    texts = near.where("doc_id <=> component_id").groupBy("component_id", alone.alias("alone"), "fp", "text_hash").agg(F.count("*").alias("n"))
    chosen = texts.groupBy("component_id", "alone").agg(F.min(F.struct("fp", "text_hash", "n")).alias("s"))
    key = lambda d: d.withColumn("key", F.xxhash64("id", "hash"))
    chosen = key(chosen.select(F.col("component_id").alias("id"), F.col("s.text_hash").alias("hash"), "s.n")).toDF("c_id", "c_hash", "n", "key")
    chosen = written(chosen, "chosen")
    # the row is kept as one column, so that no name of docs can clash with these
    rows = key(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")))
    of = lambda which: rows.join(chosen.where(which).hint("shuffle_hash"), "key").where("hash = c_hash and id <=> c_id")
    # both joins read one exchange of the rows; of the repeated rows of one id and text one is left, before any of them moves again
    return of("n = 1").select("row.*").union(of("n > 1").groupBy("key").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row")).select("row.*"))
