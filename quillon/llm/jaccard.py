"""Near-duplicates by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, none missed.

SimHash proposes first: sets whose fingerprints differ by four bits or fewer are candidates, as are, for what four bits miss, sets that share a rare shingle: in any one
order of all shingles, two similar sets share one of their first n - ceil(0.8 n) + 1 (their prefix). How many they share bounds their overlap, 16 bits of each shingle
bound it closer, and what is left is compared in full: only that links two texts. Frequent shingles come last in the order, so that common passages make no
candidates. A first round compares each set with one centre of each bucket alone, so that a large group of near copies is found by its stars and not by its pairs; a
second one compares what shares a bucket and is not yet joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import _LOWER, grouped, majority, one_row_each
from .simhash import links as near_fingerprints
from .util import Words, chained, discard, in_batches, row_slices, text_buffers, written

SHINGLE = 5
#: Similarity as a fraction: sets of a and b shingles need an overlap of P * (a + b) / (P + Q) at least, being at least P / Q similar.
P, Q = 4, 5
#: Which share of texts shows what is frequent, in how many of these it is, and how many such shingles are put last at most. Any choice gives the same result.
SHARE, FREQUENT, LAST = 16, 8, 1 << 16
_FOLD = np.frombuffer(_LOWER, np.uint8)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE):
    """Of each slice of rows: its first row, the sorted distinct 64-bit names of all rows' shingles, and each row's edges in these."""
    offs, raw = text_buffers(texts)
    for i, j in row_slices(offs):
        words = Words(offs[i : j + 1] - offs[i], _FOLD[raw[offs[i] : offs[j]]])
        row, name = words.row, words.names()
        edge = np.searchsorted(row, np.arange(j - i + 1))
        n = np.diff(edge)
        count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        first = np.r_[0, np.cumsum(count)]
        start = np.arange(first[-1]) - np.repeat(first[:-1] - edge[:-1], count)
        h = chained(name, start, np.minimum(start + shingle, np.repeat(edge[1:], count)), shingle)
        sets = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield i, np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]


def set_names(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _names(batches):
    for b in batches:
        for i, h, edge in shingle_sets(b.column("text")):
            part = b.slice(i, len(edge) - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(set_names(h, edge)), pa.array(majority(h, edge).view(np.int64))], names=["doc_id", "text_hash", "fp", "sim"])


def _all(batches):
    for b in batches:
        for _, h, _ in shingle_sets(b.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["shingle"])


def _prefixes(last: np.ndarray):
    def run(batches):
        for b in batches:
            for _, h, edge in shingle_sets(b.column("text")):
                n = np.diff(edge)
                k = np.where(n > 0, n - (P * n + Q - 1) // Q + 1, 0)
                owner = np.repeat(np.arange(len(n)), n)
                if len(last):
                    order = np.lexsort((np.isin(h, last), owner))  # stable: by name within
                    ordered = h[order]
                else:
                    ordered = h
                keep = np.arange(len(h)) - edge[owner] < k[owner]
                fp = set_names(h, edge)
                yield pa.RecordBatch.from_arrays([pa.array(fp[owner[keep]]), pa.array(n[owner[keep]]), pa.array(ordered[keep].view(np.int64))], names=["fp", "n", "shingle"])

    return run


def _whole(batches):
    for b in batches:
        for _, h, edge in shingle_sets(b.column("text")):
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            fp = set_names(h, edge)
            brief = (h >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([brief[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([h[s:e].tobytes() for s, e in spans], pa.binary())], names=["fp", "brief", "whole"])


def _alike(kind: str):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append((P + Q) * int((y[at] == x).sum()) >= P * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def alike(pairs: DataFrame, keyed: DataFrame, own: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of names those whose sets are P / Q similar. own(fp, rep): the row of keyed(key, text) that has the set."""
    pairs = written(pairs, "candidates")
    names = pairs.selectExpr("a fp").union(pairs.selectExpr("b fp")).distinct()
    texts = keyed.join(own.join(names, "fp").selectExpr("rep key"), "key").select("text")
    sets = written(in_batches(texts, _whole, "fp long, brief binary, whole binary").dropDuplicates(["fp"]), "sets")
    side = lambda k, v, column: sets.select(F.col("fp").alias(k), F.col(column).alias(v))
    for column, kind in (("brief", "<u2"), ("whole", "<u8")):
        both = pairs.join(side("a", "x", column), "a").join(side("b", "y", column), "b")
        less = written(in_batches(both, _alike(kind), "a long, b long"), "alike")
        discard(pairs)
        pairs = less
    discard(sets)
    return pairs


def may_be_alike(pairs: DataFrame) -> DataFrame:
    """a, b of pairs(a, b, na, nb, c) whose c shared prefix shingles leave room for enough overlap, as do their sizes: what is shared is in both prefixes or after the one that ends first."""
    rest = lambda n: F.floor((P * F.col(n) + Q - 1) / Q) - 1
    pairs = pairs.where(Q * F.least("na", "nb") >= P * F.greatest("na", "nb"))
    return pairs.where((P + Q) * (F.col("c") + F.greatest(rest("na"), rest("nb"))) >= P * (F.col("na") + F.col("nb"))).select("a", "b")


def by_fingerprint(own: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): pairs of names that join all sets of own(fp, sim) whose SimHashes link, each but the least one of a fingerprint with that one, and these by the links of theirs."""
    sims = written(own.groupBy("sim").agg(F.min("fp").alias("low")), "sims")
    same = own.join(sims, "sim").where("fp <> low").selectExpr("fp a", "low b")
    near = near_fingerprints(sims.selectExpr("sim fp"), radius)
    near = near.groupBy("a").agg(F.min("b").alias("b")).join(sims.selectExpr("sim a", "low la"), "a").join(sims.selectExpr("sim b", "low lb"), "b").selectExpr("la a", "lb b")
    return same.union(near)


def around_centres(shared: DataFrame) -> DataFrame:
    """(a, b, na, nb, c): each set of shared(fp, n, shingle) with the centre of each of its buckets, c being how many of its buckets have that centre.

    The centre of a bucket is the set whose buckets are the largest: of a text and its near copies the text itself, as each copy lacks some of what all others share."""
    size = written(shared.groupBy("shingle").agg(F.count("*").alias("size")), "sizes")
    score = written(shared.join(size, "shingle").groupBy("fp").agg(F.sum("size").alias("score")), "scores")
    centre = shared.join(score, "fp").groupBy("shingle").agg(F.max(F.struct("score", "fp", "n")).alias("m"))
    centre = written(centre.select("shingle", F.col("m.fp").alias("b"), F.col("m.n").alias("nb")), "centres")
    return shared.join(centre, "shingle").where("fp <> b").groupBy(F.col("fp").alias("a"), "b").agg(F.first("n").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("c"))


def links(keyed: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of similar sets."""
    seen = in_batches(keyed.where(F.pmod(F.xxhash64(F.lit(SHARE), "text"), F.lit(SHARE)) == 0).select("text"), _all, "shingle long")
    often = seen.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(LAST)
    last = np.sort(np.array([r.shingle for r in often.collect()], np.int64)).view(np.uint64)
    rows = written(in_batches(keyed.select("text"), _prefixes(last), "fp long, n long, shingle long"), "prefixes")
    buckets = written(rows.groupBy("shingle").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("shingle"), "buckets")
    shared = written(rows.join(buckets, "shingle", "left_semi").distinct(), "shared")
    discard(rows, buckets)
    stars = written(around_centres(shared), "stars")
    proposed = by_fingerprint(own).union(may_be_alike(stars))
    near = alike(proposed.selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), keyed, own)
    roots = components(near).withColumnRenamed("node", "fp")
    placed = written(shared.join(roots, "fp", "left").select("shingle", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
    discard(shared)
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
    left = written(placed.join(mixed, "shingle"), "apart")
    discard(placed)
    one, other = left.selectExpr("shingle", "fp a", "n na", "root ra"), left.selectExpr("shingle", "fp b", "n nb", "root rb")
    pairs = one.join(other, "shingle").where(f"a < b and ra <> rb and {Q} * least(na, nb) >= {P} * greatest(na, nb)")
    pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("c"))
    more = alike(may_be_alike(pairs), keyed, own)
    discard(left)
    return near.union(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, fp (the name of its set of shingles), component_id, text_hash, as simhash.near_duplicates has them.

    Texts are lower-cased (A-Z) and cut into words; one of fewer words than a shingle is one shingle, and texts without words are alike. Shingles
    are 64-bit names of their words. Rows of a null doc_id link others too; a component of these alone has a null id. Repeated rows come back as often.
    """
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")
    own = in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash"), _names, "doc_id long, text_hash long, fp long, sim long")
    own = written(own, "names")
    reps = written(own.groupBy("fp").agg(F.min(F.xxhash64("doc_id", "text_hash")).alias("rep"), F.min("sim").alias("sim")), "reps")
    return grouped(own, lambda _: links(keyed, reps))


def one_of_each(docs: DataFrame) -> DataFrame:
    """A row of docs, all columns, for each group of similar texts, chosen as simhash.one_of_each does."""
    return one_row_each(docs, near_duplicates(docs))
