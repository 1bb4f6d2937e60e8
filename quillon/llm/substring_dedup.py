"""Substring dedup by recompression.

Rounds of recompression name every run of equal words and every pair (a, b) whose symbols fall on the left and the right
side of that round's split of the alphabet. A name is a hash of its content and a side is a hash of a name, so all executors
name equal runs and pairs alike without an exchange of every word: equal substrings get the same symbols but near their ends
(EDGE words at most, see below). Of the symbols inside a window of `window` words, the one of least rank is its anchor, which
equal windows agree on. The symbols around an anchor that all windows of one half of its offsets hold (CONTEXT words) get one
high-level name, and Spark counts these names globally: a name found in a single text cannot hold a repeat. For the
others, the full windows are verified: the bytes of their words give a 128-bit BLAKE2b digest, and Spark finds the smallest doc_id of each digest. Names decide
which windows are looked at, and digests alone what is removed; names that collide cost time and change nothing.

How far ends reach: a run of more than RUN_REACH words stays a row of equal symbols, a pair of more words than its round's reach is not
merged. What lies outside of a window can thus change its outer RUN_REACH words by runs and reach - 1 more words by each round of pairs. These bounds keep
a name's content well inside of a window; no word and no window goes without a symbol for them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Words, chained, discard, in_batches, mix, row_slices, text_buffers, text_key, written

RUN_REACH, PAIR_REACH = 3, (2, 4)
EDGE = RUN_REACH + sum(c - 1 for c in PAIR_REACH)
SPAN = max(RUN_REACH, *PAIR_REACH)
_U = np.uint64


def recompress(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols that rounds of runs and pairs leave; none crosses from one row to the next."""
    n = len(names)
    at, span = np.arange(n), np.ones(n, np.int64)
    if not n:
        return names, at
    new = np.r_[True, (names[1:] != names[:-1]) | (row[1:] != row[:-1])]
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, n])
    run = np.repeat(length, length)
    keep = new | (run > RUN_REACH)
    short = new & (run > 1) & (run <= RUN_REACH)
    names = np.where(short, mix(names * _U(3) + run.astype(np.uint64)), names)
    span = np.where(short, run, 1)
    names, at, span, row = names[keep], at[keep], span[keep], row[keep]
    for r, cap in enumerate(PAIR_REACH):
        right = (mix(names + _U((r + 1) * 0xA0761D6478BD642F % 2**64)) >> _U(63)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (row[:-1] == row[1:]) & (span[:-1] + span[1:] <= cap))
        names, span = names.copy(), span.copy()
        names[pair] = mix(names[pair] * _U(0x9FB21C651E98DF25) + mix(names[pair + 1]))
        span[pair] += span[pair + 1]
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, at, span, row = names[keep], at[keep], span[keep], row[keep]
    return names, at


def anchors(ids: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window that lies in one row: its first word and the first word of its anchor."""
    n, width = len(ids), window - 2 * EDGE - SPAN + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, at = recompress(ids, row)
    rank = np.full(n, ~_U(0))
    rank[at] = mix(names) >> _U(1)
    # least[i], where[i]: the least rank of `have` words from i on, and its leftmost place
    least, where, have = rank, np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        a, b = least[: len(least) - step], least[step:]
        take = b < a
        least, where, have = np.where(take, b, a), np.where(take, where[step:], where[: len(a)]), have + step
    p = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    return p, where[p + EDGE]


def _check(window: int) -> None:
    if not 2 * EDGE + 2 * SPAN <= window <= 4096:
        raise ValueError(f"a window takes {2 * EDGE + 2 * SPAN} to 4096 words")


def _slices(batches):
    """Of each slice of a batch: its first row, the batch, its words, its bytes."""
    for b in batches:
        offs, raw = text_buffers(b.column("text"))
        for i, j in row_slices(offs):
            own = raw[offs[i] : offs[j]]
            yield i, b, Words(offs[i : j + 1] - offs[i], own), own


def _occurrences(window: int):
    """(doc_id, k1, text) -> a row for each high-level symbol and the windows it stands for."""
    half = (window - 2 * EDGE - SPAN + 2) // 2

    def run(batches):
        for i, b, words, _ in _slices(batches):
            row, names = words.row, words.names()
            p, a = anchors(names, row, window)
            if not len(p):
                continue
            side = (a - p - EDGE) // half
            new = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(side) != 0) | (np.diff(p) != 1)])
            count = np.diff(np.r_[new, len(p)])
            p, a, side = p[new], a[new], side[new]
            lo = a - EDGE - half * side
            hi = a - np.minimum(EDGE + half * (side + 1) - 1, window - EDGE - SPAN) + window
            key = mix(chained(names, lo, hi, window) + side.astype(np.uint64))
            first, at = np.searchsorted(row, row[p]), i + row[p]
            ids, k1 = (b.column(c).to_numpy(zero_copy_only=False)[at] for c in ("doc_id", "k1"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), k1, ids, (p - first).astype(np.int32), count.astype(np.int32))], names=["key", "k1", "doc_id", "start", "n"])

    return run


def spaced(words: Words, raw: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the kept words, those of a row one space apart, and where each kept word starts and ends there."""
    s, e, row = words.start[kept], words.end[kept], words.row[kept]
    stop = e + np.r_[row[1:] == row[:-1], np.zeros(min(1, len(row)), bool)]  # a word that another one follows has a white space after it
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[s] += 1
    np.subtract.at(edge, stop, 1)
    data = np.where(words.ink, raw, np.uint8(32))[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    begin = np.r_[0, np.cumsum(stop - s)][:-1]
    return data, begin, begin + e - s


def _windows(window: int):
    """(doc_id, k1, text, spans) -> the digest (d1, d2) and place of each window in a span; a span is first window * 4096 + count."""

    def run(batches):
        for i, b, words, raw in _slices(batches):
            row, spans = words.row, b.column("spans")
            so, sv = spans.offsets.to_numpy(), spans.values.to_numpy(zero_copy_only=False)
            rows = int(row[-1]) + 1 if len(row) else 0
            v = sv[so[i] : so[i + rows]]
            count = v & 4095
            which = np.repeat(np.repeat(np.arange(rows), np.diff(so[i : i + rows + 1])), count)
            p = np.repeat(v >> 12, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            s = np.searchsorted(row, which) + p
            data, begin, end = spaced(words, raw, np.ones(len(row), bool))
            text = data.tobytes()
            ids, k1 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "k1"))
            for x in range(0, len(s), 1 << 16):
                part, at = s[x : x + (1 << 16)], i + which[x : x + (1 << 16)]
                digest = b"".join([hashlib.blake2b(text[m:n], digest_size=16).digest() for m, n in zip(begin[part].tolist(), end[part + window - 1].tolist(), strict=True)])
                d = np.frombuffer(digest, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (d[:, 0].copy(), d[:, 1].copy(), k1[at], ids[at], p[x : x + (1 << 16)].astype(np.int32))], names=["d1", "d2", "k1", "doc_id", "p"])

    return run


def _cut(window: int):
    """(doc_id, text, hits, copy_of_earlier) -> doc_id and what is left of text."""

    def run(batches):
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            hits, copy = b.column("hits"), b.column("copy_of_earlier").to_numpy(zero_copy_only=False).astype(bool)
            size = np.array([len(h) if h.is_valid else 0 for h in hits])
            places = hits.flatten().to_numpy(zero_copy_only=False)
            first_hit = np.r_[0, np.cumsum(size)]
            for i, j in row_slices(offs):
                own = raw[offs[i] : offs[j]]
                words = Words(offs[i : j + 1] - offs[i], own)
                first = np.searchsorted(words.row, np.arange(j - i + 1))
                n = np.diff(first)
                at = np.repeat(first[:-1], size[i:j]) + places[first_hit[i] : first_hit[j]]
                cover = np.zeros(len(words.row) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                gone |= (copy[i:j] & (n >= window))[words.row]
                data, begin, end = spaced(words, own, ~gone)
                left = words.row[~gone]
                lengths = np.bincount(left, end - begin + 1, j - i).astype(np.int64)
                lengths -= lengths > 0
                kept = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(data)])
                same = np.r_[False, words.row[1:] == words.row[:-1]][: len(gone)]
                starts = np.flatnonzero(gone & ~(np.r_[False, gone[:-1]][: len(gone)] & same))
                ends = np.flatnonzero(gone & ~(np.r_[gone[1:], False][: len(gone)] & np.r_[same[1:], False][: len(gone)])) + 1
                owner = words.row[starts]
                spans = pa.StructArray.from_arrays([pa.array(x - first[owner]) for x in (starts, ends)], names=["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)), spans)
                removed = np.bincount(words.row[gone], minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(removed), kept.cast(pa.string()), lists], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Removes from each text the words of every `window`-word sequence that also starts in a text of a smaller doc_id.

    Takes doc_id and text, ignores other columns. Returns a row for each row: doc_id, n_words, n_removed, kept_text (kept words joined
    by one space), removed (spans of words, end exclusive). A null or empty text has no words. A row whose doc_id is null loses nothing and is
    nobody's earlier document. Rows that share a doc_id are no earlier documents of each other. Equal texts (the highest shared symbol, verified by SHA-256)
    of `window` words or more are whole repeats of the one of smallest doc_id.
    """
    _check(window)
    k1, k2 = text_key()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", "text", k1.alias("k1"))
    # 1. high-level symbols; those of more than one text may be repeats
    symbols = written(in_batches(keyed, _occurrences(window), "key long, k1 long, doc_id long, start int, n int"), "symbols")
    shared = symbols.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("key")
    shared = written(shared, "shared")  # a table, so that both sides of the join are plain exchanges and a frequent key can be split
    firsts = keyed.groupBy("k1").agg(F.min("doc_id").alias("doc_id"))
    spans = (
        symbols.join(shared, "key", "left_semi")
        .groupBy("k1", "doc_id")
        .agg(F.collect_set(F.col("start").cast("long") * 4096 + F.col("n")).alias("spans"))
        .join(firsts, ["k1", "doc_id"], "left_semi")
    )
    # 2. their windows, matched in full with the smallest doc_id of each
    windows = in_batches(keyed.join(spans.hint("shuffle_hash"), ["k1", "doc_id"]), _windows(window), "d1 long, d2 long, k1 long, doc_id long, p int")
    windows = written(windows, "windows")
    discard(symbols, shared)
    first = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    first = written(first.drop("last_doc"), "first")
    hits = windows.join(first, ["d1", "d2"]).where("first_doc < doc_id").groupBy("k1", "doc_id").agg(F.collect_set("p").alias("hits"))
    hits = written(hits, "hits")
    discard(windows, first)
    # 3. the cut
    whole = docs.select("doc_id", "text", F.coalesce(k1, F.lit(0)).alias("k1"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", k1.alias("k1"), k2.alias("k2"))
    copies = written(texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "copied")
    copies = texts.join(copies, ["k1", "k2"]).where("doc_id > low").select("k1", "doc_id").distinct().withColumn("copy_of_earlier", F.lit(True))
    facts = hits.join(copies, ["k1", "doc_id"], "full_outer")
    out = whole.join(facts.hint("shuffle_hash"), ["k1", "doc_id"], "left").select("doc_id", "text", "hits", F.coalesce("copy_of_earlier", F.lit(False)).alias("copy_of_earlier"))
    return in_batches(out, _cut(window), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>")
