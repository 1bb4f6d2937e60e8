"""Quality rules: document statistics, hard base rules, and gradient-boosted trees with monotonic constraints over the statistics.

Trees are grown by histograms with numpy on a bounded sample of labelled documents, then flattened into node arrays (feature, threshold,
left, right, value) in which all documents of a batch walk at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import _WS, Words, in_batches, numbered, pairs, row_slices, text_buffers

#: Labelled documents that training reads at most: those of least hashed doc_id.
SAMPLE = 8192
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_bytes")
#: Feature: sign of its monotonic constraint on the score (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": 0, "digits": 0, "marks": -1}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _DIGIT, _MARK = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!?")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
_POINT = ((np.arange(256) & 0xC0) != 0x80).astype(np.int8)


def counts(offsets: np.ndarray, raw: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each row of a slice of texts; words, lines and windows are compared by their bytes."""
    rows = len(offsets) - 1
    words = Words(offsets, raw)
    row = words.row

    def per_row(table):
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": per_row(_POINT * ~_WS), "n_symbols": per_row(_SYMBOL), "n_upper": per_row(_UPPER), "n_letters": per_row(_LETTER), "n_digits": per_row(_DIGIT), "n_marks": per_row(_MARK), "n_bytes": np.diff(offsets)}
    # lines with a word, and how many equal an earlier one of their row
    ends = np.flatnonzero(raw == 10)
    start = np.unique(np.r_[offsets[:-1], ends + 1])
    start = start[start < len(raw)]
    stop = np.r_[start, len(raw)][1:]
    stop = stop - (raw[stop - 1] == 10)
    line, _ = numbered(raw[raw != 10], stop - start)
    ink = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(words.ink, out=ink[1:])
    worded = ink[stop] > ink[start]
    line_row = np.searchsorted(offsets, start[worded], "right") - 1
    line = pairs(line_row, line[worded])  # numbers come in order of first appearance
    again = line <= np.r_[-1, np.maximum.accumulate(line)[:-1]] if len(line) else np.zeros(0, bool)
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    # words of 3-word windows found twice or more in their row
    n, repeat = len(row), np.zeros(rows, np.int64)
    if n >= 3:
        p, w = np.flatnonzero(row[:-2] == row[2:]), words.number
        window = pairs(row[p], pairs(pairs(w[:-2], w[1:-1]), w[2:])[p])
        often = p[np.bincount(window)[window] > 1] if len(p) else p
        word = np.zeros(n, bool)
        for k in range(3):
            word[often + k] = True
        repeat = np.bincount(row[word], minlength=rows)
    out["n_repeat_words"] = repeat
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    w, ch = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([np.log1p(c["n_words"]), c["word_chars"] / w, c["n_symbols"] / ch, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / w, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / ch, c["n_marks"] / w]).astype(np.float64)


class Trees:
    """Boosted trees for a 0/1 label by logistic loss, as flat node arrays; equal data give equal trees."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, signs) -> Trees:
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        code = np.column_stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)])
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            self.roots.append(self._grow(code, edges, p - y, p * (1 - p), np.arange(len(y)), signs, self.depth, -np.inf, np.inf, score))
        self.arrays()
        return self

    def _leaf(self, g, h, low, high):
        return float(np.clip(-g / (h + self.l2), low, high))

    def _grow(self, code, edges, g, h, rows, signs, depth, low, high, score) -> int:
        at = len(self.feature)
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            a.append(v)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f, e in enumerate(edges if depth else []):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(e) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + self.l2), low, high), np.clip(-gr / (hr + self.l2), low, high)
            gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - total_g**2 / (total_h + self.l2)
            gain[(hl < self.least) | (hr < self.least) | (signs[f] * (vr - vl) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            self.value[at] = self.rate * self._leaf(total_g, total_h, low, high)
            score[rows] += self.value[at]
            return at
        f, k, vl, vr = best[1]
        goes = code[rows, f] <= k
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[f]]
        self.feature[at], self.threshold[at] = f, float(edges[f][k])
        self.left[at] = self._grow(code, edges, g, h, rows[goes], signs, depth - 1, *bounds[0], score)
        self.right[at] = self._grow(code, edges, g, h, rows[~goes], signs, depth - 1, *bounds[1], score)
        return at

    def arrays(self) -> None:
        self.feature, self.left, self.right, self.roots = (np.asarray(a, np.int64) for a in (self.feature, self.left, self.right, self.roots))
        self.threshold, self.value = np.asarray(self.threshold), np.asarray(self.value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            score += self.value[at]
        return 1 / (1 + np.exp(-score))


def statistics(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id and the COUNTS of each text (null: empty); with trees also score (null where there are none)."""

    def run(batches):
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            for i, j in row_slices(offs):
                c = counts(offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]])
                score = trees.probability(features(c)) if trees else None
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(score) if trees else pa.nulls(j - i, pa.float64())], names=["doc_id", *COUNTS, "score"])

    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")


def sampled_labels(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id and quality of `limit` labelled documents at most, by hashed doc_id; rows with a null are left out, the least of several labels counts."""
    ok = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    return ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Trees | None:
    """Trees fitted to a bounded sample; None where it has a single class."""
    chosen = F.broadcast(sampled_labels(labels, limit))  # `limit` rows at most
    got = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id"), "doc_id"))
    got = got.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).join(chosen, "doc_id").select("doc_id", "quality", "c.*").toPandas().sort_values("doc_id")
    if got.quality.nunique() < 2:
        return None
    return Trees().fit(features({c: got[c].to_numpy() for c in COUNTS}), (got.quality > 0).to_numpy(float), list(FEATURES.values()))


def _kept(threshold: float):
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base, ~base & F.coalesce(F.col("score") >= threshold, F.lit(True))


def keep(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns of docs as they were; each row is judged by its own text, in place."""

    def run(batches):
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            for i, j in row_slices(offs):
                c = counts(offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]])
                ok = (c["n_words"] >= 50) & (100 * c["n_repeat_words"] <= 50 * c["n_words"])
                if trees:
                    ok &= trees.probability(features(c)) >= threshold
                yield b.slice(i, j - i).filter(pa.array(ok))

    return in_batches(docs, run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = SAMPLE) -> DataFrame:
    """A row for each row of docs: doc_id, the COUNTS, score, base_failed and kept.

    base_failed: fewer than 50 words, or words of repeated 3-word windows are over half of all. kept: not base_failed, and the trees' score is
    `threshold` or more. Null and empty texts have no words and fail. Without labels of both classes there is no score, and the base rules decide alone.
    """
    base, kept = _kept(threshold)
    return statistics(docs, train(docs, labels, limit)).withColumn("base_failed", base).withColumn("kept", kept)
