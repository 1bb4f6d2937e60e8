"""Quality classifier: a byte-level convolutional network in numpy.

Filters over WIDTH bytes slide over chunks of CHUNK bytes that overlap by half and cover the whole text. Each chunk is max-pooled; a text's features are the largest and the mean of its
chunks' maxima, and a logistic unit combines them, in training as in scoring. A first layer over bytes is a table for each place in the filter, so that its convolution is a sum of look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import in_batches, row_slices, text_buffers

WIDTH, FILTERS, CHUNK = 6, 16, 512
HALF = CHUNK // 2
#: Labelled documents that training reads at most (those of least hashed doc_id), each with its whole text, as in scoring.
SAMPLE = 3000


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out, self.shift = rng.normal(0, 0.05, 2 * FILTERS), 0.0

    def halves(self, offsets: np.ndarray, raw: np.ndarray):
        """Of each half chunk of each text the maxima of the filters and their places in the returned bytes; and each text's first half.

        Texts are followed by WIDTH - 1 bytes 0; an empty one has one half."""
        size = np.diff(offsets)
        room = np.maximum(-(-size // HALF), 1) * HALF
        first = np.r_[0, np.cumsum(room + WIDTH - 1)]
        data = np.zeros(first[-1], np.uint8)
        data[np.arange(len(raw)) + np.repeat(first[:-1] - offsets[:-1], size)] = raw
        count = room // HALF
        owner = np.repeat(np.arange(len(size)), count)
        edge = np.r_[0, np.cumsum(count)]
        start = first[owner] + (np.arange(len(owner)) - edge[owner]) * HALF
        best, place = np.empty((len(owner), FILTERS), np.float32), np.empty((len(owner), FILTERS), np.int64)
        for i in range(0, len(owner), 256):
            at = start[i : i + 256, None] + np.arange(HALF)
            x = self.tables[0][data[at]]
            for j in range(1, WIDTH):
                x += self.tables[j][data[at + j]]
            where = x.argmax(1)
            best[i : i + 256] = np.take_along_axis(x, where[:, None], 1)[:, 0]
            place[i : i + 256] = where + start[i : i + 256, None]
        return np.maximum(best + self.bias, 0), place, data, edge

    @staticmethod
    def pooled(best: np.ndarray, edge: np.ndarray):
        """Features of each text: of its chunks (each two neighbouring halves, or the only one) the largest maxima and their means. And of each chunk
        its first half, which of its two halves has each maximum, and the edges of texts in chunks."""
        count = np.diff(edge)
        chunks = np.maximum(count - 1, 1)
        begin = np.r_[0, np.cumsum(chunks)]
        first = np.arange(begin[-1]) + np.repeat(edge[:-1] - begin[:-1], chunks)
        second = first + np.repeat(count > 1, chunks)
        later = best[second] > best[first]
        chunk = np.where(later, best[second], best[first])
        top = np.maximum.reduceat(chunk, begin[:-1], axis=0)
        mean = np.add.reduceat(chunk, begin[:-1], axis=0, dtype=np.float64) / chunks[:, None]
        return np.hstack([top, mean]), first, later, begin

    def probability(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        best, _, _, edge = self.halves(offsets, raw)
        x = self.pooled(best, edge)[0] @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 11) -> ByteCNN:
        """Adam on the logistic loss, over whole texts (bytes); gradients flow through the places of the maxima alone."""
        rng = np.random.default_rng(seed)
        mean = np.clip(labels.mean(), 0.01, 0.99)
        self.shift = float(np.log(mean / (1 - mean)))
        shift = np.array([self.shift])
        params = [self.tables, self.bias, self.out, shift]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                best, place, data, edge = self.halves(np.r_[0, np.cumsum([len(texts[t]) for t in pick])], np.concatenate([texts[t] for t in pick]))
                feats, first, later, begin = self.pooled(best, edge)
                p = 1 / (1 + np.exp(-np.clip(feats @ self.out + shift[0], -60, 60)))
                g = (p - labels[pick]) / len(pick)
                d_feats = g[:, None] * self.out
                size = np.diff(begin)
                owner, half_owner = np.repeat(np.arange(len(pick)), size), np.repeat(np.arange(len(pick)), np.diff(edge))
                d_best = np.where(best == feats[half_owner, :FILTERS], d_feats[half_owner, :FILTERS], 0)
                filters = np.broadcast_to(np.arange(FILTERS), later.shape)
                np.add.at(d_best, (first[:, None] + later, filters), d_feats[owner, FILTERS:] / size[owner][:, None])
                d_best = np.where(best > 0, d_best, 0).astype(np.float32)
                grads = [np.zeros_like(self.tables), d_best.sum(0), feats.T @ g + 1e-4 * self.out, np.array([g.sum()])]
                filters = np.broadcast_to(np.arange(FILTERS), place.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (data[place + j], filters), d_best)
                step += 1
                for q, grad, a, s in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (grad - a)
                    s += 0.001 * (grad * grad - s)
                    q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(q.dtype)
        self.shift = float(shift[0])
        return self


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ByteCNN:
    """A network fitted to `limit` labelled documents at most, none of the held-out fold; without labels of both classes it has one score for all texts."""
    ok = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out())
    ok = ok.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ok), "doc_id")  # `limit` rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    net = ByteCNN()
    if rows.quality.nunique() > 1:
        net.fit([np.frombuffer(x.encode(), np.uint8) for x in rows.text], (rows.quality > 0).to_numpy(float))
    else:
        net.out[:] = 0
        net.shift = 4.0 if len(rows) and rows.quality.iloc[0] > 0 else -4.0 if len(rows) else 0.0
    return net


def score(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """doc_id and score (0 to 1) for each row; the whole text is read, a null text is empty and has the score of an empty one."""

    def run(batches):
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            for i, j in row_slices(offs, 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(net.probability(offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]]))], names=["doc_id", "score"])

    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (crc32 of the id's text is a multiple of 5; null for a null id), score, predicted (1 if score >= threshold)."""
    out = score(docs, train(docs, labels, limit))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


