"""Mixing sources to target weights, by hash-random keys, ranges of them, distributed prefix sums and exact cuts.

Each document has a random key (a hash of its doc_id and text). The keys of a source are sorted in ranges of equal width (a prefix of the key), so that a source of
any size is many bounded groups (rows that are equal in all of this count as one with a number); sums of the ranges give each range's first offset, sums inside of a range give each document's.
A source's budget is so many whole epochs and a rest, which is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, repeated, written

WEIGHTS, CAP = (5, 2, 1), 3
#: Documents that a range of keys has on average at most.
RANGE_ROWS = 20000


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> and target. Sources in code point order, null last, weigh `weights` in turn; a target stops at `cap` sizes and
    the excess is shared by the others by weight. One row per source takes part in the windows."""
    order, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.col("room"), F.col("place"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sources.withColumn("place", F.row_number().over(order)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("long"))
    t = t.withColumn("most", F.col("source_size") * cap).withColumn("room", F.col("most") / F.col("w"))
    # if the sources of less room than this one are at their caps, `rest` words are left for weights of `share`
    t = t.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    t = t.withColumn("share", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("fits", F.col("rest") * F.col("w") <= F.col("most") * F.col("share")).withColumn("rank", F.row_number().over(by_room))
    first = F.min(F.when(F.col("fits"), F.struct("rank", "rest", "share"))).over(every)
    t = t.withColumn("first", first)
    free = F.col("rank") >= F.col("first.rank")
    target = F.when(free, (F.col("w") * F.col("first.rest")).cast("double") / F.col("first.share")).otherwise(F.col("most").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def _key(seed: str):
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _placed(docs: DataFrame, weights, cap: int, seed: str) -> DataFrame:
    """A row for each group of equal rows: doc_id, source, size, key, n (rows), source_size, target, before (words of its source ahead of the first), epochs, rest."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _key(seed).alias("key"))
    d = written(d.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "sizes")
    rows = d.count()
    digits = 1
    while rows / 16**digits > RANGE_ROWS:
        digits += 1
    d = d.withColumn("words", F.col("n") * F.col("size")).withColumn("span", F.substring("key", 1, digits))
    ranges = d.groupBy("source", "span").agg(F.sum("words").alias("words"))
    per_source = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    w = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("words").over(w), F.lit(0)))
    r = ranges.alias("r").join(per_source.alias("s"), F.expr("r.source <=> s.source")).selectExpr("r.source r_source", "span r_span", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "span").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    d = d.join(r, F.expr("source <=> r_source and span = r_span")).withColumn("before", F.col("offset") + F.col("ahead"))
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div source_size")).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size"))
    return d.select("doc_id", "source", "size", "key", "n", "source_size", "target", "before", "epochs", "rest")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target (its source's), before (words of its source ahead of it), epochs (whole), rest, taken.

    size: words of the text (null: 0). taken: words that the mix takes of it, whole epochs and the cut. A null doc_id has a key as
    any other, and so has a null source. Equal rows come one after the other. A source without words takes none, an empty table gives no rows; texts of any length
    are counted whole, other columns are left out.
    """
    d = repeated(_placed(docs, weights, cap, seed), "n").withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    cut = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    return d.withColumn("taken", F.col("epochs") * F.col("size") + cut).select("doc_id", "source", "size", "source_size", "target", "before", "epochs", "rest", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, whole: the document in which a source's budget ends is taken if half of it fits.

    Rows of equal doc_id, source and text are one document: one of them (the least by all columns) stands for the copies that all of them get. Documents without words are not taken.
    """
    m = _placed(docs, weights, cap, seed).where("size > 0")
    # of n equal rows the i-th is in the rest if before + i * size + size / 2 <= rest
    fit = F.when(F.col("rest") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.expr("cast(floor((rest - before - size / 2) / size) as long) + 1")))).otherwise(F.lit(0))
    m = m.select(F.col("key").alias("m_key"), F.col("source").alias("m_source"), F.col("doc_id").alias("m_id"), "n", (F.col("n") * F.col("epochs") + fit).cast("long").alias("times"))
    m = written(m.where("times > 0"), "copies")
    # the row is kept as one column, so that no name of docs can clash with these
    d = docs.select(F.struct("*").alias("row"), _key(seed).alias("key"), F.col("source").cast("string").alias("own"), F.col("doc_id").cast("long").alias("id"))
    of = lambda which: d.join(m.where(which).hint("shuffle_hash"), F.expr("key = m_key and own <=> m_source and id <=> m_id"))
    # both joins read one exchange of the rows; of equal documents one is left, before any of them moves again
    many = of("n > 1").groupBy("m_key", "m_source", "m_id", "times").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return repeated(of("n = 1").select("row", "times").union(many.select("row", "times")), "times").select("row.*")
