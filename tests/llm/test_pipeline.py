"""The pipeline's stages, each against a plain version of its decisions on its own input."""

import re
from collections import Counter

import corpus_pipeline as cp
from quillon.llm import quality_rules

from .test_jaccard import brute_groups
from .test_scores import WORD, brute_counts, brute_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(cp.STAGES)
    rows = docs.collect()

    kept = stages["quality rules"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert Counter(kept.collect()) == Counter(r for r in rows if verdict[r.doc_id])
    for r in rows:
        c = brute_counts(r.text)
        assert not verdict[r.doc_id] or (c[0] >= 50 and 100 * c[4] <= 50 * c[0])

    one = stages["simhash near-dedup"](spark, kept, SF).cache()
    ks = kept.collect()
    comp = brute_groups([(r.doc_id, r.text) for r in ks])
    assert Counter(one.collect()) == Counter(r for r, c in zip(ks, comp, strict=True) if r.doc_id == c)

    clean = stages["secret scan"](spark, one, SF).cache()
    before = {r.doc_id: r for r in one.collect()}
    assert clean.count() == len(before)
    for r in clean.collect():
        old = before[r.doc_id].text
        assert not re.search(r"password=[A-Za-z0-9]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text)
        assert (r.text == old) == ("[SECRET]" not in r.text) and r.n_chars == len(r.text)
        assert "[SECRET]" in r.text or not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", old)

    mixed = stages["mixing"](spark, clean, SF).cache()
    sizes, got, most = Counter(), Counter(), Counter()
    for r in clean.collect():
        n = len(WORD.findall(r.text))
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    for r in mixed.collect():
        got[r.source] += len(WORD.findall(r.text))
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) <= most[s] / 2 + 1 for s in sizes)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    assert all(x.columns == columns for x in (kept, one, clean, mixed))

    tokens = stages["bpe"](spark, mixed, SF)
    assert Counter(r.doc_id for r in tokens.collect()) == Counter(r.doc_id for r in mixed.collect())


def test_odd_rows(spark):
    """Nulls in any column, empty and repeated rows, and a table without rows."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = " ".join(f"word{i} item{i} thing{i * 3}" for i in range(60))
    rows = [(None, good, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, good + " b", "en", None, 9), (3, good + " b", "en", None, 9), (3, "other " + good[::-1], "de", "b", None), (None, None, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
            if name != "bpe":
                assert docs.columns == schema.names
        out = docs.collect()
        assert bool(out) == bool(data)
    near = cp.near_dedup(spark, spark.createDataFrame(rows, schema), SF)
    assert len(near.where("doc_id = 3").collect()) <= 2


def test_clashing_names(spark):
    """Extra columns that are named like those that the operators use come back as they were."""
    names = "spans base found_ row id hash key nth alone s_fp s_key c_id words size copies times copy n m_id m_words m_copies fp component_id text_hash".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.columns
    odd = docs.select("*", *(cp.secrets.F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in cp.STAGES[:-1]:
        want = stage(spark, docs, SF).select("doc_id", "text").collect()
        got = stage(spark, odd, SF)
        assert got.columns == plain + names
        got = got.collect()
        assert all(r[n] == f"own {n}" for r in got for n in names)
        assert Counter((r.doc_id, r.text) for r in got) == Counter(map(tuple, want)), name


def test_tokens_give_the_text_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cp.tokens(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
