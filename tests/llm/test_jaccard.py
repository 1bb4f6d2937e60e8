import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from quillon.llm import jaccard

SCHEMA = "doc_id long, text string, extra string"


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    """The smallest doc_id that links of similarity 0.8 reach, by all pairs."""
    sets = [brute_sets(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return [low.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("often", [8, 2])
def test_all_similar_texts_are_joined(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard, "FREQUENT", often)
    monkeypatch.setattr(jaccard, "SHARE", 2)
    rnd = random.Random(often)
    line = [f"common{i}" for i in range(30)]
    rows = []
    for _ in range(30):
        w = [rnd.choice("ABcdeFgh") + str(rnd.randint(0, 999)) for _ in range(rnd.choice([1, 4, 5, 6, 40, 300]))]
        for _ in range(rnd.randint(1, 6)):
            v = list(w)
            if len(v) >= 40:
                for _ in range(rnd.randint(0, len(v) // 30)):
                    v[rnd.randrange(len(v))] = f"zz{rnd.randint(0, 9)}"
                v = v[: len(v) - rnd.choice([0, 0, len(v) // 6, len(v) // 4])] + line * rnd.randint(0, 1)
            rows.append((rnd.randint(0, 500), " ".join(v), None))
    rows += [(501, None, None), (502, "", None), (None, " ", None), rows[5], (None, "only here", "q"), (503, "ONLY  here", "q")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(zip([r[0] for r in rows], brute_groups(rows), strict=True), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pipeline_leaves_no_near_copies(spark):
    """Copies at a similarity of 0.8 to 0.9, which four bits of a SimHash mostly miss."""
    rnd = random.Random(9)
    rows = []
    for g in range(20):
        w = [f"w{rnd.randint(0, 9999)}" for _ in range(300)]
        v = list(w)
        for k in range(5):
            v[20 + 50 * k] = "other"
        rows += [(2 * g, " ".join(w), "x"), (2 * g + 1, " ".join(v), "x")]
    assert all(0.8 <= len(brute_sets(a[1]) & brute_sets(b[1])) / len(brute_sets(a[1]) | brute_sets(b[1])) < 0.9 for a, b in zip(rows[::2], rows[1::2], strict=True))
    out = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(out.collect()) == Counter(spark.createDataFrame(rows[::2], SCHEMA).collect())
