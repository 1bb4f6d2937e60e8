import hashlib
import random

import numpy as np
import pytest
import xxhash

from quillon.llm.simhash import near_duplicates, planes, within
from quillon.llm.substring_dedup import recompress, substring_dedup

SCHEMA = "doc_id long, text string, extra string"


def brute_dedup(rows, window):
    words = [(d, t.encode().split() if t else []) for d, t, *_ in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if d is not None and first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,vocabulary", [(0, 2), (1, 12), (2, 4000)])
def test_substring_dedup(spark, seed, vocabulary):
    rnd = random.Random(seed)
    text = lambda n: rnd.choices([f"w{i}é" for i in range(vocabulary)], k=n)
    passage = text(120)
    rows = []
    for i in range(60):
        w = text(rnd.choice([0, 3, 49, 50, 51, 200]))
        if i % 3 == 0:
            a = rnd.randint(0, 60)
            w = w[:20] + passage[a : a + rnd.choice([49, 50, 51, 60])] + w[20:]
        if i % 7 == 0:
            w = w[:9] + ["run"] * rnd.choice([49, 50, 90]) + w[9:]
        rows.append((rnd.randint(0, 40), " \n".join(w), "x"))
    rows += [(None, " ".join(passage), None), (7, None, None), (8, "", None), rows[0], (99, rows[0][1], None), (100, "  \t", "y")]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), 50).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_dedup(rows, 50)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def thue_morse(n):
    """Two different words of n characters that polynomial hashes modulo 2 ** 64 confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_only_equal_words_are_repeats(spark, n):
    a, b = thue_morse(n)
    words = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join(words[:20] + [a] + words[20:]), None), (2, " ".join(words[:20] + [b] + words[20:]), None), (3, " ".join([*words[:20], a, *words[20:], b]), None)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (50, b)}


def test_substring_dedup_of_long_texts_and_runs(spark):
    """Texts of more words than a slice holds, runs of one word longer than a window, and periodic text."""
    rnd = random.Random(8)
    long = [f"v{rnd.randint(0, 10**6)}" for _ in range(400_000)]
    rows = [(5, " ".join(long), None), (6, " ".join(["x"] * 30 + long[1000:1400] + ["y"] * 60), None), (7, "\n".join(["y"] * 300), None), (8, " ".join(["a", "b", "c"] * 90), None), (9, " ".join(["b", "c", "a"] * 40), None), (10, "w" * 3_000_000, None)]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_dedup(rows, 50)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_substrings_share_interior_symbols():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 50, 200).astype(np.uint64)
    seen = []
    for _ in range(2):
        a = np.r_[rng.integers(0, 50, 30).astype(np.uint64), common, rng.integers(0, 50, 30).astype(np.uint64)]
        names, at = recompress(a, np.zeros(len(a), np.int64))
        seen.append({(n, p) for n, p in zip(names.tolist(), at.tolist()) if 37 <= p < 219})
    assert seen[0] == seen[1]


def brute_simhash(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def test_near_duplicates(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(25):
        w = [rnd.choice("ABcdeFgh") + str(rnd.randint(0, 99)) for _ in range(rnd.choice([1, 3, 4, 5, 300]))]
        for _ in range(rnd.randint(1, 6)):
            v = list(w)
            if len(v) > 100:
                for _ in range(rnd.randint(0, 3)):
                    v[rnd.randrange(len(v))] = "zz"
            rows.append((rnd.randint(0, 500), " ".join(v), None))
    rows += [(501, None, None), (502, "", None), (None, " ", None), rows[5], (None, "only here", "q")]
    fps = [brute_simhash(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps), strict=True), key=repr)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_in_tiles(spark, tile):
    from quillon.llm.components import components
    from quillon.llm.simhash import links

    rng = np.random.default_rng(5)
    f = {0}
    for x in [0, *rng.integers(0, 2**63, 12).tolist()]:
        for _ in range(12):
            for k in rng.choice(64, 3, replace=False):
                x ^= 1 << int(k)
            f.add(x if x < 2**63 else x - 2**64)
    f = sorted(f)
    got = components(links(spark.createDataFrame([(x,) for x in f], "fp long"), 4, tile)).collect()
    group = {r.node: r.root for r in got}
    comp = brute_components(f, [x % 2**64 for x in f])
    assert [group.get(x, x) for x in f] == comp


def test_hot_bucket(spark):
    """Many distinct fingerprints that agree on half of their bits: further blocks part them, and no link is lost."""
    from quillon.llm.components import components
    from quillon.llm.simhash import links

    rng = np.random.default_rng(7)
    f = {int(x) for x in rng.integers(0, 2**31, 600)}
    for x in list(f)[:150]:
        for k in rng.choice(31, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(k)
        f.add(x)
    f = sorted(f)
    got = {r.node: r.root for r in components(links(spark.createDataFrame([(x,) for x in f], "fp long"), 4, 32)).collect()}
    assert [got.get(x, x) for x in f] == brute_components(f, f)


def test_majority():
    from quillon.llm.simhash import majority

    rng = np.random.default_rng(1)
    size = [0, 1, 5, 0, 70000, 3, 200000, 0]
    h = rng.integers(0, 2**63, sum(size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    edge = np.r_[0, np.cumsum(size)]
    for got, a, b in zip(majority(h, edge).tolist(), edge[:-1], edge[1:], strict=True):
        bits = (h[a:b, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert got == sum(1 << i for i in range(64) if 2 * int(bits[:, i].sum()) > b - a)


def test_within():
    rng = np.random.default_rng(0)
    f = []
    for x in rng.integers(0, 2**63, 30):
        for _ in range(6):
            y = int(x)
            for k in rng.choice(64, rng.integers(0, 7), replace=False):
                y ^= 1 << int(k)
            f.append(y)
    f = np.unique(np.array(f, np.uint64))
    for radius in (0, 3, 4, 7):
        near = [[(int(a) ^ int(b)).bit_count() <= radius for b in f] for a in f]
        q, m = within(f, planes(f), -len(f), radius)
        assert set(zip(q.tolist(), m.tolist(), strict=True)) == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if near[i][j]}
        q, m = within(f[:70], planes(f[70:]), len(f) - 70, radius)
        assert set(zip(q.tolist(), m.tolist(), strict=True)) == {(i, j - 70) for i in range(70) for j in range(70, len(f)) if near[i][j]}
    assert hashlib.sha256(planes(f).tobytes()).digest()
