"""Secret scans on long tokens, many matches, and the words that are no secrets."""

import re
import time

import numpy as np

from quillon.llm import secrets

from .test_scores import brute_base

F = secrets.F


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_long_tokens_and_many_matches_take_seconds(spark):
    rng = np.random.default_rng(6)
    make = lambda a, n: "".join(rng.choice(list(a), n))
    token = make(secrets.CODES, 1_000_000)
    hexes = " ".join(make("0123456789abcdef", 24) for _ in range(100_000))
    mixed = ":".join("password=" + make("abc123", 8) if i % 3 else "é🙂 " + make("0123456789abcdef", 30) for i in range(3000))
    for text, spans, left in (("it is " + token + " so", 1, "it is [SECRET] so"), (hexes, 100_000, None), (mixed, 3000, None)):
        began = time.time()
        r = secrets.scan(one(spark, text)).select(F.size("spans").alias("n"), secrets.joined("base").alias("b")).first()
        clean = secrets.redact(one(spark, text)).first().text
        assert time.time() - began < 60
        assert r.n == spans and r.b == brute_base(text)
        assert clean.count("[SECRET]") == spans and (left is None or clean == left)


def test_redacted_is_the_text_without_its_spans(spark):
    """Against a plain version, over pieces and overlapping spans."""
    rng = np.random.default_rng(2)
    parts = ["ünï ", "password=", "deadbeef" * 3, "AKIA" + "Z" * 16, " x " * 700, "token: ", "🙂" * 1500, "a1" * 400, "\n"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 30)))) for _ in range(40)] + ["", "no", None, "x" * 1024 + " " + "f0" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    for r in secrets.redact(df).collect():
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        out, at = [], 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += [texts[r.doc_id][at : s.start], "[SECRET]"]
            at = max(at, s.end)
        assert r.text == "".join(out) + texts[r.doc_id][at:]


def test_tokens_of_one_class(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "so " + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 32)) + " it") for i in range(30)]
    rows += [(100 + i, f"a {w} b") for i, w in enumerate(["JUMP_IF_NOT_EXC_MATCH_HERE", "ATTRIBUTEMETHODS", "donaudampfschifffahrtsgesellschaft", "a" * 40, "=" * 40, "0" * 64 + "x", "some/path/to/a/file_name", "internationalization"])]
    got = {r.doc_id: r.n for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.expr("size(filter(spans, s -> s.name = 'random'))").alias("n")).collect()}
    assert sum(got[i] == 1 for i in range(30)) >= 27
    assert all(n == 0 for i, n in got.items() if i >= 100)


def test_tokens_that_touch_base_spans_are_not_tested(spark):
    token = "xkfQWb7yRRmzePLc41TVahnKuoXdS9wj"
    r = secrets.scan(one(spark, f"my_password={token} {token} x{'deadbeef' * 3}")).first()
    names = [(s.name, s.start) for s in r.spans]
    assert names == [("assign", 3), ("random", 45), ("hex", 79)] and re.search("x", token)
