"""Pattern rules against a plain matcher, and the index against trying every rule on every URL."""

import random

import pytest

from quillon.llm import url_filter as U

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def plain_match(pattern, text):
    """The pattern language by recursion, without regular expressions."""
    text = text.lower()
    host_end = min([text.find(c) for c in "/?#" if c in text] or [len(text)])
    start = 2 if pattern.startswith("||") else 1 if pattern.startswith("|") else 0
    end = len(pattern) > start and pattern.endswith("|")
    body = pattern[start : len(pattern) - end].lower()

    def fits(i, j):
        if i == len(body):
            return not end or j == len(text)
        if body[i] == "*":
            return any(fits(i + 1, k) for k in range(j, len(text) + 1))
        if body[i] == "^":
            return ((j in (0, len(text))) and fits(i + 1, j)) or (j < len(text) and text[j] not in LETTERS and fits(i + 1, j + 1))
        return j < len(text) and text[j] == body[i] and fits(i + 1, j + 1)

    places = {0: range(len(text) + 1), 1: [0], 2: [k for k in range(host_end + 1) if k == 0 or text[k - 1] == "."]}[start]
    return any(fits(0, k) for k in places)


def split(url):
    rest = url.partition("://")[2].partition("#")[0]
    host = rest[: min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])]
    return host.lower(), host.lower() + rest[len(host) :]


def test_patterns_and_index(spark):
    rnd = random.Random(11)
    words = ["ads", "shop", "x1", "login", "a", "com", "img"]
    make = lambda marks, n: "".join(rnd.choice(words + list(marks)) for _ in range(n))
    rules = {rnd.choice(["", "|", "||"]) + make("^*./?=-", rnd.randint(1, 5)) + rnd.choice(["", "|", "^"]) for _ in range(120)} | {"*", "^", "ads", "*x1*"}
    rules = [U.pattern_rule(p, rnd.choice(["allow", "block"]), rnd.choice(["host", "url"])) for p in sorted(rules)]
    urls = [f"http://{make('.-', rnd.randint(1, 4))}{rnd.choice(['', '/'])}{make('/?=.-_A', rnd.randint(0, 6))}{rnd.choice(['', '#top'])}" for _ in range(150)] + ["http://ADS.Shop.com/LOGIN", "ads"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in U.judge(df, rules).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, at = split(url) if "://" in url else ("", "")
        fits = [r for r in rules if plain_match(r.name, host if r.scope == "host" else at)]
        want = max(fits, key=lambda r: (r.verdict == "allow", len(r.name), r.name), default=None)
        assert (got[i].fired, got[i].verdict) == ((want.name, want.verdict) if want else (None, "allow")), url


@pytest.mark.parametrize("pattern,tokens", [("^casino^", ("casino",)), ("ads", ()), ("/ads", ()), ("/ads/x", ("ads",)), ("||Track.er", ("track",)), ("*.exe|", ("exe",)), ("a*b^c^", ("c",)), ("|ab|", ("ab",))])
def test_tokens(pattern, tokens):
    assert U.pattern_rule(pattern).tokens == tokens


def test_long_lists_tables_and_repeated_rows(spark):
    """More rules than a literal could hold, as a table that is not broadcast; rows that repeat; very long URLs."""
    n = 20_000
    rules = spark.range(n).selectExpr("concat('^w', id, '^') name", "concat('(?is)(?:^|\\\\z|[^A-Za-z0-9])w', id, '(?:^|\\\\z|[^A-Za-z0-9])') regex", "array(concat('w', id)) tokens", "'block' verdict", "'url' scope", "false listed")
    rows = [(i % 50, f"http://h.org/w{i % 50 * 401}/") for i in range(10_000)] + [(None, None), (1, "http://a.org/" + "x/" * 100_000 + "w7")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = U.judge(df, rules).groupBy("page_id", "fired", "verdict").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {(i, f"^w{i * 401}^" if i * 401 < n else None, "block" if i * 401 < n else "allow"): 200 for i in range(50)} | {(None, None, "allow"): 1, (1, "^w7^", "block"): 1}
    assert {tuple(r)[:3]: r["count"] for r in got} == want


def test_no_python(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
