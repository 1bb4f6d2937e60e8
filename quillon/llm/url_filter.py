"""URL filters in DataFrame functions: pattern rules indexed by their rarest literal token.

A rule's literal tokens are those that any URL that it fits has whole. The URLs' tokens are counted for these alone, and the rule is filed under the one that fewest
have (a rule without such tokens under the empty token, which every URL has). The tokens of a URL fetch their rules by a join, and only these run their regular expressions. The
list of rules is a table, as long as it may be: Spark broadcasts it if it is small, and else both sides of the join move by token.

Patterns: `*` stands for any characters, `^` for the edge of a word (a character other than letters and digits of ASCII, or an end), `|` at either end for that end, `||` at
the start for the start of the host or of a part of it after a dot; all else for itself, in either case. A pattern is searched for in the host, or in host, path and query.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import repeated

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[A-Za-z0-9]+"
_EDGE = r"(?:^|\z|[^A-Za-z0-9])"
RULE = "name string, regex string, tokens array<string>, verdict string, scope string, listed boolean"


class Rule(NamedTuple):
    name: str
    regex: str
    tokens: tuple[str, ...]  # in small letters, whole tokens of any match
    verdict: str
    scope: str  # what the regex is searched in: page (host and path), host, or url (host, path and query)
    listed: bool  # a listed rule decides before the others


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and a path prefix (case counts)."""
    whole = [*re.findall(_TOKEN, host), *re.findall(_TOKEN, path if path.endswith("/") else path.rpartition("/")[0])]
    return Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(t.lower() for t in whole), verdict, "page", True)


def pattern_rule(pattern: str, verdict: str = "block", scope: str = "url") -> Rule:
    """A rule of the pattern language above."""
    start = re.match(r"\|{0,2}", pattern)[0]
    end = "|" if len(pattern) > len(start) and pattern.endswith("|") else ""
    body = pattern[len(start) : len(pattern) - len(end)]
    regex = {"": "", "|": "^", "||": r"^(?:[^/?#]*\.)?"}[start] + "".join({"*": ".*", "^": _EDGE}.get(c) or re.escape(c) for c in body) + (r"\z" if end else "")
    # whole tokens: an end of the pattern that is no anchor may be amid a token, and so may the place beside *
    line = ("" if start else "*") + body + ("" if end else "*")
    whole = [m[0].lower() for m in re.finditer(_TOKEN, line) if line[m.start() - 1 : m.start()] != "*" and line[m.end() : m.end() + 1] != "*"]
    return Rule(pattern, "(?is)" + regex, tuple(whole), verdict, scope, False)


#: The listed rules.
LISTED = (site_rule("com", "/", "allow"), site_rule("example.com", "/en/", "block"), site_rule("www.example.com", "/en/", "allow"), site_rule("net", "/es/", "block"), site_rule("net", "/fr/", "block"))
#: The other rules: words that stand alone in a host, and pages and files that hold no prose.
_WORDS = "adult adserver bet bets betting bingo casino casinos doubleclick escort escorts gambling jackpot lottery payday phishing pills poker porn sex slots spam torrent viagra warez xxx".split()
_PAGES = "/wp-login.php^ /wp-admin/ /cgi-bin/ /login| /signin| /logout| /checkout| /cart| /search?* ?add-to-cart= ?replytocom= /adserver/ /popunder*.js *.exe| *.apk| *.dmg| *.iso| *.zip| *.css| ||tracker. ||pixel. ||adservice.*/click?*".split()
PATTERNS = (*(pattern_rule(f"^{w}^", scope="host") for w in _WORDS), *map(pattern_rule, _PAGES))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table, for judge(); a long list may be read from anywhere instead, with these columns."""
    rows = json.dumps([r._asdict() for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")))


def parts(url: str = "url"):
    """host, path and what follows the host of a URL column; all empty where it is null or has no ://."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^/?#]*([^#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, rest


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules, each with the one of its tokens that fewest of the URLs' token arrays hold (of several the first in code point order)."""
    wanted = rules.select("name", "scope", F.explode_outer("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("name", "scope").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("r"))
    return rules.join(rarest.select("name", "scope", F.col("r.token").alias("token")), ["name", "scope"])


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame = LISTED + PATTERNS) -> DataFrame:
    """page_id, url, host, path, rule (the longest listed rule that fits, else null), fired (an unlisted rule that fits, else null), verdict.

    A listed rule's verdict stands, of equally long ones the last by name; else an unlisted rule decides (one that allows before one that blocks, then the longest, then the
    last by name); else the URL is allowed (null and empty ones, and such without :// too). Repeated rows come back as often, an empty table gives none; other columns
    are left out. rules: a list, or a table with the columns of RULE; names are unique in a scope.
    """
    rules = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    host, path, rest = parts()
    # a verdict is one of the row alone, so that equal rows are judged once
    d = pages.selectExpr("cast(page_id as long) page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    d = d.select("page_id", "url", "copies", host.alias("host"), path.alias("path"), F.concat(host, rest).alias("at"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("at"), F.lit(_TOKEN), F.lit(0)))
    d = d.withColumn("tokens", F.concat(F.array(F.lit("")), tokens))
    found = d.withColumn("token", F.explode("tokens")).drop("tokens").join(filed(d, rules), "token", "left")
    subject = F.when(F.col("scope") == "host", F.col("host")).when(F.col("scope") == "page", F.concat("host", "path")).otherwise(F.col("at"))
    fits = F.when(F.col("regex").isNotNull(), F.rlike(subject, F.col("regex")))
    own = F.when(fits, F.struct((F.col("verdict") == "allow").alias("first"), F.length("name").alias("size"), "name", "verdict"))
    listed = F.when(fits & F.col("listed"), F.struct(F.length("name").alias("size"), F.col("name"), F.col("verdict")))
    best = found.groupBy("page_id", "url", "copies", "host", "path").agg(F.max(listed).alias("best"), F.max(F.when(~F.col("listed"), own)).alias("fired"))
    best = best.select("page_id", "url", "host", "path", F.col("best.name").alias("rule"), F.col("fired.name").alias("fired"), F.coalesce("best.verdict", "fired.verdict", F.lit("allow")).alias("verdict"), "copies")
    return repeated(best, "copies").drop("copy")
