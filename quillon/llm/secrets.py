"""Secret scans in DataFrame functions: three fixed patterns, and a battery of randomness tests over long tokens.

A token's encoding is the smallest of a list of alphabets that holds its characters. Its characters are tested against that alphabet by chi-squared for uniformity, and
the quarters of the alphabet that they fall in by the number of runs and by serial correlation. How much likelier the token is as random characters of its encoding than
as ordinary text (a chain of character classes, and letters as frequent as in prose) is the evidence, less the deviations. By Markov's inequality its inverse is a
p-value under "ordinary text", and the Benjamini-Hochberg rule over the text's candidates controls false discoveries: longer tokens need less agreement, and more
candidates need more.

All of it is linear in the length of texts and tokens and in the number of matches: places come from the lengths of what lies between matches, summed in blocks
(`scan`); a token's counts come from what is left of it without a character or a pair; values that a lambda needs often are bound once (`let`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order that ties of place take. The last two hold what `AKIA[A-Z0-9]+` of 20 and `[0-9a-f]+` of 24 characters hold: a match
#: that is too short has no longer one inside. That is not so for the first, whose short matches are found and dropped.
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: kind, pattern, least length of group 1 (0: all matches count).
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 0), ("hex", HEX, 0))
#: Least length of a token that is tested; allowed share of false discoveries.
SHORTEST, FDR = 16, 0.05
_AZ, _09 = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: All characters that a token may have, in order of code; the alphabets that it may be written in, by size.
CODES = _09 + _AZ + _AZ.upper() + "+/-_"
ENCODINGS = (_09 + "abcdef", _09 + "ABCDEF", _AZ, _AZ.upper() + "234567", _09 + _AZ, CODES)
#: Long tokens of ordinary text (names, paths, hyphenated words): chances of the next class (digit, lower, upper, other; rows: the class before, at first
#: other), and of a to z in per mille of letters. Classes change more freely here than in prose, as they do in names.
NEXT = ((0.60, 0.12, 0.08, 0.20), (0.03, 0.86, 0.06, 0.05), (0.04, 0.70, 0.22, 0.04), (0.15, 0.65, 0.15, 0.05))
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_WITHIN = [math.log(0.1)] * 10 + [math.log(x / sum(LETTERS)) for x in LETTERS] * 2 + [math.log(0.25)] * 4
_CLASSES, _QUARTERS = "dluo", "wxyz"
SPAN = "struct<start:long,kind:int,end:long,name:string>"
MATCH = "struct<start:long,end:long,token:string>"
#: Elements of a block of scan(), characters of a block of cut().
BLOCK, PIECE = 256, 1024


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_array(xs: Column, state: Column, step, kind: str) -> Column:
    """The elements (of type `kind`) that step(state, x) -> (state, element) gives along an array, null ones left out.

    Blocks of BLOCK elements are scanned into arrays of their own, whose references alone are copied as the next one comes."""
    none = lambda t: F.array().cast(f"array<{t}>")

    def one(a, x):
        after, element = step(a["state"], x)
        return F.struct(after.alias("state"), F.concat(a["out"], F.array(element)).alias("out"))

    def block(a, part):
        done = F.aggregate(part, F.struct(a["state"].alias("state"), none(kind).alias("out")), one)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def parts(v):
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    zero = F.struct(state.alias("state"), none(f"array<{kind}>").alias("out"))
    all_of = let(xs, lambda v: F.when(F.size(v) > 0, F.aggregate(parts(v), zero, block, lambda a: F.flatten(a["out"]))).otherwise(none(kind)))
    return F.filter(all_of, lambda x: x.isNotNull())


def found(text: Column, pattern: str, least: int = 0) -> Column:
    """Leftmost, non-overlapping matches whose group 1 has `least` characters. What lies between matches gives their places."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), h.alias("hit")))

    def step(at, x):
        start = at + x["gap"]
        ok = x["hit"].isNotNull() & (F.length(F.regexp_extract(x["hit"], pattern, 1)) >= least) if least else x["hit"].isNotNull()
        return start + F.length(x["hit"]), F.when(ok, F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("token")))

    matches = scan_array(steps, F.lit(0).cast("long"), step, MATCH)
    return F.when(text.rlike(pattern), matches).otherwise(F.array().cast(f"array<{MATCH}>"))


def _spans(matches: Column, kind: int, name: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.lit(name).alias("name")))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start and kind."""
    return F.sort_array(F.concat(*(_spans(found(text, pattern, least), i, name) for i, (name, pattern, least) in enumerate(BASE))))


def apart(matches: Column, spans: Column) -> Column:
    """The matches that touch no span: of the spans that start before a match ends, none ends after it starts."""
    event = lambda at, late, far, m: F.struct(at.alias("at"), F.lit(late).alias("late"), far.alias("far"), m.cast(MATCH).alias("match"))
    events = F.sort_array(F.concat(F.transform(spans, lambda s: event(s["start"], 1, s["end"], F.lit(None))), F.transform(matches, lambda m: event(m["end"], 0, m["start"], m))))
    step = lambda far, e: (F.when(e["late"] == 1, F.greatest(far, e["far"])).otherwise(far), F.when((e["late"] == 0) & (far <= e["far"]), e["match"]))
    return F.when(F.size(spans) > 0, scan_array(events, F.lit(0).cast("long"), step, MATCH)).otherwise(matches)


def _number_of(s: Column, part: Column) -> Column:
    """How often a character, or a pair of two different ones, is in a string."""
    return (F.length(s) - F.length(F.replace(s, part, F.lit("")))).cast("double") / F.length(part)


def _sums(s: Column, parts: dict[str, tuple]) -> Column:
    """For each place of the tuples, the sum of number times weight over the parts (as fields a, b, ...)."""
    names = "abc"[: len(next(iter(parts.values())))]
    table = F.array(*(F.struct(F.lit(p).alias("part"), *(F.lit(float(w)).alias(k) for k, w in zip(names, ws, strict=True))) for p, ws in parts.items()))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in names))
    return F.aggregate(table, zero, lambda t, y: let(_number_of(s, y["part"]), lambda n: F.struct(*((t[k] + n * y[k]).alias(k) for k in names))))


def _squares(s: Column) -> Column:
    symbols = F.array(*map(F.lit, CODES))
    return F.aggregate(symbols, F.lit(0.0), lambda t, c: let(_number_of(s, c), lambda n: t + n * n))


def _facts(token: Column) -> Column:
    """token, its alphabet's size, its characters' classes after an "other" one (capitals as small letters where there are none), the quarters of its alphabet that they fall in as a ring, and the chance that two characters share a quarter."""
    out = None
    for alphabet in reversed(ENCODINGS):
        k = len(alphabet)
        quarter = "".join(_QUARTERS[4 * i // k] for i in range(k))
        same = sum((quarter.count(q) / k) ** 2 for q in _QUARTERS)
        ring = F.translate(token, alphabet, quarter)
        own = F.struct(F.lit(float(k)).alias("k"), F.lit(same).alias("same"), F.concat(ring, F.substring(ring, 1, 1)).alias("ring"))
        fits = token.rlike("^[" + alphabet.replace("-", r"\-") + "]+$")
        out = own if out is None else F.when(fits, own).otherwise(out)
    cased = F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token))  # ordinary words are also written in capitals throughout
    classes = F.translate(cased, CODES, "d" * 10 + "l" * 26 + "u" * 26 + "o" * 4)
    return F.struct(token.alias("token"), F.length(token).cast("double").alias("n"), F.concat(F.lit("o"), classes).alias("classes"), out.alias("e"))


def randomness(token: Column) -> Column:
    """The p-value of a token under "ordinary text": small for tokens that ordinary text hardly has and that pass all tests of randomness."""
    log_next = [[math.log(p) for p in row] for row in NEXT]
    pairs = [(i, j) for i in range(4) for j in range(4) if i != j]
    # a pair takes a stay from its first class, and a step within its first quarter, whose square it replaces
    change = {_CLASSES[i] + _CLASSES[j]: (log_next[i][j] - log_next[i][i],) for i, j in pairs}
    stay = {c: (log_next[i][i],) for i, c in enumerate(_CLASSES)}
    step = {_QUARTERS[i] + _QUARTERS[j]: (1, i * j - i * i) for i, j in pairs}
    value = {q: (i, i * i) for i, q in enumerate(_QUARTERS)}
    within = {c: (w,) for c, w in zip(CODES, _WITHIN, strict=True)}
    last_stay = lambda s: F.element_at(F.create_map(*(x for c, (w,) in stay.items() for x in (F.lit(c), F.lit(w)))), F.right(s, F.lit(1)))

    def measured(x):
        token, n, ring = x["token"], x["n"], x["e"]["ring"]
        own = F.substring(ring, F.lit(2), F.length(ring))  # the ring less the character that it repeats
        return F.struct(n.alias("n"), x["e"]["k"].alias("k"), x["e"]["same"].alias("same"), _squares(token).alias("squares"), _sums(token, within)["a"].alias("within"), _sums(ring, step).alias("steps"), _sums(own, value).alias("values"), (_sums(x["classes"], change)["a"] + _sums(x["classes"], stay)["a"] - last_stay(x["classes"])).alias("chain"))

    def p_value(m):
        n, k, same = m["n"], m["k"], m["same"]
        chi = (m["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1))
        runs = (m["steps"]["a"] - n * (1 - same)) / F.sqrt(n * same * (1 - same))
        spread = m["values"]["b"] - m["values"]["a"] * m["values"]["a"] / n
        cross = m["values"]["b"] + m["steps"]["b"] - m["values"]["a"] * m["values"]["a"] / n
        serial = F.when(spread > 0, (cross / F.when(spread > 0, spread) + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(99.0))
        deviation = F.pow(F.greatest(chi, F.lit(0.0)), 2) + F.pow(runs, 2) + F.pow(serial, 2)
        # of so many encodings one was chosen
        evidence = -n * F.log(k) - math.log(len(ENCODINGS)) - m["chain"] - m["within"]
        return F.exp(F.least(deviation / 2 - evidence, F.lit(0.0)))

    return let(_facts(token), lambda x: let(measured(x), p_value))


def discoveries(matches: Column, fdr: float = FDR) -> Column:
    """The matches that the Benjamini-Hochberg rule takes at this share of false ones."""
    scored = F.transform(matches, lambda m: F.struct(randomness(m["token"]).alias("p"), m.alias("m")))

    def chosen(s):
        ranked = let(F.sort_array(F.transform(s, lambda x: x["p"])), lambda ps: F.filter(F.transform(ps, lambda p, i: F.when(p <= fdr * (i + 1) / F.size(ps), p)), lambda p: p.isNotNull()))
        return let(F.coalesce(F.array_max(ranked), F.lit(-1.0)), lambda limit: F.transform(F.filter(s, lambda x: x["p"] <= limit), lambda x: x["m"]))

    return F.when(F.size(matches) > 0, let(scored, chosen)).otherwise(matches)


def analysis(text: Column, shortest: int = SHORTEST) -> Column:
    """base and spans (see scan) of a text as a struct."""
    pattern = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % shortest
    text = F.coalesce(text, F.lit(""))

    def both(base):
        added = let(let(found(text, pattern), lambda m: apart(m, base)), lambda m: discoveries(m))
        return F.struct(base.alias("base"), F.sort_array(F.concat(base, _spans(added, len(BASE), "random"))).alias("spans"))

    return let(base_spans(text), both)


def scan(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """docs with base (spans of the fixed patterns) and spans (these and the tests'), sorted by start and kind; code points, end exclusive.

    All columns of docs are kept, and repeated rows come back as often; a null or empty text has no spans. Tokens that touch a base span are not tested, nor are those
    of fewer than `shortest` characters. Columns named base or spans are replaced.
    """
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), analysis(F.col("text"), shortest).alias("found"))
    return d.select("row.*", "found.base", "found.spans")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cut(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text that is given as pieces of PIECE code points."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), (a % PIECE + 1).cast("int"), F.least(b - a, PIECE - a % PIECE).cast("int"))
    middle = F.when(last > first + 1, F.array_join(F.slice(pieces, first + 2, last - first - 1), ""))
    tail = F.when(last > first, F.substring(F.get(pieces, last), F.lit(1), (b % PIECE).cast("int")))
    return F.concat(*(F.coalesce(x, F.lit("")) for x in (head, middle, tail)))


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """text with each group of overlapping spans replaced by a mark; null stays null."""
    step = lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("a"), s["start"].alias("b"))))

    def clean(spans):
        kept = scan_array(spans, F.lit(0).cast("long"), step, "struct<a:long,b:long>")
        end = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("a"), F.length(text).cast("long").alias("b"))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        out = let(pieces, lambda v: F.array_join(F.transform(F.concat(kept, F.array(end)), lambda k: cut(v, k["a"], k["b"])), mark))
        return F.when(F.size(spans) > 0, out).otherwise(text)

    return let(analysis(text)["spans"], clean)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of secrets in text replaced by a mark, all else kept; a null text stays null, and repeated rows come back as often."""
    return docs.select(*(redacted(F.col("text"), mark).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
