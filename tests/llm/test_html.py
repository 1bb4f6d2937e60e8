"""Main text of pages: the two passes against plain versions, tags as browsers read them, any language, and recall on whole tables."""

import html
import random
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from quillon.llm import html_text as H

SENTENCE = "It is the text of a page that was made for this test, and it has a lot of the words that are in all the texts of it. "


def plain_second(found, label):
    """Pass 2 by trying all pairs of blocks."""
    if not any(label):
        return [x is None and b.linked == 0 for x, b in zip(label, found, strict=True)]
    cost = lambda levels: 1 + 2 * min(levels, 2)
    walk = lambda i, j: sum(cost(found[k - 1].depth + found[k].depth - 2 * min(found[k].low, found[k - 1].depth)) for k in range(min(i, j) + 1, max(i, j) + 1))
    out = []
    for i, (b, x) in enumerate(zip(found, label, strict=True)):
        if x is None:
            good = min(walk(i, j) for j, y in enumerate(label) if y)
            bad = [walk(i, j) for j, y in enumerate(label) if y is False]
            if not b.region:
                bad += [walk(i, 0) + cost(max(1, found[0].depth)), walk(i, len(found) - 1) + cost(max(1, found[-1].depth))]
            worst = min(bad, default=float("inf"))
            x = good <= worst if b.region else good < worst
        out.append(x)
    return out


def plain_first(found):
    """Pass 1 by counting anew for each block."""
    words = [re.findall(H._WORD, b.text.lower()) for b in found]
    of_page = [w for ws, b in zip(words, found, strict=True) if 2 * b.linked <= len(b.text) for w in ws]
    often = sorted({w for w in of_page if of_page.count(w) >= 3}, key=lambda w: (-of_page.count(w), w))[:40]
    out = []
    for b, ws in zip(found, words, strict=True):
        if 2 * b.linked > len(b.text):
            out.append(None if b.region and not b.apart and len(ws) <= 1 else False)
        elif len(b.text) < 80:
            out.append(None)
        else:
            out.append(True if not often or 5 * sum(ws.count(w) for w in often) >= len(ws) else None)
    return out


def random_page(rnd, depth=0):
    parts = []
    for _ in range(rnd.randint(1, 5)):
        kind = rnd.random()
        if kind < 0.35 and depth < 4:
            tag = rnd.choice(["div", "div", "ul", "section", "article", "nav", "footer", "form"])
            parts.append(f"<{tag} class='{rnd.choice(['', 'x', 'sidebar', 'social-history', 'comments list'])}'>{random_page(rnd, depth + 1)}</{tag}>")
        elif kind < 0.55:
            parts.append(f"<p><a href='x'>{rnd.choice(['one', 'two links', 'a link of many words'])}</a></p>")
        elif kind < 0.8:
            parts.append(f"<p>{rnd.choice(['Short.', 'Not long.', 'Few words here'])}</p>")
        else:
            parts.append(f"<p>{rnd.choice([SENTENCE, 'Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau'])}</p>")
    return "\n".join(parts)


def test_passes_against_plain_versions():
    rnd = random.Random(4)
    for _ in range(300):
        found = H.blocks(random_page(rnd))
        label = H.first_labels(found)
        assert label == plain_first(found)
        same = [b._replace(region=found[0].region) for b in found]  # what is left of a page is inside of a region, or the page has none
        assert H.second_labels(same, label) == plain_second(same, label)


@pytest.mark.parametrize("page,want", [
    ('<p class=x">A first one</p><p class="y">B second one</p>', "A first one\nB second one"),
    ("<p data-n=don't>A first one</p><p title='it'>B second one</p>", "A first one\nB second one"),
    ('<p title="a > b">A first one</p><p title = \'c > "d"\'>B</p>', "A first one\nB"),
    ("<article id='related-work'><h1>Work</h1><p>" + SENTENCE + "</p></article>", "Work\n" + SENTENCE.strip()),
    ("<article><section class='social-history'><p>" + SENTENCE + "</p></section><p>End.</p></article>", SENTENCE.strip() + "\nEnd."),
    ("<body><form action=x><div class='page sidebar-right'><p>" + SENTENCE + "</p><p>End.</p></div></form>", SENTENCE.strip() + "\nEnd."),
    ("<div class=comments><p>" + SENTENCE + "</p></div><article><p>" + SENTENCE * 2 + "</p></article>", (SENTENCE * 2).strip()),
    ("<article><p>Only</p><p>short ones</p></article><div class='cookie-notice'>We use them</div>", "Only\nshort ones"),
    ("<p>a&amp;b &lt;c&gt; &#233;&nbsp;d</p>", "a&b <c> é d"),
    ("", ""), ("<nav><a href=x>only a menu</a></nav>", ""),
])
def test_pages(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("text", ["Это первый абзац статьи, которая была написана для проверки, и в нём есть все слова, которые нужны, чтобы он был длинным и понятным. ", "これは試験のために書かれた記事の本文であり、言語の知識なしに本文として認識されるべき長い段落です。句読点もあります。そして続きがあります。", "นี่คือข้อความของบทความที่เขียนขึ้นเพื่อการทดสอบและควรได้รับการยอมรับว่าเป็นข้อความหลักของหน้านี้โดยไม่ต้องรู้ภาษา"])
def test_any_language(text):
    menu = "".join(f"<li><a href='/{i}'>{text.split()[0][:8]} {i}</a></li>" for i in range(8))
    page = f"<body><div><ul>{menu}</ul></div><div><h1>{text[:20]}</h1>" + "".join(f"<p>{text}</p>" for _ in range(4)) + "<p>OK.</p></div></body>"
    got = H.main_text(page).split("\n")
    assert [x for x in got if x == text.strip()] == [text.strip()] * 4 and len(got) <= 6


def test_many_blocks_take_seconds():
    for page in ("<p>short one</p>" * 100_000, "<div>" * 50_000 + "deep" + "</div>" * 50_000, "<div><p>x</p>" * 30_000 + f"<p>{SENTENCE}</p>", "</div></nav>" * 100_000, "<p title=\"" * 2000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 20


def article(page):
    part = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
    own = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", part))
    return Counter(x for x in own if x)


def test_recall_of_articles():
    """All blocks of the tables' articles; and with neutral containers, so that densities and neighbours alone decide."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    bare = lambda p: re.sub(r"<(/?)(?:article|nav|footer)", r"<\1div", p.replace(' class="ad"', ""))
    for change, least in ((lambda p: p, 0.99), (bare, 0.9)):
        hit = got = all_of = 0
        for p in pages:
            want, have = article(p), Counter(x for x in H.main_text(change(p)).split("\n") if x)
            hit, got, all_of = hit + sum((want & have).values()), got + sum(have.values()), all_of + sum(want.values())
        assert hit >= least * all_of and hit >= least * got


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "u", f"<p>{SENTENCE}</p>", "x"), (1, "u", f"<p>{SENTENCE}</p>", "x"), (None, None, None, None), (2, "v", "<p>" + "word " * 400_000, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert sorted(((r.page_id or 0, r.text) for r in got)) == [(0, ""), (1, SENTENCE.strip()), (1, SENTENCE.strip()), (2, ("word " * 400_000).strip())]
    assert H.extract(df).columns == ["page_id", "url", "text"]
