import math
import random

import duckdb
import pytest

from hitledger.llm import html_text as h
from hitledger.llm.html_text import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href="/a">Alpha</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot of them, really.</div>
<article><h1>Head &amp; line</h1><p>First   paragraph, with <b>bold</b>ness.<p>Second<br>line.
<div class="ad">Buy, now, this, thing!</div><ul><li>one<li>two</ul><pre>a
 b</pre><form><label>Name</label><input value="x"></form><p hidden>secret</p></article>
<aside>Side, side, side. More of the side.</aside><section id="comments"><article class="comment"><p>Nice, very nice, indeed nice.</p></article></section>
<footer>&copy; 2020</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == "Head & line\nFirst paragraph, with boldness.\nSecond line.\none\ntwo\na b"


@pytest.mark.parametrize("cut", ["<article><p>Text here, and more.</p", "<article><p>Text here, and more.<!-- note", "<article><p>Text here, and more.</p><scr"])
def test_cut_pages(cut):
    assert main_text(f"<body><nav>x</nav>{cut}") == "Text here, and more."


def test_page_without_an_article_element():
    body = "".join(f"<p>Sentence number {k}, which is long enough, has commas, and ends.</p>" for k in range(6))
    page = f"<body><div class='menu'><a href='/'>Home</a> <a href='/b'>B</a></div><div class='content'>{body}</div><div><a href='/x'>Next</a></div></body>"
    assert main_text(page).split("\n") == [f"Sentence number {k}, which is long enough, has commas, and ends." for k in range(6)]


@pytest.mark.parametrize("count", [1, 3, 12])
def test_linked_sources_of_an_article(count):
    said = [f"Paragraph {k}, which goes on" + ", and on, with words" * 24 + "." for k in range(5)]
    sources = [f"Journal of Things volume {k}" for k in range(count)]
    items = "".join(f"<li><a href='/{k}'>{x}</a></li>" for k, x in enumerate(sources))
    tags = "<ul class='tags'>" + "<li><a href='/t'>tag</a></li>" * 8 + "</ul>"
    page = f"<body><article>{''.join(f'<p>{x}</p>' for x in said)}<ul>{items}</ul><div>{tags}</div></article></body>"
    assert main_text(page).split("\n") == said + sources


def test_sections_of_an_article_stay_whatever_they_are_called():
    said = [f"Paragraph {k}, which goes on, and on, with words enough for a line of its own." for k in range(4)]
    page = f"""<body><div class="legal">Outside, legal, and long enough to be a line of text, with commas.</div><article>
        <p>{said[0]}</p><section class="legal"><p>{said[1]}</p></section><div class="related-work"><p>{said[2]}</p></div>
        <div class="sponsored"><p>Sponsored, by somebody, who pays for these words, and for more.</p></div><p>{said[3]}</p></article>
        <div>Something else outside, which names no noise, but is not of the article either.</div></body>"""
    assert main_text(page).split("\n") == said


def test_the_threshold_follows_the_scores():
    assert h.threshold([]) == 0.0
    assert h.threshold([100.0, 60.0, 9.0, 1.2]) == 9.0  # below 5 the widest gap ends at 9
    assert h.threshold([100.0, 4.0, 3.0, 2.0]) == 100.0
    assert h.threshold([100.0, 40.0, 20.0, 10.0]) == 1.0  # no gap below 5
    assert h.threshold([100.0, 30.0, 0.5]) == 1.0


def test_scores_decide_on_pages(monkeypatch):
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    texts = [main_text(x) for x in pages]
    assert all("Buy" not in t and t for t in texts)
    monkeypatch.setattr(h, "threshold", lambda scores: 0.0)
    assert sum(main_text(x) != t for x, t in zip(pages, texts)) > 0.9 * len(pages)


def plain_scores(blocks):
    """Paths, sums, smoothing and fusion once more, each sum by a pass over all blocks."""
    out = {}
    for path, article, named, *_ in blocks:
        parts = []
        at_path = [b for b in blocks if b[0] == path]
        for level, around in enumerate([at_path] + [[b for b in blocks if b[0][:d] == path[:d] and len(b[0]) > d] for d in range(len(path), -1, -1)]):
            if around:
                marks = sum(sum(c in ".,;:!?…。，、；：！？¿¡" for c in b[3]) for b in around)
                parts.append((h.NEAR**level, sum(len(b[3]) for b in around) / len(around), marks / len(around)))
        total = sum(w for w, _, _ in parts)
        length, marks = (sum(p[0] * p[k] for p in parts) / total for k in (1, 2))
        chars, links = sum(len(b[3]) for b in at_path), sum(b[4] for b in at_path)
        lists = not article or any(h.LINK_WORDS & set(name.split(".")) for name in path)
        apart = max(0.05, 1 - links / max(chars, 1)) if lists else 1.0
        out[path, article, named] = math.sqrt(length * (1 + marks)) * apart * named * (h.INSIDE_ARTICLE if article else 1)
    return out


def test_scores_like_a_plain_second_reading():
    rng = random.Random(3)
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    for _ in range(60):
        bits = []
        for _ in range(rng.randrange(1, 25)):
            tag = rng.choice(["div", "p", "ul", "li", "section", "article", "a", "td"])
            bits.append(rng.choice([f"<{tag} class='{rng.choice(['x', 'ad', 'tags', 'legal'])}'>", f"<{tag}>", f"</{tag}>", "some words, here. ", "No! ", "<a href=x>link</a>"]))
        pages.append("".join(bits))
    for page in pages:
        parser = h._Blocks()
        parser.feed(page)
        parser.close()
        parser.end_block()
        assert h.path_scores(parser.blocks) == pytest.approx(plain_scores(parser.blocks))


def test_references_and_white_space():
    assert main_text("<article><p>&lt;b&gt; &eacute;&#233;&#x1F642;&nbsp;\t x &am</p></article>") == "<b> éé🙂 x &am"


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "plain"), (1, "u", PAGE), (4, "x", "<article>" + "<p>word, word.</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = extract_text(pages).collect()
    assert len(found) == len(rows)
    for r, (i, u, html) in zip(found, rows):
        assert (r.page_id, r.url, r.text, r.n_chars) == (i, u, main_text(html or ""), len(main_text(html or "")))
    assert extract_text(pages.limit(0)).count() == 0
