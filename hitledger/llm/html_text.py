"""Main text of web pages by tag-path ratios.

The text of a page falls into blocks, and each block hangs on a path of block elements from the
root. Per path the page's blocks, characters, punctuation and link characters are added up. The
ratios of a path are smoothed with those of the paths around it, level by level up to the root;
length, punctuation, links (inside an article only where names mark lists of links) and what the
names on the path mean are fused into one score. The threshold comes from the page: where the scores of its
paths leave the widest gap, below those that are surely content. No block goes for its names
alone; only elements that never hold the article (scripts, forms, menus, footers and the like) and what
is hidden are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger.llm.common import ship

SURE = 0.05  # of the best path's score: content whatever the others are
LEAST = 0.01  # of it: no content
GAP = 2.5  # how many times the score below a gap the one above it is, at least
INSIDE_ARTICLE = 30.0
NAMED_NOISE = 0.03
NEAR = 0.5  # weight of the paths around, halved again with each level up

#: Fixed: elements that never hold text of the article, elements that end a block, those without an end.
NOISE_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea"
    " input label iframe object svg canvas dialog menu audio video map datalist".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option"
    " p pre section summary table tbody td tfoot th thead title tr ul caption head script style template".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed: words in class, id and role that mark other things than the article, wherever they are.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion"
    " sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs topbar cookie cookies consent gdpr"
    " popup modal overlay newsletter subscribe subscription signup login signin share sharing social"
    " recommended recommendations comment comments commentlist disqus respond widget widgets toolbar pagination pager".split()
)
#: Words that mark them outside an article, but can name a part of it.
OUTSIDE_WORDS = frozenset(
    "header head masthead banner top aside footer bottom notice notices alert dialog register search searchbox"
    " related reply replies legal copyright contentinfo complementary skip hidden form feedback".split()
)
LINK_WORDS = frozenset("links linklist toc tags tag categories category topics archive archives more next prev previous".split())  # inside it
ARTICLE_WORDS = frozenset("article articlebody main maincontent".split())
#: What a start tag closes, if it is open: element -> elements that stop the search.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dd dt", ("dl",)),
    "dd": ("dd dt", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
P_STAYS = frozenset("html body head script style template title option optgroup li dt dd tr td th tbody thead tfoot legend caption".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Path, in an article, weight of the names, text, link characters.
Block = tuple[tuple[str, ...], bool, float, str, int]


class _Blocks(HTMLParser):
    """Reads a page into blocks: path, whether it is in an article, the weight of its names, text, link characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, float, str]] = []  # tag, not read, article, weight, name on the path
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.links = 0

    def _state(self) -> tuple[bool, bool, float]:
        return self.open[-1][1:4] if self.open else (False, False, 1.0)

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(name for *_, name in self.open if name)
            self.blocks.append((path, *self._state()[1:], text, self.links))
        self.text, self.links = [], 0

    def _pop_to(self, at: int) -> None:
        if any(tag in BLOCK_TAGS for tag, *_ in self.open[at:]):
            self.end_block()
        del self.open[at:]

    def _close_implied(self, tag: str) -> None:
        if tag in BLOCK_TAGS and tag not in P_STAYS:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    return self._pop_to(at)
                if self.open[at][0] in BLOCK_TAGS:
                    return None
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in stops:
                    return None
                if self.open[at][0] in closed.split():
                    return self._pop_to(at)
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        self._close_implied(tag)
        if tag in BLOCK_TAGS:
            self.end_block()
        if tag in VOID_TAGS:
            return
        unread, article, weight = self._state()
        given = {k: v or "" for k, v in attrs}
        marks = CAMEL.sub(" ", " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop")))
        words = set(WORD.findall(marks.lower()))
        named = bool(words & NOISE_WORDS)
        if named or (not article and words & OUTSIDE_WORDS):
            weight *= NAMED_NOISE
        article = article or (weight == 1.0 and (tag in ("article", "main") or bool(words & ARTICLE_WORDS)))
        style = given.get("style", "").replace(" ", "").lower()
        unread = (
            unread
            or tag in NOISE_TAGS
            or (tag == "header" and not article)
            or (named and tag not in BLOCK_TAGS)  # inside a block, which has one score
            or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true"
            or "display:none" in style
            or "visibility:hidden" in style
        )
        name = ".".join([tag, *sorted(words)]) if tag in BLOCK_TAGS else ""
        self.open.append((tag, unread, article, weight, name))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in ("br", "p") and not any(x[0] == tag for x in self.open):
            self.text.append(" ")
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                return self._pop_to(at)
            if tag not in BLOCK_TAGS and self.open[at][0] in BLOCK_TAGS:
                return None  # an inline end tag closes no block
        return None

    def handle_data(self, data: str) -> None:
        if self._state()[0]:
            return
        self.text.append(data)
        if any(tag == "a" for tag, *_ in self.open):
            self.links += len(data.strip())


def _whole(html: str) -> str:
    """Without a tag or comment that the end of the page cuts."""
    comment = html.rfind("<!--")
    if comment >= 0 and html.find("-->", comment) < 0:
        html = html[:comment]
    tag = html.rfind("<")
    if tag >= 0 and html.find(">", tag) < 0 and re.match(r"<(?:[a-zA-Z/!?]|$)", html[tag : tag + 2]):
        html = html[:tag]
    return html


def path_scores(blocks: list[Block]) -> dict[tuple[tuple[str, ...], bool, float], float]:
    """The fused score of each path."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for path, _, _, text, links in blocks:
        own = (1, len(text), len(PUNCTUATION.findall(text)), links)
        for depth in range(len(path) + 1):
            key = path[:depth] if depth < len(path) else (*path, "")  # the path itself apart from what hangs below
            held = sums.setdefault(key, [0, 0, 0, 0])
            for k in range(4):
                held[k] += own[k]
    scores = {}
    for path, article, named in {block[:3] for block in blocks}:
        length = punctuation = total = 0.0
        weight = 1.0
        for key in [(*path, ""), *(path[:d] for d in range(len(path), -1, -1))]:
            if key in sums:
                n, chars, marks, _ = sums[key]
                length, punctuation, total = length + weight * chars / n, punctuation + weight * marks / n, total + weight
            weight *= NEAR
        n, chars, _, links = sums[(*path, "")]
        lists_links = not article or any(LINK_WORDS.intersection(name.split(".")) for name in path)
        apart = max(0.05, 1 - links / max(chars, 1)) if lists_links else 1.0
        fused = (length / total * (1 + punctuation / total)) ** 0.5 * apart * named
        scores[path, article, named] = fused * (INSIDE_ARTICLE if article else 1.0)
    return scores


def threshold(scores: Iterable[float]) -> float:
    """The least score of content: above the widest gap of those that start below SURE of the best."""
    ordered = sorted(set(scores))
    best = ordered[-1] if ordered else 0.0
    least, widest = LEAST * best, GAP
    for below, above in zip(ordered, ordered[1:]):
        if LEAST * best <= below < SURE * best and above >= widest * below:
            least, widest = above, above / below
    return least


def main_text(html: str) -> str:
    """The article of one page: its blocks in order, one per line."""
    parser = _Blocks()
    parser.feed(_whole(html))
    parser.close()
    parser.end_block()
    scores = path_scores(parser.blocks)
    least = threshold(scores.values())
    return "\n".join(block[3] for block in parser.blocks if scores[block[:3]] >= least)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, have the empty text. Each page stands
    alone: repeated rows give repeated results, in one pass without a shuffle. <br> is white space.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
