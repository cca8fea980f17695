"""Main text of HTML pages by two passes of block rules.

The first pass labels each block by length, link density and the share of stop words; the
second gives undecided blocks the label of the nearest decided neighbour.  Parts whose tag,
role or class says that they are furniture are no blocks at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in a is it that for on with as was are be this by at from or an not have but they which you
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er
    le la les de des du et en un une que qui dans pour pas sur au est par il ce avec plus ne se son
    el los las de del y en un una que por con para no se es al lo su como más o pero sus""".split()
)

#: Blocks of fewer characters are decided by their neighbours; of more, by their words.
SHORT, LONG = 70, 200
#: Share of stop words of running text, and below which there is none.
DENSE, SPARSE = 0.30, 0.15
#: Share of a block's characters inside links from which it is a list of links.
LINKED = 0.5

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe object svg canvas dialog menu audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HINTED = frozenset("div section ul ol dl p span table td header figure a h2 h3 h4".split())
# Words of class and id names, and roles.
FURNITURE = frozenset(
    """ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright
    disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo
    promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split()
)
#: Words that say nothing of what a part is for.
NEUTRAL = frozenset("area block bottom box container content fixed global group inner item left list main outer page panel right section site top wrap wrapper zone".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: A name with one of these is that of readers' comments, whatever else it says, unless it tells
#: whether there are any.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
TELLING = frozenset("has no with without open closed allow allowed enabled disabled count".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    inside: bool  # in an article or main element
    heading: bool


class _Blocks(HTMLParser):
    """Blocks of a page.  The places of each open tag in the stack are kept, so that a tag costs
    what it ends, however many others are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, in an article, in a link
        self.open: dict[str, list[int]] = {}
        self.containers: list[int] = []  # places of open blocks other than paragraphs
        self.parts: list[tuple[str, bool]] = []
        self.blocks: list[Block] = []
        self.heading = False

    def _push(self, tag: str, dropped: bool, inside: bool, linked: bool) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS and tag != "p":
            self.containers.append(len(self.stack))
        self.stack.append((tag, dropped, inside, linked))

    def _pop_to(self, at: int) -> None:
        """End all elements from a place on."""
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            if tag:
                self.open[tag].pop()
            if self.containers and self.containers[-1] == len(self.stack):
                self.containers.pop()

    def _state(self) -> tuple[bool, bool]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)

    def flush(self) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = len(" ".join("".join(t for t, link in self.parts if link).split()))
            self.blocks.append(Block(text, linked, self._state()[1], self.heading))
        self.parts = []

    def _furniture(self, tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
        if tag in DROPPED or "hidden" in attrs or (attrs.get("aria-hidden") == "true" and tag in BLOCKS) or attrs.get("role") in ROLES:
            return True
        names = [set(re.split(r"[_-]+", x)) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()]
        if tag == "header":
            return not inside
        if tag == "article":
            return any(n & {"comment", "reply", "ad", "related", "promo"} for n in names)
        if tag in HINTED and any(n & COMMENTS and not n & TELLING for n in names):
            return True
        # A name says furniture if all of its words do, or say nothing: not share-price or has-sidebar.
        return tag in HINTED and any(n & FURNITURE and n <= FURNITURE | NEUTRAL for n in names) and not any(n <= CONTENT for n in names)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            self.parts.append((" ", False))
            return
        own = self.open.get(tag)
        if tag in ("p", "li") and own and own[-1] >= (self.containers or [-1])[-1]:
            self._pop_to(own[-1])  # a new one ends one that is open in the same container
        if tag in ("article", "main") or tag == "body":
            # what an unclosed menu or header swallowed ends here
            while self.stack and self.stack[-1][1] and not self.open.get("article"):
                self._pop_to(len(self.stack) - 1)
        if tag == "a" and self.open.get("a"):  # a new one ends one that is open
            at = self.open["a"].pop()
            self.stack[at] = ("", *self.stack[at][1:])
        dropped, inside = self._state()
        linked = bool(self.stack) and self.stack[-1][3] and tag != "a"
        named = dict(attrs)
        dropped = dropped or self._furniture(tag, named, inside)
        self._push(tag, dropped, inside or tag in ("article", "main") and not dropped, linked or tag == "a" and "href" in named)
        self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.open.get(tag):
            self._pop_to(self.open[tag][-1])
        if tag in BLOCKS:
            self.heading = False

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.parts.append((data, bool(self.stack) and self.stack[-1][3]))


def page_blocks(html: str) -> list[Block]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.blocks


_LETTERS = re.compile(r"[^\W\d_]+")


def stop_density(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def _linked(block: Block) -> bool:
    """Whether a block is a list of links."""
    return block.linked > LINKED * len(block.text)


def label(block: Block, has_article: bool, known: bool) -> bool | None:
    """First pass: True for main text, False for furniture, None for undecided.

    `known`: whether the page has stop words at all.  Where it has not, its language is none of
    those listed, and length and links decide; so they do for long blocks of an article, which
    may hold lists or code.
    """
    if has_article and not block.inside:
        return False
    n = len(block.text)
    if _linked(block):
        return False
    if n < SHORT or block.heading:
        return None
    density = stop_density(block.text)
    if density >= DENSE or density >= SPARSE and n > LONG or not known or block.inside and n > LONG:
        return True
    return None if block.inside or density >= SPARSE else False


def main_text(html: str) -> str:
    """Main text: blocks joined by two line feeds; empty if there is none."""
    blocks = page_blocks(html)
    has_article = any(b.inside for b in blocks)
    known = stop_density(" ".join(b.text for b in blocks if len(b.text) >= SHORT)) >= SPARSE / 2
    first = [label(b, has_article, known) for b in blocks]
    # Blocks of an article have neighbours there, but for its lists of links; elsewhere all blocks
    # are neighbours.  Where no block is main text for sure, what is undecided stays.
    decided = [i for i, x in enumerate(first) if x is not None and (not has_article or blocks[i].inside and not _linked(blocks[i]))]
    decided = decided if any(first[i] for i in decided) else []
    out = []
    for i, (b, x) in enumerate(zip(blocks, first, strict=True)):
        if x is None:
            x = not min((abs(i - j), not first[j]) for j in _around(decided, i))[1] if decided else True
        if x:
            out.append(b.text)
    return "\n\n".join(out)


def _around(decided: list[int], i: int) -> list[int]:
    """The decided places next before and after i."""
    lo, hi = 0, len(decided)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if decided[mid] < i else (lo, mid)
    return decided[max(0, lo - 1) : lo + 1]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page's main text.

    pages: page_id, url, html; other columns are ignored.  Null html is empty, which gives empty
    text; whole pages are read; each row, repeated ones too, has its own result; no rows give none.
    Markup that is not well-formed is read as far as it makes sense: unclosed paragraphs end at the
    next, unclosed menus at the article.  The time is in proportion to the page, however many
    elements stay open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = pa.array([main_text(h) if h else "" for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    out = small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
