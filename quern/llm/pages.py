"""Main text of web pages by tree scoring.

Paragraphs pass points, for their length and commas, to the elements around
them: all to the first, a half to the next, less further up; links take their
part of the points away.  The element with most is the article, and such of its
siblings as look like text belong to it.  Menus, notices, adverts and the like
are cut out of the tree beforehand, by tag, role and class.

Each page is a row for itself; its tree lives as long as its row is worked on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of HTML: elements without an end, elements that hold no text for readers, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head title script style noscript template iframe object svg canvas math select option button textarea audio video map dialog".split())
AROUND = frozenset("nav header footer aside menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre li td th dd dt blockquote figcaption caption summary address".split())
BLOCKS = PARAGRAPHS | AROUND | frozenset("html body main article section div form fieldset ul ol dl table thead tbody tfoot tr figure details center hgroup search".split())
#: Fixed values of HTML: which open elements a start tag ends, and at which element looking for them stops.
ENDS_P = BLOCKS - frozenset("html body td th tr thead tbody tfoot caption summary figcaption".split()) | {"hr"}
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table"), "option": ("option", "select")}
ENDS = {tag: (frozenset(over.split()), frozenset(stop.split())) for tag, (over, stop) in ENDS.items()}
WHITE = re.compile(r"[\x20\x09-\x0D]+")

#: Words of class, id and role that say an element is no part of an article, whatever else they say.
APART = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored banner comment comments commentlist disqus reply replies respond sidebar sidebars sidenav "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations trending promo promotion paywall toolbar pagination pager widget widgets complementary contentinfo search skip".split()
)
#: Words that say it is the article or stands around it: then only the words of SURE count.
PART = frozenset("article body content main page post entry story text wrapper container layout column row".split())
SURE = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense sponsored comment comments commentlist disqus".split())
KEPT_TAGS = frozenset("html body main article".split())
ARTICLES = frozenset("article main".split())

LEAST_CHARS = 25


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    cut: bool = False
    form: bool = False
    classes: str = ""
    points: float = 0.0
    chars: int = 0
    linked: int = 0


@dataclass(eq=False)
class Block:
    """A run of text in one element, between the borders of blocks."""

    element: Element
    text: str
    linked: float
    points: float = 0.0


@dataclass
class Opened:
    tag: str
    element: Element
    link: bool = False
    cut: bool = False
    pieces: list = field(default_factory=list)


class Tree(HTMLParser):
    """The elements of a page that hold text, and its blocks in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", None)
        self.stack = [Opened("", self.root)]
        self.blocks: list[Block] = []
        self.run: list[tuple[str, bool]] = []  # text of the current block so far, and whether a link holds it

    def end_block(self) -> None:
        if self.run:
            text = WHITE.sub(" ", "".join(t for t, _ in self.run)).strip(" ")
            if text:
                held = sum(len(t) for t, _ in self.run)
                self.blocks.append(Block(self.stack[-1].element, text, sum(len(t) for t, link in self.run if link) / held))
            self.run = []

    def pop(self, to: int) -> None:
        """Closes all elements from place ``to`` on."""
        for opened in reversed(self.stack[to:]):
            if opened.tag in BLOCKS:
                self.end_block()
            self.stack.pop()

    def close_within(self, over: frozenset, stop: frozenset) -> None:
        """Closes the outermost open element of ``over`` above the last of ``stop``."""
        at = None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in stop:
                break
            if self.stack[k].tag in over:
                at = k
        if at is not None:
            self.pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self.close_within(_P, _P_STOPS)
        if tag in ENDS:
            self.close_within(*ENDS[tag])
        if tag == "a":
            self.close_within(_A, BLOCKS)
        above = self.stack[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "hr":
                    self.end_block()
                elif not above.cut:
                    self.run.append((" ", False))
            return
        named = dict(attrs)
        words = f"{named.get('class') or ''} {named.get('id') or ''} {named.get('role') or ''}"
        gone = above.cut or tag in UNREAD or tag in AROUND or (words.strip() and tag not in KEPT_TAGS and is_apart(words)) or (tag == "article" and bool(SURE & set(tokens(words))))
        element = above.element
        if tag in BLOCKS:
            self.end_block()
            if not gone:
                element = Element(tag, element, False, tag == "form" or element.form, named.get("class") or "")
        self.stack.append(Opened(tag, element, above.link or tag == "a", gone))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements alone

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag(tag, [])
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.pop(k)
                return
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                return  # the end of something inline that this block doesn't hold

    def handle_data(self, data: str) -> None:
        opened = self.stack[-1]
        if not opened.cut:
            self.run.append((data, opened.link))


_P, _A = frozenset({"p"}), frozenset({"a"})
_P_STOPS = frozenset("div section article main table td th blockquote li ul ol body form button object".split())


def tokens(words: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower())


def is_apart(words: str) -> bool:
    """Whether class, id and role say that an element is no part of an article."""
    found = set(tokens(words))
    return bool(found & SURE) or bool(found & APART) and not found & PART


def paragraph_points(block: Block) -> float:
    """One for being a paragraph (less if it is short), one for each comma, up to three for length; links take their share."""
    size = len(block.text)
    commas = sum(block.text.count(c) for c in ",，、،")
    return (min(1.0, size / LEAST_CHARS) + commas + min(size // 100, 3)) * (1 - block.linked)


def score(blocks: list[Block]) -> dict[Element, float]:
    """Points of each element that paragraphs stand in, discounted by the share of its text that links hold."""
    found: dict[Element, float] = {}
    for block in blocks:
        block.points = paragraph_points(block)
        at = block.element.parent if block.element.tag in PARAGRAPHS and block.element.parent else block.element
        level = 0
        while at:
            at.points += block.points / (1 if not level else 2 if level == 1 else 3 * level)
            at.chars += len(block.text)
            at.linked += round(len(block.text) * block.linked)
            found[at] = 0.0
            at, level = at.parent, level + 1
    return {e: e.points * (1 - e.linked / e.chars) for e in found}


def main_blocks(html: str) -> list[str]:
    """The blocks of the article of a page, in page order."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.end_block()
    blocks = [b for b in tree.blocks if not b.element.form]
    for given in (blocks, tree.blocks):  # a page that is one form as a whole is read as if it were none
        if not given:
            continue
        scores = score(given)
        best = max(scores, key=lambda e: scores[e])
        if scores[best] <= 0:
            continue
        at = best
        while at and at.tag not in ARTICLES:
            at = at.parent
        inside = {at or best}
        if not at:
            inside |= {e for e in _beside(best, scores, given)}
        return [b.text for b in given if _within(b.element, inside)]
    return []


def _within(element: Element | None, inside: set[Element]) -> bool:
    while element:
        if element in inside:
            return True
        element = element.parent
    return False


def _beside(best: Element, scores: dict[Element, float], blocks: list[Block]) -> Iterator[Element]:
    """Siblings of the best element that belong to the article: with a fifth of its points, or text, or headings, of few links."""
    if not best.parent:
        return
    own: dict[Element, list[Block]] = {}
    for block in blocks:
        e = block.element
        while e and e.parent is not best.parent:
            e = e.parent
        if e and e is not best:
            own.setdefault(e, []).append(block)
    for e, held in own.items():
        chars = sum(len(b.text) for b in held)
        linked = sum(len(b.text) * b.linked for b in held) / chars
        like = 0.2 * scores[best] if e.classes and e.classes == best.classes else 0.0
        ended = any(re.search(r"[.!?。！？]($|\s)", b.text) for b in held)
        if scores.get(e, 0.0) + like >= 0.2 * scores[best] or e.tag in HEADINGS and linked < 0.25 or e.tag in PARAGRAPHS and (linked < 0.25 if chars > 80 else linked == 0 and ended):
            yield e


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(main_blocks(html)) if html else "" for html in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url and the article's text.

    Blocks stand in page order, one a line; white space (U+0020, U+0009 to
    U+000D) inside a block, line breaks included, is one space, character
    references are decoded.  Null and empty pages, and pages that hold nothing
    but what is no article, have an empty text.  Repeated rows are worked on
    each; an empty table gives no rows.  Other columns are not read.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(_extracted, own.withColumnRenamed("html", "text").schema)
