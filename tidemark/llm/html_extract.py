"""Main-text extraction from HTML by block rules in two passes.

A page is cut into blocks at block-level tags.  The first pass classifies every block by its length, its link
density and the density of function words: good, bad, near good or short.  Blocks inside elements that hold
no article (menus, headers, footers, sidebars, forms, scripts, comments of readers, adverts, notices, by tag,
role or class) are bad from the start; blocks inside an ``article`` or ``main`` rise one class (bad or short to
near good, near good to good) once the rules have run, unless they are mostly links.  Blocks outside have no
other rules.  The second pass decides short and near-good blocks by the nearest decided blocks on either side.

Character references are decoded, white space inside a block becomes one space, and kept blocks are joined by
a line feed.  Null or empty pages give the empty text.  Broken markup (tags left open, ends without starts,
references cut short) is read as far as it goes, in time proportional to the page's length.  Every block of a
page is looked at, whatever its length.  Rows with a null id or address come back like others.  Repeated rows
give equal texts; an empty table an empty result.  Extra columns, also those whose names differ by case only, are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pick
from .quality import FUNCTION_WORDS

#: Limits of the first pass, in characters and shares.
SHORT, LONG = 70, 200
LINKS, LINKS_INSIDE, STOPS_LOW, STOPS_HIGH = 0.2, 0.6, 0.15, 0.28

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select option button canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("nav header footer aside form menu dialog head fieldset search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role names that say an element holds no article.
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner\w*|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|widget\w*|foot\w*|head-?bar|masthead|site-?header|top-?bar|cookie\w*|consent\w*|notice\w*|alert\w*|pop-?up\w*|modal\w*|"
    r"header-?nav|responses?|reactions?|newsletter\w*|subscri\w*|sign-?up|comment\w*|repl(?:y|ies)|discuss\w*|disqus\w*|respond|share\w*|sharing|social\w*|related\w*|recommend\w*|more-?stories|pagination|pager|login|search\w*|contentinfo|complementary|navigation|banner|form|hidden|toc|tags|meta|byline-?share|legal|copyright|disclaimer\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: A whole class or id of this kind is a page header; "article-header" is not.
HEADER_NAME = re.compile(r"(?:^|\s)(?:(?:page|site|top|main|global)[_-]?)?header(?:$|\s)", re.IGNORECASE)
#: Names that say what a layout has beside the element, not what the element is.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:with|without|has|no|not|show|hide)[_-]\S+", re.IGNORECASE)
#: An article of this kind is not the page's own.
OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comment\w*|repl(?:y|ies)|related|promo\w*|teaser\w*|ads?|advert\w*)(?:$|[\s_-])", re.IGNORECASE)
_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_STOPS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())


class Block:
    __slots__ = ("tag", "apart", "inside", "text", "linked", "kind")

    def __init__(self, tag: str, apart: bool, inside: bool, text: str, linked: int):
        self.tag, self.apart, self.inside, self.text, self.linked, self.kind = tag, apart, inside, text, linked, ""


def _is_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Does this element hold no article?  A header within the article counts by its name alone."""
    if tag in APART and not (inside and tag in ("header", "fieldset")):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    own = OTHER_ARTICLE if tag in ("article", "main") else APART_NAMES
    for name, *values in _NAMED.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return True
        if name in ("class", "id", "role"):
            value = _LAYOUT.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
            if own.search(value) or (own is APART_NAMES and not inside and HEADER_NAME.search(value)):
                return True
    return False


class _Stack:
    """Open elements: (tag, apart, inside an article, place of the nearest block element), and where each tag was opened last."""

    def __init__(self):
        self.open: list[tuple[str, bool, bool, int]] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> tuple[str, bool, bool, int]:
        return self.open[-1] if self.open else ("", False, False, -1)

    def block(self) -> str:
        """The tag of the nearest block element."""
        at = self.top()[3]
        return self.open[at][0] if at >= 0 else ""

    def push(self, tag: str, apart: bool, inside: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, apart, inside, len(self.open) if tag in BLOCK else self.top()[3]))

    def cut(self, size: int) -> None:
        """Close all elements from this place on."""
        while len(self.open) > size:
            self.places[self.open.pop()[0]].pop()

    def end(self, tag: str) -> None:
        """Close the last element of this tag; one that is not a block closes no block."""
        at = self.places.get(tag)
        if at and (tag in BLOCK or at[-1] > self.top()[3]):
            self.cut(at[-1])


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with their setting, in time proportional to its length."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    endless: set[str] = set()  # raw elements that have no more ends
    linked = 0
    link_depth = 0
    at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, apart, inside, _ = stack.top()
            out.append(Block(stack.block(), apart, inside, text, linked))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if link_depth:
            linked += len(piece.strip())

    size = len(page)
    while at < size:
        m = _PARTS.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(html.escape(m[1]))
            continue
        if m[3] is None:
            continue
        tag, ends = m[3].lower(), m[2] == "/"
        alone = m[4].rstrip().endswith("/")
        if tag in RAW:
            if not ends and not alone:  # skip to its end, or past the start if it has none
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else (size if tag in ("script", "style") else at)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        elif tag == "a":
            link_depth = max(0, link_depth - 1) if ends else link_depth + 1
        if tag in VOID or (not ends and alone and tag not in BLOCK):
            continue
        if ends:
            if tag in BLOCK and stack.places.get(tag):
                link_depth = 0
            stack.end(tag)
        else:
            if tag in BLOCK and tag not in ("html", "body", "div", "section", "article", "main"):
                # A paragraph ends where the next block starts, and a list item at the next item.
                block = stack.block()
                if block == "p" or (block == tag and stack.top()[0] == tag and tag in ("li", "dt", "dd", "tr", "td")):
                    stack.cut(stack.top()[3])
            _, apart, inside, _ = stack.top()
            stack.push(tag, apart or _is_apart(tag, m[4], inside), inside or tag in ("article", "main"))
    close()
    return out


def first_pass(block: Block) -> str:
    """good, bad, near or short: by the block's length, links and words, then one class higher inside an article."""
    kind = "bad" if block.apart else _by_words(block)
    if not block.inside or block.apart or block.linked / len(block.text) > LINKS_INSIDE:
        return kind
    return "good" if kind in ("near", "good") else "near"


def _by_words(block: Block) -> str:
    n = len(block.text)
    if block.linked / n > LINKS:
        return "bad"
    if "©" in block.text or "copyright" in block.text.lower():
        return "bad"
    if n < SHORT:
        return "bad" if block.linked else "short"
    density = _density(block.text)
    if density >= STOPS_HIGH:
        return "good" if n > LONG else "near"
    if density >= STOPS_LOW:
        return "near"
    if block.tag != "p":
        return "bad"
    return "near" if n > LONG else "bad" if block.linked else "short"


def _density(text: str) -> float:
    """The share of function words."""
    words = _WORD.findall(text.lower())
    return sum(w in _STOPS for w in words) / max(len(words), 1)


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    for b in found:
        b.kind = first_pass(b)
    decided = [b.kind if b.kind in ("good", "bad") else "" for b in found]

    def neighbours(kinds: list[str]) -> tuple[list[str], list[str]]:
        """The nearest decided kind before and after each place; the page's edges count as bad."""
        ahead, last = [], "bad"
        for k in kinds:
            ahead.append(last)
            last = k or last
        behind, last = [], "bad"
        for k in reversed(kinds):
            behind.append(last)
            last = k or last
        return ahead, behind[::-1]

    # Short blocks look at good, bad and near-good neighbours; near-good ones then at what is decided.
    wide = [b.kind if b.kind != "short" else "" for b in found]
    ahead, behind = neighbours(wide)
    strict_a, strict_b = neighbours(decided)
    for i, b in enumerate(found):
        if b.kind == "short":
            pair = {ahead[i], behind[i]}
            if pair <= {"good"}:
                b.kind = "good"
            elif pair == {"bad"} or pair == {"near"} and strict_a[i] == strict_b[i] == "bad":
                b.kind = "bad"
            elif b.tag in HEADING:  # a heading goes with what it stands over
                b.kind = "good" if behind[i] in ("good", "near") else "bad"
            else:  # between the two: with prose on one side a paragraph of words goes with it
                prose = "near" in pair or b.tag == "p" and _density(b.text) >= STOPS_LOW
                b.kind = "good" if prose and "good" in (strict_a[i], strict_b[i]) and b.tag in ("p", "li", "dd") else "bad"
    ahead, behind = neighbours([b.kind if b.kind in ("good", "bad") else "" for b in found])
    whole = any(b.kind == "good" for b in found)
    for i, b in enumerate(found):
        if b.kind == "near":
            b.kind = "good" if not whole or "good" in (ahead[i], behind[i]) else "bad"
    return "\n".join(b.text for b in found if b.kind == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    pages = pick(df, id_col, url_col, html_col).toDF("page_id", "url", "html")
    types = [f.dataType.simpleString() for f in pages.schema]
    return pages.mapInArrow(_extract, f"page_id {types[0]}, url {types[1]}, text string, n_chars bigint")
