"""Main text of web pages: the best-scoring contiguous region of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import drawn, flat_map_rows, map_rows, settled

LABELLED_PAGES = 2_000  # pages the weights are learnt from, at most
KINDS = 1_000  # kinds of tags that get a weight of their own, at most
SEED = 6
LEAST = 0.1  # the least size of a tag's weight
WORD_SCORES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0, 3.0)
AS_GOOD = 0.001  # F1 by which two scores of words are alike
UNKNOWN_TAG = -0.2
WORD = "word"
INSIDE, OUTSIDE, LEFT_OUT = "inside", "outside", "left out"

# Names of HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "object")
EMPTY = ("svg", "template", "iframe", "object")  # such raw elements may end in their start tag
NOT_CONTENT = frozenset((
    "head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "menu",
    "dialog", *RAW))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
# Words in class, id and role that mark what is around an article.
MARKS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies",
    "consent", "disqus", "footer", "gdpr", "masthead", "menu", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "promoted", "promotion", "related",
    "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"))
STATES = ("has", "no", "with", "without", "not")  # "has-sidebar" tells of what is around
BY_TAG, NAMED, COMPOUND = 3, 2, 1  # how surely an element is no content
ARTICLE = ("article", "main")
# Elements that are parts of a text, and no containers of one.
TEXTUAL = INLINE | frozenset((
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure",
    "figcaption", "details", "summary", "address", "center"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{'|'.join(EMPTY)})(?=[\s/])[^>]*+(?<=/)>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    # A quoted value stands behind "="; a tag that never ends takes the rest of the page.
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""",
    re.S | re.I)
_ATTRIBUTE = re.compile(
    r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile("[a-z]+")


def _attribute_values(rest: str) -> list[str]:
    """The values of class, id and role in a start tag."""
    return ["".join(found) for found in _ATTRIBUTE.findall(rest)]


def _marked(name: str, attributes: str) -> int:
    """Whether class, id or role name something that is no content.

    ``NAMED`` where a whole token does, ``COMPOUND`` where a part of one does, 0 else.
    Tokens that tell of a state do not, nor does a part behind the first of an
    article's token; ``main`` is never marked.
    """
    found = 0
    if name in ("html", "body", "main"):
        return found
    for value in _attribute_values(attributes):
        for token in value.lower().split():
            if token in MARKS:
                return NAMED
            parts = _PARTS.findall(token)
            if parts and parts[0] not in STATES and not MARKS.isdisjoint(
                    parts[:1] if name == "article" else parts):
                found = COMPOUND
    return found


class Element(NamedTuple):
    """An element of a page: its name, its parent's number, how surely it is no content."""

    name: str
    parent: int
    marked: int  # BY_TAG, NAMED, COMPOUND or 0
    tokens: tuple[str, ...]  # of class, id and role


class Page:
    """Tags and texts of a page in order, and the elements they belong to.

    ``items`` are (name, text, number of the element, whether it begins there); the name is
    a tag's, of its beginning or its end, or ``WORD`` for a text.  An element that is never closed
    ends where its parent does; one that is no content also where an article or a body
    begins.  Scripts, styles and their like are not among the items.  The time
    is in proportion to the page, whatever its tags.
    """

    def __init__(self, page: str | None):
        page = page or ""
        self.elements = [Element("", -1, 0, ())]  # what holds everything
        self.items: list[tuple[str, str, int, bool]] = []
        stack, opened, at = [0], Counter(), 0
        marked: list[int] = []  # places in the stack of elements that are no content

        def shut(depth: int) -> None:
            """Close all elements from this place in the stack on."""
            while len(stack) > depth:
                opened[self.elements[stack.pop()].name] -= 1
            while marked and marked[-1] >= depth:
                marked.pop()

        for token in _TOKEN.finditer(page):
            if token.start() > at:
                self.items.append((WORD, page[at:token.start()], stack[-1], False))
            at = token.end()
            name = token["name"]
            if name is None:
                continue
            name = name.lower()
            if token["close"]:
                self.items.append((name, "", stack[-1], False))
                if opened[name]:
                    depth = len(stack) - 1
                    while self.elements[stack[depth]].name != name:
                        depth -= 1
                    shut(depth)
                continue
            if name in ARTICLE or name == "body":
                while marked:
                    shut(marked[-1])
            opens = name not in VOID and not token["rest"].endswith("/")
            owner = stack[-1]
            if opens:
                if name == "p" and self.elements[owner].name == "p":
                    shut(len(stack) - 1)  # a paragraph ends where the next begins
                sure = BY_TAG if name in NOT_CONTENT else _marked(name, token["rest"])
                tokens = tuple(
                    " ".join(_attribute_values(token["rest"])).lower().split())
                self.elements.append(Element(name, stack[-1], sure, tokens))
                owner = len(self.elements) - 1
                if sure:
                    marked.append(len(stack))
                stack.append(owner)
                opened[name] += 1
            self.items.append((name, "", owner, opens))
        if at < len(page):
            self.items.append((WORD, page[at:], stack[-1], False))

    def sureness(self, kept: frozenset[int] = frozenset()) -> list[int]:
        """How surely each element is in something that is no content, but for those ``kept``."""
        found = [0]
        for number, element in enumerate(self.elements[1:], 1):
            own = 0 if number in kept else element.marked
            found.append(max(found[element.parent], own))
        return found

    def in_article(self) -> list[bool]:
        found = [False]
        for element in self.elements[1:]:
            found.append(found[element.parent] or element.name in ARTICLE)
        return found

    def chain(self, number: int) -> list[int]:
        """An element and what holds it, from within."""
        found = []
        while number >= 0:
            found.append(number)
            number = self.elements[number].parent
        return found


def events(page: str | None) -> list[tuple[str, str, str]]:
    """Tags and texts of a page in order: (name, text, part).

    ``part`` is ``INSIDE`` an article or ``OUTSIDE``, or ``LEFT_OUT`` for what its tag, class,
    id or role says is no content, with all that it holds.
    """
    parsed = Page(page)
    sure, inside = parsed.sureness(), parsed.in_article()
    return [(name, text, LEFT_OUT if sure[number] else INSIDE if inside[number] else OUTSIDE)
            for name, text, number, _ in parsed.items]


def kinds_of(parsed: Page, place: int) -> Iterator[str]:
    """What an item is scored by: a tag's name, and where it begins its class tokens too."""
    name, _, number, begins = parsed.items[place]
    yield name
    if begins:
        yield from (f".{token}" for token in parsed.elements[number].tokens)


def count_labels(page: str | None) -> list[tuple[str, int, int]]:
    """(kind, inside, outside) of a page with an article: words, tags by name, class tokens."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    parsed = Page(page)
    sure, article = parsed.sureness(), parsed.in_article()
    for place, (name, text, number, _) in enumerate(parsed.items):
        counts = inside if article[number] and not sure[number] and name not in ARTICLE else outside
        for kind in kinds_of(parsed, place):
            counts[kind] += len(text.split()) if kind == WORD else 1
    if not inside[WORD]:
        return []
    return [(name, inside[name], outside[name]) for name in {*inside, *outside}]


def scores_by_word(page: str | None, weights: dict[str, float]) -> list[tuple[float, float]]:
    """(score of a word, F1 of the words found) for each of ``WORD_SCORES``, on a marked page.

    The scan goes over the whole page, with nothing left out by name.
    """
    parsed = Page(page)
    sure, article = parsed.sureness(), parsed.in_article()
    wanted = Counter(word for name, text, number, _ in parsed.items if name == WORD
                     and article[number] and not sure[number] for word in text.split())
    if not wanted:
        return []
    out = []
    for score in WORD_SCORES:
        first, past = best_region(parsed, dict(weights, **{WORD: score}), None)
        found = Counter(word for name, text, *_ in parsed.items[first:past] if name == WORD
                        for word in text.split())
        both = (found & wanted).total()
        out.append((score, 2 * both / (found.total() + wanted.total())))
    return out


def learn_weights(
    pages: DataFrame, id_column: str = "page_id", page: str = "html",
    most_pages: int = LABELLED_PAGES, most_kinds: int = KINDS,
) -> dict[str, float]:
    """Weights of words, of tags by name and of class tokens, from pages that mark their article.

    Of the pages, those of ``most_pages`` ids at most are read, drawn by a seeded hash.
    A tag's weight is the log of how often it stands within articles against outside,
    at most ``-LEAST``.  The ``most_kinds`` most frequent kinds, inside and outside together,
    have one.  The score of a word is that of ``WORD_SCORES`` with which the scan, without
    any list of names, finds the articles best; the largest of those as good.
    Without any marked page, words count 1 and tags as unknown.
    """
    some = drawn(pages.select(id_column).dropna().distinct(), id_column, most_pages, SEED)
    chosen = settled(pages.select(id_column, page).join(
        F.broadcast(some), id_column, "left_semi").select(F.col(page).alias("page")), "labelled")
    counted = flat_map_rows(chosen, lambda: count_labels, "kind string, inside long, outside long")
    totals = counted.groupBy("kind").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(
        F.desc(F.col("inside") + F.col("outside")), "kind").limit(most_kinds).collect()
    if not totals:
        return {WORD: 1.0}
    weights = {row["kind"]: min(-LEAST, math.log((row["inside"] + 1) / (row["outside"] + 1)))
               for row in totals}
    found = flat_map_rows(chosen, lambda: lambda value: scores_by_word(value, weights),
                          "score double, f1 double").groupBy("score").agg(F.avg("f1")).collect()
    best = max(f1 for _, f1 in found)
    return weights | {WORD: max(score for score, f1 in found if f1 > best - AS_GOOD)}


def best_region(
    parsed: Page, weights: dict[str, float], sure: list[int] | None, least: int = NAMED,
) -> tuple[int, int]:
    """The items of the highest sum, from the first to past the last: one scan.

    Words score ``weights[WORD]``, tags and class tokens their weights, below zero.  Words of
    elements that ``sure`` says are no content, ``least`` or surer, count as much against.
    """
    best = total = 0.0
    first, region, word = 0, (0, 0), weights[WORD]
    for place, (name, text, number, _) in enumerate(parsed.items):
        if name == WORD:
            n = len(text.split())
            total += word * (-n if sure and sure[number] >= least else n)
            if total > best:
                best, region = total, (first, place + 1)
        else:
            total += sum(weights.get(kind, 0.0 if kind[0] == "." else UNKNOWN_TAG)
                         for kind in kinds_of(parsed, place))
        if total <= 0:
            total, first = 0.0, place + 1
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page, its blocks joined by line feeds; empty if it has no words.

    The scan finds a region.  The text is that of the smallest container (not a
    paragraph, list or table) around the region, whole, so no link, list or table
    within or at its ends is lost; if that is the page itself, of all the page.  Left
    out of it is what tags, classes, ids and roles say is no content, but for the class of
    an element around the region, or around one of its ends and a first heading.  Where
    all words are in elements that their class says are no content, classes say nothing.
    """
    parsed = Page(page)
    sure = parsed.sureness()
    region = best_region(parsed, weights, sure)
    if region == (0, 0):
        region = best_region(parsed, weights, sure, BY_TAG)
    words = [number for name, text, number, _ in parsed.items[slice(*region)]
             if name == WORD and text.strip()]
    if not words:
        return ""
    first, last = parsed.chain(words[0]), parsed.chain(words[-1])
    around = frozenset(first).intersection(last)
    holder = next(number for number in last
                  if number in around and parsed.elements[number].name not in TEXTUAL)
    headed = [element.name == "h1" for element in parsed.elements]
    for number in range(len(headed) - 1, 0, -1):
        headed[parsed.elements[number].parent] |= headed[number]
    left = parsed.sureness(frozenset(
        number for number in {*first, *last} if parsed.elements[number].marked < BY_TAG
        and (number in around or headed[number])))
    within = [False] * len(parsed.elements)
    for number, element in enumerate(parsed.elements):
        within[number] = number == holder or element.parent >= 0 and within[element.parent]
    blocks, block = [], ""
    for name, text, number, _ in parsed.items:
        if not within[number] or left[number]:
            continue
        if name == WORD:
            block += html.unescape(text)
        elif name == "br":
            block += " "
        elif name not in INLINE:
            blocks.append(block)
            block = ""
    blocks.append(block)
    texts = (" ".join(block.split()) for block in blocks)
    return "\n".join(text for text in texts if text)


def extract(
    pages: DataFrame, id_column: str = "page_id", page: str = "html", *more: str,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """One row per page: id, columns ``more``, and ``text``, its main text.

    Words score positive, tags negative, with ``weights``, or those learnt from the
    pages themselves; one scan finds the contiguous region of the highest sum,
    the first of equal ones, and its container is taken whole (``main_text``).  Character
    references are decoded, white space inside a block is one space, blocks are
    lines; nothing else is dropped.  Time is in proportion to a page's length.
    Null, empty and wordless pages have an empty text; repeated rows give
    repeated rows; an empty table stays empty; other columns are not read.
    """
    known = learn_weights(pages, id_column, page) if weights is None else weights
    kept = pages.select(id_column, *more)
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes)
    return map_rows(
        pages.select(page, id_column, *more),
        lambda: lambda value, *rest: (*rest, main_text(value, known)), f"{ddl}, text string")
