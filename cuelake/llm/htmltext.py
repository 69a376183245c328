"""Main text of web pages by two passes over blocks.

The page is read once into blocks: pieces of text between block-level tags, each with the path of regions that it
lies in. Blocks inside a region that is never article text (menus, headers and footers of the page, sidebars, forms,
comments of readers, adverts, by tag, role or name) are left out; a long block of few links inside an article or main element is good. First pass: of the rest, length, link density and
stop-word density make a block good, bad, or undecided when it is short or of middling density. Second pass: an
undecided block takes the label of its nearest decided neighbours; where those on both sides differ, it takes that of the
nearer one, and at equal distance, or within the region of the good one, it is good. A heading looks to the block behind it.

Stop-word density tells nothing of a text in a language without a list here: if no block of a page reaches the density of
a good one and over half of its long blocks fall below that of a bad one, these are undecided rather than bad.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import append_columns

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was with as be by at this are from or an not have they which one you had but what all were when we there can more if "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont avec ou "
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
SKIP = frozenset("script style noscript template svg math iframe object head title select textarea button".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe".split())
#: All that a head holds; any other tag ends it.
HEAD = frozenset("title meta link base basefont bgsound style script noscript template".split())
#: Tags that end an unclosed select, button or drawing.
BREAKS = frozenset("body article main section nav header footer aside h1 h2 h3 h4 h5 h6 p ul ol table form blockquote pre".split())
BROKEN = frozenset("select button svg math".split())
AWAY = frozenset("nav aside footer form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A class or id is that of a region outside the article if it consists of these words, and at most of PLAIN ones besides.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead "
    "cookie cookies consent notice alert popup modal newsletter subscribe share social related recommended comment comments disqus replies login signup search widget pagination pager".split()
)
PLAIN = frozenset(
    "a and area bar block bottom box btn button buttons card center column container content count desktop feed fixed form global group header holder icons id inner item items left link links "
    "list main message middle mobile module more new page panel post posts articles primary reader reading right row secondary section single site slot sticky tag template the thread title to top unit user view wrap wrapper".split()
)
#: Regions by name that hold articles of others: only a main inside overrides them. Names that tell of another part.
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo related recommended comment comments disqus replies widget".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+x?[0-9]*")
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TAIL = re.compile(r"<[a-zA-Z/!?]")
_SPACE = re.compile(r"[\s\xa0]+")
_WORD = re.compile(r"\w+")

#: Blocks of fewer words are short; stop-word shares from which a block is good, and below which it is bad.
SHORT, DENSE, SPARSE, LINKED = 12, 0.2, 0.05, 0.5
#: So many times at most a page is read, each time without the containers that the last one found.
CONTAINERS = 5


def named(names: str) -> tuple[bool, bool]:
    """Whether one of the classes or ids is that of a region outside the article, and whether it holds others' text."""
    away = others = False
    for token in names.split():
        words = [x.lower() for x in _PART.findall(token)]
        if all(x in NAMES or x in PLAIN or x[0].isdigit() for x in words):
            away |= any(x in NAMES for x in words)
            others |= any(x in OTHERS for x in words)
    return away, others


class Tokens:
    """Tags and comments of a page, in linear time. A tag without an end outside quotation marks ends at its first >, as
    do all that follow it."""

    def __init__(self, page: str):
        self.page, self.loose = page, False

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next one from ``at`` on: start, end, whether it closes, its name (none for a comment) and attributes."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                return None if end < 0 else (at, end + 1, False, "", "")
            if m := _OPEN.match(page, at):
                if not self.loose:
                    if rest := _REST.match(page, m.end()):
                        return at, rest.end(), bool(m[1]), m[2].lower(), rest[1]
                    self.loose = True
                end = page.find(">", m.end())
                return None if end < 0 else (at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end])
            at += 1
        return None


class Block:
    __slots__ = ("away", "hard", "heading", "inside", "label", "linked", "region", "text")

    def __init__(self, text: str, linked: int, away: bool, hard: bool, region: int, heading: bool, inside: bool):
        self.text, self.linked, self.away, self.hard, self.region, self.heading, self.inside = text, linked, away, hard, region, heading, inside
        self.label = ""


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, white space inside as one space, character references decoded."""
    ignored: set[int] = set()
    for _ in range(CONTAINERS):
        out, soft = _read(page, ignored)
        words, articles = [0], [0]
        for b in out:
            words.append(words[-1] + (0 if b.hard else len(b.text.split())))
            articles.append(articles[-1] + b.inside)
        found = {k for k, (a, b) in soft.items() if 2 * (words[b] - words[a]) > words[-1] and articles[b] - articles[a] == articles[-1]}
        if not found:
            break
        ignored |= found
    return out


def _read(page: str, ignored: set[int]) -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """Blocks, and of each element that is a region as a form or by its name, by its number, the range of its blocks. Elements
    that are ``ignored`` are no such regions."""
    out: list[Block] = []
    soft: dict[int, tuple[int, int]] = {}
    begun: list[tuple[int, int]] = []  # number and first block of those that are open
    # tag, away (1: by name, 2: by the name of others' text, 3: as a form, 4: by tag or role), region, whether within an article
    # or main, whether it is a form or goes by its name
    stack: list[tuple[str, int, int, bool, bool]] = []
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    linked = anchors = regions = skip = at = number = 0
    foreign = False
    heading = False
    skipping, resume = "", 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            _, away, region, inside, _ = stack[-1] if stack else ("", 0, 0, False, False)
            out.append(Block(text, linked, away > 0, away > 3, region, heading, inside))
        parts.clear()
        linked = 0

    def push(tag: str, away: int, region: int, own: bool) -> None:
        stack.append((tag, away, region, tag in ("article", "main") or bool(stack) and stack[-1][3], own))
        opened[tag] += 1
        if own:
            begun.append((number, len(out)))

    def pop() -> str:
        tag, *_, own = stack.pop()
        opened[tag] -= 1
        if own:
            k, first = begun.pop()
            soft[k] = (first, len(out))
        return tag

    def add(text: str) -> None:
        nonlocal linked
        if text and not skipping:
            parts.append(text)
            if anchors:
                linked += len(text)

    tokens = Tokens(page)
    while True:
        found = tokens.after(at)
        if not found:
            if not skipping or skipping == "head":
                break
            unclosed.add(skipping)  # its end tag is missing: read on behind its start tag
            skipping, at = "", resume
            continue
        start, end, closing, tag, given = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        if skipping == "head" and (tag not in HEAD and tag != "head" or closing and tag == "html"):
            skipping = ""
        elif skipping in BROKEN and tag in BREAKS and not foreign:
            skipping = ""
        if tag in RAW and not closing and not given.endswith("/"):
            if not skipping and tag in BLOCK:
                flush()
            if tag not in unclosed:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(tag)
            if tag in unclosed:
                next_ = _TAIL.search(page, at)
                at = next_.start() if next_ else len(page)
            continue
        if skipping:
            if tag in ("foreignobject", "annotation-xml"):
                foreign = not closing
            if tag == skipping:
                skip += -1 if closing else 1 if tag not in ("select", "button", "head") else 0
                if skip <= 0:
                    skipping = ""
            continue
        if tag in SKIP and not closing and tag not in unclosed:
            if not given.endswith("/"):
                if tag in BLOCK:
                    flush()
                skipping, skip, resume, foreign = tag, 1, at, False
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        elif tag in BLOCK:
            flush()
            anchors = 0
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
            if tag in VOID:
                continue
            if closing:
                while opened[tag] and pop() != tag:
                    pass
            elif tag not in ("p", "li", "option", "dd", "dt", "tr", "td", "th") or given.strip():
                away = stack[-1][1] if stack else 0
                marks = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(given)}
                outside, others = named(marks.get("class", "") + " " + marks.get("id", ""))
                if away == 1 and tag == "article" and not others or away in (1, 2) and tag == "main":
                    away = 0
                number += 1
                own = False
                if away < 4:
                    inside = bool(stack) and stack[-1][3]
                    if tag in AWAY and tag != "form" or tag == "header" and not inside or marks.get("role", "").lower() in ROLES or "hidden" in marks and tag != "body":
                        away = 4
                    elif number not in ignored:
                        if tag == "form":
                            away, own = max(away, 3), True
                        elif tag not in ("body", "html", "article", "main") and outside:
                            away, own = max(away, 2 if others else 1), True
                if tag in ("p", "li", "option", "dd", "dt", "tr", "td", "th"):
                    if stack and stack[-1][0] == tag:
                        pop()
                        away = away or (stack[-1][1] if stack else 0)
                    push(tag, away, stack[-1][2] if stack else 0, own)
                else:
                    if stack and stack[-1][0] == "p":
                        pop()
                    regions += 1
                    push(tag, away, regions, own)
            elif stack and stack[-1][0] == tag == "p":
                pop()
    tail = _TAIL.search(page, at)
    add(page[at : tail.start()] if tail else page[at:])
    flush()
    while stack:
        pop()
    return out, soft


def classify(found: list[Block]) -> None:
    """Label every block good or bad."""
    rest = []
    for b in found:
        if b.away:
            b.label = "bad"
        else:
            rest.append(b)
    dense = sparse = long = 0
    for b in rest:
        words = _WORD.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.linked > LINKED * len(b.text):
            b.label = "bad"
        elif len(words) < SHORT:
            b.label = "short"
        else:
            b.label = "good" if stop >= DENSE else "near" if b.inside or stop >= SPARSE else "sparse"
            long, dense, sparse = long + 1, dense + (b.label == "good"), sparse + (b.label == "sparse")
    listed = dense or 2 * sparse <= long
    for b in rest:
        if b.label == "sparse":
            b.label = "bad" if listed or b.linked > 0.2 * len(b.text) else "near"
    first = [b.label for b in rest]
    before, last = [], -1
    for k, x in enumerate(first):
        before.append(last)
        last = k if x in ("good", "bad") else last
    behind = -1
    for k in range(len(rest) - 1, -1, -1):
        if first[k] in ("good", "bad"):
            behind = k
            continue
        sides = [i for i in (before[k], behind) if i >= 0]
        good = [i for i in sides if first[i] == "good"]
        if rest[k].heading and behind >= 0:
            keep = first[behind] == "good"
        elif len(good) in (0, len(sides)):
            keep = not sides or bool(good)
        else:
            keep = any(rest[i].region == rest[k].region for i in good) or abs(k - good[0]) <= min(abs(k - i) for i in sides)
        rest[k].label = "good" if keep else "bad"


def main_text(page: str) -> str:
    found = blocks_of(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extracted(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` with text, the main text's blocks joined by line ends, and n_chars (code points).

    A null or empty page, or one without article text, has an empty text. Repeated rows give equal results. One
    narrow pass over whole pages.
    """

    def make():
        def handle(block):
            made = [main_text(x.decode("utf-8", "replace")) for x in block]
            return {"text": made, "n_chars": [len(x) for x in made]}

        return handle

    return append_columns(pages, make, "text string, n_chars long", source="html")


def page_report(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
