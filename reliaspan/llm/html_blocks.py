"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by its place,
stop-word density, length and link density as content, boilerplate, short or near-content; the second
gives the undecided ones the label of their nearest decided neighbours. Inside an article only a block
that is mostly links is boilerplate, with what lies between two of these and is not long; a paragraph that
is one link follows its neighbours. A page in a language without a stop-word list is judged by length and
links. Omitted end tags close as browsers close them. A form is left out with its text, unless it wraps
the page: it holds the article, or there is none and it holds most of the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed lists of tag names.
SKIPPED = frozenset("head script style noscript template iframe object embed svg math canvas select button textarea option".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BOILERPLATE = frozenset("nav aside footer menu dialog".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main nav aside header footer ul ol dl table tbody thead tr figure form head script style noscript template iframe object svg math canvas select button textarea menu dialog fieldset details a".split())
BLOCKS = CONTAINERS - {"a"} | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre hr address caption figcaption summary title legend center optgroup option".split())
#: What a head may hold; anything else ends it. Elements without text of their own, which end no block.
HEAD = frozenset("title meta link base script style noscript template".split())
SILENT = frozenset("script style noscript".split())
#: Elements that no class voids, and blocks that the start of one of the others closes.
WHOLE = frozenset("html body main article form".split())
ENDED_BY = {n: BLOCKS for n in "p h1 h2 h3 h4 h5 h6".split()} | {"li": frozenset(["li"])} | {n: frozenset(["dt", "dd"]) for n in ("dt", "dd")} | {n: frozenset("td th tr tbody thead".split()) for n in ("td", "th")}
#: Fixed words of class and id attributes that name page parts other than the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus footer login menu modal "
    "nav navbar navigation newsletter notice notices pagination popup promo promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Fixed stop words of the languages that pages come in: English, French, German, Spanish.
STOP = frozenset(
    "the of and to in is this that with by for from was are or on at be as it an not have has he she they we you i but which one all will can "
    "le la les de des du un une et est en que qui dans pour par sur au aux avec ne pas ce il elle se son sa ses plus ou "
    "der die das und ist ein eine den dem des von zu mit im für auf nicht sich auch als an er sie es werden aus bei wird "
    "el los las del y es una con para su no por lo se al más como pero sus le ha o este sí porque esta entre cuando muy sin sobre".split()
)
#: Thresholds of the first pass: characters of a short and a long block, stop-word densities, link density, the same inside an article.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, LINKS_IN = 70, 200, 0.30, 0.32, 0.2, 0.5
#: Stop-word share of a page's unlinked text below which no list fits its language.
FITS = 0.2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
#: Characters that stand for a syllable or a word, so that a line of them says as much as a longer one.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    place: str  # "in": inside the article, "out": inside another part, "": not known
    heading: bool
    paragraph: bool = False
    form: int = 0  # number of the form around it, 0: none
    label: str = ""


def _part(attributes: str) -> bool:
    """Whether a class, id or role names a page part that is not the article: a whole one, of such words only."""
    if "=" not in attributes:
        return False
    names = (n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split())
    return any(words and all(w in PARTS for w in words) for words in (re.findall(r"[a-z]+", n) for n in names))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; empty ones are left out. Broken markup closes where it can."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open containers with the place they make: in, out, skip or as before
    parts: list[str] = []
    linked = 0
    heading = paragraph = article = False
    form = forms = 0
    wrappers: set[int] = set()  # forms around an article

    def place() -> str:
        now = ""
        for _, p in stack:
            if p == "skip" or p == "out" and now != "skip":
                now = p
            elif p and now not in ("out", "skip"):
                now = p
        return now

    def flush(at: str) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text and at != "skip":
            out.append(Block(text, min(linked, len(text)), at, heading, paragraph, form))
        parts.clear()
        linked = 0

    def closed() -> None:
        """After elements were closed: the place now, and no link or form that was opened inside them."""
        nonlocal here, form, in_link
        here = place()
        in_link = in_link and len(stack) >= link_depth
        form = form if any(n == "form" for n, _ in stack) else 0

    at, here, end = 0, "", len(page)
    in_link, link_depth = False, 0
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if stack and stack[-1][0] == "head" and text and not text.isspace():
            stack.pop()
            closed()
        if text and here != "skip":
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and here != "skip":
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name == "br":
            parts.append(" ")
            continue
        if name in SILENT and not closing and not attributes.endswith("/"):
            at = _after(page, name, at)
            continue
        if not closing and name not in HEAD and any(n == "head" for n, _ in stack):
            while stack.pop()[0] != "head":
                pass
            closed()
        if name in BLOCKS:
            flush(here)
            if not closing and stack and name in ENDED_BY.get(stack[-1][0], ()):
                while stack and name in ENDED_BY.get(stack[-1][0], ()):
                    stack.pop()
                closed()
            heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            paragraph = not closing and name == "p"
        if name == "a":
            in_link, link_depth = not closing and bool(_HREF.search(attributes)), len(stack)
        if closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                closed()
            continue
        if name in RAW and not attributes.endswith("/"):
            at = _after(page, name, at)
            continue
        if name == "form" and not form:
            forms += 1
            form = forms
        if name in CONTENT and here not in ("out", "skip"):
            article = True
            wrappers.add(form)
        if name in BLOCKS and name != "hr" and not attributes.endswith("/"):
            inside = here == "in"
            part = name not in WHOLE and _part(attributes)
            made = "skip" if name in SKIPPED else "out" if name in BOILERPLATE or name == "header" and not inside or part else "in" if name in CONTENT else ""
            stack.append((name, made))
            here = place()
    flush(here)
    kept = {0} | (_wrapping(out, forms, wrappers, article) if forms else set())
    return [b for b in out if b.form in kept]


def _after(page: str, name: str, at: int) -> int:
    """Where the content of a raw element that begins at `at` has ended."""
    stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return stop.end() if stop else len(page)


def _wrapping(found: list[Block], forms: int, around: set[int], article: bool) -> set[int]:
    """The forms that wrap the page: those around an article; without any, the one with most of the unlinked text."""
    if article:
        return around
    own = [0] * (forms + 1)
    for b in found:
        own[b.form] += len(b.text) - b.linked if b.place != "out" else 0
    return {f for f in range(1, forms + 1) if 2 * own[f] > sum(own)}


def _size(text: str) -> int:
    """Code points, of scripts without letters threefold."""
    return len(text) + (0 if text.isascii() else 2 * len(_DENSE.findall(text)))


def _density(words: list[str]) -> float:
    return sum(w in STOP for w in words) / max(1, len(words))


def _listed(found: list[Block]) -> bool:
    """Whether the stop-word lists fit the page's language, by its text that is neither linked nor short."""
    words = [w for b in found if b.place != "out" and not b.linked and _size(b.text) >= SHORT for w in _WORD.findall(b.text.lower())]
    return not words or _density(words) >= FITS


def classify(found: list[Block]) -> None:
    """Labels every block `good` or `bad`."""
    listed = _listed(found)
    for b in found:
        if b.place == "out":
            b.label = "bad"
            continue
        density = _density(_WORD.findall(b.text.lower())) if listed else STOP_HIGH
        links = b.linked / max(1, len(b.text))
        n = _size(b.text)
        if b.place == "in":
            b.label = "bad" if links > LINKS_IN and not b.heading else "good" if n > LONG or n >= SHORT and density >= STOP_HIGH else "short"
        elif links > LINKS or "©" in b.text:
            b.label = "bad"
        elif n < SHORT:
            b.label = "bad" if b.linked else "short"
        elif density >= STOP_HIGH:
            b.label = "good" if n > LONG else "near"
        elif density >= STOP_LOW:
            b.label = "near"
        else:
            b.label = "bad"
    for prev, b, nxt in zip([None, *found], found, [*found[1:], None], strict=False):
        if b.place == "in" and b.label == "bad" and b.paragraph and all(x is None or x.place == "out" or 2 * x.linked <= len(x.text) for x in (prev, nxt)):
            b.label = "short"  # a paragraph that is one link, not part of a list of links
    for _, run in groupby(found, lambda b: b.place):
        _settle_article([b for b in run if b.place == "in"])
    decided = [b.label if b.label in ("good", "bad") else None for b in found]
    before, last = [], None
    for label in decided:
        before.append(last)
        last = label or last
    after, last = [], None
    for label in reversed(decided):
        after.append(last)
        last = label or last
    after.reverse()
    any_good = "good" in decided
    for b, prev, nxt in zip(found, before, after, strict=True):
        if b.label in ("good", "bad"):
            continue
        if not any_good:  # a page of short blocks only: those with stop words, and headings, are its text
            b.label = "good" if b.label == "near" or b.heading else "bad"
        elif prev == nxt or prev is None or nxt is None:
            b.label = prev or nxt or "bad"
        else:  # between content and boilerplate
            b.label = "good" if b.label == "near" or b.heading and nxt == "good" else "bad"


def _settle_article(run: list[Block]) -> None:
    """The second pass inside an article: undecided blocks are bad only between two bad ones."""
    before, last = [], None
    for b in run:
        before.append(last)
        last = b.label if b.label != "short" else last
    last = None
    for b, prev in zip(reversed(run), reversed(before), strict=True):
        if b.label != "short":
            last = b.label
        else:
            b.label = "bad" if prev == last == "bad" and not b.heading else "good"


def main_text(page: str | None) -> str:
    """The content blocks joined by two line feeds; empty for None, an empty page and a page without content."""
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, keep: list[Column], page: str = "html") -> DataFrame:
    """The `keep` columns with text and n_chars, a row for each row of pages."""
    rows = pages.select(*keep, F.col(page).alias("_page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
