"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of tags from the root to its leaf. Per path the
length of its text and its punctuation are related to the number of its nodes. Both ratios are
smoothed along the page, fused into one weight, and paths over a share of the greatest weight
are content, inside an <article> or <main> too. All content is the result, with headings, lists and tables
beside it, without what markup says is something else (navigation, forms, notices and the like).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import text_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
PUNCTUATION = ".,;:!?…。，！？؟،"
# The rest of this file treats HTML's own vocabulary as fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
NOT_TEXT = frozenset(
    "head title nav footer aside form script style template noscript iframe object embed svg math canvas audio "
    "video map button select option textarea input dialog menu datalist noembed noframes".split()
)
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form toolbar alertdialog".split())
# Whole words of class and id names.
NOT_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside "
    "footer foot footnav masthead topbar header siteheader cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup signin login share sharing social related "
    "recommended recommendations comment comments commentlist comentarios kommentare disqus respond reply replies "
    "discussion widget widgets toolbar skip skiplink copyright disclaimer paywall".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SMOOTHING = (0.25, 0.5, 0.25)
THRESHOLD = 0.1  # of the greatest weight of a path
# Headings and parts of lists, tables and quotations beside content are text however short they are.
TEXT_TAGS = HEADINGS | frozenset("li dt dd td th caption figcaption pre blockquote".split())
LIST_TAGS = frozenset("ul ol dl table thead tbody tfoot tr li td figure blockquote".split())
MOST_LINKED = 0.7  # a path with more of its text in links is a list of links


@dataclass
class Element:
    tag: str
    path: str
    parent: Element | None
    hidden: bool
    article: bool
    named: bool = False  # its class or id says that it is something else
    main: bool = False  # a main element is inside
    size: int = 0  # content text below it


@dataclass
class Block:
    element: Element
    path: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _names(value: str) -> set[str]:
    return {w.lower() for w in NAME_WORD.findall(value)}


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value))
    return found


def _hidden(tag: str, marks: dict[str, str], parent: Element) -> bool:
    if tag in NOT_TEXT or marks.get("role", "").lower() in NOT_TEXT_ROLES:
        return True
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true":
        return True
    style = marks.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    if tag == "header":
        return not parent.article
    return False


def _named(tag: str, marks: dict[str, str]) -> bool:
    if tag in ("html", "body", "article", "main", "header"):
        return False
    ids = "" if tag in HEADINGS else marks.get("id", "")  # of a heading it is the anchor of its section
    return bool(_names(f"{marks.get('class', '')} {ids}") & NOT_TEXT_NAMES)


def parse(page: str) -> list[Block]:
    """The blocks of text of a page, in order, without elements that tag, role or style hide. Tags that are left open or
    closed twice do no harm: a block tag ends an open paragraph, an end tag closes up to its start."""
    root = Element("", "", None, False, False)
    here, blocks, block, links, at = root, [], None, 0, 0

    def text(raw: str) -> None:
        nonlocal block
        if here.hidden or not raw:
            return
        value = entities.unescape(raw) if "&" in raw else raw
        if block is None:
            if not value.strip():
                return
            owner = here
            while owner.tag in INLINE and owner.parent is not None:
                owner = owner.parent
            block = Block(owner, owner.path)
            blocks.append(block)
        block.parts.append(value)
        if links:
            block.linked += len(value.strip())

    for found in TOKEN.finditer(page):
        if found.start() < at:
            continue
        text(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block = None
        if found.group(1):
            up = here
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                while here is not up.parent:
                    links -= here.tag == "a"
                    here = here.parent
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            ended = {"p"} if tag in CLOSES_P else {tag, "p"} | ({"td", "th"} if tag in ("tr", "td", "th") else set()) | ({"dd", "dt"} if tag in ("dd", "dt") else set())
            up = here
            while up.parent is not None and (up.tag in INLINE or up.tag in ended) and up.tag not in ("table", "ul", "ol", "dl"):
                if up.tag in ended:
                    while here is not up.parent:
                        links -= here.tag == "a"
                        here = here.parent
                up = up.parent
        if tag in VOID:
            continue
        marks = _attributes(found.group(3)) if found.group(3).strip(" /\n\t\r\f") else {}
        label = tag
        if marks.get("class", "").split():
            label += "." + ".".join(sorted(marks["class"].split()))
        hidden = here.hidden or _hidden(tag, marks, here)
        article = here.article or tag in ("article", "main") or marks.get("role", "").lower() in ("main", "article")
        here = Element(tag, f"{here.path}/{label}", here, hidden, article, _named(tag, marks))
        if not hidden and (tag == "main" or marks.get("role", "").lower() == "main"):
            up = here
            while up is not None and not up.main:
                up.main, up = True, up.parent
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            block = None
    text(page[at:])
    return blocks


def _above(element: Element) -> Iterator[Element]:
    """The element and those around it."""
    while element is not None:
        yield element
        element = element.parent


def _without_named(both: list[tuple[Block, str]]) -> list[tuple[Block, str]]:
    """The blocks without those in elements whose class or id says that they are something else. Names do not
    hide an element that holds a main element or most of the content: of the text in articles, if there
    is any, or else of all text. If they would hide all articles, they hide no element with one."""
    inside = any(b.element.article for b, _ in both)
    held: dict[int, int] = {}
    total = 0
    for b, t in both:
        if b.element.article or not inside:
            total += len(t)
            for up in _above(b.element):
                held[id(up)] = held.get(id(up), 0) + len(t)

    def hides(e: Element, least: float) -> bool:
        # An element inside an article is hidden by name unless it is most of the text.
        return e.named and not e.main and (e.parent.article or held.get(id(e), 0) <= least) and held.get(id(e), 0) <= 0.5 * total

    for least in (0.5 * total, 0):
        left = [(b, t) for b, t in both if not any(hides(e, least) for e in _above(b.element))]
        if not inside or any(b.element.article for b, _ in left):
            break
    return left


def _ratios(blocks: list[Block], texts: list[str]) -> np.ndarray:
    """The fused weight of every block's path: text length and punctuation per node of the path,
    smoothed along the page."""
    paths: dict[str, list[float]] = {}
    for b, t in zip(blocks, texts, strict=True):
        sums = paths.setdefault(b.path, [0.0, 0.0, 0.0])
        sums[0] += len(t)
        sums[1] += sum(map(t.count, PUNCTUATION))
        sums[2] += 1
    length = np.array([paths[b.path][0] / paths[b.path][2] for b in blocks])
    marks = np.array([paths[b.path][1] / paths[b.path][2] for b in blocks])

    same = np.array([b.path == a.path for a, b in zip(blocks, blocks[1:])], float)
    before = SMOOTHING[0] * np.concatenate(([0.0], same))
    after = SMOOTHING[2] * np.concatenate((same, [0.0]))

    def smooth(x: np.ndarray) -> np.ndarray:
        """Over neighbours of the same path, so that long paragraphs do not lift what stands between them."""
        sums = before * np.roll(x, 1) + SMOOTHING[1] * x + after * np.roll(x, -1)
        return sums / (before + SMOOTHING[1] + after)

    weight = smooth(length) * np.log2(2 + smooth(marks))
    fused: dict[str, list[float]] = {}
    for b, w in zip(blocks, weight, strict=True):
        fused.setdefault(b.path, []).append(w)
    mean = {path: float(np.mean(values)) for path, values in fused.items()}
    return np.array([mean[b.path] for b in blocks])


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by line breaks; empty if there is none."""
    if not page:
        return ""
    blocks = parse(page)
    texts = [" ".join("".join(b.parts).split()) for b in blocks]
    both = [(b, t) for b, t in zip(blocks, texts, strict=True) if t]
    both = _without_named(both)
    if not both:
        return ""
    blocks, texts = [b for b, _ in both], [t for _, t in both]
    if any(b.element.article for b in blocks):  # the page itself says where its articles are
        both = [(b, t) for b, t in zip(blocks, texts, strict=True) if b.element.article]
        blocks, texts = [b for b, _ in both], [t for _, t in both]
    linked: dict[str, list[int]] = {}
    for b, t in zip(blocks, texts, strict=True):
        sums = linked.setdefault(b.path, [0, 0])
        sums[0] += b.linked
        sums[1] += len(t)
    lists = {path for path, (inside, size) in linked.items() if inside > MOST_LINKED * size}
    weight = _ratios(blocks, texts)
    content = [
        k for k, b in enumerate(blocks) if b.path not in lists and weight[k] >= THRESHOLD * weight.max()
    ]
    if not content:
        content = list(range(len(blocks)))
    chosen, direct = set(content), set()
    for k in content:
        direct.add(id(blocks[k].element.parent))
        for up in _above(blocks[k].element):
            up.size += len(texts[k])
    out = []
    for k, (b, t) in enumerate(zip(blocks, texts, strict=True)):
        if k not in chosen and b.path not in lists and b.element.tag in TEXT_TAGS:
            around = b.element.parent
            while around.tag in LIST_TAGS and around.parent is not None:
                around = around.parent
            if id(around) in direct or (around.size and around.tag not in ("", "html", "body")):
                chosen.add(k)
        if k in chosen:
            out.append(t)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html"):
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.record_batch(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) for every row of ``pages``
    (``page_id``, ``url``, ``html``; other columns are left out).

    A null or empty page, and a page without an article, has an empty text. Ids and addresses may be null and
    repeat. Pages are independent of each other, so that nothing is shuffled.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return plain.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
