"""Main text of web pages by tag-path ratios.

A page becomes blocks of text in page order, each with its root-to-leaf path of tags.
Per path, text length and punctuation are summed and divided by the number of its
blocks; the ratios are smoothed over the page's sequence of blocks, fused as a
product with the spread of the path's block lengths, and thresholded against the
page's mean.  Paths above it are content, and so is all that stands beside content
in the same part of the page: headings, short paragraphs, list items.

Parts that the markup itself sets apart (navigation, headers and footers, asides,
forms, hidden parts, scripts, and parts whose class, id or role names them as menus,
notices, adverts, comments and the like) never count.  Text in ``article`` or ``main``
parts gets a higher ratio, no more: the threshold decides over it and over what stands
outside alike.

White space in a block, character references decoded, becomes single spaces; empty
blocks go; blocks are joined by one line feed.  Null, empty and text-free pages give
an empty text; every row gives one row; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table ul ol dl td th div article section main".split())

#: Parts that are not main text, by tag, role and words of class or id.
NOT_CONTENT = frozenset("nav header footer aside form button select option datalist dialog menu head template svg math canvas audio video object applet map".split()) | RAW
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs pagination pager header masthead "
    "topbar toolbar footer colophon copyright sidebar aside widget related recommended recommendations share sharing social comment comments commentlist disqus discussion reply "
    "replies respond feedback rating form search".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|</(?P<end>[A-Za-z][^\s/>]*+)[^>]*+>"
    r"|<(?P<tag>[A-Za-z][^\s/>\"']*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[A-Za-z][^\s/>]*+)(?P<odd_rest>[^>]*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Factor of the ratio of paths in ``article`` or ``main``.
MAIN_PRIOR = 1.5
PUNCTUATION = re.compile(r"[,.;:!?…。，；：！？、]")


@dataclass
class Element:
    tag: str
    parent: Element | None
    path: str
    shut: bool  # not content, by markup
    main: bool


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /\t\r\n") else {}


def _shut(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOT_CONTENT or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in NOT_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("html", "body", "article", "main"):
        words = WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        return tag in ("article",) and any(w.lower() in ("comment", "comments", "reply", "ad", "advert", "related") for w in words)
    return any(w.lower() in NOT_WORDS for w in WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    root = Element("", None, "", False, False)
    now, out, current = root, [], None
    links = 0
    at = 0

    def text(raw: str) -> None:
        nonlocal current
        if not raw or now.shut:
            return
        if current is None:
            if not raw.strip():
                return
            owner = now
            while owner.tag in INLINE and owner.parent:
                owner = owner.parent
            current = Block(owner)
            out.append(current)
        decoded = html.unescape(raw)
        current.parts.append(decoded)
        if links:
            current.linked += len(decoded)

    def close_to(element: Element) -> None:
        nonlocal now, links, current
        while now is not element:
            if now.tag == "a":
                links = max(0, links - 1)
            if now.tag not in INLINE:
                current = None
            now = now.parent

    def find(tags: tuple[str, ...], stop: frozenset[str]) -> Element | None:
        e = now
        while e.parent is not None:
            if e.tag in tags:
                return e
            if e.tag in stop:
                return None
            e = e.parent
        return None

    pos = 0
    while (m := TOKEN.search(page, pos)) is not None:
        text(page[at : m.start()])
        at = pos = m.end()
        if m["end"]:
            tag = m["end"].lower()
            e = find((tag,), frozenset() if tag not in INLINE else frozenset(CLOSES_P | {"li", "td", "th"}))
            if e is not None:
                close_to(e.parent)
            elif tag == "p":
                current = None
        elif m["tag"] or m["odd"]:
            tag, rest = (m["tag"] or m["odd"]).lower(), m["rest"] or m["odd_rest"] or ""
            if tag == "br":
                text(" ")
                continue
            if tag in CLOSES_P and (e := find(("p",), SCOPES)) is not None:
                close_to(e.parent)
            if tag in CLOSED_BY_SAME and (e := find(CLOSED_BY_SAME[tag], SCOPES - {"td", "th"} if tag in ("tr", "td", "th") else SCOPES)) is not None:
                close_to(e.parent)
            if tag not in INLINE:
                current = None
            if tag in VOID:
                continue
            attrs = _attributes(rest)
            main = now.main or tag in ("article", "main") or attrs.get("role") == "main"
            path = now.path if tag in INLINE else f"{now.path}/{tag}"
            element = Element(tag, now, path, now.shut or _shut(tag, attrs), main)
            if rest.endswith("/") and tag in ("path", "circle", "rect", "use"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = pos = end.end() if end else len(page)
                continue
            now = element
            links += tag == "a"
    text(page[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def _smooth(values: list[float]) -> list[float]:
    """Gaussian smoothing over two neighbours at either side."""
    weights = [exp(-(d * d) / 2) for d in (-2, -1, 0, 1, 2)]
    out = []
    for i in range(len(values)):
        pairs = [(w, values[i + d]) for w, d in zip(weights, (-2, -1, 0, 1, 2), strict=True) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def content_paths(blocks: list[Block]) -> set[str]:
    """Paths whose fused ratio is above the page's threshold."""
    by_path: dict[str, list[Block]] = defaultdict(list)
    for b in blocks:
        by_path[b.element.path].append(b)
    fused = {}
    for path, own in by_path.items():
        sizes = [max(0, len(b.text) - b.linked) for b in own]
        mean = sum(sizes) / len(own)
        spread = (sum((s - mean) ** 2 for s in sizes) / len(own)) ** 0.5
        marks = sum(len(PUNCTUATION.findall(b.text)) for b in own) / len(own)
        prior = 1 + (MAIN_PRIOR - 1) * sum(b.element.main for b in own) / len(own)
        fused[path] = prior * log1p(mean) * log1p(marks + 0.2) * (1 + log1p(spread))
    smoothed = _smooth([fused[b.element.path] for b in blocks])
    totals: dict[str, list[float]] = defaultdict(list)
    for b, v in zip(blocks, smoothed, strict=True):
        totals[b.element.path].append((v + fused[b.element.path]) / 2)
    ratio = {p: sum(v) / len(v) for p, v in totals.items()}
    threshold = 0.8 * sum(ratio[b.element.path] for b in blocks) / len(blocks)
    linked = {p: sum(b.linked for b in own) > 0.5 * sum(len(b.text) for b in own) for p, own in by_path.items()}
    return {p for p, r in ratio.items() if r >= threshold and not linked[p]} or {max(ratio, key=ratio.get)}


def main_text(page: str | None) -> str:
    blocks = [b for b in blocks_of(page or "") if not b.element.shut]
    if not blocks:
        return ""
    chosen = content_paths(blocks)
    picked = [b for b in blocks if b.element.path in chosen]
    chains = []
    for b in picked:
        chain, e = [], b.element
        while e is not None:
            chain.append(id(e))
            e = e.parent
        chains.append(chain)
    common = set(chains[0]).intersection(*map(set, chains[1:]))
    beside = {id(b.element.parent) for b in picked}

    def belongs(b: Block) -> bool:
        if b.element.path in chosen:
            return True
        e, last = b.element, None
        while e is not None and id(e) not in common:
            last, e = e, e.parent
        if e is not None and e.tag not in ("", "html", "body"):
            return b.linked <= 0.5 * len(b.text)
        return id(b.element.parent) in beside and b.element.tag != "div" and b.linked <= 0.5 * len(b.text) and last is not None

    return "\n".join(b.text for b in blocks if belongs(b))


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_page_batches, "page_id long, url string, text string, n_chars long")
