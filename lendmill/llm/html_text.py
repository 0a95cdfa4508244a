"""Operator 6, HTML extraction by tag-path ratios.

A page is cut into text nodes by its tags. Each node has the path of its elements from the root, with their classes; a
path's length of text and number of punctuation marks are summed over its nodes and divided by their number. The two
ratios are fused (their product), smoothed over the nodes' order in the page by a Gaussian window, and paths whose mean
reaches the threshold are content: their nodes are the content nodes.

The article is what the content nodes lie in. Where elements ``article`` or ``main`` hold at least half of the content,
it is all in these. Elsewhere it is the lowest element that holds nearly all content, from its first content node to its
last: short headings, list items, cells and inner divs in between stay, and so do headings and paragraphs right before
and paragraphs, items and cells right after, unless most of their text is links; what comes before and after that
(menus, subscription boxes, copyright lines) goes, whatever its markup is called.

Scripts, styles, forms and hidden elements are never text; elements that HTML itself names as no article (``nav``,
``aside``, ``footer``, a page's ``header``) are left out, and so are blocks inside the article whose class, as a whole
word of it, or role names them as something else (an advert, a share bar, reader comments); a container's id counts too.

Page order and inner text are kept: character references are decoded, white space inside a block becomes one space,
blocks are joined by a line feed. Broken markup is read leniently: a paragraph ends where the next block begins, an end
tag without a start is passed over, a script's or style's content is never markup, a quote that does not close before a
tag's end is no quote, an unfinished tag at the end is dropped.

Cases: null and empty html give an empty text; a page without content gives an empty text; a page of any length and any
depth is read whole, in time by its length; repeated rows are read each; an empty table gives no rows; page_id and url of
any type are returned as they are; extra columns are dropped.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lendmill.llm.ragged import blocks

# Elements of the HTML standard by what they do, and class words that name parts that are no article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
SPACES = frozenset("br td th img input wbr option".split())
SECTIONS = frozenset("article main section div td body html".split())
NEVER = frozenset("head nav footer aside form script style title textarea noscript iframe noembed noframes template svg math button select option dialog menu object embed audio video canvas map".split())
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BEFORE = HEADINGS | frozenset("p blockquote".split())
AFTER = HEADINGS | frozenset("p li td th caption blockquote pre dd dt figcaption".split())
#: An end tag may be missing: a start tag closes an open element of its kind, up to a limit element.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs masthead site-header page-header footer site-footer page-footer"
    " sidebar side-bar widget widgets cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices notification alert popup modal overlay newsletter newsletter-signup subscribe"
    " signup login paywall share sharing share-bar share-buttons social social-share social-links related-posts related-articles related-links recommended recommendations comments comment-list commentlist"
    " comments-area comment-section user-comments reader-comments replies respond disqus disqus_thread pagination pager toolbar copyright disclaimer skip-link".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
#: Share of the mean over all text that a content path's score has at least; share of the content that one element of an
#: article without markup of its own holds; share of links that a block right after the content has at most.
SHARE, HELD, LINKS = 0.5, 0.95, 0.5


def _read(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether markup names an element as no part of an article, and its class without numbers."""
    if tag in NEVER:
        return True, ""
    out, shape = False, ""
    if attributes:
        for name, *value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(value).lower()
            if name == "class":
                shape = _DIGITS.sub("", value)
            if tag in KEPT:
                continue
            if name == "class" or name == "id" and tag in CONTAINERS:
                out |= not NAMES.isdisjoint(value.split())
            out |= name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true"
            out |= name == "style" and "display:none" in value.replace(" ", "")
    return out, shape


@dataclass
class Page:
    """Elements by number (0 is the document) and the text nodes outside excluded parts, in page order."""

    tag: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    #: The nearest article or main, the nearest block and whether a link is around.
    article: list[int] = field(default_factory=lambda: [0])
    block: list[int] = field(default_factory=lambda: [0])
    link: list[bool] = field(default_factory=lambda: [False])
    #: (element, number of the run of text, text).
    nodes: list[tuple[int, int, str]] = field(default_factory=list)


def parse(page: str) -> Page:
    """A page's elements and text nodes; every tag costs the elements that it opens or closes."""
    found, paths = Page(), {}
    #: Open elements, whether each is excluded, and where in ``stack`` the elements of each tag and of some kinds stand.
    stack, out = [0], [False]
    open_: dict[str, list[int]] = {}
    sections, others = [0], [0]
    run, at = 0, 0

    def text(a: int, b: int) -> None:
        if b > a and not out[-1]:
            found.nodes.append((stack[-1], run, page[a:b]))

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            open_[found.tag[stack.pop()]].pop()
            out.pop()
        for kind in (sections, others):
            while kind[-1] >= down_to:
                kind.pop()

    def last(tag: str) -> int:
        held = open_.get(tag)
        return held[-1] if held else 0

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            text(at, len(page))
            break
        text(at, token.start())
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not token[4]:
            break  # an unfinished tag
        if tag in BLOCKS and tag not in SPACES:
            run += 1
        elif tag in SPACES and found.nodes:
            found.nodes.append((stack[-1], run, " "))
        if token[1]:
            # An inline element's end tag does not reach beyond a section.
            place = last(tag)
            if place and (tag in BLOCKS or place > sections[-1] or place == sections[-1]):
                close(place)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not token[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            continue
        if tag in BLOCKS:
            if last("p") > others[-1]:  # a block ends an open paragraph
                close(last("p"))
            if tag in HEADINGS and found.tag[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
        if tag in CLOSES:
            ended, limit = CLOSES[tag]
            floor = max(map(last, limit))
            ends = [held[i] for held in (open_.get(t, []) for t in ended) for i in [bisect_right(held, floor)] if i < len(held)]
            if ends:
                close(min(ends))
        top = stack[-1]
        excluded, shape = _read(tag, token[3])
        number = len(found.tag)
        found.tag.append(tag)
        found.above.append(top)
        found.path.append(paths.setdefault((found.path[top], tag, shape), len(paths) + 1))
        found.article.append(number if tag in ("article", "main") else found.article[top])
        found.block.append(number if tag in BLOCKS else found.block[top])
        found.link.append(found.link[top] or tag == "a")
        place = len(stack)
        open_.setdefault(tag, []).append(place)
        stack.append(number)
        out.append(out[-1] or excluded or tag == "header" and not found.article[top])
        if tag in SECTIONS:
            sections.append(place)
        if tag in BLOCKS and tag != "p":
            others.append(place)
    return found


def smooth(values: np.ndarray, radius: int = 2) -> np.ndarray:
    """A Gaussian window over the order of nodes, normalized at both ends."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    pad = lambda x: np.convolve(x, kernel, "full")[radius : radius + len(x)]
    return pad(values) / pad(np.ones(len(values)))


def content_nodes(page: Page) -> np.ndarray:
    """For every text node whether its path is content, by path ratios."""
    content = np.zeros(len(page.nodes), bool)
    full = [i for i, (_, _, text) in enumerate(page.nodes) if not text.isspace()]
    if not full:
        return content
    length = np.array([len(_SPACE.sub("", page.nodes[i][2])) for i in full], np.float64)
    marks = np.array([len(_MARKS.findall(page.nodes[i][2])) for i in full], np.float64)
    _, which = np.unique([page.path[page.nodes[i][0]] for i in full], return_inverse=True)
    count, weight = np.bincount(which), np.bincount(which, weights=length)
    ratio = weight / count * (1 + np.bincount(which, weights=marks) / count)
    # Smoothing lifts what stands beside long text; fused with the path's own ratio, a short line there stays low.
    score = np.sqrt(ratio * np.bincount(which, weights=smooth(ratio[which])) / count)
    # Paths at least a share of the mean over all text, and the best one, are content.
    limit = min(SHARE * float((score * weight).sum() / max(weight.sum(), 1)), float(score.max()))
    content[full] = (score >= limit)[which]
    return content


def article_nodes(page: Page, content: np.ndarray) -> list[int]:
    """Numbers of the text nodes of the article, in page order."""
    chosen = np.flatnonzero(content).tolist()
    if not chosen:
        return []
    size = {i: len(page.nodes[i][2]) for i in chosen}
    whole = sum(size.values())
    own = {page.article[page.nodes[i][0]] for i in chosen} - {0}
    if 2 * sum(n for i, n in size.items() if page.article[page.nodes[i][0]]) >= whole:
        inside = [e in own for e in range(len(page.tag))]
        for e in range(1, len(inside)):  # an element comes after the one above it
            inside[e] = inside[e] or inside[page.above[e]]
        return [i for i, (e, _, _) in enumerate(page.nodes) if inside[e]]
    held = [0] * len(page.tag)
    for i, n in size.items():
        held[page.nodes[i][0]] += n
    for e in range(len(held) - 1, 0, -1):
        held[page.above[e]] += held[e]
    root = lowest = 0
    for e in range(1, len(held)):
        if page.above[e] == lowest and held[e] >= HELD * whole:
            lowest = e
            root = e if page.tag[e] in SECTIONS else root
    inside = [e == root for e in range(len(page.tag))]
    for e in range(1, len(inside)):
        inside[e] = inside[e] or inside[page.above[e]]
    under = [i for i, (e, _, _) in enumerate(page.nodes) if inside[e]]
    # Runs of text by number: their nodes, kind of block, and text in and outside links.
    runs: dict[int, list[int]] = {}
    for i in under:
        runs.setdefault(page.nodes[i][1], []).append(i)
    kept = [some for some in runs.values() if any(not page.nodes[i][2].isspace() for i in some)]
    if not kept:
        return []
    full = [any(content[i] for i in some) for some in kept]
    first, last = full.index(True), len(full) - 1 - full[::-1].index(True)

    def fits(some: list[int], kinds: frozenset) -> bool:
        e = next(page.nodes[i][0] for i in some if not page.nodes[i][2].isspace())
        linked = sum(len(page.nodes[i][2]) for i in some if page.link[page.nodes[i][0]])
        return page.tag[page.block[e]] in kinds and linked <= LINKS * sum(len(page.nodes[i][2]) for i in some)

    while first and fits(kept[first - 1], BEFORE):
        first -= 1
    end = last
    while end + 1 < len(kept) and fits(kept[end + 1], AFTER):
        end += 1
    while end > last and page.tag[page.block[page.nodes[kept[end][0]][0]]] in HEADINGS:
        end -= 1
    return [i for some in kept[first : end + 1] for i in some]


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    found = parse(page)
    out: dict[int, list[str]] = {}
    for i in article_nodes(found, content_nodes(found)):
        _, run, text = found.nodes[i]
        out.setdefault(run, []).append(text)
    lines = (_SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in out.values())
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html); one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
