"""HTML extraction by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf tag path.  Per path
the text length and the punctuation are summed and divided by the number of
blocks on the path; both ratios are smoothed over the page's blocks and fused, and a
path whose blocks reach a threshold on average (a share of the fused values' spread) is
content.  The text is made of the blocks on content paths, of what lies between
them, and of headings and paragraphs with punctuation that lead up to the first one.  Elements that are boilerplate by their tag,
or by a class, id or role word, are left out in any case, and so are blocks of links and
nothing else (menus without a name) unless their path is content.  In article and main
elements a path needs only `inside` of the threshold, which breaks ties on pages of little text.

Nulls and empty pages give an empty text; markup without any element is text.
Repeated rows are extracted once each.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Element names of HTML, and words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
# What is no part of an article: menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg math head title button select textarea menu dialog object canvas".split())
BOILERPLATE_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising menu menus nav navbar navigation header footer sidebar notice notices cookie cookies form forms comment comments".split())
CLOSES_P = BLOCK - frozenset("br button option select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

#: Share of the fused values' spread that a path's average must reach, and of that in article and main elements.
THRESHOLD, INSIDE = 0.5, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>\x00]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)", re.S)
_NAMES = re.compile(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    path: str
    boiler: bool
    article: bool  # in an article or main element


@dataclass
class Block:
    node: int
    pieces: list[str] = field(default_factory=list)
    links_only: bool = True


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Element nodes, and text blocks in page order; raw elements keep no text."""
    nodes = [Node("", "", False, False)]
    stack = [0]
    blocks: list[Block] = []
    open_block: Block | None = None
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        tok, at = m[0], m.end()
        if tok[0] != "<" or tok == "<":
            if open_block is None:
                open_block = Block(next((i for i in reversed(stack) if nodes[i].tag not in INLINE), 0))
                blocks.append(open_block)
            open_block.pieces.append(_html.unescape(tok))
            if open_block.links_only and not tok.isspace():
                open_block.links_only = _linked(nodes, stack)
            continue
        t = _TAG.match(tok)
        if t is None:
            continue
        tag = t[2].lower()
        if t[1]:
            where = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag), 0)
            if where and not (tag in INLINE and any(nodes[i].tag not in INLINE for i in stack[where + 1 :])):
                del stack[where:]
            if tag in BLOCK:
                open_block = None
            continue
        if tag in BLOCK:
            open_block = None
        if tag in VOID:
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            if tok[-2:] != "/>" or tag not in ("svg", "math"):
                at = page.find(">", stop.start()) + 1 or end
            continue
        if tag in CLOSES_P:
            where = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag not in INLINE), 0)
            if where and (nodes[stack[where]].tag == "p" or (tag == nodes[stack[where]].tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                del stack[where:]
        names = {w for x in _NAMES.findall(tok) for w in re.split(r"[^a-z]+", x.lower()) if w} if "=" in tok else set()
        up = nodes[stack[-1]]
        label = tag + "".join(f".{w}" for w in sorted(names))
        boiler = tag in BOILERPLATE or (tag not in ("html", "body", "main", "article") and bool(names & BOILERPLATE_NAMES))
        nodes.append(Node(tag, f"{up.path}/{label}", up.boiler or boiler, up.article or tag in ("article", "main")))
        stack.append(len(nodes) - 1)
    return nodes, blocks


def _linked(nodes: list[Node], stack: list[int]) -> bool:
    for i in reversed(stack):
        if nodes[i].tag not in INLINE:
            return False
        if nodes[i].tag == "a":
            return True
    return False


def smoothed(values: np.ndarray, sigma: float = 1.0, reach: int = 2) -> np.ndarray:
    """Gaussian average of each value and up to reach neighbours on either side."""
    total, weight = values.astype(float).copy(), np.ones(len(values))
    for d in range(1, min(reach, len(values) - 1) + 1):
        w = np.exp(-(d**2) / (2 * sigma**2))
        total[d:] += w * values[:-d]
        total[:-d] += w * values[d:]
        weight[d:] += w
        weight[:-d] += w
    return total / weight


def path_scores(paths: list[str], lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Fused, smoothed ratio of each block, in page order."""
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    which = np.array([number[p] for p in paths])
    blocks = np.bincount(which)
    text_ratio = (np.bincount(which, lengths) / blocks)[which]
    mark_ratio = (np.bincount(which, marks) / blocks)[which]
    return smoothed(text_ratio) * (1.0 + smoothed(mark_ratio))


def content_paths(paths: list[str], fused: np.ndarray, favoured: np.ndarray, sizes: np.ndarray, threshold: float, inside: float) -> np.ndarray:
    """Whether each block is on a content path: one whose average reaches the threshold's share of the spread.

    Beside article elements with content, a path must reach it without its neighbours, too.
    """
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    which = np.array([number[p] for p in paths])
    score, least = np.bincount(which, fused) / np.bincount(which), threshold * fused.std()
    good = score[which] >= least * np.where(favoured, inside, 1.0)
    if (good & favoured).any():
        own = np.bincount(which, sizes) / np.bincount(which)
        good &= favoured | (own[which] >= least)
    return good


def extract(page: str | None, threshold: float = THRESHOLD, inside: float = INSIDE) -> str:
    """The main text of a page: blocks joined by one newline, empty if there is none."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    found = [(nodes[b.node], " ".join("".join(b.pieces).split()), b.links_only) for b in blocks]
    found = [x for x in found if x[1]]
    if not found:
        return ""
    paths = [n.path for n, _, _ in found]
    lengths, marks = np.array([len(t) for _, t, _ in found], float), np.array([len(_PUNCT.findall(t)) for _, t, _ in found], float)
    fused = path_scores(paths, lengths, marks)
    content = content_paths(paths, fused, np.array([n.article for n, _, _ in found]), lengths * (1.0 + marks), threshold, inside)
    content &= ~np.array([n.boiler for n, _, _ in found])
    at = np.flatnonzero(content)
    if not len(at):
        return ""
    kept: list[str] = []
    after = False  # whether the block after this one is kept
    for i in range(int(at[-1]), -1, -1):
        node, text, links_only = found[i]
        leads = after and (node.tag in HEADINGS or (node.tag == "p" and not links_only and _PUNCT.search(text) is not None))
        after = not node.boiler and (bool(content[i]) or (i > at[0] and not links_only) or leads)
        if after:
            kept.append(text)
    return "\n".join(reversed(kept))


def extract_pages(pages: DataFrame, threshold: float = THRESHOLD, inside: float = INSIDE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(None if h is None else str(h), threshold, inside) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
