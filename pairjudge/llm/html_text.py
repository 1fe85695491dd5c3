"""Main text of HTML pages by tag-path ratios.

A page is read into its text leaves. For every tag path (the element names and classes from the root
to a leaf) the text length and the punctuation of its leaves are added up and divided by the number of
leaves: two ratios per path. They are fused (geometric mean, weighted by the path's share of text
outside links), laid out over the leaves in page order, smoothed with a Gaussian window, and the
leaves over ``THRESHOLD`` standard deviations are content nodes.

Content nodes choose the container. ``article`` and ``main`` elements are a hint: those that hold some are taken if they hold at least as much
text of content nodes as there is outside; else it is the smallest element that holds ``SHARE`` of the score outside, without
such elements in it. Every block of a chosen container
is returned, but for lists of links, told by their ratios, and those inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, known by element name, role or class. So a short heading or
last line of the article stays although its own path has a small ratio.

Character references are decoded, white space inside a block (``br`` included) becomes one space,
blocks are joined by a line feed.

Defined results: a null or empty page has the empty text; a page without content nodes too, unless it
has a single ``article`` or ``main``; unclosed elements, comments and scripts end with the page;
repeated rows are extracted each. Work is linear in the page, which is never cut; only page_id, url and html are read, so other columns may
have any names.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.llm.common import out_batch, slices, strings

#: Content nodes score over this many standard deviations.
THRESHOLD = 0.5
#: Share of the content nodes' score that their container holds.
SHARE = 0.9
#: Gaussian weights of a leaf and its neighbours at distance 1 and 2.
WINDOW = (0.4026, 0.2442, 0.0545)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PUNCTUATION = re.compile(r"""[.,;:!?…。，；：！？、]""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr""".split())
#: An opening tag closes these open elements, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
HOLDS_P = frozenset("article aside blockquote body button caption dd details div dl fieldset figure footer form header li main nav object section table td th ul ol".split())
BOILERPLATE = frozenset("head nav menu header footer aside form script style noscript template iframe object svg button select textarea dialog title".split())
#: Words of a class, id or role that mark an element as boilerplate.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent
    gdpr notice notices alert popup modal overlay sidebar complementary menu nav navbar navigation navigational breadcrumb breadcrumbs header masthead
    footer contentinfo comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter
    subscribe subscription signup login search toolbar pagination pager widget copyright disclaimer form""".split())
CONTAINERS = frozenset({"article", "main"})


class Element:
    """``path`` numbers the tag path; equal paths of a page have equal numbers."""

    __slots__ = ("name", "path", "parent", "marked", "holds_article", "depth", "hidden", "container")

    def __init__(self, name: str, path: int, parent: Element | None, marked: bool):
        self.name, self.path, self.parent, self.marked = name, path, parent, marked
        self.holds_article = self.hidden = False
        self.depth = parent.depth + 1 if parent else 0
        self.container = self if name in CONTAINERS else parent.container if parent else None


class Leaf:
    __slots__ = ("element", "text", "block", "linked")

    def __init__(self, element: Element, text: str, block: int, linked: bool):
        self.element, self.text, self.block, self.linked = element, text, block, linked


def leaves(page: str) -> tuple[list[Leaf], list[Element]]:
    """Text leaves in page order, with the number of the block that each is part of; all elements,
    parents before children."""
    root = Element("", 0, None, False)
    stack, out, block, links, at = [root], [], 0, 0, 0
    elements, paths, opened = [root], {}, Counter()

    def close(i: int) -> None:
        nonlocal links
        for e in stack[i:]:
            opened[e.name] -= 1
            links -= e.name == "a"
        del stack[i:]

    while True:
        tag = _TAG.search(page, at)
        text = page[at:tag.start() if tag else len(page)]
        if text:
            out.append(Leaf(stack[-1], html.unescape(text), block, links > 0))
        if tag is None:
            return out, elements
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            block += 1
        elif name == "br":
            out.append(Leaf(stack[-1], " ", block, links > 0))
        if tag[1]:
            if opened[name] > 0:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                close(i)
            continue
        if name in VOID:
            continue
        closing, until = CLOSES.get(name, (None, None))
        if closing is None and name not in INLINE:
            closing, until = {"p"}, HOLDS_P
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closing:
                    close(i)
                    if closing == {"p"} or name in ("li", "option"):
                        break
                    if i <= 1 or stack[-1].name not in closing:
                        break
                elif stack[i].name in until:
                    break
        marks = [w for found in _ATTRIBUTE.findall(tag[3] or "") for w in _WORD.findall("".join(found))]
        marked = name in BOILERPLATE or (name not in ("html", "body", "article", "main") and not MARKS.isdisjoint(w.lower() for w in marks))
        step = (stack[-1].path, name, *sorted(set(marks)))
        element = Element(name, paths.setdefault(step, len(paths) + 1), stack[-1], marked)
        elements.append(element)
        if name in CONTAINERS or name == "h1":
            for e in reversed(stack):
                if e.holds_article:
                    break
                e.holds_article = True
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = _TAG.search(page, at).end()
            continue
        if not (tag[3] or "").endswith("/") or name not in INLINE:
            stack.append(element)
            opened[name] += 1
            links += name == "a"


def hide(elements: list[Element]) -> None:
    """Mark what is inside boilerplate. Neither its class nor being a header hides an element that holds
    an ``article``, a ``main`` or an ``h1``."""
    for e in elements:
        own = e.marked and not (e.holds_article and e.name not in BOILERPLATE - {"header"})
        e.hidden = own or (e.parent is not None and e.parent.hidden)


def scores(found: list[Leaf]) -> np.ndarray:
    """Smoothed fused tag-path ratio of each leaf."""
    length, punctuation, number, plain = {}, {}, {}, {}
    for leaf in found:
        path, n = leaf.element.path, len(leaf.text)
        length[path] = length.get(path, 0) + n
        punctuation[path] = punctuation.get(path, 0) + len(_PUNCTUATION.findall(leaf.text))
        number[path] = number.get(path, 0) + 1
        plain[path] = plain.get(path, 0) + (0 if leaf.linked else n)
    fused = {p: np.sqrt(length[p] / number[p] * (punctuation[p] / number[p])) * plain[p] / length[p] for p in length}
    raw = np.array([fused[leaf.element.path] for leaf in found])
    out = WINDOW[0] * raw
    for d in (1, 2):
        if len(raw) > d:
            out[d:] += WINDOW[d] * raw[:-d]
            out[:-d] += WINDOW[d] * raw[d:]
    return out


def main_text(page: str | None) -> str:
    everything, elements = leaves(page or "")
    hide(elements)
    shown = [leaf for leaf in everything if not leaf.element.hidden]
    found = [leaf for leaf in shown if leaf.text.strip()]
    if not found:
        return ""
    score = scores(found)
    content = score > THRESHOLD * score.std()
    holders = [leaf.element.container for leaf in found]
    inside, outside = (sum(len(leaf.text) for leaf, h, ok in zip(found, holders, content) if ok and bool(h) == held) for held in (True, False))
    if any(holders) and inside >= outside:  # elements are a hint: taken if most content nodes are in them
        found, holders = zip(*((leaf, h) for leaf, h in zip(found, holders) if h))
        score = scores(found)
        content = score > THRESHOLD * score.std()
        chosen, barred = {c for c, ok in zip(holders, content) if ok} or ({holders[0]} if len(set(holders)) == 1 else set()), set()
    elif content.any():
        weights = np.where(content & np.array([h is None for h in holders]), score, 0.0)
        chosen, barred = {_smallest([leaf.element for leaf in found], weights)}, {h for h in holders if h}
    else:
        return ""
    within: set[Element] = set()
    for e in elements:
        if e in chosen or e.parent in within and e not in barred:
            within.add(e)
    lists = _link_lists([(leaf, ok) for leaf, ok in zip(found, content) if leaf.element in within])
    blocks: dict[int, list[str]] = {}
    for leaf in shown:
        if leaf.element in within and leaf.block not in lists:
            blocks.setdefault(leaf.block, []).append(leaf.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _link_lists(found: list[tuple[Leaf, bool]]) -> set[int]:
    """Blocks of linked text whose path has several such leaves, little else, and a ratio under the threshold: lists of links
    and tags, wherever they stand."""
    linked, length, several, content = Counter(), Counter(), Counter(), set()
    for leaf, ok in found:
        n = len(leaf.text.strip())
        length[leaf.block] += n
        linked[leaf.block] += n if leaf.linked else 0
        if leaf.linked:
            several[leaf.element.path] += 1
        if ok and not leaf.linked:
            content.add(leaf.block)
    return {leaf.block for leaf, ok in found if leaf.linked and several[leaf.element.path] > 2 and leaf.block not in content
            and 2 * linked[leaf.block] > length[leaf.block]}


def _smallest(elements: list[Element], weights: np.ndarray) -> Element:
    """The deepest element that is above leaves with ``SHARE`` of the weight."""
    held: dict[Element, float] = {}
    for element, weight in zip(elements, weights.tolist()):
        held[element] = held.get(element, 0.0) + weight
    for element in sorted(_closed(held), key=lambda e: -e.depth):  # children before parents
        if element.parent is not None:
            held[element.parent] = held.get(element.parent, 0.0) + held.get(element, 0.0)
    total = weights.sum()
    best = max((e for e, w in held.items() if w >= SHARE * total), key=lambda e: e.depth)
    while best.name in INLINE | {"p"} and best.parent is not None:  # a paragraph's neighbours belong to it
        best = best.parent
    return best


def _closed(elements) -> set[Element]:
    out: set[Element] = set()
    for e in elements:
        while e is not None and e not in out:
            out.add(e)
            e = e.parent
    return out


TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def task(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in strings(batch.column("html"))]
            yield out_batch(TEXTS, {"page_id": strings(batch.column("page_id")), "url": strings(batch.column("url")),
                                    "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(task, TEXTS)
