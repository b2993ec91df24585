"""HTML extraction by the distribution of text over line blocks.

A page is read once, tag by tag. Scripts, styles, menus, page headers and footers, sidebars, notices, adverts, forms and reader
comments (known by element, role or class) go with everything inside them. What is left are lines, one per block of text, and empty
lines where a container starts or ends; a removed region leaves a whole window of empty lines, so no window sees both sides.

The length of a line is its number of characters outside links. ``block(i)`` is the sum over ``WINDOW`` lines from line ``i``.
Text *surges* at the first line of a stretch with ``block(i) >= SURGE`` and *dives* at the last line before a window
without text; the lines between the two are the main text. Where a page marks its article (``article``, ``main`` or the role
``main``), only lines inside count, and each of them is long enough for a surge of its own, so short ones stay. If nothing
surges, the stretch with the most text is the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import prepare

WINDOW = 3
SURGE = 80

# Names of the HTML standard, and words that sites use in classes and ids of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
                  "summary table tbody td tfoot th thead tr ul br".split())
CONTAINER = frozenset("article aside blockquote body center details div dl fieldset figure footer form header main nav ol section "
                      "table td ul".split())
CLOSES_P = BLOCK - frozenset("br td th tr tbody thead tfoot option optgroup legend body html summary figcaption".split()) | {"figcaption", "summary"}
REMOVED = frozenset("head nav aside footer form menu dialog button select datalist svg math canvas audio video object template "
                    "search fieldset".split()) | (RAW - {"xmp"})
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
                  "consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification "
                  "overlay pager pagination popup promo promotion recommended related respond share sharebar sharing sidebar signup skip "
                  "social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
#: Header and masthead are the page's where they stand outside the article.
OUTSIDE = frozenset("header masthead".split())
NEGATED = frozenset("has with no not without".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}
#: Elements whose content starts afresh for the implied ends above.
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "option": ("select", "datalist")}

_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _marks(rest: str) -> tuple[dict[str, str], list[list[str]]]:
    """Attributes of a tag, and the parts of each name in its class and id."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    return found, [[p.lower() for p in re.split(r"[-_:]+|\s", _CAMEL.sub("-", n)) if p] for n in names]


def _boilerplate(name: str, rest: str, inside: bool, by_class: bool) -> bool:
    """Does this element, with all it holds, stand outside the main text?"""
    if name in REMOVED or (name == "header" and not inside):
        return True
    if not rest.strip():
        return False
    found, names = _marks(rest)
    if found.get("role", "").lower() in ROLES or "hidden" in found or _HIDDEN.search(found.get("style", "")):
        return name not in ("html", "body")
    if not by_class or name in ("html", "body", "main"):
        return False
    words = WORDS if inside else WORDS | OUTSIDE
    return any(parts and (parts[0] in words or parts[-1] in words) and not NEGATED & set(parts) for parts in names)


class _Lines:
    """The lines of a page while it is read: text, characters outside links, and whether the page calls it its article."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.length: list[int] = []
        self.own: list[bool] = []
        self._pieces: list[str] = []
        self._free = 0

    def add(self, piece: str, in_link: bool) -> None:
        self._pieces.append(piece)
        if not in_link:
            self._free += len(piece) - piece.count(" ")

    def end(self, own: bool, empty: int = 0) -> None:
        if self._pieces:
            line = " ".join("".join(self._pieces).split())
            if line:
                self.text.append(line)
                self.length.append(self._free)
                self.own.append(own)
            self._pieces, self._free = [], 0
        if empty:
            self.text += [""] * empty
            self.length += [0] * empty
            self.own += [False] * empty


def lines_of(page: str, by_class: bool = True) -> _Lines:
    """The lines of a page outside boilerplate."""
    lines = _Lines()
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()
    removed = inside = links = at = 0

    def close() -> None:
        nonlocal removed, inside, links
        name, gone, own = stack.pop()
        opened[name] -= 1
        links -= name == "a"
        if gone:
            removed -= 1
            if not removed:
                lines.end(inside > 0, WINDOW)
        elif not removed and name in BLOCK:
            lines.end(inside > 0, 1 if name in CONTAINER else 0)
        inside -= own

    while at < len(page):
        tag = _TAG.search(page, at)
        piece = page[at: tag.start() if tag else len(page)]
        if piece and not removed:
            lines.add(html.unescape(piece), links > 0)
        if not tag:
            break
        at = tag.end()
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if tag["end"]:
            if opened[name]:
                if name in BLOCK:
                    while stack[-1][0] != name:
                        close()
                    close()
                else:
                    # An inline end does not close the blocks that were opened inside.
                    i = len(stack) - 1
                    while stack[i][0] not in BLOCK and stack[i][0] != name:
                        i -= 1
                    if stack[i][0] == name:
                        while len(stack) > i:
                            close()
            elif name == "p" and not removed:
                lines.end(inside > 0)
            continue
        if name in CLOSES_P and opened["p"]:
            i = len(stack) - 1
            while stack[i][0] != "p" and stack[i][0] not in ("td", "th", "button", "caption", "table"):
                i -= 1
            if stack[i][0] == "p":
                while len(stack) > i:
                    close()
        if any(opened[s] for s in SAME.get(name, ())):
            i = len(stack) - 1
            low = -1
            while i >= 0 and stack[i][0] not in HOLDS[name]:
                low = i if stack[i][0] in SAME[name] else low
                i -= 1
            while low >= 0 and len(stack) > low:
                close()
        if name in BLOCK and not removed:
            lines.end(inside > 0, 1 if name in CONTAINER else 0)
        if name in VOID:
            continue
        gone = removed > 0 or _boilerplate(name, tag["rest"], inside > 0, by_class)
        if gone and not removed:
            lines.end(inside > 0, WINDOW)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            if name == "xmp" and not gone:
                lines.add(page[at: end.start() if end else len(page)], links > 0)
            at = end.start() if end else len(page)
            if end and (close_tag := _TAG.match(page, at)):
                at = close_tag.end()
            continue
        own = not gone and (name in ("article", "main") or (tag["rest"] != "" and _marks(tag["rest"])[0].get("role", "").lower() == "main"))
        stack.append((name, gone, own))
        opened[name] += 1
        removed += gone
        inside += own
        links += name == "a"
    lines.end(inside > 0)
    return lines


def between_surge_and_dive(length: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """``(first, last + 1)`` of the lines from each surge to the dive after it."""
    n = len(length)
    sums = np.concatenate([[0], np.cumsum(length)])
    block = sums[np.minimum(np.arange(n) + window, n)] - sums[:n]
    filled = np.flatnonzero(length > 0)
    if not len(filled):
        return []
    # A window without text lies between two lines that are further apart than it is long.
    new = np.flatnonzero(np.diff(filled) > window) + 1
    first, last = filled[np.concatenate([[0], new])], filled[np.concatenate([new, [len(filled)]]) - 1] + 1
    found = []
    for low, high in zip(first.tolist(), last.tolist(), strict=True):
        over = np.flatnonzero(block[low:high] >= surge)
        if len(over):
            found.append((low + int(over[0]), high))
    if not found:
        best = int(np.argmax(sums[last] - sums[first]))
        found = [(int(first[best]), int(last[best]))]
    return found


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page, its blocks joined by one space."""
    for by_class in (True, False):
        lines = lines_of(page, by_class)
        own = np.array(lines.own, bool)
        length = np.array(lines.length, np.int64)
        if own.any():
            length = np.where(own, length + surge, 0)
        elif not length.any():
            # Link text is all there is.
            length = np.array([len(t) for t in lines.text], np.int64)
        kept = [t for low, high in between_surge_and_dive(length, window, surge) for t, inner in
                zip(lines.text[low:high], lines.own[low:high], strict=True) if t and (inner or not own.any())]
        if kept:
            return " ".join(kept)
    return ""


def extracted(page: Column | str, window: int = WINDOW, surge: int = SURGE) -> Column:
    """The main text of a column of pages; null gives an empty text."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py() or "", window, surge) for v in values], pa.string())
    return F.arrow_udf(run, "string")(F.col(page) if isinstance(page, str) else page)


def extract_text(pages: DataFrame, page: str = "html", keys: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW,
                 surge: int = SURGE) -> DataFrame:
    """``keys, text, n_chars``: the main text of every page and its code points.

    A null, empty or text-free page gives an empty text. Null keys and repeated rows have results like any other row; other
    columns are not read. An empty table gives an empty result. Pages are worked on one at a time, so memory follows the longest.
    """
    prepare(pages.sparkSession)
    plain = pages.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(page).alias("_page"))
    return (plain.withColumn("_text", extracted("_page", window, surge))
            .select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_text").alias("text"),
                    F.length("_text").cast("long").alias("n_chars")))
