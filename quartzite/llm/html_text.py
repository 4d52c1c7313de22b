"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of block elements (names and classes) from the root. For each block
there are two ratios, text length and punctuation, held within 0 and 1 and smoothed over its neighbours in the same
element; their means over all blocks of a path are fused to the path's own weight. Text in links counts against it, and
so do marks (menu, advert, comments and the like in a class or id). As titles, list items and short lines belong to the
article that they stand in, a path also inherits: from the element around it, the mean weight of what stands directly in
that, and ever less from elements further out. Paths of which the weight reaches a share of the page's mean (by text) are
content, and their blocks are the article. Below an <article> that has a content path all others are content too, but for
those that marks speak against: tables, captions, verses and short lines are the article's whatever their ratios are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quartzite.llm.common import row_groups, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_CLOSED = re.compile(r"(?:-->|\]\]>|</[a-zA-Z]+\s*>)\Z")
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…،؛؟。、！？；：।]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"button", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "optgroup", "html", "head", "body"}
#: What a start tag ends, up to which element.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_OTHER_TAGS = frozenset("nav aside footer form button menu dialog head fieldset".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class names and ids that mark what isn't the article, and words beside them that say nothing.
_OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation navi menu submenu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead topbar toolbar comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login share sharing social related recommended widget widgets form search skip".split()
)
_PLAIN_WORDS = frozenset("area bar block bottom box button buttons container content footer global group header holder id inner inline item items left link links list main module outer page panel right row section site small sub text the title top unit wrap wrapper".split()) - _OTHER_WORDS
#: Of the marks, those that say less of a single line or paragraph than of what holds several.
_WEAK_WORDS = frozenset("alert aside footer form login notice notices related reply respond search share sharing skip social toolbar widget widgets".split())
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre caption figcaption".split())
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text length and punctuation marks at which a block's ratios are one half; what is left of a weight for each element
#: further out; factors of a class or id that is made of marks, and of one that has a mark among other words.
HALF_TEXT, HALF_MARKS, OUTWARD, MARKED, HALF_MARKED = 60, 1, 0.6, 0.02, 0.5
#: Share of the page's mean weight that makes a path content.
SHARE = 0.25


class _Element:
    """A block element: its name, its parent, the number of its path, the factor of its marks and of those around it, and the <article> that it is in."""

    __slots__ = ("name", "parent", "path", "factor", "inside", "article")

    def __init__(self, name: str, parent: _Element | None, path: int, factor: float, inside: bool):
        self.name, self.parent, self.path, self.factor, self.inside = name, parent, path, factor, inside
        self.article: _Element | None = self if name == "article" else parent.article if parent else None


class Block:
    """A block of text: its element, its text, and the share of its letters that is in links."""

    __slots__ = ("element", "text", "links")

    def __init__(self, element: _Element, text: str, links: float):
        self.element, self.text, self.links = element, text, links


def _factor(name: str, marks: str, inside: bool) -> float:
    """What its name and marks leave of an element's weight; 0: it is no part of any article. inside: is it in an article?"""
    if name in _OTHER_TAGS or (name == "header" and not inside):
        return 0.0
    if name in ("html", "body", "main", "article") or not marks:
        return 1.0
    out = 1.0
    for m in _MARK.finditer(marks):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
            return 0.0
        if kind == "role" and value.lower() in _OTHER_ROLES:
            return 0.0
        if kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
        for part in value.split() if kind in ("class", "id") else ():
            words = {x.lower() for x in _SPLIT.split(part) if x and not x.isdigit()}
            if name in _LINES:
                words -= _WEAK_WORDS
            if words & _OTHER_WORDS:
                out = min(out, HALF_MARKED if words - _OTHER_WORDS - _PLAIN_WORDS else MARKED)
    return out


_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page that have text, in page order, with references decoded and white space made one; and the parent of each path."""
    parents, numbers = [-1], {}
    root = _Element("", None, 0, 1.0, False)
    stack, out, buffer, at = [root], [], [], 0
    open_: dict[str, int] = {}  # how often each name is on the stack
    link, linked = 0, 0  # the stack's height where a link began (0: in none), and letters in links so far

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(Block(stack[-1], text, min(1.0, linked / max(1, len(text) - text.count(" ")))))
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        buffer.append(text)
        if link:
            linked += len(text) - sum(map(str.isspace, text))

    def drop(height: int) -> None:
        nonlocal link
        for e in stack[height:]:
            open_[e.name] -= 1
        del stack[height:]
        if link > height:
            link = 0

    # where no tag can end, none begins: looking for one at every < would take time in square
    last = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if at == last and (m[1] or m[0].startswith(("<!--", "<![CDATA["))) and not _CLOSED.search(m[0]):
                at = len(page)  # it goes on to the end
            continue
        name = name.lower()
        if name == "br":
            buffer.append(" ")
        if name in _VOID and name != "hr":
            continue
        if name == "a":
            link = 0 if m[2] else len(stack)
        if m[2]:
            if open_.get(name, 0):
                flush()
                height = len(stack) - 1
                while stack[height].name != name:
                    height -= 1
                drop(height)
            elif name == "p":
                flush()
            continue
        marks, top = m[4], stack[-1]
        factor = 1.0
        if name not in _BLOCK:
            # an inline element counts only if it is marked as something else
            if not marks or marks.endswith("/") or (factor := _factor(name, marks, top.inside)) > MARKED:
                continue
        flush()
        if name == "hr":
            continue
        if name in _ENDS_P and stack[-1].name == "p":
            drop(len(stack) - 1)
        if name in _ENDS:
            ended, limit = _ENDS[name]
            if any(open_.get(x, 0) for x in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in limit:
                        break
                    if stack[k].name in ended:
                        drop(k)
                        # a row ends its cells, a table part its rows
                        if name not in ("tr", "tbody", "tfoot"):
                            break
        top = stack[-1]
        factor = min(top.factor, _factor(name, marks, top.inside))
        classes = _CLASS.search(marks) if marks else None
        path = numbers.setdefault((top.path, name, classes[1].strip("\"'").lower() if classes else "", factor), len(parents))
        if path == len(parents):
            parents.append(top.path)
        stack.append(_Element(name, top, path, factor, top.inside or name in ("article", "main")))
        open_[name] = open_.get(name, 0) + 1
    if at < len(page):
        take(page[at:].partition("<!--")[0])
    flush()
    return out, parents


def path_weights(found: list[Block], parents: list[int]) -> np.ndarray:
    """The weight of each path: its own from smoothed, fused ratios, and what it inherits."""
    n = len(parents)
    path = np.array([b.element.path for b in found])
    factor = np.array([b.element.factor for b in found])
    count = np.maximum(1, np.bincount(path, minlength=n))
    mean = lambda x: np.bincount(path, x, n) / count
    length = np.array([len(b.text) for b in found], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in found], float)
    holder = np.array([id(b.element.parent) for b in found])
    near = holder[1:] == holder[:-1]
    fused = np.ones(n)
    for x, half, least in ((length, HALF_TEXT, 0.0), (marks, HALF_MARKS, 0.5)):
        x = x / (x + half)
        left, right = (np.where(np.append(False, near), np.roll(x, 1), x), np.where(np.append(near, False), np.roll(x, -1), x))
        fused *= least + (1 - least) * mean(0.25 * left + 0.5 * x + 0.25 * right)
    free = (1 - mean(np.array([b.links for b in found]))) * mean(factor)
    own = fused * free
    # what stands directly in an element of each path: its own text, and blocks one further in
    inner = np.array(parents)[path]
    held, blocks_ = np.zeros(n), np.zeros(n)
    for p, ok in ((path, path >= 0), (inner, inner >= 0)):
        held += np.bincount(p[ok], own[path[ok]], n)
        blocks_ += np.bincount(p[ok], minlength=n)
    around = held / np.maximum(1, blocks_)
    for p in range(1, n):  # parents come before their children
        around[p] = max(around[p], OUTWARD * around[parents[p]])
    outer = np.where(np.array(parents) >= 0, around[parents], 0.0)
    return own + OUTWARD * outer * free


def chosen(found: list[Block], parents: list[int], share: float = SHARE) -> list[bool]:
    """Which blocks are content: those whose path's weight reaches `share` of the mean weight, in which each letter counts
    alike, and what stands in an <article> with them; but for headings with nothing else of the article up to the next heading."""
    if not found:
        return []
    weight = path_weights(found, parents)[[b.element.path for b in found]]
    length = np.array([len(b.text) for b in found], float)
    least = share * (weight * weight * length).sum() / max(1e-12, (weight * length).sum())
    out = (weight > 1e-9) & (weight >= least)
    articles = {id(b.element.article) for b, keep in zip(found, out, strict=True) if keep and b.element.article}
    out |= [id(b.element.article) in articles and b.element.factor > MARKED for b in found]
    after, any_kept, any_at_all = out.tolist(), False, False
    for k in range(len(found) - 1, -1, -1):
        if found[k].element.name in _HEADINGS:
            after[k] = after[k] and (any_kept or not any_at_all)
            # a heading above headings goes with them
            any_kept, any_at_all = (after[k], True) if k and found[k - 1].element.name in _HEADINGS else (False, False)
        else:
            any_kept, any_at_all = any_kept or after[k], True
    return after


def main_text(page: str | None) -> str:
    """The article of a page: content blocks in page order, joined by one line end; empty if there is none."""
    if not page:
        return ""
    found, parents = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, chosen(found, parents), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: its id, url, text (the article, empty if there is none) and n_chars (code points).

    Pages are read whole; null or empty html gives empty text; broken markup is read as far as it goes. Nothing is
    shuffled. Other columns, text and n_chars among them, are ignored.
    """
    small_batches(pages.sparkSession)
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in row_groups(batches, html_col):
            texts = [main_text(v) for v in values]
            yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars bigint")
