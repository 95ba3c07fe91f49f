"""Main text of web pages by tag-path ratios.

A page is read into blocks: text between tags that aren't inline, each at the end of a path of elements from the root. Every
tag path gets two ratios, text per block and sentence marks per block; both are smoothed over the page's blocks, fused, and
lowered for every element on the path whose class, id or role says that it is something beside the text. Paths whose fused
ratio reaches a share of the page's highest are content. The elements that hold the content then give their other blocks
too (headings, short lines), unless those lie in an element that is marked as an aside.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import table

# Elements that never hold main text, words in class names of what isn't main text, and kinds of elements.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript", "template", "head", "title", "button", "select", "textarea", "iframe", "svg", "dialog", "menu", "object", "canvas", "option", "label", "fieldset"}
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "comment", "comments", "reply", "replies", "disqus", "cookie", "cookies", "consent", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar", "copyright", "disclaimer", "alert"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words that make a class name speak of a page's layout or state, as in no-sidebar, has-comments, search-result.
LAYOUT_WORDS = {"no", "not", "non", "has", "have", "with", "without", "hide", "hides", "hidden", "show", "is", "result", "results"}
#: Words that only tell an element's place, shape or kind, so that a name made of them and aside words alone is sure, as in comment-list.
PART_WORDS = {"area", "bar", "block", "body", "bottom", "box", "boxes", "button", "buttons", "col", "column", "container", "content", "dropdown", "form", "frame", "group", "header", "holder", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "lists", "main", "message", "mobile", "outer", "panel", "policy", "posts", "primary", "respond", "right", "row", "secondary", "section", "site", "slot", "sticky", "stories", "text", "thread", "title", "top", "tools", "unit", "wrap", "wrapper", "zone"}
#: Elements that hold running text, which a form around a whole page has and a form to fill in hasn't.
TEXT_TAGS = {"p", "article", "main"}
RAW_TAGS = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE_TAGS = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ITEMS = {"li", "dt", "dd", "tr", "td", "th", "option"}
HOLDERS = {"article", "main", "section", "div", "form", "body", "html", ""}
#: Share of the highest fused ratio that a content path has; share of the content that the element around it holds.
SHARE, HELD = 0.5, 0.9
#: Fused ratios are multiplied by this for every marked element on the path.
LOWERED = 0.1
#: Characters, and sentence marks, of a block at which its ratio is half of what it can be.
HALF_SIZE, HALF_MARKS = 150.0, 4.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…、。，！？；：¿¡\"'«»()-]")


def _marked(attrs: str) -> int:
    """Whether an element's class, id or role names something beside the main text: 2 surely, 1 if the name has other words too."""
    found = 0
    for name, *value in _ATTR.findall(attrs) if "=" in attrs else ():
        for token in "".join(value).split():
            words = {w.lower() for w in _WORDS.findall(token)}
            if name.lower() == "role":
                if token.lower() in ASIDE_ROLES:
                    return 2
            elif words & ASIDE_WORDS and not words & LAYOUT_WORDS:
                if words <= ASIDE_WORDS | PART_WORDS:
                    return 2
                found = 1
    return found


class Page:
    """Elements and blocks of a page, read once from start to end; unclosed and stray tags do no harm.

    Element 0 stands above the root. `parent`, `tag`, `marks` (marked elements from the root), `shut` (whether in an element
    that never holds main text) and `path` (number of the tag path) are given for each element; blocks are (text, element).

    An element whose name only may speak of an aside isn't marked if it holds more than half of the text that no sure mark
    takes away. A form's blocks count only if the form holds nearly all of that text, half of it or more in TEXT_TAGS.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.own_mark, self.shut = [0], [""], [0], [False]
        self.blocks: list[tuple[str, int]] = []
        self._read(page)
        holds_main = [t == "main" for t in self.tag]
        for e in range(len(self.tag) - 1, 0, -1):
            holds_main[self.parent[e]] |= holds_main[e]
        mark = [0 if m or t in ("html", "body") else k for k, m, t in zip(self.own_mark, holds_main, self.tag, strict=True)]
        if "form" in self.tag:
            self._leave_forms(mark)
        held = self._held(mark)
        self.marks, self.path, known = [0], [0], {}
        for e in range(1, len(self.tag)):
            marked = mark[e] == 2 or mark[e] == 1 and 2 * held[e] <= held[0]
            self.marks.append(self.marks[self.parent[e]] + marked)
            self.path.append(known.setdefault((self.path[self.parent[e]], self.tag[e], marked), len(known) + 1))

    def _held(self, mark: list[int], within: list[bool] | None = None) -> list[int]:
        """Characters of the blocks in every element, those in surely marked elements left out; with `within`, only of blocks in such elements."""
        sure = [False] * len(self.tag)
        held = [0] * len(self.tag)
        for e in range(1, len(self.tag)):
            sure[e] = sure[self.parent[e]] or mark[e] == 2
        for text, e in self.blocks:
            if not sure[e] and (within is None or within[e]):
                held[e] += len(text)
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        return held

    def _leave_forms(self, mark: list[int]) -> None:
        """Takes away the blocks of forms to fill in."""
        form, running = [0] * len(self.tag), [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            up = self.parent[e]
            form[e] = form[up] or (e if self.tag[e] == "form" else 0)
            running[e] = running[up] or self.tag[e] in TEXT_TAGS
        held, told = self._held(mark), self._held(mark, running)
        stays = {f: f == 0 or (mark[f] != 2 and held[f] >= HELD * held[0] and 2 * told[f] >= held[f]) for f in set(form)}
        self.blocks = [(text, e) for text, e in self.blocks if stays[form[e]]]

    def _read(self, page: str) -> None:
        parent, tag_of, shut = self.parent, self.tag, self.shut
        open_count: Counter[str] = Counter()
        stack, text, at = [0], [], 0

        def flush() -> None:
            if text:
                words = " ".join("".join(text).split())
                text.clear()
                if words:
                    self.blocks.append((words, stack[-1]))

        def pop() -> None:
            open_count[tag_of[stack.pop()]] -= 1

        while at < len(page):
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at and not shut[stack[-1]]:
                piece = page[at:end]
                text.append(html.unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in INLINE_TAGS and (m[1] and tag_of[stack[-1]] != tag or not m[1] and not _marked(m[3])):
                continue
            if tag == "br":
                text.append(" ")
                continue
            flush()
            if tag in VOID_TAGS:
                continue
            if m[1]:
                while open_count[tag]:
                    found = tag_of[stack[-1]] == tag
                    pop()
                    if found:
                        break
                continue
            if tag == "body":
                while len(stack) > 1 and tag_of[stack[-1]] != "html":
                    pop()
            if tag in CLOSES_P and tag_of[stack[-1]] == "p":
                pop()
            if tag in ITEMS:
                while tag_of[stack[-1]] in (tag, "p"):
                    pop()
            if tag in RAW_TAGS:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            if m[3].endswith("/>"):
                continue
            up = stack[-1]
            title = tag in HEADINGS and shut[up] and tag_of[up] == "header" and not shut[parent[up]] and self._in_article(up)
            parent.append(up)
            tag_of.append(tag)
            self.own_mark.append(_marked(m[3]))
            shut.append((shut[up] or tag in ASIDE_TAGS) and not title)
            stack.append(len(tag_of) - 1)
            open_count[tag] += 1
        flush()

    def _in_article(self, e: int) -> bool:
        return self.tag[self.parent[e]] in ("article", "main", "section")


def path_scores(page: Page) -> np.ndarray:
    """Fused ratio of every block's tag path.

    Text and sentence marks per block of a path, each as x / (x + half) so that one huge block doesn't outweigh all others,
    are smoothed over neighbouring blocks and multiplied; a path's score is the mean over its text, lowered for its marks.
    """
    of = np.array([page.path[e] for _, e in page.blocks])
    marks = np.array([page.marks[e] for _, e in page.blocks], float)
    size = np.array([len(t) for t, _ in page.blocks], float)
    signs = np.array([len(_MARKS.findall(t)) for t, _ in page.blocks], float)
    count = np.maximum(np.bincount(of), 1)
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")
    per = lambda x, half: ((r := np.bincount(of, x) / count) / (r + half))[of]
    fused = np.sqrt(smooth(per(size, HALF_SIZE)) * smooth(per(signs + 1, HALF_MARKS)))
    return (np.bincount(of, fused * size) / np.maximum(np.bincount(of, size), 1))[of] * LOWERED**marks


def chosen(page: Page, share: float = SHARE) -> np.ndarray:
    """Whether each block is main text."""
    score = path_scores(page)
    content = score >= share * score.max()
    at = np.array([e for _, e in page.blocks])
    held = np.zeros(len(page.tag))
    np.add.at(held, at[content], [len(t) for (t, _), c in zip(page.blocks, content, strict=True) if c])
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    core = int(np.flatnonzero(held >= HELD * held[0])[-1])  # the innermost element around nearly all of the content
    holder = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        holder[e] = e if page.tag[e] in HOLDERS else holder[page.parent[e]]
    wide = ("", "html", "body")
    tops = {holder[core]}
    if page.tag[holder[core]] in wide:
        tops = {holder[e] for e in set(at[content].tolist())}
    tops = {e for e in tops if page.tag[e] not in wide}
    allowed = np.full(len(page.tag), -1)  # marks that an element in one of the tops may have
    for e in range(1, len(page.tag)):
        allowed[e] = max(allowed[page.parent[e]], page.marks[e] if e in tops else -1)
    keep = content | (np.array([page.marks[e] for e in at]) <= allowed[at])
    for k in np.flatnonzero(~keep[:-1] & keep[1:])[::-1]:  # headings right before what is kept
        while k >= 0 and not keep[k] and page.tag[at[k]] in HEADINGS and page.marks[at[k]] <= page.marks[at[k + 1]]:
            keep[k] = True
            k -= 1
    return keep


def main_text(page: str | None, share: float = SHARE) -> str:
    """Blocks of the main text, in page order, joined by one space."""
    read = Page(page or "")
    return " ".join(t for (t, _), k in zip(read.blocks, chosen(read, share), strict=True) if k) if read.blocks else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html; others are ignored).

    Null or empty html gives an empty text, as does a page whose text all stands in elements that never hold main text. Null
    ids and urls and repeated rows stay; an empty table gives no rows. Of paths with equal ratios all are taken or none. A
    page is worked on alone, in time linear in its length; nothing is shuffled.
    """

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    got = pages.select("page_id", "url", text(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
