"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of block elements from the root to it. Three steps choose the blocks of the article:

1. *Ratios.* For each path, the text outside links and the punctuation of all its blocks are summed and divided by the number of its blocks.
   Both ratios, on a logarithmic scale against the page's best path, are fused into one share between 0 and 1. A path through an element that
   says it is something else (``nav``, ``footer``, ``form``, a role, a class of sidebars, adverts, notices, comments, …) has share 0.
2. *Smoothing.* A block's share is averaged with its neighbours in page order, the nearer in order and in the tree the heavier. The mean of
   a path's blocks is the path's score; paths above ``THRESHOLD`` of the best are content.
3. *Region.* The element that holds most of the content, ``article`` or ``main`` if there is one, bounds the article. Inside it, blocks
   between content blocks (headings, short paragraphs, cells) belong to it, and lists or tables after the last; in an ``article``, so does all
   that is not links or ruled out.

Pages are judged one by one, in tasks that hold about ``WORKING_BYTES`` of them at a time; nothing is shuffled.

A null or empty page has an empty text, so has a page without an article. Repeated rows are each judged for themselves; null ids and URLs
are passed on. An empty table gives no rows. Other columns, of any name, are passed on only where ``keep`` names them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm import common as C
from tallyweave.llm.html_blocks import HEADINGS, Element, Page, read_page

#: Share of the best path's score from which a path is content.
THRESHOLD = 0.5
#: Reach of the smoothing, in blocks to either side, and its width.
REACH, WIDTH = 3, 1.5
#: Share of the content's text that the region must hold.
MOST = 0.8

# Elements, roles and words of class names that say what is not the article.
NEVER = frozenset({
    "aside", "audio", "button", "canvas", "dialog", "dir", "footer", "head", "label", "legend", "menu", "nav", "noscript", "object", "optgroup", "option", "select", "svg", "template", "video",
})
ROLES = frozenset({"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "note", "search", "status", "toolbar"})
WORDS = frozenset({
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "alert", "alerts", "banner", "banners", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright",
    "disclaimer", "foot", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "notifications", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promos", "promotion", "recommended", "register", "related", "search", "share", "sharing", "sidebar", "sidebars",
    "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "teasers", "toolbar", "topbar", "widget", "widgets",
})
COMMENTS = frozenset({"comment", "commentaires", "commentlist", "comments", "comentarios", "discussion", "disqus", "feedback", "kommentar", "kommentare", "replies", "reply", "respond", "responses", "reviews"})
STEMS = ("adbox", "adcontainer", "adsby", "adslot", "adunit", "advert", "breadcrumb", "cookie", "newsletter", "sidebar", "sponsor")
COMMENT_STEMS = ("commentarea", "commentbox", "commentform", "comments", "kommentar")
#: After one of these, the words of a class name tell of something that is near, or absent.
NEAR = frozenset({"has", "is", "no", "not", "with", "without"})
COMMENT_HEADING = re.compile(
    r"\W*\d*\W*(?:reader'?s?'? |user |recent |leser)?(?:comments?|kommentare?|commentaires?|comentarios?|discussion|responses|replies|leave a (?:comment|reply))\W*\d*\W*", re.IGNORECASE
)
#: After the last content block of a region without a name, blocks of these elements still belong to it.
ENDING = frozenset({"blockquote", "dd", "dt", "figcaption", "li", "p", "pre", "td", "th"})
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def name_words(attributes: dict[str, str]) -> set[str]:
    """Words of the class and id names, without those after a word like "with"; a compound counts as its known stem."""
    found = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        for word in NAME_PART.findall(name):
            if word.lower() in NEAR:
                break
            word = word.lower()
            found.add("advert" if word.startswith(STEMS) else "comments" if word.startswith(COMMENT_STEMS) else word)
    return found


def _path_name(element: Element) -> str:
    """Tag of a leaf, tag with class and id of an element that holds others; without digits, so that numbered names are one path."""
    if element.tag in ("p", "li", "td", "th", "tr", "dt", "dd") or element.tag in HEADINGS or not element.attributes:
        return element.tag
    return element.tag + re.sub(r"\d+", "", f"#{element.attributes.get('id', '')}.{element.attributes.get('class', '')}")


class _Judged:
    """What the elements of a page are: excluded or not, their paths, and the element chosen as the article."""

    def __init__(self, page: Page) -> None:
        self.page, self.elements = page, page.elements
        self.path: list[int] = []
        self.excluded: list[bool] = []
        self._judge_elements()
        self._exclude_after_comment_headings()

    def ancestors(self, i: int) -> Iterator[int]:
        while i >= 0:
            yield i
            i = self.elements[i].parent

    def _judge_elements(self) -> None:
        hints = [name_words(e.attributes) if e.attributes else set() for e in self.elements]
        comments = [bool(h & COMMENTS) for h in hints]
        articles = [i for i, e in enumerate(self.elements) if e.tag == "article" and not hints[i] & WORDS and not any(comments[a] for a in self.ancestors(i))]
        # A wrapper whose names mention a sidebar is not a sidebar: elements around the one article, or the main part, are what they are.
        holds_main, holds_article = set(), set()
        for i, e in enumerate(self.elements):
            if e.tag == "main" or e.attributes.get("role") == "main":
                holds_main.update(self.ancestors(i))
            elif e.tag == "h1" or articles == [i]:
                holds_article.update(self.ancestors(i))
        paths: dict[tuple[int, str], int] = {}
        for i, e in enumerate(self.elements):
            inside = i > 0 and self.excluded[e.parent]
            above = self.path[e.parent] if i else -1
            self.path.append(paths.setdefault((above, _path_name(e)), len(paths)))
            named = bool(hints[i] & WORDS) or e.tag in ("form", "fieldset") or (e.attributes.get("role") or "") in ROLES
            if e.tag == "header" or "header" in hints[i]:
                # The head of an article holds its title; the head of a page does not.
                named = not any(self.elements[a].tag in ("article", "main") for a in self.ancestors(i))
                wraps = i in holds_main
            else:
                wraps = i in holds_main or i in holds_article
            if e.tag in ("html", "body", "main") or articles == [i]:
                named = False
            hidden = "hidden" in e.attributes or e.attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(e.attributes.get("style", "")))
            spoken = comments[i] and i not in holds_main and e.tag not in ("html", "body")
            self.excluded.append(inside or e.tag in NEVER or hidden or spoken or (named and not wraps))

    def _exclude_after_comment_headings(self) -> None:
        """What follows a heading "Comments" in the same element is comments."""
        out: set[int] = set()
        for block in self.page.blocks:
            e = block.element
            if self.excluded[e]:
                continue
            around = self.elements[e].parent
            if self.elements[e].tag in HEADINGS and COMMENT_HEADING.fullmatch(block.text):
                out.add(around)
            elif not out:
                continue
            if any(a in out for a in self.ancestors(e)):
                block.element = -1


def _distance(judged: _Judged, a: int, b: int) -> float:
    """How near two elements are in the tree: 1 for the same or siblings, less the further up they meet."""
    elements = judged.elements
    a, b = max(0, elements[a].parent), max(0, elements[b].parent)
    total, x, y = elements[a].depth + elements[b].depth + 2, a, b
    while x != y:
        if elements[x].depth >= elements[y].depth:
            x = elements[x].parent
        else:
            y = elements[y].parent
    return (2 * (elements[x].depth + 1) / total) ** 2


def path_scores(judged: _Judged) -> dict[int, float]:
    """Path -> smoothed share of its blocks."""
    blocks = [b for b in judged.page.blocks if b.element >= 0]
    paths = [judged.path[b.element] for b in blocks]
    sums: dict[int, list[int]] = {}
    for b, path in zip(blocks, paths, strict=True):
        if not judged.excluded[b.element]:
            total = sums.setdefault(path, [0, 0, 0])
            total[0] += 1
            total[1] += b.plain
            total[2] += b.punctuation if b.plain else 0
    text = {p: log1p(t / n) for p, (n, t, _) in sums.items()}
    marks = {p: log1p(m / n) for p, (n, _, m) in sums.items()}
    most_text, most_marks = max(text.values(), default=0.0) or 1.0, max(marks.values(), default=0.0) or 1.0
    share = {p: text[p] / most_text * (0.5 + 0.5 * marks[p] / most_marks) for p in sums}
    shares = [share.get(p, 0.0) if not judged.excluded[b.element] else 0.0 for b, p in zip(blocks, paths, strict=True)]
    found: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        if judged.excluded[b.element]:
            continue
        weights = total = 0.0
        for j in range(max(0, i - REACH), min(len(blocks), i + REACH + 1)):
            w = exp(-((i - j) ** 2) / (2 * WIDTH * WIDTH)) * _distance(judged, b.element, blocks[j].element)
            weights += w
            total += w * shares[j]
        smoothed = found.setdefault(paths[i], [0.0, 0])
        # The path's own share and its neighbourhood count alike; links alone are never content.
        smoothed[0] += (shares[i] + total / weights) / 2 if shares[i] else 0.0
        smoothed[1] += 1
    return {p: s / n for p, (s, n) in found.items()}


def _region(judged: _Judged, sizes: dict[int, int], elements: set[int]) -> tuple[int, bool]:
    """The element that holds most of the content (text by element), and whether it says that it is the article.

    A page's only ``article`` with text (``elements`` have some) is the article, however short.
    """
    only = {a for e in elements for a in judged.ancestors(e) if judged.elements[a].tag == "article"}
    outer = [a for a in only if not any(x in only for x in judged.ancestors(judged.elements[a].parent))]
    if len(outer) == 1:
        return outer[0], True
    held: dict[int, int] = {}
    for e, size in sizes.items():
        for a in judged.ancestors(e):
            held[a] = held.get(a, 0) + size
    total = held.get(0, 0)
    named = [a for a in held if judged.elements[a].tag == "article"] or [a for a in held if judged.elements[a].tag == "main" or judged.elements[a].attributes.get("role") == "main"]
    best = max(named, key=lambda a: (held[a], -judged.elements[a].depth), default=None)
    if best is not None and 2 * held[best] >= total:
        return best, True
    inside = [a for a in held if held[a] >= MOST * total]
    return max(inside, key=lambda a: judged.elements[a].depth), False


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    if not html:
        return ""
    judged = _Judged(read_page(html))
    blocks = [b for b in judged.page.blocks if b.element >= 0 and not judged.excluded[b.element]]
    scores = path_scores(judged)
    best = max(scores.values(), default=0.0)
    if not best:
        return ""
    content = [scores.get(judged.path[b.element], 0.0) >= THRESHOLD * best for b in blocks]
    sizes: dict[int, int] = {}
    for b, chosen in zip(blocks, content, strict=True):
        if chosen:
            sizes[b.element] = sizes.get(b.element, 0) + b.plain
    region, named = _region(judged, sizes, {b.element for b in blocks if b.plain})
    inside = [any(a == region for a in judged.ancestors(b.element)) for b in blocks]
    tags = [judged.elements[b.element].tag for b in blocks]
    linked = [scores.get(judged.path[b.element], 0.0) == 0 and tag not in HEADINGS for b, tag in zip(blocks, tags, strict=True)]
    if named:
        kept = [i for i in range(len(blocks)) if inside[i] and not linked[i]]
    else:
        chosen = [i for i in range(len(blocks)) if inside[i] and content[i]]
        last = chosen[-1]
        while last + 1 < len(blocks) and tags[last + 1] in ENDING:
            last += 1
        kept = [i for i in range(chosen[0], last + 1) if inside[i] and not linked[i]]
    # Titles that stand right before the first paragraph belong to it.
    first = kept[0] if kept else 0
    around = set(judged.ancestors(region))
    while first > 0 and tags[first - 1] in HEADINGS and (inside[first - 1] or (not named and judged.elements[blocks[first - 1].element].parent in around)):
        first -= 1
    return " ".join(blocks[i].text for i in [*range(first, kept[0] if kept else 0), *kept])


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns of ``keep``, text and n_chars (code points) of every page, see the module."""
    fixed = [f"keep_{i}" for i in range(len(keep))]
    given = pages.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, fixed, strict=True)), F.col(f"`{html}`").alias("html"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            columns = [*(batch.column(k) for k in fixed), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*fixed, "text", "n_chars"])

    found = given.mapInArrow(extract, schema)
    return found.select(*(F.col(k).alias(c) for k, c in zip(fixed, keep, strict=True)), "text", "n_chars")
