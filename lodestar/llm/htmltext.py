"""Main text of web pages by tag-path ratios.

A page is parsed into text blocks, each with its root-to-leaf path of tags and classes. Per
path, and per beginning of a path, text length and punctuation are aggregated over the blocks
below it; both ratios to the number of blocks are fused, smoothed along each path from the
leaf to the body, and thresholded. Paths over the threshold select the content nodes: the
article, or else the container, that one of their blocks stands in. The main text is the
blocks of those nodes; marked boilerplate goes before, and what is mostly links goes unless
its path is selected or it stands in a selected article.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
RAW = ("script", "style", "noscript", "textarea", "title", "template", "iframe", "svg", "select", "xmp", "noembed")
BOILERPLATE = frozenset("nav footer aside form button menu dialog head object canvas audio video input datalist".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset(("article", "main", "section", "div", "td", "body", "center", "#root"))
#: A start tag closes these open elements first, up to the nearest stopper.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPPERS = frozenset("ul ol dl table article main section div body #root".split())
#: Words of a class or id that mean boilerplate, and words that go with them in one name.
NAMED = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promos promotion sponsor sponsored sponsors sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice alert popup modal "
    "newsletter subscribe subscription share sharing social comment comments disqus respond replies related recommended "
    "widget login signup search pagination pager toolbar skip".split()
)
BESIDE = frozenset(
    "site page main top bottom left right inner outer primary secondary global mobile desktop box block bar slot unit area "
    "wrap wrapper container section list group items item links link posts post articles stories form button buttons icons "
    "text content title reader user blog first last fixed sticky policy to the and of js is hidden".split()
)
WORDS_OF_NAME = re.compile(r"[^\s_-]+")
#: What readers' comments are headed by.
COMMENTS = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|user)s?'?\s+)?(?:comments?|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?|replies|responses)(?:\s*\(\d+\))?\s*:?",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|</{tag}\Z", re.I) for tag in RAW}

#: The weight of each beginning of a path against the one below it.
SMOOTH = 0.5
#: The share of the best path's ratio from which a path is selected.
THRESHOLD = 0.6
#: The share of a page's text from which an element is no boilerplate by its class or id alone.
BULK = 0.5
#: How an element is marked: by its tag, role or being hidden, or only by a class or id.
SURE, NAME = 1, 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOPS = frozenset(("#root", "html", "body"))
#: What a comments heading can mark, if it is the first text in it.
HOLDERS = frozenset("section div aside ol ul details fieldset".split())


@dataclass
class Block:
    """A piece of text in the element of that number."""

    element: int
    text: str
    linked: int
    punctuation: int = field(init=False)

    def __post_init__(self) -> None:
        self.punctuation = len(PUNCTUATION.findall(self.text))

    @property
    def own(self) -> int:
        """The length of what isn't a link."""
        return len(self.text) - self.linked


@dataclass
class Page:
    """Elements in the order they begin, number 0 being the root, and text blocks.

    What an element inherits is kept with it, so no step walks up a path. ``path`` numbers
    different root-to-leaf paths of tags with their classes; ``above`` is the path one step
    shorter, where that lies below the body, else -1.
    """

    kind: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    mark: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    article: list[int] = field(default_factory=lambda: [-1])
    container: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [-1])
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)

    def add(self, tag: str, parent: int, step: str, mark: int) -> int:
        """A new element; its number."""
        n, before = len(self.kind), self.path[parent]
        path = self.numbers.setdefault((before, step), len(self.above))
        if path == len(self.above):
            self.above.append(-1 if self.kind[parent] in TOPS else before)
        self.kind.append(tag)
        self.parent.append(parent)
        self.mark.append(SURE if self.mark[parent] == SURE else mark)
        self.path.append(path)
        self.article.append(n if tag in ARTICLE else self.article[parent])
        self.container.append(n if tag in CONTAINERS else self.container[parent])
        return n

    def node(self, b: Block) -> int:
        """A block's innermost article, or else its innermost container."""
        inner = self.article[b.element]
        return inner if inner >= 0 else self.container[b.element]


def _classes(attributes: str) -> list[str]:
    value = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "") if attributes else ""
    return sorted(value.split())


def _names(value: str) -> bool:
    """Whether a class or id has a name all of whose words mean boilerplate or go with such a word."""
    for name in value.lower().split():
        parts = WORDS_OF_NAME.findall(name)
        if any(x in NAMED for x in parts) and all(x in NAMED or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _marked(tag: str, attributes: str, inside: bool) -> int:
    """Whether and how an element is marked; ``inside`` an article, headers, ids and the classes of text are not."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return SURE
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return SURE
        if name == "role" and value.lower() in ROLES:
            return SURE
        if (name == "class" or (name == "id" and not inside)) and _names(value):
            found = NAME
    return found


def parse(html_text: str) -> Page:
    """The elements and text blocks of a page, without the blocks of surely marked boilerplate."""
    page = Page()
    stack: list[int] = [0]
    open_: dict[str, int] = defaultdict(int)
    spoken: set[int] = set()  # elements that hold text
    parts: list[str] = []
    at = linked = 0
    in_link = False

    def pop() -> None:
        open_[page.kind[stack.pop()]] -= 1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            last = stack[-1]
            if text and page.mark[last] != SURE:
                holder = stack[-2] if len(stack) > 1 else 0
                if page.kind[last] in HEADINGS and holder not in spoken and page.kind[holder] in HOLDERS and COMMENTS.fullmatch(text):
                    page.mark[holder] = page.mark[last] = SURE
                else:
                    page.blocks.append(Block(last, text, min(linked, len(text))))
                    n = last
                    while n >= 0 and n not in spoken:
                        spoken.add(n)
                        n = page.parent[n]
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if in_link else 0

    while m := TOKEN.search(html_text, at):
        add(html_text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag in ("br", "wbr", "img"):
                parts.append(" ")
            continue
        flush()
        in_link = False
        if m[1]:
            if open_[tag]:
                while page.kind[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(html_text, at)
            at = end.end() if end else len(html_text)
            continue
        if page.kind[stack[-1]] == "p":
            pop()
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if page.kind[stack[depth]] in CLOSES[tag]:
                    while len(stack) > depth:
                        pop()
                    break
                if page.kind[stack[depth]] in STOPPERS:
                    break
        if page.kind[stack[-1]] == "head" and tag not in VOID:
            pop()
        if tag not in VOID and not m[3].endswith("/"):
            inside = page.article[stack[-1]] >= 0
            step = ".".join((tag, *_classes(m[3])))
            stack.append(page.add(tag, stack[-1], step, _marked(tag, m[3], inside)))
            open_[tag] += 1
    add(html_text[at:])
    flush()
    return page


def unmarked(page: Page) -> list[Block]:
    """The blocks outside elements that their class or id marks, where that mark holds.

    It doesn't for what holds the page's only articles, nor for what holds the bulk of its text
    unless an article stands elsewhere; and where all text is marked so, no mark holds.
    """
    some, n = page.blocks, len(page.kind)
    if NAME not in page.mark:
        return some
    size, ends, told = [0] * n, list(range(1, n + 1)), [False] * n
    for b in some:
        size[b.element] += b.own
        told[b.element] = True
    spoken = list(told)
    holds = [False] * n
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        size[up] += size[e]
        ends[up] = max(ends[up], ends[e])
        spoken[up] |= spoken[e]
        holds[up] |= holds[e] or (page.kind[e] in ARTICLE and spoken[e])
    marks = {e for e in range(n) if page.mark[e] == NAME and spoken[e]}
    within = {e for e in marks if page.article[page.parent[e]] >= 0}
    over = [0] * n  # marks that an element stands under
    for e in range(1, n):
        over[e] = over[page.parent[e]] + (e in marks)
    listed = [e for e in range(n) if told[e] and page.article[e] >= 0]
    free = sum(not over[e] for e in listed)
    order = sorted(marks, key=lambda e: (-size[e], e))
    for e in order:
        if holds[e] and not free:
            marks.discard(e)
            for x in listed[bisect_left(listed, e) : bisect_left(listed, ends[e])]:
                over[x] -= 1
                free += not over[x]
    bulk = BULK * size[0]
    marks -= {e for e in order if size[e] and size[e] >= bulk and (holds[e] or e in within or not free)}
    under = [False] * n
    for e in range(1, n):
        under[e] = under[page.parent[e]] or e in marks
    return [b for b in some if not under[b.element]] or some


def ratios(page: Page, some: list[Block]) -> dict[int, float]:
    """Each path's fused ratio, smoothed with those of its beginnings below the body.

    Sums go from each path to the one a step shorter once, and smoothed ratios the other way.
    """
    n = len(page.above)
    length, marks, count = [0] * n, [0] * n, [0] * n
    used = {page.path[b.element] for b in some}
    for b in some:
        path = page.path[b.element]
        length[path] += b.own
        marks[path] += b.punctuation
        count[path] += 1
    for path in range(n - 1, 0, -1):
        up = page.above[path]
        if up >= 0:
            length[up] += length[path]
            marks[up] += marks[path]
            count[up] += count[path]
    total, weight = [0.0] * n, [0.0] * n
    for path in range(n):
        if count[path]:
            up = page.above[path]
            fused = log1p(length[path] / count[path]) * (1 + log1p(marks[path] / count[path]))
            total[path] = fused + (SMOOTH * total[up] if up >= 0 else 0.0)
            weight[path] = 1 + (SMOOTH * weight[up] if up >= 0 else 0.0)
    return {path: total[path] / weight[path] for path in used}


def main_text(html_text: str | None) -> str:
    """The main text: blocks joined by one line feed; empty for a page without text.

    Paths that tie are selected alike. Where all that is selected is links, it is the text. A
    heading right before a block that stays, stays.
    """
    page = parse(html_text or "")
    some = unmarked(page)
    if not some:
        return ""
    score = ratios(page, some)
    limit = THRESHOLD * max(score.values())
    chosen = [score[page.path[b.element]] >= limit for b in some]
    links = [b.linked > len(b.text) / 2 for b in some]
    nodes = {page.node(b) for b, good, link in zip(some, chosen, links, strict=True) if good and not link}
    kept = []
    for b, good, link in zip(some, chosen, links, strict=True):
        held = page.node(b) in nodes
        kept.append(held and (good or not link or page.article[b.element] >= 0))
    if not any(kept):
        kept = chosen
    for i in range(len(some) - 2, -1, -1):
        kept[i] = kept[i] or (kept[i + 1] and page.kind[some[i].element] in HEADINGS)
    return "\n".join(b.text for b, stays in zip(some, kept, strict=True) if stays)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, url, text, n_chars`` of every page, from its whole html.

    A null or empty html, or one without text, has an empty text. White space is what
    ``str.split`` parts at. Repeated rows stay; an empty table gives an empty result.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return own.mapInArrow(extracted, f"`{id_col}` long, url string, text string, n_chars long")
