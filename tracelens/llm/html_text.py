"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, with the open elements around them. A linear
classifier over a block's own features (semantic elements, words of class, id and role, link density, length) gives a
cost in each direction, which become the capacities from the source (content) and to the sink (boilerplate).
Neighbours on the page and neighbours below the same parent are joined by smoothness edges, stronger the deeper their
common parent. A maximum flow gives the minimum cut, and the source side is the content. So a short paragraph among
paragraphs of an article stays, and a long notice inside a menu goes.

The words of a name are weighed together: a word counts in full where it is the name ("sidebar", "main-nav"), little
beside words of another subject ("market-share", "how-to-login"), and not at all in a state ("no-sidebar",
"comments-enabled"). What an element's marks say against it doesn't count if it is a wrapper, that is if it holds the
page's headline, an article or main element and half of the page's running text, or is a form with half of that text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page
order. Null and empty pages have an empty text; pages of any length and depth are read whole, broken markup too
(unclosed elements end with their parents, elements without readable content also at the next block; stray end tags
count for nothing). Repeated rows give equal rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element kinds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
#: Elements whose content isn't text of the page.
RAW_TAGS = frozenset("script style noscript template iframe textarea object audio video canvas noembed noframes xmp annotation annotation-xml".split())
#: Start tags that end an open drawing.
BREAKOUT = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
#: Opening one of these ends an open one of the same group.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK_TAGS - {"body", "button", "caption", "html", "head", "legend", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
SCOPES = frozenset("html body table td th ul ol dl article aside section div main nav header footer form button select".split())

# Weights of the block classifier, in nats: above zero for content.
ELEMENT_WEIGHT = {
    "article": 3.0, "main": 2.5, "nav": -9.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "button": -8.0,
    "select": -9.0, "option": -9.0, "dialog": -8.0, "head": -30.0, "title": -30.0, "search": -8.0, "fieldset": -5.0, "label": -3.0, "header": -6.0,
}
#: An article's own header or footer.
INNER_HEADER = -1.0
WORD_WEIGHT = [
    (-9.0, "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside advert adverts advertisement "
           "ad ads adsense advertising adbox adslot sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices notification alert "
           "popup modal overlay newsletter subscribe subscription signup login share sharing social footer comment comments "
           "disqus reply replies respond related recommended recommendations trending toolbar widget copyright disclaimer masthead skip hidden"),
    (-4.0, "header topbar meta byline tags tagcloud legal terms rating ratings"),
    (2.0, "article content entry post story body text main prose maintext"),
]
WORDS = {w: x for x, ws in WORD_WEIGHT for w in ws.split()}
#: Words of a name that say nothing of its subject.
PLACES = frozenset(
    "site page left right top bottom list box wrapper wrap container area section block item items button buttons link links bar global primary "
    "secondary inner outer module component region panel pane column grid form group holder title heading header icon icons label inline fixed sticky "
    "mobile desktop small large view node field layout slot unit zone strip center row card teaser count author follow email mail media site blog home news".split()
)
#: Words that make a name a state of something else, and words of phrases.
STATES = frozenset("no non not without with has have is enabled disabled open opened closed free hide show if".split())
PHRASES = frozenset("how to the of for and in on your my our an why what when best about from".split())
#: Words that name other things as often: they count little beside words of another subject.
AMBIGUOUS = frozenset("share sharing login signup banner notice notices cookie cookies reply replies related subscription hidden skip overlay promotion respond menu legal terms text story body main post".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
ROLES = {"navigation": -9.0, "banner": -8.0, "contentinfo": -9.0, "complementary": -8.0, "search": -9.0, "alert": -8.0, "dialog": -9.0, "menu": -9.0, "form": -8.0, "main": 2.5, "article": 3.0}
#: What the marks of one element say at most; what a word says beside words of another subject (its share).
LEAST, MOST, BESIDE, HEAD = -10.0, 3.0, 0.15, 0.6
HIDDEN = -30.0
BIAS, LINK, LONG, SHORT, SENTENCE, HEADING, ITEM = 0.3, -5.0, 1.5, -0.6, 0.5, 0.3, -0.4
NEXT, SIBLING, DEEP = 0.5, 0.7, 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_BREAK = rf"<(?:{'|'.join(sorted(BREAKOUT))})\b"
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "parent", "depth", "own", "readers", "weight", "article", "link", "drawing", "dropped", "prose", "heads")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.link = bool(parent and parent.link) or tag == "a"
        self.drawing = bool(parent and parent.drawing and tag != "foreignobject") or tag == "svg"
        self.own, self.readers = ELEMENT_WEIGHT.get(tag, 0.0), False
        if parent and parent.article and tag in ("header", "footer"):
            self.own = INNER_HEADER
        self.heads = tag in ("h1", "article", "main")
        if attributes and not attributes.isspace() and tag not in ("html", "body"):
            marks, self.readers, is_main = mark_weight(attributes)
            self.own = marks if marks == HIDDEN else max(LEAST, self.own + marks) if self.own > LEAST else self.own
            self.heads = self.heads or is_main
        self.dropped = self.drawing or bool(parent and parent.dropped) or self.own == HIDDEN and tag not in BLOCK_TAGS
        self.weight, self.prose = 0.0, 0


def weigh(elements: list[Element], blocks: list[Block]) -> None:
    """The weight that each element gives its blocks. Elements stand before those they hold."""
    for b in blocks:
        b.element.prose += b.size - b.linked
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.prose += e.prose
            e.parent.heads = e.parent.heads or e.heads
    total = elements[0].prose
    for e in elements:
        own = e.own
        if HIDDEN < own < 0 and 2 * e.prose > total and (e.tag == "form" and not e.readers or e.heads and e.tag not in ("h1", "article", "main")):
            own = 0.0
        # what speaks against an element counts for all below it; what speaks for it, once
        above = e.parent.weight if e.parent else 0.0
        e.weight = min(above, 0.0) + own if own < 0 else above if above < 0 else max(above, own)


def name_weight(name: str) -> float:
    """What one class or id says: its words together."""
    parts = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
    parts = [one if w not in WORDS and (WORDS.get(one := w.removesuffix("s"), 0.0) < 0 or one in PLACES) else w for w in parts]
    found = [(i, w, WORDS[w]) for i, w in enumerate(parts) if w in WORDS]
    up = max((x for _, _, x in found if x > 0), default=0.0)
    down = [(i, w, x) for i, w, x in found if x < 0]
    if not down or len(parts) > 1 and any(w in STATES for w in parts):
        return up
    other = [w for w in parts if w not in WORDS and w not in PLACES and w.removesuffix("s") not in WORDS and (len(w) > 3 or w in PHRASES)]
    if not other:
        return min(x for _, _, x in down) + (up if len(down) == 1 else 0.0)
    # beside words of another subject: the last word is what the name means, unless it means other things as well
    phrase = any(w in PHRASES for w in parts)
    return min(x * (HEAD if i == len(parts) - 1 and w not in AMBIGUOUS and not phrase else BESIDE) for i, w, x in down) + up


def mark_weight(attributes: str) -> tuple[float, bool, bool]:
    """What an element's class, id, role and visibility say; whether they name readers' comments, or the main part."""
    names: set[str] = set()
    x, is_main = 0.0, False
    for mark, value in _MARK.findall(attributes):
        mark, value = mark.lower(), value.strip("\"'")
        if mark == "hidden" or mark == "aria-hidden" and value.lower() == "true" or mark == "style" and _HIDE.search(value):
            return HIDDEN, False, False
        if mark == "role":
            x += ROLES.get(value.lower(), 0.0)
            is_main = is_main or value.lower() in ("main", "article")
        elif mark in ("class", "id"):
            names.update(value.split())
    said = [name_weight(n) for n in names]
    x += sum(w for w in said if w < 0) + max((w for w in said if w > 0), default=0.0)
    readers = any(w in READERS for n in names for w in _SPLIT.split(_CAMEL.sub("-", n).lower()))
    return max(LEAST, min(MOST, x)), readers and x < 0, is_main


class Block:
    __slots__ = ("text", "element", "linked", "size")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked, self.size = text, element, linked, len(text)


def _raw_end(page: str, at: int, here: Element, tag: str, unclosed: set[str]) -> int:
    """Where the content of a raw element ends that began before `at`: behind its end tag, else before the end tag of an
    element that holds it or, but for scripts and styles, before the next block."""
    code = tag in ("script", "style")
    if tag not in unclosed:
        m = re.compile(rf"</{tag}\b[^>]*>" if code else rf"<(/?){tag}\b[^>]*>", re.I).search(page, at)
        if m and (code or m[1]):
            return m.end()
        if not m:
            unclosed.add(tag)
    holders = set()
    e = here
    while e.parent is not None and len(holders) < 32:
        holders.add(e.tag)
        e = e.parent
    ends = [rf"</(?:{'|'.join(map(re.escape, sorted(holders)))})\b"] if holders else []
    if not code:
        ends.append(_BREAK)
    m = re.compile("|".join(ends), re.I).search(page, at) if ends else None
    return m.start() if m else len(page)


def blocks_of(page: str) -> list[Block]:
    """A page's blocks in order, decoded, with single spaces."""
    found: list[Block] = []
    here = root = Element("#", None, "")
    elements = [root]
    parts: list[str] = []
    linked: list[str] = []
    holder = root
    unclosed: set[str] = set()  # raw elements that have no end tag further on

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, holder, min(len(text), len(" ".join(entities.unescape("".join(linked)).split())))))
        parts, linked = [], []

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if (text[0] != "<" or text == "<") and not here.dropped:
                if not parts:
                    holder = here
                parts.append(text)
                if here.link:
                    linked.append(text)
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # end tag
            e = here
            while e is not root and e.tag != tag and not (tag not in SCOPES and e.tag in SCOPES and tag not in BLOCK_TAGS):
                e = e.parent
            if e is not root and e.tag == tag:
                if tag in BLOCK_TAGS and not e.drawing:
                    flush()
                here = e.parent
            elif tag in BLOCK_TAGS:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if here.drawing:
            if tag in BREAKOUT:
                while here.drawing:
                    here = here.parent
            else:
                if not attributes.rstrip().endswith("/"):
                    here = Element(tag, here, "")
                    elements.append(here)
                continue
        if tag in RAW_TAGS:
            if not attributes.rstrip().endswith("/"):
                at = _raw_end(page, at, here, tag, unclosed)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not here.dropped:
                parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P:
                e = here
                while e is not root and e.tag not in SCOPES and e.tag != "p":
                    e = e.parent
                if e.tag == "p":
                    here = e.parent
            if tag in IMPLIED_END:
                e = here
                while e is not root and e.tag not in IMPLIED_END[tag] and e.tag not in ("ul", "ol", "dl", "table", "select", "body"):
                    e = e.parent
                if e.tag in IMPLIED_END[tag]:
                    here = e.parent
            if tag == "body":
                while here is not root and here.tag != "html":
                    here = here.parent
        if tag not in VOID_TAGS and not (tag == "svg" and attributes.rstrip().endswith("/")):
            here = Element(tag, here, attributes)
            elements.append(here)
    flush()
    weigh(elements, found)
    return found


def block_cost(b: Block) -> float:
    """Evidence for content, in nats."""
    e = b.element
    x = BIAS + e.weight + LINK * min(1.0, b.linked / b.size)
    if b.size >= 80:
        x += LONG
    elif b.size < 25:
        x += SHORT
    if b.text[-1] in ".!?…\"”":
        x += SENTENCE
    while e is not None and e.tag in ("b", "i", "em", "strong", "span", "a", "u", "small", "code"):
        e = e.parent
    if e is not None:
        x += HEADING if e.tag[:1] == "h" and e.tag[1:].isdigit() else ITEM if e.tag in ("li", "td", "th", "dt") else 0.0
    return x


def _common_depth(a: Element, b: Element) -> int:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth


def _holder(e: Element) -> Element:
    """The parent of the block element that an element belongs to."""
    while e.parent is not None and e.tag not in BLOCK_TAGS:
        e = e.parent
    return e.parent or e


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, capacity): neighbours on the page, and neighbours below one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            edges[i - 1, i] = NEXT + DEEP * min(10, _common_depth(a.element, b.element))
        at = id(_holder(b.element))
        if at in last:
            edges[last[at], i] = edges.get((last[at], i), 0.0) + SIBLING
        last[at] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut: cost > 0 is the capacity from the source, < 0 to the
    sink, edges hold both ways. Maximum flow by shortest augmenting paths in layers."""
    n = len(cost)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, c in enumerate(cost):
        if c > 0:
            add(s, i, c, 0.0)
        elif c < 0:
            add(i, t, -c, 0.0)
    for i, j, w in edges:
        add(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = min_cut([block_cost(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["rest", "text", "n_chars"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars. No shuffle."""
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(_extract, schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "text", "n_chars")
