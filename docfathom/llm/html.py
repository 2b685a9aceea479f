"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a page's tokens, kept as a tree: elements in order, each perhaps optional, each
perhaps repeated, with texts that are constant or slots. The pages of a host are aligned one after the other with the wrapper of those
before: elements that match are merged, a text that differs becomes a slot, a mismatch that repeats what stands before or after it makes
that a repeated group, other elements that one side lacks become optional. Wrappers merge in the same way, so the work is spread
however many pages a host has.

The wrapper decides where the article is: at the part that holds the text in slots, where elements that pages themselves call article or
main count first. A page is aligned with its host's wrapper, and the article is what falls on that part; a page that has none of it is
its own wrapper. Parts that say by element or class what they are (menus, forms, adverts, comments ...) go, unless they hold the article or
over half of the page's text; ids of headings and sections say nothing. A text is never left out for being the same on other pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

# HTML's element names by role, and words in classes that name a part of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp".split())
DROPPED = frozenset(
    "script style noscript template textarea title head nav footer aside form button select option datalist input label fieldset iframe svg canvas object embed audio video map dialog menu".split()
)
#: Of those, the ones that may hold a whole page.
CONTAINERS = frozenset("form fieldset".split())
NEVER = DROPPED - CONTAINERS
BLOCK = frozenset(
    "html body p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address details summary form fieldset center hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs sidebar side aside rail footer foot header masthead topbar banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup promo promotion ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors social share sharing sharebar related recommended recommendations comment comments commentlist disqus respond reply replies responses discussion pagination pager widget widgets toolbar login search searchbox skip hidden copyright legal tags tagcloud toc".split()
)
ARTICLE_WORDS = frozenset("article post entry story content articlebody postcontent entrycontent maincontent main".split())
#: Words of classes that outweigh ARTICLE_WORDS, and those of article elements that are no article.
NEVER_ARTICLE = frozenset("comment comments reply replies related sidebar footer ad ads promo".split())
OTHER_ARTICLES = frozenset("comment comments reply replies related teaser promo sponsored ad".split())
CLOSES = {
    "p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"},
    "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Characters of a class beyond which a key has its hash.
LONG_CLASS = 60


class Node:
    """An element of a page: key (element and class without digits), words of its class and id, children (nodes and texts), and whether it holds the article or most of the page's text."""

    __slots__ = ("children", "key", "kept", "tag", "words")

    def __init__(self, tag: str, key: str, words: frozenset[str]):
        self.tag, self.key, self.words, self.children, self.kept = tag, key, words, [], False


def _marks(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    if not attributes or attributes.isspace():
        return tag, frozenset()
    words, key = set(), tag
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            words.add("hidden")
        elif name in ("class", "role", "itemprop") or name == "id" and tag != "section" and tag not in HEADINGS:  # theirs are made from headings
            words.update(w.lower() for w in _WORD.findall(value))
            words.update(w.lower().replace("-", "").replace("_", "") for w in value.split())
            if name == "class" and key == tag:
                own = re.sub("[0-9]+", "", value)
                key = f"{tag}.{own if len(own) <= LONG_CLASS else hashlib.blake2b(own.encode(errors='replace'), digest_size=12).hexdigest()}"
    return key, frozenset(words)


def parse(page: str) -> Node:
    """The page as a tree; unclosed and stray tags are mended as far as articles need it. Comments and declarations are left out."""
    root = Node("#root", "#root", frozenset())
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in BLOCK:
                    break
            continue
        while len(stack) > 1 and tag in CLOSES.get(stack[-1].tag, ()):
            stack.pop()
        if tag in BLOCK:  # an inline element left open inside a paragraph does not keep the paragraph open
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in BLOCK:
                i -= 1
            if stack[i].tag == "p" and tag in CLOSES["p"]:
                del stack[i:]
        node = Node(tag, *_marks(tag, m[3] or ""))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
        elif tag in BLOCK:  # HTML knows no self-closing elements of these kinds
            stack.append(node)
    _hold(root)
    return root


def _hold(root: Node) -> None:
    """Mark the elements that hold the article (the largest article or main element, if it has a quarter of the text) or over half of the text."""
    order, todo = [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        at = len(order)
        order.append((node, parent))
        if not (node.tag in NEVER or "hidden" in node.words):
            todo.extend((c, at) for c in node.children if not isinstance(c, str))
    sizes = [0 if n.tag in NEVER or "hidden" in n.words else sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n, _ in order]
    for i in range(len(order) - 1, 0, -1):
        sizes[order[i][1]] += sizes[i]
    own = [i for i, (n, _) in enumerate(order) if n.tag == "main" or n.tag == "article" and not n.words & OTHER_ARTICLES]
    top = max(own, key=lambda i: sizes[i], default=0)
    at = order[top][1] if 4 * sizes[top] >= sizes[0] else -1
    while at > 0:
        order[at][0].kept, at = True, order[at][1]
    for (node, _), n in zip(order, sizes, strict=True):
        node.kept = node.kept or 2 * n > sizes[0]


def dropped(node: Node, inside: bool) -> bool:
    """Whether a node is no part of an article; inside: it stands in one."""
    words = node.words
    if node.tag in NEVER or "hidden" in words:
        return True
    if node.tag == "article":
        return bool(words & OTHER_ARTICLES)
    if node.kept:
        return False
    if node.tag in CONTAINERS or node.tag == "header" and not inside:
        return True
    if node.tag in ("html", "body", "main") or not words & BOILERPLATE:
        return False
    return not words & ARTICLE_WORDS or bool(words & NEVER_ARTICLE)


def text_size(node: Node, inside: bool = False) -> int:
    """Characters that an article would keep of a node."""
    total, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                total += len(c.strip())
            elif not dropped(c, inside):
                todo.append(c)
    return total


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=6).digest(), "big")


def own_text(node: Node) -> str:
    """The text that stands directly in an element, white space folded."""
    return " ".join(" ".join(entities.unescape(c) for c in node.children if isinstance(c, str)).split())


def elements(node: Node, inside: bool) -> list[Node]:
    """The elements in a node that take part in wrappers."""
    return [c for c in node.children if not isinstance(c, str) and c.tag not in VOID and not dropped(c, inside)]


def kind_of(node: Node) -> int:
    """What a page says of an element itself: 0 an article, 1 the main part, 2 a part with an article's name, 3 nothing."""
    if node.tag == "article":
        return 0
    if node.tag == "main" or "main" in node.words and node.tag in ("div", "section"):
        return 1
    return 2 if node.tag in ("div", "section", "td") and node.words & ARTICLE_WORDS else 3


class Part:
    """An element of a wrapper: on how many pages it is, characters of its own text outside links, that text (its hash, None for a
    slot, 0 for none), its kind, and what it is made of (src: parts of other wrappers, or a page's nodes).
    """

    __slots__ = ("chars", "key", "kids", "kind", "n", "optional", "repeated", "src", "text")

    def __init__(self, key, n=1, chars=0, text=0, kind=3, optional=False, repeated=False, src=()):
        self.key, self.n, self.chars, self.text, self.kind, self.optional, self.repeated = key, n, chars, text, kind, optional, repeated
        self.kids, self.src = [], list(src)

    def copy(self) -> Part:
        return Part(self.key, self.n, self.chars, self.text, self.kind, self.optional, self.repeated, [self])

    def take(self, other: Part, n: int) -> Part:
        """Become what stands for both; n: pages that have one of them."""
        self.n, self.chars, self.kind = n, self.chars + other.chars, min(self.kind, other.kind)
        self.text = self.text if self.text == other.text else None
        self.optional, self.repeated = self.optional or other.optional, self.repeated or other.repeated
        self.src += other.src
        return self


def fold(root: Node) -> Part:
    """The wrapper of one page: its elements without dropped parts, and their texts."""
    top = Part("#root")
    todo = [(root, top, False, False)]
    while todo:
        node, part, inside, linked = todo.pop()
        if t := own_text(node):
            part.text, part.chars = text_hash(t), 0 if linked else len(t)
        for c in elements(node, inside):
            part.kids.append(Part(c.key, kind=kind_of(c)))
            todo.append((c, part.kids[-1], inside or c.tag == "article", linked or c.tag == "a"))
    return top


#: Bits of a table of a longest common subsequence; a larger one is split at the middle of one list first.
TABLE_BITS = 1 << 22


def _places(v: list[str]) -> dict[str, int]:
    """For each key a bit at every place that has it."""
    at: dict[str, list[int]] = {}
    for j, k in enumerate(v):
        at.setdefault(k, []).append(j)
    out = {}
    for k, js in at.items():
        if len(js) < 64:
            out[k] = sum(1 << j for j in js)
        else:
            bits = bytearray(len(v) // 8 + 1)
            for j in js:
                bits[j >> 3] |= 1 << (j & 7)
            out[k] = int.from_bytes(bits, "little")
    return out


def _rows(u: list[str], v: list[str]):
    """After each entry of u a row of bits: a zero where the length of the common subsequence with v grows."""
    has, full = _places(v), (1 << len(v)) - 1
    row = full
    for k in u:
        hit = row & has.get(k, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(u: list[str], v: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of u and each beginning of v."""
    row = (1 << len(v)) - 1
    for row in _rows(u, v):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(v) // 8 + 1, "little"), np.uint8), count=len(v), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as ascending pairs of places.

    Equal ends first. Then a table with a row of bits for each entry; one that would be too large is split: where the lengths before and
    after the middle of one list add up to most, so space is linear and the pairs are as many at every size.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        u, v = x[a:b], y[c:d]
        if len(u) * len(v) > TABLE_BITS and len(u) > 1:
            mid = len(u) // 2
            best = int(np.argmax(_lengths(u[:mid], v) + _lengths(u[mid:][::-1], v[::-1])[::-1]))
            todo += [(a, a + mid, c, c + best), (a + mid, b, c + best, d)]
            continue
        rows = [(1 << len(v)) - 1, *_rows(u, v)]
        i, j = len(u), len(v)
        while i and j:
            if u[i - 1] == v[j - 1]:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
            elif rows[i] >> (j - 1) & 1:  # no growth at j
                j -= 1
            else:
                i -= 1
    return sorted(out)


def _period(gap: list[Part]) -> int:
    """The fewest elements that the gap repeats, its length if it repeats nothing."""
    border = [0] * len(gap)
    for i in range(1, len(gap)):
        k = border[i - 1]
        while k and gap[i].key != gap[k].key:
            k = border[k - 1]
        border[i] = k + (gap[i].key == gap[k].key)
    p = len(gap) - border[-1]
    return p if len(gap) % p == 0 else len(gap)


def _same(x: list[Part], y: list[Part]) -> bool:
    return len(x) == len(y) and all(a.key == b.key for a, b in zip(x, y, strict=True))


def align(x: list[Part], y: list[Part], total: int) -> list[Part]:
    """Two sequences of elements as one; total: pages that the sequences stand for.

    Elements in common are merged. A mismatch that repeats the elements before or after it, however many, makes them a repeated group; other
    elements that one side lacks are optional. Among neighbours that are all optional or repeated, a key that comes again makes
    what stands from its first to its last place one repeated group, with each key in it once.
    """
    if _same(x, y):
        return [a.take(b, a.n + b.n) for a, b in zip(x, y, strict=True)]
    pairs = [*matches([a.key for a in x], [b.key for b in y]), (len(x), len(y))]
    out: list[Part] = []
    i = j = 0
    for p, (a, b) in enumerate(pairs):
        for gap in (x[i:a], y[j:b]):
            if not gap:
                continue
            size = _period(gap)
            after = [x[q] for t, (q, r) in enumerate(pairs[p : p + size]) if q < len(x) and (q, r) == (a + t, b + t)]
            group = next((g for g in (out[-size:], after) if _same(g, gap[:size])), None)
            if group:
                for k, g in enumerate(gap):
                    g.optional = False
                    own = group[k % size]
                    own.take(g, max(own.n, g.n)).repeated = True
            else:
                for g in gap:
                    g.optional = True
                out += gap
        if a < len(x):
            out.append(x[a].take(y[b], x[a].n + y[b].n))
        i, j = a + 1, b + 1
    return _regroup(out, total)


def _regroup(parts: list[Part], total: int) -> list[Part]:
    out: list[Part] = []
    i = 0
    while i < len(parts):
        z = i
        while z < len(parts) and (parts[z].optional or parts[z].repeated):
            z += 1
        last = {parts[j].key: j for j in range(i, z)}
        while i < z:
            end, j = last[parts[i].key], i
            while j < end:
                j += 1
                end = max(end, last[parts[j].key])
            if end == i:
                out.append(parts[i])
            else:
                own: dict[str, Part] = {}
                for k in parts[i : end + 1]:
                    own[k.key] = own[k.key].take(k, min(total, own[k.key].n + k.n)) if k.key in own else k
                for k in own.values():
                    k.optional = k.repeated = True
                out += own.values()
            i = end + 1
        if z < len(parts):
            out.append(parts[z])
        i = z + 1
    return out


def merge(wrappers: list[Part]) -> Part:
    """One wrapper for all: each in turn is aligned with those before it, level by level."""
    top = wrappers[0].copy()
    for w in wrappers[1:]:
        top.take(w.copy(), top.n + w.n)
    todo = [top]
    while todo:
        part = todo.pop()
        if len(part.src) == 1:
            part.kids, part.src = part.src[0].kids, []
            continue
        kids = [k.copy() for k in part.src[0].kids]
        total = part.src[0].n
        for other in part.src[1:]:
            total += other.n
            kids = align(kids, [k.copy() for k in other.kids], total)
        part.kids, part.src = kids, []
        todo += kids
    return top


def dump(top: Part, mark=lambda part: 0) -> str:
    """A wrapper as text, its elements in page order; no nesting, so that deep pages are fine."""
    rows, todo = [], [top]
    while todo:
        k = todo.pop()
        rows.append([k.key, k.n, k.chars, k.text, k.kind, 2 * k.optional + k.repeated, len(k.kids), mark(k)])
        todo += reversed(k.kids)
    return json.dumps(rows, separators=(",", ":"), ensure_ascii=False)


def load(text: str) -> tuple[Part, dict[int, int]]:
    """What dump() wrote, and the marks by the identity of the part."""
    top, marks, open_ = None, {}, []
    for key, n, chars, own, kind, flags, kids, mark in json.loads(text):
        part = Part(key, n, chars, own, kind, flags >= 2, flags % 2 == 1)
        if mark:
            marks[id(part)] = mark
        if open_:
            open_[-1][0].kids.append(part)
            open_[-1][1] -= 1
            if not open_[-1][1]:
                open_.pop()
        else:
            top = part
        if kids:
            open_.append([part, kids])
    return top, marks


def _order(top: Part) -> tuple[list[Part], list[int]]:
    """Parts in page order, and the place of each one's parent."""
    order, above, todo = [], [], [(top, -1)]
    while todo:
        k, p = todo.pop()
        todo += [(c, len(order)) for c in reversed(k.kids)]
        order.append(k)
        above.append(p)
    return order, above


def _tag(part: Part) -> str:
    return part.key.split(".")[0]


def regions(top: Part) -> list[Part]:
    """The parts that may be the article, the likeliest first.

    What counts is text in slots (all text, if nothing differs). Parts that pages call articles, main parts or contents themselves come
    first if they have a quarter of what a page has; last comes the part reached from the root by going down as long as one element that
    is no paragraph has most of it.
    """
    order, above = _order(top)
    slots = any(k.text is None and k.chars for k in order)
    mass = {id(k): k.chars if not slots or k.text is None else 0 for k in order}
    for k, p in zip(order[:0:-1], above[:0:-1], strict=True):
        mass[id(order[p])] += mass[id(k)]
    called: list[list[Part]] = [[], [], []]
    in_article = [False] * len(order)
    for i, (k, p) in enumerate(zip(order, above, strict=True)):
        in_article[i] = p >= 0 and (in_article[p] or order[p].kind == 0)
        if k.kind < 3 and not in_article[i] and 4 * mass[id(k)] * top.n >= mass[id(top)] * k.n and mass[id(k)]:
            called[k.kind].append(k)
    out = [k for own in called for k in sorted(own, key=lambda k: -mass[id(k)])]
    k = top
    while k.kids:
        child = max(k.kids, key=lambda c: mass[id(c)])
        tag = _tag(child)
        if not mass[id(k)] or mass[id(child)] < 0.6 * mass[id(k)] or child.repeated or tag not in BLOCK or tag in HEADINGS or tag in ("p", "li", "td", "blockquote", "pre"):
            break
        k = child
    if k is not top and k not in out:
        out.append(k)
    return out


#: The mark of a part on the way to a region; regions are marked with their ranks, from 1.
WAY = -1


def told(top: Part) -> str:
    """What extraction needs of a wrapper: the regions, and beside the way to them the keys of their neighbours."""
    order, above = _order(top)
    place = {id(k): i for i, k in enumerate(order)}
    marks = {id(k): rank for rank, k in enumerate(regions(top), 1)}
    for i in [place[x] for x in marks]:
        while (i := above[i]) >= 0 and id(order[i]) not in marks:
            marks[id(order[i])] = WAY
    if not marks:
        return ""
    needed = set(marks)
    slim: dict[int, Part] = {}
    for k, p in zip(order, above, strict=True):
        if p < 0 or id(order[p]) in needed:
            own = slim[id(k)] = k.copy()
            own.src, own.chars, own.text = [id(k)], 0, 0
            if p >= 0:
                slim[id(order[p])].kids.append(own)
    return dump(slim[id(top)], lambda k: marks.get(k.src[0], 0))


def place(root: Node, wrapper: tuple[Part, dict[int, int]]) -> Node | None:
    """Align a page with its host's wrapper: the node of the best region that the page has."""
    top, marks = wrapper
    found: dict[int, list[Node]] = {}
    todo = [(top, root, False)]
    while todo:
        part, node, inside = todo.pop()
        if not part.kids:
            continue
        ours = [k.copy() for k in part.kids]
        theirs = [Part(c.key, src=[c]) for c in elements(node, inside)]
        for k in align(ours, theirs, part.n + 1):
            nodes = [c for c in k.src if isinstance(c, Node)]
            for known in [c for c in k.src if not isinstance(c, Node) and id(c) in marks] if nodes else ():
                mark = marks[id(known)]
                for c in nodes:
                    if mark > 0:
                        found.setdefault(mark, []).append(c)
                    todo.append((known, c, inside or c.tag == "article"))
    for mark in sorted(found):
        size, _, node = max(((text_size(c, True), -i, c) for i, c in enumerate(found[mark])), key=lambda x: x[:2])
        if size:
            return node
    return None


def _body(root: Node) -> Node:
    for c in root.children:
        if not isinstance(c, str) and c.tag in ("html", "body"):
            return _body(c) if c.tag == "html" else c
    return root


def article_of(root: Node, wrapper: tuple[Part, dict[int, int]] | None) -> Node:
    """The element that holds the article by the host's wrapper, or, where the page has none of its regions, by the page's own."""
    node = place(root, wrapper) if wrapper else None
    if node is None and (alone := told(fold(root))):
        node = place(root, load(alone))
    return node or _body(root)


def blocks(article: Node) -> list[str]:
    """The article's blocks in page order, white space folded."""
    out, line = [], []

    def close() -> None:
        if t := " ".join("".join(line).split()):
            out.append(t)
        line.clear()

    todo = [(article, False, iter(article.children))]
    while todo:
        node, heading_only, children = todo[-1]
        for c in children:
            if isinstance(c, str):
                if not heading_only:
                    line.append(entities.unescape(c))
                continue
            if dropped(c, True):
                if c.tag in BLOCK:
                    close()
                continue
            if c.tag == "br":
                line.append(" ")
                continue
            if c.tag in BLOCK:
                close()
            only = (heading_only or c.tag == "header") and c.tag not in HEADINGS
            todo.append((c, only, iter(c.children)))
            break
        else:
            todo.pop()
            if node.tag in BLOCK and node is not article:
                close()
    close()
    return out


def extract(page: str | None, wrapper: tuple[Part, dict[int, int]] | None = None) -> str:
    """The main text of a page, by its host's wrapper (load(told(...))) or by its own."""
    if not page:
        return ""
    return "\n\n".join(blocks(article_of(parse(page), wrapper)))


#: Pages (or, later, wrappers) that are merged in one go.
PAGES_AT_ONCE, WRAPPERS_AT_ONCE = 100, 64


def _skeletons(batches):
    for batch in batches:
        for part in shared.slices(batch, "html"):
            host, out = [], []
            for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                if page:
                    host.append(h)
                    out.append(zlib.compress(dump(fold(parse(page))).encode(errors="replace"), 1))
            yield pa.record_batch([pa.array(host, pa.string()), pa.array(out, pa.binary())], names=["host", "wrapper"])


def _times(w: Part, n: int) -> Part:
    """A page's wrapper for n equal pages."""
    todo = [w] if n > 1 else []
    while todo:
        k = todo.pop()
        k.n, k.chars = k.n * n, k.chars * n
        todo += k.kids
    return w


def _merge(table: pa.Table) -> pa.Table:
    """Merge a group's wrappers, in an order that depends on the wrappers alone."""
    rows = sorted(zip(table.column("wrapper").to_pylist(), table.column("n").to_pylist(), strict=True))
    out = merge([_times(load(zlib.decompress(w).decode())[0], n) for w, n in rows])
    host, bucket = table.column("host")[0].as_py(), table.column("bucket")[0].as_py()
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64()]
    return pa.table([pa.array([x], k) for x, k in zip((host, bucket, zlib.compress(dump(out).encode(), 1), 1), kinds, strict=True)], names=["host", "bucket", "wrapper", "n"])


def _tell(batches):
    for batch in batches:
        tops = [load(zlib.decompress(w).decode())[0] for w in batch.column("wrapper").to_pylist()]
        yield pa.record_batch([batch.column("host"), pa.array([w.n for w in tops], pa.int64()), pa.array([told(w) for w in tops], pa.string())], names=["host", "pages", "wrapper"])


def _extract(batches):
    last, known = None, None
    for batch in batches:
        for part in shared.slices(batch, "html"):
            out = []
            for page, wrapper in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                if wrapper != last:
                    last, known = wrapper, load(wrapper) if wrapper else None
                out.append(extract(page, known))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def infer(rows: DataFrame) -> DataFrame:
    """The wrapper of each host, staged: (host, pages, wrapper as told()), from rows (host, html).

    Equal pages are counted first. A host's pages are dealt by hash to buckets of about PAGES_AT_ONCE, which are merged on their own;
    WRAPPERS_AT_ONCE of those at a time are merged until one is left. Within a bucket, order is by content, so the layout of the input
    plays no part.
    """
    skeletons = rows.mapInArrow(_skeletons, "host string, wrapper binary").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    skeletons = shared.stage(skeletons, "skeletons")
    hosts = shared.stage(skeletons.groupBy("host").agg(F.count("*").alias("distinct"), F.ceil(F.count("*") / F.lit(PAGES_AT_ONCE)).alias("buckets")), "hosts")
    size = hosts.agg(F.sum("distinct").alias("rows"), F.max("buckets").alias("buckets")).first()
    known = shared.split_join(skeletons, hosts, "host", "distinct", size["rows"] or 1).withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.col("buckets")))
    schema, left, spent = "host string, bucket long, wrapper binary, n long", size["buckets"] or 1, [skeletons, hosts]
    known = shared.stage(known.groupBy("host", "bucket").applyInArrow(_merge, schema), "wrappers")
    while left > 1:
        spent.append(known)
        known = known.withColumn("bucket", F.floor(F.col("bucket") / WRAPPERS_AT_ONCE))
        known = shared.stage(known.groupBy("host", "bucket").applyInArrow(_merge, schema), "wrappers")
        left = -(-left // WRAPPERS_AT_ONCE)
    out = shared.stage(known.select("host", "wrapper").mapInArrow(_tell, "host string, pages long, wrapper string"), "told")
    shared.discard(known, *spent)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: (id_col, url_col, text).

    Blocks are joined by two line feeds; character references are decoded, white space inside a block is one space. A null or empty
    page, or one without an article, has an empty text. Pages with a null URL or one without a host share one wrapper; equal rows have
    equal texts; elements may be nested to any depth; other columns are not read. Every page takes part in its host's wrapper.
    """
    spark = pages.sparkSession
    shared.small_batches(spark, 500)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    known = infer(rows.select("host", "html"))
    total = max(1, known.agg(F.sum("pages")).first()[0] or 0)
    joined = shared.split_join(rows, known, "host", "pages", total, "left")
    out = joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")
