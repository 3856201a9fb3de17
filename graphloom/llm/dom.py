"""Trees of web pages, and their alignment by simple tree matching.

``parse`` reads a page into a tree of block elements and blocks of text; inline markup melts into the text
between blocks. ``match`` aligns two trees: it pairs elements of equal label (tag and class) under paired
parents, in order, so that as many nodes as possible are paired. Runs of repeated siblings of one shape
(paragraphs, list items, rows) count as one node that repeats, as they are one slot of a wrapper.

Everything is a loop over arrays, linear in the page but for the alignment of siblings, which is a
dynamic programme over what is left after equal heads and tails are cut off; beyond ``CELLS`` cells it is
split by Hirschberg's rule, so memory stays linear in the number of siblings.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from functools import lru_cache

import numpy as np
import xxhash

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
LEFT_OUT = frozenset(
    "head nav header footer aside form script style noscript template iframe button select option textarea svg canvas audio "
    "video object dialog menu title".split()
)
CLOSES_P = BLOCK - frozenset("body head html title caption tbody td tfoot th thead tr summary legend".split())
KEEPS_P = ("article", "section", "main", "aside", "td", "th", "button", "table")
#: Element -> elements it closes, and where the search for them ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
REPEAT = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre option".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Words of class and id that are mostly given to regions which are no part of the article. They are no proof: a region that
#: holds nearly all of the varying text stays (``webpages.decide``).
NAMED_OUT = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter popup replies share sharing sidebar social sponsor sponsored "
    "subscribe toolbar".split()
)
#: Words that may also stand on parts of an article: such a region is left out unless it holds most of the text.
NAMED_DOUBTFUL = frozenset("banner header notice promo related respond widget".split())
#: Words that say a region is text of the article, whatever doubtful words stand beside them.
NAMED_TEXT = frozenset("article body content entry main post story text work works".split())
#: Words that make even an ``article`` such a region.
NAMED_NEVER = frozenset("ad ads advert advertisement comment comments sponsored".split())

#: Marks of nodes. NAMED: by a word of NAMED_OUT; WITHIN: so marked itself, or below one that is.
OUT, DOUBTFUL, MAIN, HEADING, REPEATS, NAMED, WITHIN = 1, 2, 4, 8, 16, 32, 64
#: Cells of a table of alignment that are held at once.
CELLS = 1 << 22

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|(?=[\s/]|$))", re.I)
_WORD = re.compile(r"[\s_-]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(8192)
def _read(tag: str, attributes: str) -> tuple[int, int]:
    """Label and own marks of an element."""
    marks, named, classes = 0, [], ""
    for name, value in _ATTRIBUTE.findall(attributes):
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            marks |= OUT
        elif name == "role":
            marks |= OUT if value in ROLES_OUT else MAIN if value == "main" else 0
        elif name in ("class", "id"):
            named.append(value)
            if name == "class":
                classes = re.sub(r"\d+", "0", value)
    words = {w for v in named for w in _WORD.split(v)}
    whole = tag in ("html", "body", "h1")
    if tag in ("article", "main"):
        marks |= NAMED if words & NAMED_NEVER else MAIN
    elif tag not in BLOCK:  # a few words within a text: only the plain name counts
        marks |= OUT if {w for v in named for w in v.split()} & NAMED_OUT else 0
    elif not whole and words & NAMED_OUT:
        marks |= NAMED
    elif not whole and words & NAMED_DOUBTFUL and not words & NAMED_TEXT:
        marks |= DOUBTFUL
    if tag in ("h1", "hgroup"):
        marks |= HEADING
    if tag in REPEAT:
        marks |= REPEATS
    return zlib.crc32(f"{tag}.{classes}".encode()) | 1, marks


class Tree:
    """Nodes in page order: parent, label (0: text), marks; of text nodes the text, its key, characters and linked ones."""

    __slots__ = ("parent", "label", "mark", "text", "key", "chars", "linked", "groups", "shape", "within")

    def __init__(self, parent, label, mark, text, key, chars, linked):
        self.parent, self.label, self.mark, self.text, self.key, self.chars, self.linked = parent, label, mark, text, key, chars, linked
        self.groups = self.shape = self.within = None

    def pack(self) -> bytes:
        n = np.array([len(self.parent)], np.int64).tobytes()
        return n + b"".join(
            np.array(x, kind).tobytes()
            for x, kind in ((self.key, np.int64), (self.parent, np.int32), (self.label, np.uint32), (self.chars, np.int32), (self.linked, np.int32), (self.mark, np.uint8))
        )

    @staticmethod
    def unpack(data: bytes) -> Tree:
        n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
        for kind in (np.int64, np.int32, np.uint32, np.int32, np.int32, np.uint8):
            out.append(np.frombuffer(data, kind, n, at).tolist())
            at += n * np.dtype(kind).itemsize
        key, parent, label, chars, linked, mark = out
        return Tree(parent, label, mark, None, key, chars, linked)


def text_key(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def parse(page: str) -> Tree:
    """The tree of a page. Text of regions that are left out by tag, role or ``hidden`` is not read at all."""
    parent, label, mark, texts, linked_of = [-1], [1], [0], [None], [0]
    stack: list[tuple[str, int, int]] = [("#", 0, 0)]  # tag, node, left out by tag
    where: dict[str, list[int]] = {}  # tag -> its places in the stack
    words: list[str] = []
    linked, link, dark, dark_depth, dark_at = 0, False, "", 0, 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                parent.append(stack[-1][1])
                label.append(0)
                mark.append(0)
                texts.append(text)
                linked_of.append(min(linked, len(text)))
            words.clear()
        linked = 0

    def cut(i: int) -> None:
        nonlocal dark
        flush()
        for tag, _, _ in stack[i:]:
            where[tag].pop()
        del stack[i:]
        if dark and dark_at >= len(stack):
            dark = ""

    def close(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        i = max((where[t][-1] for t in tags if where.get(t)), default=0)
        if i and all(not where.get(s) or where[s][-1] < i for s in stops):
            cut(i)

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2] and not dark:
            text = _html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if link:
                linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            put(page[at:])
            break
        after = page[i + 1 : i + 2]
        if after in "!?" and after:
            put(page[at:i])
            if page.startswith("<!--", i):
                j = i + 5 if page.startswith("<!-->", i) else i + 6 if page.startswith("<!--->", i) else page.find("-->", i + 4) + 3
                at = j if j > 2 else n
            else:
                j = page.find(">", i)
                at = j + 1 if j >= 0 else n
            continue
        m = _TAG.match(page, i)
        if m is None:
            if after.isascii() and after.isalpha() or after == "/" and page[i + 2 : i + 3].isalpha():
                put(page[at:i])  # a tag that never ends takes the rest of the page with it
                break
            put(page[at : i + 1])
            at = i + 1
            continue
        put(page[at:i])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == dark:
                dark_depth -= 1
                if not dark_depth:
                    dark = ""
            if tag == "a":
                link = False
            elif tag in BLOCK or tag in LEFT_OUT:
                close((tag,), ())
            continue
        if tag == "br":
            put(" ")
        elif tag == "a":
            link = True
        if tag in BLOCK or tag in LEFT_OUT:
            if tag in CLOSES_P:
                close(("p",), KEEPS_P)
            if tag in CLOSES:
                close(*CLOSES[tag])
            flush()
            _, up, hidden = stack[-1]
            own_label, own = _read(tag, m[3])
            hidden = hidden or tag in LEFT_OUT
            node = up
            if not hidden:
                node = len(parent)
                parent.append(up)
                label.append(own_label)
                mark.append(own)
                texts.append(None)
                linked_of.append(0)
            if tag not in VOID and not m[3].endswith("/"):
                where.setdefault(tag, []).append(len(stack))
                stack.append((tag, node, hidden))
        elif dark:
            dark_depth += tag == dark and tag not in VOID
        elif m[3] and tag not in VOID and _read(tag, m[3])[1] & OUT:
            dark, dark_depth, dark_at = tag, 1, len(stack) - 1
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    tree = Tree(parent, label, mark, texts, [0 if t is None else text_key(t) for t in texts], [len(t or "") for t in texts], linked_of)
    _settle(tree)
    return tree


def _settle(t: Tree) -> None:
    """Marks go down to all below. A region named as left out that holds an ``article``, ``main`` or ``h1`` is a frame, and stays."""
    holds = [0] * len(t.parent)
    for i in range(len(t.parent) - 1, 0, -1):
        if holds[i] or t.mark[i] & (MAIN | HEADING) and not t.mark[i] & (OUT | NAMED):
            holds[t.parent[i]] = 1
    for i in range(1, len(t.parent)):
        if t.mark[i] & (OUT | DOUBTFUL | NAMED) and holds[i]:
            t.mark[i] &= ~(OUT | DOUBTFUL | NAMED)
        if t.mark[i] & NAMED:
            t.mark[i] |= WITHIN
        t.mark[i] |= t.mark[t.parent[i]] & (OUT | DOUBTFUL | MAIN | WITHIN)


class Shapes:
    """Shapes of subtrees: label and the shapes of the children, runs of repeated ones taken as one."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[int, tuple[int, ...], int]] = {}  # shape -> label, children, nodes
        self.weights: dict[tuple[int, int], int] = {}

    def add(self, t: Tree) -> None:
        """Sets ``groups`` (the children of each node, by runs) and ``shape`` of a tree."""
        n = len(t.parent)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[t.parent[i]].append(i)
        t.groups, t.shape, t.within = [()] * n, [0] * n, self
        for i in range(n - 1, -1, -1):
            groups: list[list[int]] = []
            for c in kids[i]:
                if groups and t.mark[c] & REPEATS and t.shape[c] == t.shape[groups[-1][0]]:
                    groups[-1].append(c)
                else:
                    groups.append([c])
            below = tuple(t.shape[g[0]] for g in groups)
            shape = hash((t.label[i], below))
            if shape not in self.known:
                self.known[shape] = (t.label[i], below, 1 + sum(self.known[s][2] for s in below))
            t.groups[i], t.shape[i] = groups, shape

    def weight(self, a: int, b: int) -> int:
        """The most nodes that two subtrees of these shapes can pair."""
        if a == b:
            return self.known[a][2]
        if self.known[a][0] != self.known[b][0]:
            return 0
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.weights:
                todo.pop()
                continue
            head, xs, ys, tail = trimmed(self.known[x][1], self.known[y][1])
            open_ = [
                (u, v) for u in set(xs) for v in set(ys)
                if u != v and self.known[u][0] == self.known[v][0] and (u, v) not in self.weights
            ]
            if open_:
                todo += open_
                continue
            equal = self.known[x][1][:head] + (self.known[x][1][len(self.known[x][1]) - tail :] if tail else ())
            self.weights[x, y] = 1 + sum(self.known[s][2] for s in equal) + (self._best(xs, ys) if xs and ys else 0)
            todo.pop()
        return self.weights[a, b]

    def _best(self, xs, ys) -> int:
        if len(xs) * len(ys) > 400:
            return int(self._table(xs, ys)[-1][-1])
        row = [0] * (len(ys) + 1)
        for x in xs:
            before, best = 0, 0
            for j, y in enumerate(ys, 1):
                w = self.known[x][2] if x == y else self.weights.get((x, y), 0)
                above = row[j]
                best = max(above, best, before + w)
                before, row[j] = above, best
        return row[-1]

    def _rows(self, xs, ys):
        """For each of ``xs`` its weights with ``ys``."""
        different = list(dict.fromkeys(ys))
        place = np.array([different.index(y) for y in ys]) if len(different) < 8 else None
        if place is None:
            at = {y: i for i, y in enumerate(different)}
            place = np.array([at[y] for y in ys])
        cache: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in cache:
                cache[x] = np.array([self.weight(x, y) for y in different], np.int64)[place]
            yield cache[x]

    def _table(self, xs, ys, last_only: bool = True) -> np.ndarray:
        row = np.zeros(len(ys) + 1, np.int64)
        rows = [row]
        for w in self._rows(xs, ys):
            new = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))))
            row = new
            if last_only:
                rows[0] = row
            else:
                rows.append(row)
        return np.array(rows)

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of ``xs`` and ``ys`` paired in order with the greatest sum of weights."""
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            head, mx, my, tail = trimmed(xs[a:b], ys[c:d])
            out += [(a + i, c + i) for i in range(head)] + [(b - 1 - i, d - 1 - i) for i in range(tail)]
            a, b, c, d = a + head, b - tail, c + head, d - tail
            if a >= b or c >= d:
                continue
            if b - a > 1 and (b - a + 1) * (d - c + 1) > CELLS:
                mid = (a + b) // 2
                up = self._table(xs[a:mid], ys[c:d])[-1]
                down = self._table(xs[mid:b][::-1], ys[c:d][::-1])[-1][::-1]
                at = c + int((up + down).argmax())
                todo += [(a, mid, c, at), (mid, b, at, d)]
                continue
            m = self._table(xs[a:b], ys[c:d], last_only=False)
            i, j = b - a, d - c
            while i and j:
                if m[i, j] == m[i - 1, j]:
                    i -= 1
                elif m[i, j] == m[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
        return out


def trimmed(xs, ys) -> tuple[int, tuple, tuple, int]:
    """Lengths of the equal head and tail, and what is between: pairing equal shapes there loses nothing."""
    n = min(len(xs), len(ys))
    head = 0
    while head < n and xs[head] == ys[head]:
        head += 1
    tail = 0
    while tail < n - head and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    return head, xs[head : len(xs) - tail], ys[head : len(ys) - tail], tail


def match(a: Tree, b: Tree, shapes: Shapes | None = None) -> list[int]:
    """For each node of ``a`` its partner in ``b``; for a node without one, ``-1 - p`` of its next paired ancestor's partner p."""
    shapes = shapes or Shapes()
    for t in (a, b):
        if t.within is not shapes:
            shapes.add(t)
    found = [-1] * len(a.parent)
    paired = [False] * len(a.parent)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x], paired[x] = y, True
        gx, gy = a.groups[x], b.groups[y]
        if a.shape[x] == b.shape[y]:
            both = zip(gx, gy)
        else:
            sx, sy = tuple(a.shape[g[0]] for g in gx), tuple(b.shape[g[0]] for g in gy)
            both = ((gx[i], gy[j]) for i, j in shapes.pairs(sx, sy))
        todo += [(c, h[0]) for g, h in both for c in g]
    for i in range(1, len(found)):
        if not paired[i]:
            p = found[a.parent[i]]
            found[i] = -1 - p if p >= 0 else p
    return found
