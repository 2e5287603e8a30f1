"""A forgiving HTML parser, simple tree matching, and wrapper induction over pages of one host."""

from __future__ import annotations

import html
import re

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",)}


#: Pages that a page is aligned with.
PARTNERS = 5


class Node:
    """An element, or a text (tag "#text")."""

    __slots__ = ("tag", "attributes", "children", "text", "shape", "size", "constant")

    def __init__(self, tag: str, attributes: str = "", text: str = "") -> None:
        self.tag, self.attributes, self.text = tag, attributes, text
        self.children: list[Node] = []
        self.shape, self.size, self.constant = None, 1, 0

    def get(self, *names: str) -> str:
        """Values of these attributes, joined by a space."""
        return " ".join(html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(self.attributes) if k.lower() in names) if self.attributes else ""

    def has(self, name: str) -> bool:
        return any(m[0].lower() == name for m in _ATTRIBUTE.findall(self.attributes)) if self.attributes else False


def parse(page: str) -> Node:
    """The tree of a page; whatever is broken or cut off, text is never lost except within unfinished tags."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].children.append(Node("#text", text=html.unescape(raw)))

    def close(names: tuple[str, ...], fences: tuple[str, ...]) -> None:
        """Close the nearest open element of these names, unless a fence is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in fences:
                return

    pending = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        add_text(page[pending : m.start()])
        at = pending = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in ("body", "html", "table", "article", "main", "section", "div") and stack[k].tag in ("table", "td", "th", "article", "main", "body"):
                    break
            continue
        if tag in CLOSES_P:
            close(("p",), ("button", "table", "td", "th", "article", "main"))
        if tag in SIBLINGS and tag != "p":
            close(SIBLINGS[tag], FENCES.get(tag, ()) + ("article", "main"))
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body, at = (page[at : end.start()], end.end()) if end else (page[at:], n)
            node.children.append(Node("#text", text=body))
            pending = at
            continue
        stack.append(node)
    add_text(page[pending:])
    return root


def measure(node: Node, shapes: dict) -> None:
    """Number shapes, so that equal structure is one comparison, and sizes."""
    order, todo = [], [node]
    while todo:  # no recursion: pages may nest deeply
        x = todo.pop()
        order.append(x)
        todo += x.children
    for x in reversed(order):
        key = (x.tag, *(c.shape for c in x.children))
        x.shape = shapes.setdefault(key, len(shapes))
        x.size = 1 + sum(c.size for c in x.children)


def _ends(x: Node, y: Node) -> tuple[int, int]:
    """Children of equal shape at both ends are matched outright, which loses no weight."""
    xs, ys, lo, hi = x.children, y.children, 0, 0
    most = min(len(xs), len(ys))
    while lo < most and xs[lo].shape == ys[lo].shape:
        lo += 1
    while hi < most - lo and xs[-1 - hi].shape == ys[-1 - hi].shape:
        hi += 1
    return lo, hi


def _inner(x: Node, y: Node) -> tuple[list[Node], list[Node]]:
    """The children between those that `_ends` matches."""
    lo, hi = _ends(x, y)
    return x.children[lo : len(x.children) - hi], y.children[lo : len(y.children) - hi]


class Matching:
    """Weights of simple tree matching between two trees, by pair of shapes. No recursion, since pages may nest deeply."""

    def __init__(self) -> None:
        self.weights: dict[tuple[int, int], int] = {}

    def known(self, x: Node, y: Node) -> int | None:
        if x.tag != y.tag:
            return 0
        return x.size if x.shape == y.shape else self.weights.get((x.shape, y.shape))

    def weigh(self, x: Node, y: Node) -> int:
        """Weight of a pair, after those of all pairs below it that it needs."""
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if self.known(x, y) is not None:
                todo.pop()
                continue
            xs, ys = _inner(x, y)
            firsts = [{c.shape: c for c in side}.values() for side in (xs, ys)]
            open_ = [(p, q) for p in firsts[0] for q in firsts[1] if self.known(p, q) is None]
            if open_:
                todo += open_
                continue
            todo.pop()
            # What both ends match weighs as much as it has nodes: all of the smaller side but its inner children.
            self.weights[x.shape, y.shape] = x.size - sum(c.size for c in xs) + (int(self.table(xs, ys)[-1, -1]) if xs and ys else 0)
        return self.known(x, y)

    def table(self, xs: list[Node], ys: list[Node]) -> np.ndarray:
        """Weights of the best order-preserving matchings of the first i of xs and the first j of ys."""
        shapes = list({c.shape: c for c in ys}.values())
        column = {c.shape: k for k, c in enumerate(shapes)}
        place = np.array([column[c.shape] for c in ys])
        rows: dict[int, np.ndarray] = {}
        out = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        for i, x in enumerate(xs):
            if x.shape not in rows:
                rows[x.shape] = np.array([self.weigh(x, y) for y in shapes], np.int64)[place]
            np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + rows[x.shape]), out=out[i + 1, 1:])
        return out


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Matched pairs of simple tree matching: roots match by tag, children by the best order-preserving matching of their subtrees."""
    pairs: list[tuple[Node, Node]] = []
    match = Matching()
    match.weigh(a, b)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.tag != y.tag:
            continue
        pairs.append((x, y))
        xs, ys = x.children, y.children
        if x.shape == y.shape:
            todo += zip(xs, ys)
            continue
        lo, hi = _ends(x, y)
        todo += zip(xs[:lo], ys[:lo])
        todo += zip(xs[len(xs) - hi :], ys[len(ys) - hi :]) if hi else ()
        xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
        if not xs or not ys:
            continue
        rows = match.table(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i, j] == rows[i - 1, j]:
                i -= 1
            elif rows[i, j] == rows[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
    return pairs


def texts(node: Node) -> list[Node]:
    """Text nodes that are not blank, in page order."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag == "#text":
            if x.text.strip():
                out.append(x)
        else:
            todo += reversed(x.children)
    return out


def _copies(a: dict[str, int], b: dict[str, int]) -> bool:
    """Whether four fifths of the characters of the shorter slot are in equal text nodes."""
    least = min(sum(a.values()), sum(b.values()))
    return least > 0 and sum(a[t] for t in a.keys() & b.keys()) >= 0.8 * least


def induce(trees: list[Node], slots: list[list[Node]] | None = None) -> None:
    """Mark the constant text nodes of same-host pages: those that are equal to their partners on most of the pages a page is aligned with.

    Each page is aligned with the next PARTNERS pages of other content, cyclically. A page of equal texts is a copy and says nothing
    about the template, nor does one whose named slot (`slots`, by page) is nearly the same; the search goes on past them over
    all pages. `constant` is the number of partners that agree.
    """
    whole = [tuple(t.text.strip() for t in texts(tree)) for tree in trees]
    inner = [{t.text.strip(): len(t.text.strip()) for root in (slots[k] if slots else ()) for t in texts(root)} for k in range(len(trees))]
    for i, tree in enumerate(trees):
        votes: dict[int, int] = {}
        seen, partners = {whole[i]}, 0
        for step in range(1, len(trees)):
            j = (i + step) % len(trees)
            if not whole[j] or whole[j] in seen or _copies(inner[i], inner[j]):
                continue
            seen.add(whole[j])
            partners += 1
            for x, y in align(tree, trees[j]):
                if x.tag == "#text" and x.text.strip() and x.text.strip() == y.text.strip():
                    votes[id(x)] = votes.get(id(x), 0) + 1
            if partners == PARTNERS:
                break
        for x in texts(tree):
            n = votes.get(id(x), 0)
            x.constant = n if 2 * n > partners else 0
