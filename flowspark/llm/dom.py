"""A small HTML tree for text extraction: elements and text runs, tolerant of missing end tags.

Nodes know their shape, a number for the structure below them, so that matching two trees
can look scores up by pairs of shapes.
"""

from __future__ import annotations

import html as references
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these names, and the names that bound the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
}
P_BOUNDS = frozenset({"table", "td", "th", "caption", "button", "object", "html", "body"})
DEEPEST = 200

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<torn>[^>]*)(?:>|\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("attributes", "children", "shape", "tag", "text")

    def __init__(self, tag: str, attributes: str = "", text: str = ""):
        self.tag, self.attributes, self.text = tag, attributes, text
        self.children: list[Node] = []
        self.shape = -1

    def named(self) -> dict[str, str]:
        """Attributes by lower-case name; of repeated ones the first."""
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
        return found


def parse(page: str) -> Node:
    """The tree of a page under a root node; text runs are nodes named #text."""
    root = Node("#root")
    stack, at, beyond = [root], 0, 0

    def text(part: str) -> None:
        if part and not part.isspace():
            stack[-1].children.append(Node("#text", text=part))
        elif part and stack[-1].children:  # a blank between inline elements separates words
            stack[-1].children.append(Node("#blank"))

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if beyond:
                beyond -= 1
            else:
                _close(stack, name)
            continue
        _imply(stack, name)
        node = Node(name, m["rest"] or m["torn"] or "")
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                beyond += 1
    text(page[at:])
    return root


def _close(stack: list[Node], name: str) -> None:
    """Ends the nearest open element of a name; an inline one only within its block."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if name not in BLOCK and stack[i].tag in BLOCK:
            return


def _imply(stack: list[Node], name: str) -> None:
    """Ends the elements whose end tag a start tag implies."""
    if name in ENDS:
        ended, bounds = ENDS[name]
    elif name in BLOCK:
        ended, bounds = {"p"}, P_BOUNDS
    else:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ended:
            del stack[i:]
            return
        if stack[i].tag in bounds:
            return


def clean(text: str) -> str:
    """Character references decoded, white space turned to single spaces."""
    return " ".join(references.unescape(text).split())


class Shapes:
    """Numbers for structures, and the simple tree matching score of any two of them."""

    LIMIT = 200_000

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.known: dict[tuple[int, int], int] = {}

    def label(self, node: Node) -> int:
        """Sets the shape of a node and of all below it."""
        order, todo = [], [node]
        while todo:
            n = todo.pop()
            order.append(n)
            todo += n.children
        for n in reversed(order):
            key = (n.tag, *[c.shape for c in n.children if c.tag != "#blank"])
            n.shape = self.number.get(key, -1)
            if n.shape < 0:
                n.shape = self.number[key] = len(self.parts)
                self.parts.append(key)
        return node.shape

    def score(self, a: int, b: int) -> int:
        """Number of node pairs in the largest matching that keeps order and depth."""
        if self.parts[a][0] != self.parts[b][0]:
            return 0
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[a, b] = 1 + self.table(self.parts[a][1:], self.parts[b][1:])[-1][-1]
        return found

    def table(self, a: tuple, b: tuple) -> list[list[int]]:
        """Best scores of all beginnings of two child lists."""
        rows = [[0] * (len(b) + 1)]
        for x in a:
            last, row = rows[-1], [0]
            for j, y in enumerate(b):
                row.append(max(last[j + 1], row[j], last[j] + self.score(x, y)))
            rows.append(row)
        return rows

    def align(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Pairs of nodes of the best matching of two trees that have the same root tag."""
        pairs, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            pairs.append((x, y))
            left, right = [c for c in x.children if c.tag != "#blank"], [c for c in y.children if c.tag != "#blank"]
            if x.shape == y.shape:
                todo += zip(left, right, strict=True)
                continue
            best = self.table(tuple(c.shape for c in left), tuple(c.shape for c in right))
            i, j = len(left), len(right)
            while i and j:
                gain = self.score(left[i - 1].shape, right[j - 1].shape)
                if gain and best[i][j] == best[i - 1][j - 1] + gain:
                    i, j = i - 1, j - 1
                    todo.append((left[i], right[j]))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return pairs
