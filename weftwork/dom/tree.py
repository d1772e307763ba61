"""A forgiving HTML tree on the standard library's tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes, nearest first, up to a container.
_CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
    "tbody": {"tbody", "thead", "tr", "td", "th"},
}
_WALLS = frozenset("ul ol table dl select body html div article section nav main aside header footer form".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.kids: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.elements()[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(n.kids[::-1])
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def index(self) -> int:
        return next((i for i, k in enumerate(self.parent.elements()) if k is self), 0) if self.parent else 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted; nobody asks for them."""
        return j

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = _CLOSES.get(tag)
        if closes:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closes:
                    del self.open[i:]
                    break
                if self.open[i].tag in _WALLS:
                    break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        kids = self.open[-1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def release(root: Node) -> None:
    """Take a read tree apart: parents and children name each other, and would stay until the collector comes round."""
    stack = [root]
    while stack:
        n = stack.pop()
        stack += n.elements()
        n.kids, n.parent = [], None


def parse(html: str | None) -> Node:
    """The document node; text that is JSON gives an empty document."""
    b = _Builder()
    if html and html.lstrip()[:1] not in ("{", "["):
        b.feed(html)
        b.close()
    return b.root
