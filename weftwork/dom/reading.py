"""Pages for readers: a folded outline, plain Markdown, and the selectors under which a text stands."""

from __future__ import annotations

from . import selectors
from .analysis import selector, step
from .tree import Node, parse

_SKIP = frozenset("script style noscript svg template head".split())


def _short(text: str, n: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= n else text[: n - 1].rstrip() + "…"


def outline(html: str, lines: int | None = None, text: int = 80) -> str:
    """The tree, one element a line; of more than three like siblings in a row two are shown and the rest counted.

    lines: the most to show, for a reader with little room; all without it.
    """
    out: list[str] = []

    def show(n: Node, depth: int) -> None:
        kids = [k for k in n.elements() if k.tag not in _SKIP]
        i = 0
        while i < len(kids) and (lines is None or len(out) < lines):
            run = i
            while run < len(kids) and step(kids[run]) == step(kids[i]):
                run += 1
            for k in kids[i : i + 2] if run - i > 3 else kids[i:run]:
                own = _short("".join(x for x in k.kids if isinstance(x, str)), text)
                out.append("  " * depth + step(k) + (f" {own!r}" if own else ""))
                show(k, depth + 1)
            if run - i > 3:
                out.append("  " * depth + f"+{run - i - 2} more {step(kids[i])}")
            i = run

    show(parse(html), 0)
    return "\n".join(out[:lines])


def markdown(html: str, most: int | None = None) -> str:
    """Headings, paragraphs, lists, links and emphasis of the visible text; `most` characters and a mark where that is set."""
    out: list[str] = []

    def inline(n: Node) -> str:
        parts = []
        for k in n.kids:
            if isinstance(k, str):
                parts.append(k)
            elif k.tag in _SKIP:
                continue
            elif k.tag == "a" and k.attrs.get("href"):
                parts.append(f"[{' '.join(inline(k).split())}]({k.attrs['href']})")
            elif k.tag in ("b", "strong", "em", "i"):
                mark = "**" if k.tag in ("b", "strong") else "*"
                inner = " ".join(inline(k).split())
                parts.append(f"{mark}{inner}{mark}" if inner else "")
            elif k.tag == "br":
                parts.append("\n")
            else:
                parts.append(inline(k))
        return "".join(parts)

    def block(n: Node) -> None:
        for k in n.elements():
            if k.tag in _SKIP:
                continue
            if k.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("#" * int(k.tag[1]) + " " + " ".join(inline(k).split()))
            elif k.tag == "li":
                out.append("- " + " ".join(inline(k).split()))
            elif k.tag in ("p", "blockquote", "td", "th", "dt", "dd", "figcaption", "pre", "title") or not k.elements():
                text = " ".join(inline(k).split())
                if text:
                    out.append(text)
            else:
                block(k)

    block(parse(html))
    return _short_text("\n\n".join(out), most)


def _short_text(text: str, most: int | None) -> str:
    return text if most is None or len(text) <= most else text[:most].rstrip() + "…"


def search(html: str, query: str, container: str | None = None, most: int = 10) -> list[dict]:
    """Selectors of the elements whose own text or attributes hold a text; inside items first, then by how many items have it."""
    root, low = parse(html), query.lower()
    items = selectors.nodes(root, container) if container else []
    inside = {id(d): item for item in items for d in [item, *item.walk()]}
    out: dict[str, dict] = {}
    for n in root.walk():
        if n.tag in _SKIP:
            continue
        own = "".join(k for k in n.kids if isinstance(k, str))
        attr = next((a for a, v in n.attrs.items() if low in v.lower()), None)
        if low not in own.lower() and attr is None:
            continue
        item = inside.get(id(n))
        css = step(n) if item is not None else selector(n, root)
        fill = sum(any(selectors.norm(x.text()) for x in selectors.css(css)(i)) for i in items) if item is not None else 0
        out.setdefault(css, {"selector": css, "attr": None if low in own.lower() else attr, "in_container": item is not None, "fill": fill, "text": _short(own, 80)})
    return sorted(out.values(), key=lambda r: (not r["in_container"], -r["fill"], len(r["selector"])))[:most]


def probe_selector(html: str, css: str, container: str | None = None, most: int = 8) -> dict:
    """Matches of a selector (-1 where it is none), its first values, and in how many items it is filled."""
    root = parse(html)
    try:
        found, values = selectors.nodes(root, css.split("::")[0]), selectors.values(root, css)
    except ValueError:
        return {"matches": -1, "values": [], "filled": 0}
    items = selectors.nodes(root, container) if container else []
    return {"matches": len(found), "values": values[:most], "filled": sum(bool(selectors.values(i, css)) for i in items)}
