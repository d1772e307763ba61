"""A subset of CSS and XPath; what lies outside it is refused when a recipe is compiled.

CSS: tag, *, #id, .class, [a], [a=v], [a~=v], [a^=v], [a$=v], [a*=v], descendant, >, +, ~, commas,
:first-child, :last-child, :nth-child(n), :nth-of-type(n), :not(simple), and ::text or ::attr(x) at
the end.  XPath: steps by / and //, names, *, ., .., @a, text(), following-sibling::, and the
predicates [n], [last()], [@a], [@a='v'], [text()='v'], [contains(@a,'v')], [contains(text(),'v')].
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from .tree import Node

Test = Callable[[Node], bool]
_XPATH = ("/", "(", "./", "../", ".//", "descendant::", "child::", "self::", "ancestor::", "following-sibling::")


class Unsupported(ValueError):
    """A selector outside the subset."""


def kind(selector: str) -> str:
    return "xpath" if selector.strip().startswith(_XPATH) else "css"


def norm(text: str) -> str:
    return " ".join(text.split())


# ---- CSS ----------------------------------------------------------------------------------

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]
    |:not\((?P<not>[^()]+)\)|:(?P<pseudo>first-child|last-child|only-child|first-of-type|last-of-type)|:(?P<nth>nth-child|nth-of-type)\((?P<n>\d+|odd|even)\)""",
    re.X,
)


def _attr_test(name: str, op: str | None, value: str | None) -> Test:
    name = name.lower()
    if op is None:
        return lambda n: name in n.attrs
    v = value.strip("\"'")
    return {
        "=": lambda n: n.attrs.get(name) == v,
        "~=": lambda n: v in n.attrs.get(name, "").split(),
        "^=": lambda n: bool(v) and n.attrs.get(name, "").startswith(v),
        "$=": lambda n: bool(v) and n.attrs.get(name, "").endswith(v),
        "*=": lambda n: bool(v) and v in n.attrs.get(name, ""),
        "|=": lambda n: n.attrs.get(name, "") == v or n.attrs.get(name, "").startswith(v + "-"),
    }[op]


def _same(n: Node, of_type: bool) -> list[Node]:
    return [k for k in n.parent.elements() if not of_type or k.tag == n.tag] if n.parent else [n]


def _compound(text: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise Unsupported(f"selector part {text[at:]!r}")
        at = m.end()
        if m["tag"]:
            tests.append((lambda t: lambda n: t == "*" or n.tag == t)(m["tag"].lower()))
        elif m["id"]:
            tests.append((lambda i: lambda n: n.attrs.get("id") == i)(m["id"]))
        elif m["cls"]:
            tests.append((lambda c: lambda n: c in n.classes())(m["cls"]))
        elif m["attr"]:
            tests.append(_attr_test(m["attr"], m["op"], m["val"]))
        elif m["not"]:
            tests.append((lambda inner: lambda n: not inner(n))(_compound(m["not"].strip())))
        elif m["pseudo"]:
            p = m["pseudo"]
            typed = p.endswith("type")
            if p == "only-child":
                tests.append(lambda n: len(_same(n, False)) == 1)
            else:
                tests.append((lambda e, typed: lambda n: _same(n, typed)[e] is n)(0 if p.startswith("first") else -1, typed))
        else:
            typed, k = m["nth"].endswith("type"), m["n"]

            def nth(n: Node, typed=typed, k=k) -> bool:
                i = next(i for i, x in enumerate(_same(n, typed), 1) if x is n)
                return i % 2 == (k == "odd") if k in ("odd", "even") else i == int(k)

            tests.append(nth)
    return lambda n: all(t(n) for t in tests)


def _split(text: str, marks: str) -> list[str]:
    """Cut at marks outside brackets and quotes; marks are kept as items of their own."""
    out, depth, quote, held = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        if c in marks and not depth and not quote:
            out += [held, c]
            held = ""
        else:
            held += c
    return [*out, held]


@lru_cache(maxsize=512)
def css(selector: str) -> Callable[[Node], list[Node]]:
    """Matches below a node, in document order."""
    chains: list[list[tuple[str, Test]]] = []
    for one in "".join(_split(selector, ",")).split(",") if "," not in selector else [x for x in _split(selector, ",") if x != ","]:
        parts = [p for p in _split(re.sub(r"\s*([>+~])(?![=])\s*", r"\1", one.strip()), " >+~") if p]
        links, link = [], " "
        for p in parts:
            if p in " >+~":
                if link != " " and p != " ":
                    raise Unsupported(f"two combinators in {selector!r}")
                link = p
            else:
                links.append((link, _compound(p)))
                link = " "
        if not links:
            raise Unsupported(f"empty selector in {selector!r}")
        chains.append(links)

    def holds(n: Node, chain: list[tuple[str, Test]], i: int, root: Node) -> bool:
        link, test = chain[i]
        if not test(n):
            return False
        if i == 0:
            return True
        if link == " ":
            up = n.parent
            while up is not None and up is not root.parent:
                if holds(up, chain, i - 1, root):
                    return True
                up = up.parent
            return False
        if link == ">":
            return n.parent is not None and holds(n.parent, chain, i - 1, root)
        before = n.parent.elements()[: n.index()] if n.parent else []
        return any(holds(b, chain, i - 1, root) for b in (before[-1:] if link == "+" else before))

    return lambda root: [n for n in root.walk() if any(holds(n, c, len(c) - 1, root) for c in chains)]


# ---- XPath --------------------------------------------------------------------------------

_STEP = re.compile(r"(?P<axis>following-sibling::|descendant::|child::|self::|ancestor::|parent::)?(?P<name>\*|\.\.?|@[\w:-]+|text\(\)|node\(\)|[\w:-]+)(?P<preds>(?:\[[^\]]*\])*)$")
_PRED = re.compile(r"\[\s*(.*?)\s*\]")


def _predicate(text: str) -> Callable[[Node, int, int], bool]:
    value = r"""(?:"([^"]*)"|'([^']*)')"""
    if text.isdigit():
        return lambda n, i, size: i == int(text)
    if text == "last()":
        return lambda n, i, size: i == size
    if m := re.fullmatch(r"@([\w:-]+)", text):
        return lambda n, i, size: m[1] in n.attrs
    if m := re.fullmatch(rf"@([\w:-]+)\s*=\s*{value}", text):
        return lambda n, i, size: n.attrs.get(m[1]) == (m[2] if m[2] is not None else m[3])
    if m := re.fullmatch(rf"text\(\)\s*=\s*{value}", text):
        return lambda n, i, size: any(k == (m[1] if m[1] is not None else m[2]) for k in n.kids if isinstance(k, str))
    if m := re.fullmatch(rf"contains\(\s*(@[\w:-]+|text\(\)|\.)\s*,\s*{value}\s*\)", text):
        part = m[2] if m[2] is not None else m[3]
        return lambda n, i, size: part in (n.attrs.get(m[1][1:], "") if m[1][0] == "@" else n.text())
    raise Unsupported(f"predicate [{text}]")


@lru_cache(maxsize=512)
def xpath(selector: str) -> Callable[[Node], list[Node | str]]:
    text = selector.strip()
    steps: list[tuple[bool, str, str, list]] = []
    rooted = text.startswith("/")
    pieces = _split(text, "/")
    deep, held = False, []
    for p in pieces:
        if p == "/":
            held.append("/")
            continue
        if not p:
            continue
        deep = held[-2:] == ["/", "/"]
        held = []
        m = _STEP.match(p)
        if not m:
            raise Unsupported(f"step {p!r} of {selector!r}")
        steps.append((deep, (m["axis"] or "child::")[:-2], m["name"], [_predicate(x) for x in _PRED.findall(m["preds"] or "")]))
    if not steps:
        raise Unsupported(f"empty path {selector!r}")

    def run(root: Node) -> list[Node | str]:
        top = root
        while rooted and top.parent is not None:
            top = top.parent
        now: list[Node | str] = [top]
        for deep, axis, name, preds in steps:
            out: list[Node | str] = []
            for n in now:
                if isinstance(n, str):
                    continue
                for c in [n, *n.walk()] if deep else [n]:
                    got = _axis(c, axis, name)
                    for p in preds:
                        got = [x for i, x in enumerate(got, 1) if isinstance(x, Node) and p(x, i, len(got))]
                    out += got
            seen: set[int] = set()
            now = [x for x in out if isinstance(x, str) or not (id(x) in seen or seen.add(id(x)))]
        return now

    return run


def _axis(n: Node, axis: str, name: str) -> list[Node | str]:
    if name == ".":
        return [n]
    if name == "..":
        return [n.parent] if n.parent is not None else []
    if name.startswith("@"):
        return [n.attrs[name[1:]]] if name[1:] in n.attrs else []
    if name == "text()":
        return [k for k in n.kids if isinstance(k, str)]
    if axis == "following-sibling":
        found: Iterable[Node] = n.parent.elements()[n.index() + 1 :] if n.parent else []
    elif axis == "descendant":
        found = n.walk()
    elif axis == "self":
        found = [n]
    elif axis in ("ancestor", "parent"):
        up, found = n.parent, []
        while up is not None:
            found.append(up)
            up = up.parent if axis == "ancestor" else None
    else:
        found = n.elements()
    return [k for k in found if name in ("*", "node()") or k.tag == name]


# ---- values -------------------------------------------------------------------------------


def nodes(root: Node, selector: str) -> list[Node]:
    return [n for n in (xpath if kind(selector) == "xpath" else css)(selector)(root) if isinstance(n, Node)]


def check(selector: str) -> None:
    """Refuse a selector outside the subset, before any page is read."""
    if not selector.strip():
        raise Unsupported("empty selector")
    if kind(selector) == "xpath":
        xpath(selector)
    else:
        css(re.sub(r"::(text|attr\([\w:-]+\))\s*$", "", selector) or "*")


def values(root: Node, selector: str, attr: str | None = None) -> list[str]:
    """Texts or attributes of the matches, white space collapsed, blanks dropped."""
    if kind(selector) == "xpath":
        found = xpath(selector)(root)
        raw = [x if isinstance(x, str) else x.attrs.get(attr, "") if attr else x.text() for x in found]
    else:
        m = re.search(r"::(?:(text)|attr\(([\w:-]+)\))\s*$", selector)
        base = selector[: m.start()] if m else selector
        found = css(base)(root) if base.strip() else [root]
        attr = m[2] if m and m[2] else attr
        raw = [k for n in found for k in n.kids if isinstance(k, str)] if m and m[1] else [n.attrs.get(attr, "") if attr else n.text() for n in found]
    return [v for v in map(norm, raw) if v]
