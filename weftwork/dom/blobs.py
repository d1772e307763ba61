"""JSON documents inside pages: script elements and window variables."""

from __future__ import annotations

import json
import re

#: Global variables that hold page state (fixed values).
VARIABLES = ("__NUXT__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__DATA__", "__INITIAL_DATA__", "__STATE__", "__remixContext")
MOST_BYTES = 5 << 20
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.I | re.S)


def balanced(text: str, at: int) -> str | None:
    """The literal that opens at a brace or bracket; strings and escapes are skipped over."""
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S).finditer(text, at):
        c = m[0]
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[at : m.end()]
    return None


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def embedded(html: str | None) -> dict[str, str]:
    """Name to JSON text: script ids, all ld+json as a list, and window variables not named already."""
    out: dict[str, str] = {}
    linked: list[str] = []
    for attrs, body in _SCRIPT.findall(html or ""):
        body = body.strip()
        kind = re.search(r"""type\s*=\s*["']?application/(ld\+)?json""", attrs, re.I)
        if not kind or len(body) > MOST_BYTES or not _valid(body):
            continue
        name = re.search(r"""\bid\s*=\s*["']?([\w:.-]+)""", attrs, re.I)
        if kind[1]:
            linked.append(body)
        elif name:
            out[name[1]] = body
    if linked:
        out["ld+json"] = f"[{','.join(linked)}]"
    for v in VARIABLES:
        m = re.search(rf"(?:\b(?:window|globalThis|self)\.)?\b{re.escape(v)}\s*=\s*(?=[\[{{])", html or "")
        if m and v not in out:
            found = balanced(html, m.end())
            if found and len(found) <= MOST_BYTES and _valid(found):
                out[v] = found
    return out
