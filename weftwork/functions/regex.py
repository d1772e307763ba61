"""Python regular expressions and replacements in the dialect of Spark's regexp functions."""

from __future__ import annotations

import re


class Untranslatable(ValueError):
    """The pattern means something that Java's regular expressions cannot say."""


def java_pattern(pattern: str) -> str:
    """Unicode classes as in Python; named groups and \\Z respelt; conditionals are refused."""
    re.compile(pattern)
    if re.search(r"\(\?\(", pattern):
        raise Untranslatable(f"conditional group in {pattern!r}")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{m[1].replace('_', '')}>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return "(?U)" + out


def java_replacement(replacement: str) -> str:
    """\\1 and \\g<name> as $1 and ${name}; a dollar sign stands for itself."""
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "$":
            out.append(r"\$")
        elif c == "\\" and i + 1 < len(replacement):
            rest = replacement[i + 1 :]
            if m := re.match(r"g<(\w+)>", rest):
                out.append(f"${m[1]}" if m[1].isdigit() else f"${{{m[1].replace('_', '')}}}")
                i += m.end()
            elif m := re.match(r"\d{1,2}", rest):
                out.append(f"${m[0]}")
                i += m.end()
            else:
                named = {"n": "\n", "t": "\t", "r": "\r", "\\": r"\\"}
                if rest[0] not in named:
                    raise Untranslatable(f"escape \\{rest[0]} in {replacement!r}")
                out.append(named[rest[0]])
                i += 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\.\[\]{}()*+\-?^$|#&~])", r"\\\1", text)
