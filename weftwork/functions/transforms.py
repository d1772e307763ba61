"""The fifteen string transforms of recipes, as expressions on one value or on all of a field's values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java_pattern, java_replacement, literal

#: Longer patterns leave the value as it is.
MAX_PATTERN = 200
_SPACE = r"(?U)\s+"


@dataclass(frozen=True)
class Transform:
    kind: str
    value: str = ""
    pattern: str = ""
    chars: str = ""
    index: int | None = None


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def title(c: Column) -> Column:
    """A capital after every character that is not a letter."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def decimal_comma(c: Column) -> Column:
    european = c.rlike(r"(?U),\d{1,2}\b")
    return F.when(european, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c)


def regex_replace(c: Column, pattern: str, value: str) -> Column:
    if not pattern or len(pattern) > MAX_PATTERN:
        return c
    try:
        return F.regexp_replace(c, java_pattern(pattern), java_replacement(value))
    except Exception as e:  # a pattern that does not compile leaves values as they are
        if isinstance(e, ValueError) and type(e).__name__ == "Untranslatable":
            raise
        return c


def pieces(c: Column, separator: str = "") -> Column:
    """Parts between separators, stripped, without blanks."""
    return F.filter(F.transform(F.split(c, literal(separator or ","), -1), strip), lambda x: x != "")


def piece(c: Column, separator: str, index: int) -> Column:
    """One part; negative from the end; null beyond the ends."""
    return F.try_element_at(pieces(c, separator), F.lit(index + 1 if index >= 0 else index))


_ONE: dict[str, Callable[[Column, Transform], Column]] = {
    "trim": lambda c, t: F.btrim(c, F.lit(t.chars)) if t.chars else strip(c),
    "collapse_space": lambda c, t: collapse_space(c),
    "lower": lambda c, t: F.lower(c),
    "upper": lambda c, t: F.upper(c),
    "title": lambda c, t: title(c),
    "strip_prefix": lambda c, t: F.when(F.startswith(c, F.lit(t.value)), F.substring(c, F.lit(len(t.value) + 1), F.length(c))).otherwise(c) if t.value else c,
    "strip_suffix": lambda c, t: F.when(F.endswith(c, F.lit(t.value)), F.substring(c, F.lit(1), F.length(c) - len(t.value))).otherwise(c) if t.value else c,
    "replace": lambda c, t: F.replace(c, F.lit(t.pattern), F.lit(t.value)) if t.pattern else c,
    "regex_replace": lambda c, t: regex_replace(c, t.pattern, t.value),
    "prepend": lambda c, t: F.concat(F.lit(t.value), c),
    "append": lambda c, t: F.concat(c, F.lit(t.value)),
    "decimal_comma": lambda c, t: decimal_comma(c),
    "digits": lambda c, t: F.regexp_replace(c, r"(?U)[^\d.\-]", ""),
    "default": lambda c, t: F.when(strip(c) != "", c).otherwise(F.lit(t.value)),
}
KINDS = (*_ONE, "split")


def one(c: Column, t: Transform) -> Column:
    """A transform of one value; null stays null."""
    if t.kind == "split":
        if t.index is None:
            raise ValueError("a split without an index makes a list; use chain()")
        return piece(c, t.pattern, t.index)
    return _ONE[t.kind](c, t)


def chain(values: Column, transforms: Sequence[Transform]) -> Column:
    """An array of values through a chain; what becomes null or empty is dropped, and a split into a list ends it."""
    steps: list[Transform] = []
    for t in transforms:
        if t.kind == "split" and t.index is None:
            many = F.flatten(F.transform(F.filter(_through(values, steps), lambda x: x.isNotNull()), lambda x: pieces(x, t.pattern)))
            return F.filter(many, lambda x: x.isNotNull() & (x != ""))
        steps.append(t)
    return F.filter(_through(values, steps), lambda x: x.isNotNull() & (x != ""))


def _through(values: Column, steps: Sequence[Transform]) -> Column:
    def apply(x: Column) -> Column:
        for t in steps:
            x = one(x, t)
        return x

    return F.transform(values, apply) if steps else values
