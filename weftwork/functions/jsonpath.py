"""JSON paths compiled to VARIANT expressions; every path gives an array of hits.

a.b[0][*] walks keys, indexes (negative from the end) and wildcards; a leading $ is the document.
A key on an array means that key of each of its objects.  A wildcard on an object gives its values,
in key order, as variants keep no other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .told import bound

_PART = re.compile(r"\[(?P<index>\*|-?\d+)\]|(?P<key>[^.\[\]]+)")
ROOTS = ("", "$", ".")


def parts(path: str) -> list[str | int | None]:
    """Keys as text, indexes as numbers, None for the wildcard."""
    path = path.strip()
    if path.startswith("$"):
        path = path[1:]
    return [m["key"] if m["key"] else None if m["index"] == "*" else int(m["index"]) for m in _PART.finditer(path)]


def is_array(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def is_object(v: Column) -> Column:
    """Whether it is read as a struct without fields; its schema would be that of everything inside."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def elements(v: Column) -> Column:
    """The elements of an array; null for all else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _some(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _key(name: str) -> str:
    return f'["{name}"]' if "'" in name else f"['{name}']"


def _step(node: Column, part: str | int | None) -> Column:
    if part is None:
        inside = F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
        return F.coalesce(elements(node), inside, F.array().cast("array<variant>"))
    if isinstance(part, int):
        items = elements(node)
        place = F.lit(part) if part >= 0 else F.size(items) + part
        return _some(F.array(F.get(items, place)))
    at = "$" + _key(part)
    return F.coalesce(_some(F.transform(elements(node), lambda e: F.try_variant_get(e, at, "variant"))), _some(F.array(F.try_variant_get(node, at, "variant"))))


def _walk(part: str | int | None) -> Callable[[Column], Column]:
    return lambda node: _step(node, part)


def looked_up(document: Column, path: str) -> Column | None:
    """The one hit of a path of keys and indexes as text; null if it is met only by walking, or not at all.  None for other paths."""
    steps = parts(path)
    if path.strip() in ROOTS or not steps or any(p is None or isinstance(p, int) and p < 0 for p in steps):
        return None
    return F.try_variant_get(document, "$" + "".join(_key(p) if isinstance(p, str) else f"[{p}]" for p in steps), "string")


def resolve(document: Column, path: str) -> Column:
    """array<variant> of the hits.

    The keys and indexes that a path begins with are looked up at once; only where a key meets an array on the way, or an
    index is counted from the end, are they walked one by one.
    """
    if path.strip() in ROOTS:
        return F.array(document)
    steps = parts(path)
    plain = next((i for i, p in enumerate(steps) if p is None or isinstance(p, int) and p < 0), len(steps))
    at = ["$"]
    for p in steps[:plain]:
        at.append(at[-1] + (_key(p) if isinstance(p, str) else f"[{p}]"))

    def found_in(v: Column) -> Column:
        hit = F.try_variant_get(v, at[-1], "variant")
        found = F.when(hit.isNotNull(), _walked(F.array(hit), steps[plain:]))
        # a look-up that finds nothing is dear (Spark leaves it by an exception), so this is asked last
        met = [F.try_variant_get(v, a, "array<variant>").isNotNull() for a, p in zip(at, steps[:plain], strict=False) if isinstance(p, str)]
        found = found.when(reduce(or_, met), _walked(F.array(v), steps)) if met else found
        return found.otherwise(F.array().cast("array<variant>"))

    return bound(document, found_in) if plain else _walked(F.array(document), steps)


def _walked(nodes: Column, steps: list[str | int | None]) -> Column:
    for part in steps:
        nodes = F.flatten(F.transform(nodes, _walk(part)))
    return F.coalesce(nodes, F.array().cast("array<variant>")) if steps else nodes


def first(document: Column, path: str) -> Column:
    return F.get(resolve(document, path), F.lit(0))


def as_text(v: Column) -> Column:
    """Scalars as their text, null for JSON null, objects and arrays as JSON."""
    return F.when(F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def texts(document: Column, path: str) -> Column:
    """array<string> of the hits; a hit that is an array gives its elements."""
    flat = F.flatten(F.transform(resolve(document, path), lambda v: F.coalesce(elements(v), F.array(v))))
    return F.filter(F.transform(flat, as_text), lambda x: x.isNotNull())


def body_map(body: Column) -> Column:
    """map<string,variant>: the document as `body`, and its top-level keys; a key named body wins."""
    keys = F.when(is_object(body), F.try_variant_get(body, "$", "map<string,variant>"))
    keys = F.coalesce(keys, F.create_map().cast("map<string,variant>"))
    alone = F.create_map(F.lit("body"), body)
    return F.when(F.map_contains_key(keys, "body"), keys).otherwise(F.map_concat(keys, alone))


def body_part(body: Column, name: str) -> Column:
    """What body_map has under a name."""
    own = F.try_variant_get(body, "$" + _key(name), "variant")
    return F.coalesce(own, body) if name == "body" else own
