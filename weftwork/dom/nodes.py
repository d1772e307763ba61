"""Pages as a table of nodes: a row per element and per text, numbered so that what lies inside what is a comparison of numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, MapType, StringType, StructType

from .analysis import step
from .tree import Node, parse

TEXT = "#text"
_COLUMNS = {"pre": IntegerType(), "post": IntegerType(), "depth": IntegerType(), "parent": IntegerType(), "place": IntegerType(), "tag": StringType(), "step": StringType(), "attrs": MapType(StringType(), StringType()), "own": StringType()}


def numbered(root: Node) -> list[tuple]:
    """(pre, post, depth, parent, place, tag, step, attrs, own) in document order, by a stack: pages nest as deep as they like."""
    out: list[list] = []
    stack: list[tuple[Node | str | int, int, int, int]] = [(k, 0, -1, p) for p, k in reversed(list(enumerate(root.kids)))]
    while stack:
        k, depth, parent, place = stack.pop()
        if isinstance(k, int):  # all of an element's descendants are numbered
            out[k][1] = len(out) - 1
        elif isinstance(k, str):
            out.append([len(out), len(out), depth, parent, place, TEXT, TEXT, None, k])
        else:
            me = len(out)
            out.append([me, me, depth, parent, place, k.tag, step(k), k.attrs, "".join(x for x in k.kids if isinstance(x, str))])
            stack.append((me, 0, 0, 0))
            stack += [(x, depth + 1, me, p) for p, x in reversed(list(enumerate(k.kids)))]
    return [tuple(r) for r in out]


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pre, post, depth, parent, place, tag, step, attrs, own: one parse a page, all else is left to tables.

    pre numbers elements and texts in document order; post is the last number inside; so a lies in b where
    b.pre < a.pre <= b.post.  parent is the pre of the element around (-1 at the top), place the position among its
    children.  own is a text, or an element's own texts joined.  A null or empty page has no rows.
    """
    kind = pages.schema[key].dataType
    schema = StructType().add(key, kind)
    for c, t in _COLUMNS.items():
        schema = schema.add(c, t)
    arrow = to_arrow_schema(schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1)):
                rows = numbered(parse(text.as_py()))
                if rows:
                    cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
                    yield pa.record_batch([b.column(0).take(pa.array([i] * len(rows))), *cols], schema=arrow)

    return pages.select(F.col(key), F.col(html)).mapInArrow(work, schema)
