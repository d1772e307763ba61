"""What counts as empty, and the keys of rows, datasets and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Between the parts of a dataset key (a fixed value).
SEPARATOR = "␟"


def is_filled(c: Column, dtype: T.DataType) -> Column:
    """False for null, the empty string and the empty list; 0 and false are filled."""
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(dtype, T.ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def row_key(*columns: Column | str) -> Column:
    """The key of diffs and datasets: parts as text, null as 'None'."""
    return F.concat_ws(SEPARATOR, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("None")) for c in columns])


def dataset_id(recipe_id: Column | str, key: Column) -> Column:
    owner = F.lit(recipe_id) if isinstance(recipe_id, str) else recipe_id
    return F.substring(F.sha1(F.concat(owner, F.lit("|"), key)), 1, 24)


def content_hash(body: Column) -> Column:
    return F.sha1(body)
