"""Short texts for people and for links: times, schedules, diffs, names, and the shape of a document."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host


def iso(at: Column) -> Column:
    """A time in UTC with a Z, with microseconds where it has some; the session's zone gives the clock."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    text = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(utc, ".SSSSSS")
    return F.concat(text, F.when(micro == ".000000", "").otherwise(micro), F.lit("Z"))


def summary_line(added: Column, removed: Column, changed: Column, total: Column) -> Column:
    return F.format_string("+%d new · −%d gone · ~%d changed · %d total", added, removed, changed, total)


def describe(kind: Column, seconds: Column, cron: Column, zone: Column) -> Column:
    """How often a schedule runs, in words."""
    number = lambda by: F.floor(seconds / by).cast("string")
    every = (
        F.when(seconds % 86400 == 0, F.concat(F.lit("every "), number(86400), F.lit(" day(s)")))
        .when(seconds % 3600 == 0, F.concat(F.lit("every "), number(3600), F.lit(" hour(s)")))
        .otherwise(F.concat(F.lit("every "), number(60), F.lit(" min")))
    )
    named = F.concat(F.lit("cron "), F.coalesce(cron, F.lit("None")), F.when(F.coalesce(zone, F.lit("")) != "", F.concat(F.lit(" ("), zone, F.lit(")"))).otherwise(""))
    return F.when((kind == "interval") & (F.coalesce(seconds, F.lit(0)) > 0), every).otherwise(named)


def slug(text: Column) -> Column:
    """A name of small letters, digits and underscores that begins with a letter; at most 64 characters."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = F.regexp_replace(bare, "^([0-9])", "f$1")
    return F.substring(F.when(named == "", "field").otherwise(named), 1, 64)


def host_or_text(url: Column) -> Column:
    """The host of an address, or the text itself where it is none."""
    return F.coalesce(F.when(host(url) != "", host(url)), url)


def _shape(v: Any, depth: int, keys: int) -> Any:
    # The names of the types.
    name = {dict: "dict", list: "list", str: "str", bool: "bool", int: "int", float: "float", type(None): "NoneType"}[type(v)]
    if depth <= 0 or name not in ("dict", "list"):
        return name
    if name == "list":
        return [f"array[{len(v)}]", _shape(v[0], depth - 1, keys) if v else None]
    out = {k: _shape(v[k], depth - 1, keys) for k in list(v)[:keys]}
    return out | ({"…": f"+{len(v) - keys} keys"} if len(v) > keys else {})


def shape_summary(document: Column, depth: int = 4, keys: int = 25) -> Column:
    """JSON text of a document's keys, types and list lengths, in the order of the document; null where it is no JSON."""

    @F.pandas_udf("string")
    def shape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(_shape(json.loads(text), depth, keys), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        for b in batches:
            yield b.map(one)

    return shape(document)
