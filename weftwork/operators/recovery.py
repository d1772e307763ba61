"""Pages that gave no rows, read again by an outside function within a budget of money per run.

A run's failed pages are few by construction (the quarantine keeps the first fifty), so a run is
one group of rows: its pages are taken in the order in which they failed, each is charged, and the
first page that finds nothing left is skipped, with all after it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import coerce_one
from ..plans.recipe import Field, Recipe

#: Gets url, kind, text and the JSON schema of what is asked for; returns the values and what they cost.
Reader = Callable[[str, str, str, dict], tuple[Any, float]]
STATUS = "run_id string, page_id string, url string, kind string, status string, rows_added int, cost double, error string, answers array<string>"
# The JSON type of each field type; all others are strings.
JSON_TYPES = {"number": "number", "price": "number", "bool": "boolean", "list": "array"}


def _asked(recipe: Recipe, kind: str) -> list[Field]:
    return [f for f in recipe.fields if (f.scope == "detail") == (kind == "detail") and f.extract.source != "llm"]


def field_spec(recipe: Recipe, kind: str = "list") -> list[dict]:
    """name, type, description and the allowed values of the fields of a kind of page."""
    return [{"name": f.name, "type": f.type, "description": f.description} | ({"enum": f.enum} if f.enum else {}) for f in _asked(recipe, kind)]


def json_schema(recipe: Recipe, kind: str = "list") -> dict:
    """What an answer must look like: every field is there, and any may be null."""
    properties: dict[str, dict] = {}
    for f in _asked(recipe, kind):
        name = JSON_TYPES.get(f.type, "string")
        own: dict = {"enum": [*f.enum, None]} if f.enum else {"type": [name, "null"]}
        if name == "array":
            own["items"] = {"type": "string"}
        properties[f.name] = own | ({"description": f.description} if f.description else {})

    def closed(inside: dict[str, dict]) -> dict:
        return {"type": "object", "properties": inside, "required": list(inside), "additionalProperties": False}

    return closed(properties) if kind == "detail" else closed({"items": {"type": "array", "items": closed(properties)}})


def recover(failed: DataFrame, recipe: Recipe, reader: Reader, order: Sequence[str] = ("created_at", "page_id")) -> DataFrame:
    """Of pending pages (run_id, page_id, url, kind, text, status, order columns) what became of them, with answers as JSON rows."""
    enabled, budget = recipe.fallback.llm_enabled, recipe.limits.per_run_llm_budget_usd
    schemas = {k: json_schema(recipe, k) for k in ("list", "detail")}
    names = [f.name for f in T._parse_datatype_string(STATUS).fields]

    def one(page: Any, spent: float) -> tuple[str, list, float, str | None]:
        if not enabled:
            return "skipped", [], 0.0, "fallback disabled in recipe"
        if budget and spent >= budget:
            return "skipped", [], 0.0, "run budget exhausted"
        if not (page.text or "").strip():
            return "failed", [], 0.0, "empty page"
        try:
            found, cost = reader(page.url, page.kind, page.text, schemas[page.kind])
        except Exception as e:  # noqa: BLE001 - whatever an outside function raises is the page's error
            return "failed", [], 0.0, str(e)[:300]
        if page.kind == "detail":
            answers = [found] if isinstance(found, dict) else []
        else:
            answers = found.get("items") if isinstance(found, dict) else found
        answers = [a for a in answers if isinstance(a, dict)] if isinstance(answers, list) else []
        return "recovered" if answers else "failed", answers, float(cost), None if answers else "no rows returned"

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        spent, out = 0.0, []
        for page in pages.sort_values(list(order)).itertuples(index=False):
            status, answers, cost, error = one(page, spent)
            spent += cost
            out.append((page.run_id, page.page_id, page.url, page.kind, status, len(answers), cost, error, [json.dumps(a, ensure_ascii=False) for a in answers]))
        return pd.DataFrame(out, columns=names)

    slim = failed.where(F.col("status") == "pending").select(*dict.fromkeys(["run_id", "page_id", "url", "kind", "text", *order]))
    return slim.groupBy("run_id").applyInPandas(run, STATUS)


def recovered_rows(found: DataFrame, recipe: Recipe, kind: str = "list", origin: str = "llm") -> DataFrame:
    """The answers as typed rows with _url, _page_url and provenance; names that no field has are left out."""
    fields = _asked(recipe, kind)
    each = found.where((F.col("kind") == kind) & (F.col("status") == "recovered")).select("run_id", "url", F.posexplode("answers").alias("i", "answer"))
    body = F.from_json("answer", "map<string,string>")
    rows = each.withColumn("_m", body)
    given = {f.name: coerce_one(F.try_element_at("_m", F.lit(f.name)), f.type, f.enum or ()) for f in fields}
    rows = rows.select("run_id", "url", "i", *[c.alias(n) for n, c in given.items()])
    link = next((f.name for f in fields if f.type == "url"), None)
    made = F.concat("url", F.lit(f"#{origin}-"), (F.col("i") + 1).cast("string"))
    filled = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in given]), lambda x: x.isNotNull())
    provenance = F.map_from_entries(F.transform(filled, lambda n: F.struct(n, F.lit(origin))))
    return rows.withColumns({"_url": F.coalesce(F.col(link), made) if link else made, "_page_url": F.col("url"), "_provenance": provenance}).drop("url", "i")


def overlay(base: DataFrame, found: DataFrame, key: str, fields: Sequence[str], origin: str = "llm") -> DataFrame:
    """Rows of the list with what their detail pages gave on a second reading; values that were found win, and say so."""
    from .rows import write_back

    return write_back(base, found, key, fields, origin)


def agent_rows(rows: DataFrame, recipe: Recipe, page_url: Column) -> DataFrame:
    """Rows of texts that an agent hands in: unknown columns go, values take their fields' types, the origin is `agent`."""
    fields = [f for f in recipe.fields if f.name in rows.columns]
    named = F.filter(F.array(*[F.when(F.col(f.name).isNotNull(), F.lit(f.name)) for f in fields]), lambda x: x.isNotNull())
    origin = F.map_from_entries(F.transform(named, lambda n: F.struct(n, F.lit("agent"))))
    return rows.select(*[coerce_one(F.col(f.name), f.type, f.enum or ()).alias(f.name) for f in fields], page_url.alias("_page_url"), origin.alias("_provenance"))
