"""Repair of selectors that stopped matching: a second pass over the pages of fields whose fill collapsed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dom import analysis
from ..functions import pages as expr
from ..plans.recipe import Extractor, Recipe

FINGERPRINT = "tag string, id string, classes array<string>, attrs map<string,string>, path array<string>, text struct<len int, digits boolean, currency boolean, words int>, shape string, leaf boolean, href boolean, src boolean"
_ROW = f"item int, selector string, {FINGERPRINT}"


def collapsed(rates: DataFrame, low: float = 0.25, least: int = 3) -> DataFrame:
    """The first page of each field whose fill is low: field, _page_url.  rates: _page_url, field, rate, items, page_no."""
    w = Window.partitionBy("field").orderBy("page_no")
    return rates.where((F.col("rate") <= low) & (F.col("items") >= least)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("field", "_page_url")


def _candidates(container: str):
    @F.pandas_udf(f"array<struct<{_ROW}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda t: analysis.candidates(t, container))

    return find


def relocate(pages: DataFrame, container: str, fingerprints: DataFrame) -> DataFrame:
    """field, selector, score, fill: the likeliest new place of each field's element.

    fingerprints: field, fp (struct as FINGERPRINT), with one row per field, so it is small and bounded
    by the recipe.  The similarity is an expression; only the trees are Python.
    """
    found = pages.select("url", F.explode(_candidates(container)(F.col("html"))).alias("c"))
    items = found.groupBy("url").agg((F.max("c.item") + 1).alias("items")).agg(F.sum("items").alias("items"))
    pairs = found.crossJoin(F.broadcast(fingerprints))
    scored = pairs.select("url", "field", "c.item", "c.selector", expr.similarity(F.col("fp"), F.col("c")).alias("s"))
    first = scored.groupBy("field", "selector", "url", "item").agg(F.max("s").alias("s"))
    by = first.groupBy("field", "selector").agg(F.avg("s").alias("score"), F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(items))
    by = by.withColumn("fill", F.col("hits") / F.col("items")).where((F.col("score") >= analysis.SCORE) & (F.col("fill") >= analysis.FILL))
    w = Window.partitionBy("field").orderBy((F.col("score") * 0.6 + F.col("fill") * 0.4).desc(), F.length("selector"), "selector")
    return by.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("field", "selector", F.round("score", 4).alias("score"), F.round("fill", 4).alias("fill"))


def patched(recipe: Recipe, repairs: dict[str, str]) -> Recipe:
    """The recipe with the repaired selectors in front and the old ones as alternates."""
    out = recipe.model_copy(deep=True)
    for f in out.fields:
        if f.name in repairs:
            old = f.extract
            f.extract = Extractor(css=repairs[f.name], attr=old.attr, regex=old.regex, template=old.template, all=old.all)
            f.alternates = [old, *f.alternates]
    return out
