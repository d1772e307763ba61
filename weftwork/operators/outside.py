"""Values from outside functions (a language model, a person): batched calls, budgets, and what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_filled
from ..plans.recipe import Field

BATCH = 20
Provider = Callable[[list[dict]], list[dict]]


def needs_values(rows: DataFrame, fields: Sequence[str]) -> Column:
    """Rows that lack a value the outside function is to give."""
    out = F.lit(False)
    for f in fields:
        out = out | ~is_filled(F.col(f), rows.schema[f].dataType)
        if "_provenance" in rows.columns:
            out = out | F.coalesce(F.try_element_at("_provenance", F.lit(f)) == "llm_pending", F.lit(False))
    return out


def call(rows: DataFrame, key: str, inputs: Sequence[str], fields: Sequence[str], provider: Provider, batch: int = BATCH) -> DataFrame:
    """key and the fields as text, for rows that need them; the provider sees some rows at a time.

    A provider returns one mapping per row, in order; a short answer leaves the rest empty, and a provider that raises
    leaves its rows empty (`answers` tries again and keeps what it was told).  The filter stands below the call,
    so full rows never leave the JVM.
    """
    wanted = rows.where(needs_values(rows, fields)).select(key, *[c for c in inputs if c != key])
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    got = provider(part.to_dict("records"))
                except Exception:  # noqa: BLE001 - any fault of the outside function is its own
                    got = []
                got = [*got, *[{}] * (len(part) - len(got))]
                yield pd.DataFrame({key: part[key].to_numpy(), **{f: [None if g.get(f) is None else str(g[f]) for g in got] for f in fields}})

    return wanted.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` string" for f in fields))


def typed(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Texts from outside as the types their fields declare."""
    from ..functions.coerce import coerce_one

    return df.withColumns({f.name: coerce_one(F.col(f.name), f.type, f.enum or ()) for f in fields if f.name in df.columns})


def known_only(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with known columns, and the names of those left out."""
    dropped = [c for c in df.columns if c not in fields and not c.startswith("_")]
    return df.drop(*dropped), dropped


def usage(calls: DataFrame, prices: Mapping[str, tuple[float, float]], default: tuple[float, float] = (3.0, 15.0)) -> DataFrame:
    """model, calls, tokens and cost: each model by the longest price prefix that fits its name, per million tokens."""
    rate_in, rate_out = F.lit(default[0]), F.lit(default[1])
    for prefix in sorted(prices, key=len):
        fits = F.startswith("model", F.lit(prefix))
        rate_in, rate_out = F.when(fits, F.lit(prices[prefix][0])).otherwise(rate_in), F.when(fits, F.lit(prices[prefix][1])).otherwise(rate_out)
    cost = (F.col("tokens_in") * rate_in + F.col("tokens_out") * rate_out) / 1e6
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))


def quarantine(pages: DataFrame, items: DataFrame, most: int = 50, by: str = "run_id") -> DataFrame:
    """Pages that gave no rows, the first of each run."""
    from pyspark.sql.window import Window

    none = pages.join(items.select("_page_url").distinct(), F.col("url") == F.col("_page_url"), "left_anti")
    w = Window.partitionBy(by).orderBy("url")
    return none.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r").withColumn("status", F.lit("pending"))


def append_recovered(items: DataFrame, found: DataFrame, order: Sequence[str]) -> DataFrame:
    """items with recovered rows after them, numbered on."""
    from .rows import numbered

    last = items.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return items.unionByName(numbered(found, list(order), after=last), allowMissingColumns=True)
