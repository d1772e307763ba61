"""Which pages to read again, and the state of pages that decides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import dataset_id


def stale(fetched_at: Column, now: Column, days: int | None) -> Column:
    """Never with no limit; always where the time is missing or unreadable."""
    if days is None:
        return F.lit(False)
    at = fetched_at.try_cast("timestamp")
    return F.coalesce(F.timestamp_diff("DAY", at, now.cast("timestamp")) >= days, F.lit(True))


def decide(pages: DataFrame, state: DataFrame, now: Column, days: int | None = None, enabled: bool = True) -> DataFrame:
    """pages with `decision`: lastmod, not_modified, same_hash, or read.

    pages: url, lastmod, status, html.  The state is joined by url before any page is parsed.
    """
    prior = state.select(F.col("url").alias("_s_url"), F.col("lastmod").alias("_s_lastmod"), F.col("content_hash").alias("_s_hash"), F.col("fetched_at").alias("_s_at"))
    j = pages.join(prior, F.col("url") == F.col("_s_url"), "left")
    same_mod = (F.coalesce("lastmod", F.lit("")) != "") & (F.col("lastmod") == F.col("_s_lastmod")) & ~stale(F.col("_s_at"), now, days)
    same_hash = (F.coalesce("_s_hash", F.lit("")) != "") & (F.sha1("html") == F.col("_s_hash"))
    known = F.col("_s_url").isNotNull() & F.lit(enabled)
    why = F.when(known & same_mod, "lastmod").when(F.col("status") == 304, "not_modified").when(known & same_hash, "same_hash").otherwise("read")
    return j.withColumn("decision", why).drop("_s_url", "_s_lastmod", "_s_hash", "_s_at")


def state_entries(decided: DataFrame, recipe_id: str, run_id: str, now: Column) -> DataFrame:
    """What a run writes to the page state; skipped pages carry status 304 and no hash of their own."""
    skipped = F.col("decision") != "read"
    return decided.where("url <> ''").select(
        dataset_id(recipe_id, F.col("url")).alias("id"),
        F.lit(recipe_id).alias("recipe_id"),
        "url",
        "lastmod",
        F.when(~skipped, F.sha1("html")).alias("content_hash"),
        F.when(skipped, F.lit(304)).otherwise(F.col("status")).cast("int").alias("status"),
        F.lit(run_id).alias("run_id"),
        now.cast("timestamp").alias("fetched_at"),
    )


def is_partial(decided: DataFrame) -> bool:
    """A run that skipped a page has not seen everything."""
    return bool(decided.where("decision <> 'read'").limit(1).count())
