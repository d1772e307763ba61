"""Run-to-run diffs and the dataset: one row per key across runs, with a bounded history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.values import dataset_id, row_key

IMPLICIT = ("_url", "_page_url", "_fetched_at", "_provenance", "_tier")
HISTORY = 20


def _text(df: DataFrame, c: str) -> Column:
    """A value as JSON text, so that types may differ between runs."""
    t = df.schema[c].dataType
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.col(c))
    return F.col(c).cast("string")


def keyed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """_key, _url and a map of the fields as text; of a repeated key the last row by order."""
    values = [x for f in fields for x in (F.lit(f), _text(df, f))]
    body = F.create_map(*values) if values else F.create_map().cast("map<string,string>")
    url = F.col("_url") if "_url" in df.columns else F.lit("")
    slim = df.select(row_key(*keys).alias("_key"), url.alias("_url"), body.alias("_row"), F.struct(*order).alias("_at"))
    w = Window.partitionBy("_key").orderBy(F.col("_at").desc())
    return slim.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("_key", "_url", "_row")


def _changed(a: Column, b: Column) -> Column:
    """map<field, struct<old, new>> where two maps differ; an absent field is null."""
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    pairs = F.transform(names, lambda k: F.struct(k.alias("k"), F.struct(F.try_element_at(a, k).alias("old"), F.try_element_at(b, k).alias("new")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: ~p["v"]["old"].eqNullSafe(p["v"]["new"])))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], partial: bool = False) -> DataFrame:
    """Change feed: _key, change (added, removed, changed, unchanged), diff, old_row, new_row.

    A partial run proves nothing about what it did not see, so it removes nothing.
    """
    fields = [[c for c in d.columns if c not in IMPLICIT and c not in keys and c not in order] for d in (old, new)]
    a, b = keyed(old, keys, fields[0], order), keyed(new, keys, fields[1], order)
    both = a.select("_key", F.col("_row").alias("old_row")).join(b.select("_key", F.col("_row").alias("new_row")), "_key", "full_outer")
    d = _changed(F.col("old_row"), F.col("new_row"))
    change = F.when(F.col("old_row").isNull(), "added").when(F.col("new_row").isNull(), "removed").when(F.size(d) > 0, "changed").otherwise("unchanged")
    feed = both.select("_key", change.alias("change"), F.when(F.col("old_row").isNotNull() & F.col("new_row").isNotNull(), d).alias("diff"), "old_row", "new_row")
    return feed.where("change <> 'removed'") if partial else feed


def diff_counts(feed: DataFrame) -> DataFrame:
    of = lambda c: F.count_if(F.col("change") == c).alias(c)
    return feed.agg(F.count("old_row").alias("old_count"), F.count("new_row").alias("new_count"), of("added"), of("removed"), of("changed"), of("unchanged"))


def diff_samples(feed: DataFrame, most: int = 25) -> DataFrame:
    """The first rows of each kind of change, by key."""
    w = Window.partitionBy("change").orderBy("_key")
    return feed.where("change <> 'unchanged'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


_DATASET = "id string, recipe_id string, key string, url string, data map<string,string>, first_seen timestamp, last_seen timestamp, last_changed timestamp, changes int, runs int, gone boolean, history array<struct<at timestamp, diff map<string,struct<old string, new string>>>>"


def run_ids(rows: DataFrame, recipe_id: str, keys: Sequence[str]) -> DataFrame:
    """The dataset ids of a run's rows."""
    return rows.select(dataset_id(recipe_id, row_key(*keys)).alias("id")).distinct()


def empty_dataset(spark) -> DataFrame:
    return spark.createDataFrame([], _DATASET)


def _bounded(history: Column, most: int) -> Column:
    """The last entries; slice() from the end gives nothing of a shorter array."""
    return F.when(F.size(history) <= most, history).otherwise(F.slice(history, F.lit(-most), F.lit(most)))


def fold(dataset: DataFrame, rows: DataFrame, recipe_id: str, keys: Sequence[str], order: Sequence[str], now: Column, partial: bool = False, history: int = HISTORY) -> DataFrame:
    """The dataset after a run, with `action` per row: added, changed, unchanged, gone or null.

    One full outer join on the dataset's id; the caller writes the result to a new place
    (`dataset_store` keeps it in buckets, which a run of few keys leaves where they are).
    """
    mine, others = dataset.where(F.col("recipe_id") == recipe_id), dataset.where(F.col("recipe_id") != recipe_id)
    out = fold_own(mine, rows, recipe_id, keys, order, now, partial, history)
    return out.unionByName(others.withColumn("action", F.lit(None).cast("string")))


def fold_own(mine: DataFrame, rows: DataFrame, recipe_id: str, keys: Sequence[str], order: Sequence[str], now: Column, partial: bool = False, history: int = HISTORY) -> DataFrame:
    """`fold` where all rows of the dataset are this recipe's."""
    fields = [c for c in rows.columns if not c.startswith("_") and c not in order]
    run = keyed(rows, keys, fields, order)
    run = run.select(dataset_id(recipe_id, F.col("_key")).alias("_id"), "_key", "_row", F.coalesce("_url", F.lit("")).alias("_url"))
    j = mine.join(run, F.col("id") == F.col("_id"), "full_outer")
    known, seen = F.col("id").isNotNull(), F.col("_id").isNotNull()
    # worked out once, below; several columns read it
    j = j.withColumn("_d", _changed(F.col("data"), F.col("_row")))
    d = F.col("_d")
    differs = F.coalesce(known & seen & (F.size(d) > 0), F.lit(False))
    lost = known & ~seen & ~F.col("gone") & F.lit(not partial)
    when = now.cast("timestamp")
    longer = F.concat("history", F.array(F.struct(when.alias("at"), d.alias("diff"))))
    none = F.array().cast(T._parse_datatype_string(_DATASET)["history"].dataType)
    return j.select(
        F.coalesce("id", "_id").alias("id"),
        F.lit(recipe_id).alias("recipe_id"),
        F.coalesce("key", "_key").alias("key"),
        F.when(seen & ~known, F.col("_url")).when(differs & (F.col("_url") != ""), F.col("_url")).otherwise(F.col("url")).alias("url"),
        F.when(seen & (~known | differs), F.col("_row")).otherwise(F.col("data")).alias("data"),
        F.when(known, F.col("first_seen")).otherwise(when).alias("first_seen"),
        F.when(seen, when).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(differs, when).otherwise(F.col("last_changed")).alias("last_changed"),
        (F.coalesce("changes", F.lit(0)) + differs.cast("int")).alias("changes"),
        (F.coalesce("runs", F.lit(0)) + seen.cast("int")).alias("runs"),
        F.when(seen, F.lit(False)).when(lost, F.lit(True)).otherwise(F.col("gone")).alias("gone"),
        F.when(differs, _bounded(longer, history)).otherwise(F.coalesce("history", none)).alias("history"),
        F.when(seen & ~known, "added").when(differs, "changed").when(seen, "unchanged").when(lost, "gone").alias("action"),
    )


def fold_counts(folded: DataFrame) -> DataFrame:
    return folded.where("action is not null").groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def upsert(table: DataFrame, entries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """table with the last entry of each key put in; columns of the table."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    last = entries.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    kept = table.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.select(*[c for c in table.columns if c in last.columns]), allowMissingColumns=True)
