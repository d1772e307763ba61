"""Stored tables: recipe versions, dataset pages, failed pages, and what is counted over them.

Every change returns the table after it; the caller writes that to a new place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import dataset_id
from ..sources import formats, sinks

VERSIONS = "recipe_id string, version int, data string, note string, archived boolean, at timestamp"


# ---- recipes ------------------------------------------------------------------------------


def _newest(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("recipe_id").orderBy(F.col("version").desc())
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def current(versions: DataFrame, archived: bool = False) -> DataFrame:
    """The newest version of each recipe, the latest saved first; archived ones only when asked for."""
    now = _newest(versions)
    return (now if archived else now.where(~F.col("archived"))).orderBy(F.col("at").desc(), "recipe_id")


def save(versions: DataFrame, saved: DataFrame, now: Column) -> DataFrame:
    """versions with saved (recipe_id, data, note): the first save is version 1, a later one counts only if the data differ."""
    last = _newest(versions).select("recipe_id", F.col("version").alias("_v"), F.col("data").alias("_data"), F.col("archived").alias("_gone"))
    both = saved.join(last, "recipe_id", "left").where(F.col("_v").isNull() | (F.col("data") != F.col("_data")))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.col("note")).otherwise(F.when(F.col("_v").isNull(), "created").otherwise(""))
    new = both.select("recipe_id", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"), "data", note.alias("note"), F.coalesce("_gone", F.lit(False)).alias("archived"), now.cast("timestamp").alias("at"))
    return versions.unionByName(new)


def rollback(versions: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """versions with an old version (recipe_id, version) saved again as the newest."""
    old = versions.join(wanted, ["recipe_id", "version"]).select("recipe_id", "data", F.concat(F.lit("rollback to v"), F.col("version").cast("string")).alias("note"))
    return save(versions, old, now)


def archive(versions: DataFrame, recipes: DataFrame, gone: bool = True) -> DataFrame:
    """versions with the recipes named hidden, or shown again; nothing is lost."""
    marked = recipes.select("recipe_id").distinct().withColumn("_m", F.lit(True))
    return versions.join(marked, "recipe_id", "left").withColumn("archived", F.when(F.col("_m"), F.lit(gone)).otherwise(F.col("archived"))).select(versions.columns)


def export_fields(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """run_id and the field names of the recipe version it ran with, or of the newest where that version is gone."""
    exact = versions.select("recipe_id", F.col("version").alias("recipe_version"), F.col("data").alias("_exact"))
    newest = _newest(versions).select("recipe_id", F.col("data").alias("_newest"))
    both = runs.join(exact, ["recipe_id", "recipe_version"], "left").join(newest, "recipe_id", "left")
    names = F.from_json(F.coalesce("_exact", "_newest"), "fields array<struct<name string>>")
    return both.select("run_id", names["fields"]["name"].alias("fields"))


def export(items: DataFrame, fields: Sequence[str], path: str, fmt: str, meta: bool = True) -> None:
    """items to one of the formats, the recipe's fields first."""
    columns = sinks.column_order(fields, items.columns, meta)
    write = {"csv": sinks.csv_file, "json": sinks.json_file, "xlsx": sinks.xlsx_file, "jsonl": sinks.write_jsonl}.get(fmt.lower())
    if write is None:
        raise ValueError(f"no format {fmt!r}")
    write(items, path, columns)


# ---- dataset ------------------------------------------------------------------------------


def dataset_rows(dataset: DataFrame, recipe_id: str, include_gone: bool = True, since: Column | None = None) -> DataFrame:
    own = dataset.where(F.col("recipe_id") == recipe_id)
    own = own if include_gone else own.where(~F.col("gone"))
    return own if since is None else own.where(F.col("last_changed") >= since.cast("timestamp"))


def dataset_page(dataset: DataFrame, recipe_id: str, offset: int = 0, limit: int = 100, include_gone: bool = True, since: Column | None = None) -> tuple[int, DataFrame]:
    """How many rows fit, and a page of them, the last seen first; rows seen together are in the order of their keys."""
    own = dataset_rows(dataset, recipe_id, include_gone, since)
    page = own.orderBy(F.col("last_seen").desc(), "key").offset(offset).limit(limit)
    return own.count(), page.select("key", "url", "first_seen", "last_seen", "last_changed", "changes", "runs", "gone", "data")


def key_history(dataset: DataFrame, recipe_id: str, key: str) -> DataFrame:
    """at, diff of one key's changes."""
    own = dataset.where(F.col("id") == dataset_id(recipe_id, F.lit(key)))
    return own.select(F.explode("history").alias("h")).select("h.at", "h.diff")


def forget(table: DataFrame, values: Sequence[str], by: str = "recipe_id") -> DataFrame:
    """The table without the rows of the recipes (or runs, hosts, pages) named; a null name is never forgotten."""
    return table.where(~F.coalesce(F.col(by).isin(*values), F.lit(False)))


# ---- failed pages -------------------------------------------------------------------------


def page_failed(verdict: Column, status: Column) -> Column:
    """The page is blocked for good or answered with an error."""
    return F.coalesce(verdict, F.lit("ok")).isin("blocked", "failed") | (F.coalesce(status, F.lit(200)) >= 400)


def failed_pages(failed: DataFrame, run_id: str, status: str | None = None, limit: int = 200) -> DataFrame:
    own = failed.where(F.col("run_id") == run_id)
    own = own if status is None else own.where(F.col("status") == status)
    return own.orderBy("created_at", "page_id").limit(limit)


def failed_by_status(failed: DataFrame) -> DataFrame:
    return failed.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("pages"))


def failed_total(counts: DataFrame) -> DataFrame:
    return counts.groupBy("run_id").agg(F.sum("pages").alias("failed"))


def processing_summary(failed: DataFrame) -> DataFrame:
    """recovered, skipped and failed pages of each run."""
    return failed.groupBy("run_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("recovered", "skipped", "failed")])


# ---- counts -------------------------------------------------------------------------------


def sitemap_summary(entries: DataFrame, sample: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """urls, with_lastmod, newest and the first locations of sitemap entries (base, pos, loc, lastmod)."""
    dated = F.when(F.coalesce("lastmod", F.lit("")) != "", F.col("lastmod"))
    w = Window.partitionBy(*by).orderBy("base", "pos")
    first = F.when(F.col("_r") <= sample, F.struct(F.col("_r").alias("r"), F.col("loc").alias("loc")))
    ranked = entries.withColumn("_r", F.row_number().over(w))
    shown = F.transform(F.array_sort(F.collect_list(first)), lambda x: x["loc"])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("urls"), F.count(dated).alias("with_lastmod"), F.coalesce(F.max(dated), F.lit("")).alias("newest"), shown.alias("sample"))


def detail_ratio(rows: DataFrame, link: str = "_detail_url", by: Sequence[str] = ()) -> DataFrame:
    """items, those with a link to a detail page, and their share."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count(link).alias("with_link"))
    return out.withColumn("ratio", F.round(F.when(F.col("items") > 0, F.col("with_link") / F.col("items")).otherwise(0.0), 6))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """value (as text, null as None) and rows."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def first_heals(heals: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first repair of each field of a run."""
    w = Window.partitionBy("run_id", "field").orderBy(*order)
    return heals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def grid_columns(columns: Sequence[str], most: int = 8) -> list[str]:
    """What a table of items shows: plain columns, then the address, up to a number."""
    return [*[c for c in columns if not c.startswith("_")], *[c for c in columns if c == "_url"]][:most]


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def log_tail(spark: SparkSession, path: str, last: int = 200) -> DataFrame:
    """The last lines of a log in order (file, offset, line); no more than their bytes are read."""
    return formats.log_lines(spark, path, last=last).orderBy("file", "offset")
