"""Keep-first de-duplication, budgets, the stop on old items, and enrichment by detail pages.

Order is never that of arrival: callers name the columns that give it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.values import is_filled
from ..sources import places


def _empty(df: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & ~is_filled(F.col(k), df.schema[k].dataType)
    return out


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; rows whose key is empty throughout all stay.

    Those rows bypass the shuffle by key, so they are no hot group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    blank = _empty(df, keys)
    first = df.where(~blank).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return first.unionByName(df.where(blank))


def dedupe_against(df: DataFrame, seen: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """dedupe(), and without rows whose key an earlier run has written."""
    on = F.lit(True)
    old = seen.select(*[F.col(k).alias(f"_seen_{k}") for k in keys]).distinct()
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_seen_{k}"))
    fresh = df.where(~_empty(df, keys)).join(old, on, "left_anti")
    return dedupe(fresh.unionByName(df.where(_empty(df, keys))), keys, order)


def numbered(df: DataFrame, order: Sequence[str | Column], after: int = 0) -> DataFrame:
    """Rows with n = after + 1, 2, ... in order: ranks inside range partitions, and their running counts.

    A window over everything would sort the whole table in one task.  The dealt rows are written: bounds of ranges come
    from a sample, so two readers of a plan need not deal the rows alike.
    """
    spark, folder = df.sparkSession, places.shared_folder(df.sparkSession, "numbered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"_part": F.shiftright("_m", 33), "_own": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    dealt.write.parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("n", F.col("_before") + F.col("_own") + after + 1).drop("_part", "_own", "_before")


def limit_items(df: DataFrame, most: int, order: Sequence[str | Column]) -> DataFrame:
    """Exactly the first rows; a top-k, no full sort."""
    return df.orderBy(*order).limit(most)


def limit_pages(df: DataFrame, pages: int, page_no: str = "page_no", start: int = 1) -> DataFrame:
    return df.where(F.col(page_no) < start + pages)


def until_nothing_new(df: DataFrame, keys: Sequence[str], page_no: str = "page_no", walk: Sequence[str] = ()) -> DataFrame:
    """Rows of a page walk up to, and without, the first page all of whose keys came before.

    walk: columns that tell walks apart; without them the table is one walk.
    """
    first = df.groupBy(*walk, *keys).agg(F.min(page_no).alias("_first"))
    on = F.lit(True)
    renamed = first.select(*[F.col(c).alias(f"_k_{c}") for c in (*walk, *keys)], "_first")
    for c in (*walk, *keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    marked = df.join(renamed, on).drop(*[f"_k_{c}" for c in (*walk, *keys)])
    stale = marked.groupBy(*walk, page_no).agg(F.count_if(F.col("_first") == F.col(page_no)).alias("_new")).where("_new = 0")
    stop = stale.groupBy(*walk).agg(F.min(page_no).alias("_stop"))
    named = stop.select(*[F.col(c).alias(f"_w_{c}") for c in walk], "_stop")
    same = F.lit(True)
    for c in walk:
        same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    joined = marked.join(named, same, "left").drop(*[f"_w_{c}" for c in walk]) if walk else marked.crossJoin(F.broadcast(stop.agg(F.min("_stop").alias("_stop"))))
    return joined.where(F.col("_stop").isNull() | (F.col(page_no) < F.col("_stop"))).drop("_first", "_stop")


def enrich(rows: DataFrame, details: DataFrame, fields: Sequence[str], link: str = "_detail_url", url: str = "url", budget: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows with the fields of their detail pages, which win even when null.

    details: url, the fields, _provenance, and if it is there `blocked`.  A blocked page gives the row
    `_detail: blocked`, a missing one `_detail: missing`; no row is lost.  With a budget only the first
    rows by `order` (names of columns that tell rows apart) are looked up.
    """
    # of pages stored more than once the last fetched; where no time is known, the one whose values come first
    at = [F.col(c).desc_nulls_last() for c in ("fetched_at", "_fetched_at") if c in details.columns]
    latest = Window.partitionBy(url).orderBy(*at, *[F.col(f).cast("string").asc_nulls_last() for f in fields if not isinstance(details.schema[f].dataType, T.VariantType)])
    one = details.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")
    mine = [F.col(f).alias(f"_d_{f}") for f in fields]
    blocked = F.col("blocked") if "blocked" in details.columns else F.lit(False)
    one = one.select(F.col(url).alias("_d_url"), *mine, F.col("_provenance").alias("_d_prov"), blocked.alias("_d_blocked"))
    if budget is not None:
        # the last row within the budget comes from a top-k; one row is broadcast, no full sort
        last = rows.select(F.struct(*order).alias("_o")).orderBy("_o").limit(budget).agg(F.max("_o").alias("_last"))
        rows = rows.crossJoin(F.broadcast(last)).withColumn("_in", F.col(link).isNotNull() & F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))).drop("_last")
    else:
        rows = rows.withColumn("_in", F.col(link).isNotNull())
    # rows that ask for nothing are dealt by what they hold: as nulls they would all go to one task
    plain = [F.col(f.name) for f in rows.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    asked = F.when(F.col("_in"), F.concat(F.lit("="), F.col(link))).otherwise(F.concat(F.lit("-"), F.xxhash64(*plain).cast("string")))
    joined = rows.withColumn("_asked", asked).join(one.withColumn("_d_asked", F.concat(F.lit("="), F.col("_d_url"))), F.col("_asked") == F.col("_d_asked"), "left").drop("_asked", "_d_asked")
    good = F.col("_d_url").isNotNull() & ~F.col("_d_blocked")
    state = F.when(F.col("_d_blocked"), "blocked").when(F.col("_in") & F.col("_d_url").isNull(), "missing")
    kept = F.map_filter("_provenance", lambda k, v: ~F.coalesce(F.map_contains_key("_d_prov", k), F.lit(False)) & (k != "_detail"))
    prov = F.when(good, F.map_concat(kept, F.col("_d_prov"))).when(state.isNotNull(), F.map_concat(F.map_filter("_provenance", lambda k, v: k != "_detail"), F.create_map(F.lit("_detail"), state))).otherwise(F.col("_provenance"))
    out = joined.withColumns({f: F.when(good, F.col(f"_d_{f}")).otherwise(F.col(f) if f in rows.columns else F.lit(None)) for f in fields})
    out = out.withColumn("_provenance", prov).withColumn("_url", F.when(good, F.col("_d_url")).otherwise(F.col("_url")))
    return out.drop("_d_url", "_d_prov", "_d_blocked", "_in", *[f"_d_{f}" for f in fields])


def write_back(rows: DataFrame, values: DataFrame, key: str, fields: Sequence[str], origin: str = "llm") -> DataFrame:
    """Rows with values that an outside function found, by key; what it did not find stays."""
    got = values.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_v_{f}") for f in fields])
    out = rows.join(got, F.col(key) == F.col("_k"), "left")
    named = F.filter(F.array(*[F.when(F.col(f"_v_{f}").isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    if "_provenance" in rows.columns:
        found = F.map_from_entries(F.transform(named, lambda n: F.struct(n, F.lit(origin))))
        out = out.withColumn("_provenance", F.map_concat(F.map_filter("_provenance", lambda k, v: ~F.array_contains(named, k)), found))
    return out.withColumns({f: F.coalesce(f"_v_{f}", f) for f in fields}).drop("_k", *[f"_v_{f}" for f in fields])
