"""Fill rates, field profiles and the issues that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_filled

#: Levels of the issue codes; only errors make a recipe unsound.
LEVELS = {"required_missing": "error", "container_missing": "error", "empty_field": "warning", "low_fill": "warning", "constant_column": "info", "alternate_used": "info", "identical_columns": "warning", "sparse_empty": "info", "fallback_only_field": "info", "few_items": "warning"}


def fill_rates(rows: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, field, rate: the filled share, to three places, in one aggregation."""
    rates = [F.round(F.avg(is_filled(F.col(f), rows.schema[f].dataType).cast("double")), 3).alias(f) for f in fields]
    wide = rows.groupBy(*by).agg(*rates)
    return wide.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(F.col, fields)))).alias("field", "rate"))


def _shown(df: DataFrame, f: str) -> Column:
    nested = isinstance(df.schema[f].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    return F.to_json(f) if nested else F.col(f).cast("string")


def profile(rows: DataFrame, fields: Sequence[str], approximate: bool = False) -> DataFrame:
    """field, n_total, n_filled, fill_rate, n_distinct; one pass over the rows.

    approximate: HyperLogLog distinct counts, which keep one sketch per field and no values.
    """
    aggs = []
    for f in fields:
        ok = is_filled(F.col(f), rows.schema[f].dataType)
        value = F.when(ok, _shown(rows, f))
        distinct = F.approx_count_distinct(value, 0.01) if approximate else F.count_distinct(value)
        aggs += [F.count_if(ok).alias(f"filled_{f}"), distinct.alias(f"distinct_{f}")]
    wide = rows.agg(F.count(F.lit(1)).alias("n_total"), *aggs)
    stats = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"filled_{f}").alias("n_filled"), F.col(f"distinct_{f}").alias("n_distinct")) for f in fields])
    out = wide.select("n_total", F.inline(stats))
    return out.withColumn("fill_rate", F.round(F.when(F.col("n_total") > 0, F.col("n_filled") / F.col("n_total")).otherwise(0.0), 3))


def examples(rows: DataFrame, fields: Sequence[str], most: int = 3) -> DataFrame:
    """field, value: the least distinct values of each field, a few per partition before the shuffle."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.when(is_filled(F.col(f), rows.schema[f].dataType), _shown(rows, f)).alias("value")) for f in fields]))).where("value is not null")
    from pyspark.sql.window import Window

    w = Window.partitionBy("field").orderBy("value")
    return long.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def provenance(rows: DataFrame) -> DataFrame:
    """field, origin, rows."""
    return rows.select(F.explode("_provenance").alias("field", "origin")).groupBy("field", "origin").agg(F.count(F.lit(1)).alias("rows"))


def identical_columns(rows: DataFrame, fields: Sequence[str], least: int = 3) -> DataFrame:
    """a, b of fields that agree on every row, in one pass; of at least `least` rows, some filled."""
    tests, names = [F.count(F.lit(1)).alias("n")], []
    for i, a in enumerate(fields):
        for b in fields[i + 1 :]:
            if rows.schema[a].dataType == rows.schema[b].dataType:
                names.append((a, b))
                tests.append((F.bool_and(F.col(a).eqNullSafe(F.col(b))) & F.bool_or(is_filled(F.col(a), rows.schema[a].dataType))).alias(f"t{len(names)}"))
    wide = rows.agg(*tests)
    found = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"t{k}").alias("same")) for k, (a, b) in enumerate(names, 1)])
    return wide.where(F.col("n") >= least).select(F.inline(found)).where("same").select("a", "b")


def issues(stats: DataFrame, origins: DataFrame, rules: Mapping[str, Mapping[str, bool]], low: float = 0.5) -> DataFrame:
    """field, code, level.  rules: per field required, sparse, html_only, list.

    Of required_missing, sparse_empty, fallback_only_field, empty_field and low_fill the first holds;
    constant_column and alternate_used come besides.
    """
    spark = stats.sparkSession
    table = spark.createDataFrame([(f, bool(r.get("required")), bool(r.get("sparse")), bool(r.get("html_only")), bool(r.get("list"))) for f, r in rules.items()], "field string, required boolean, sparse boolean, html_only boolean, is_list boolean")
    alternate = origins.where("origin like 'alt:%'").groupBy("field").agg(F.sum("rows").alias("by_alternate"))
    s = stats.join(table, "field").join(alternate, "field", "left")
    empty = F.col("n_filled") == 0
    main = (
        F.when(F.col("required") & (F.col("n_filled") < F.col("n_total")), "required_missing")
        .when(empty & F.col("sparse"), "sparse_empty")
        .when(empty & F.col("html_only"), "fallback_only_field")
        .when(empty, "empty_field")
        .when((F.col("fill_rate") < low) & ~F.col("sparse"), "low_fill")
    )
    constant = F.when(F.col("is_list") & (F.col("n_total") >= 5) & (F.col("n_distinct") == 1), "constant_column")
    used = F.when(F.col("by_alternate") > 0, "alternate_used")
    codes = F.filter(F.array(main, constant, used), lambda c: c.isNotNull())
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return s.select("field", F.explode(codes).alias("code")).withColumn("level", level[F.col("code")])
