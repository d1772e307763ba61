"""Field profiles that merge: sketches per run and field, stored once, read for any span of runs.

A run's rows are read in one aggregation without an expansion by field.  Per field it keeps the counts,
a HyperLogLog sketch of the different values, a KLL sketch of the order of numbers and times, and
the most frequent values.  Profiles of many runs are unions of these, so no value is read again, and
a run's drift is the distance between its distribution and that of the runs before it.

Errors, at the sizes below (one standard deviation for distinct counts, 99 % for ranks): distinct counts 0.8 %,
ranks of quantiles 1.65 %; a value is missing from the most frequent, or its count off, by 1 / (0.75 * `ITEMS`)
of the rows at most, and not at all while a field has fewer different values than 0.75 * `ITEMS`.

Defined results: nulls, empty texts and lists are not filled and in no sketch; numbers that are not a
number, or infinite, are in no quantile sketch.  A field without filled values has 0 distinct ones, no quantiles
and no frequent values.  Lists and other nested values count as JSON texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.values import is_filled
from .profiles import _shown

#: log2 of a distinct sketch's registers; size of a quantile sketch; values tracked for the most frequent.
REGISTERS, KLL, ITEMS = 14, 200, 4096
#: A run has drifted from here on, by the largest difference of two distribution functions.
DRIFTED = 0.3
PROBES = tuple(k / 20 for k in range(1, 20))


def _number(rows: DataFrame, f: str) -> Column | None:
    """A field's place on a line, where it has one."""
    kind = rows.schema[f].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(f).cast("timestamp")).cast("double") / 1e6
    if isinstance(kind, T.NumericType):
        x = F.col(f).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return None


def sketched(rows: DataFrame, fields: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """by, field, n_total, n_filled, distinct, quantiles, frequent: one row a run and field."""
    aggs, parts = [F.count(F.lit(1)).alias("_n")], []
    for k, f in enumerate(fields):
        ok, number = is_filled(F.col(f), rows.schema[f].dataType), _number(rows, f)
        value = F.when(ok, _shown(rows, f))
        aggs += [F.count_if(ok).alias(f"_f{k}"), F.hll_sketch_agg(value, REGISTERS).alias(f"_d{k}"), F.call_function("approx_top_k_accumulate", value, F.lit(ITEMS)).alias(f"_t{k}")]
        if number is not None:
            aggs += [F.kll_sketch_agg_double(number, F.lit(KLL)).alias(f"_q{k}"), F.count(number).alias(f"_m{k}")]
        quantiles = F.lit(None).cast("binary") if number is None else F.when(F.col(f"_m{k}") > 0, F.col(f"_q{k}"))
        parts.append(F.struct(F.lit(f).alias("field"), F.col(f"_f{k}").alias("n_filled"), F.col(f"_d{k}").alias("distinct"), quantiles.alias("quantiles"), F.col(f"_t{k}").alias("frequent")))
    wide = rows.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.col("_n").alias("n_total"), F.inline(F.array(*parts))).select(*by, "field", "n_total", "n_filled", "distinct", "quantiles", "frequent")


def append(sketches: DataFrame, folder: str) -> None:
    """Store a run's sketches beside those of other runs; storing a run again replaces it."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of all runs together, or of the runs of each group."""
    return sketches.groupBy(*by, "field").agg(
        F.sum("n_total").alias("n_total"),
        F.sum("n_filled").alias("n_filled"),
        F.hll_union_agg("distinct", True).alias("distinct"),
        F.expr("CASE WHEN count(quantiles) > 0 THEN kll_merge_agg_double(quantiles) END").alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(ITEMS)).alias("frequent"),
    )


def report(sketches: DataFrame, by: Sequence[str] = (), probes: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), most: int = 5) -> DataFrame:
    """by, field, n_total, n_filled, fill_rate, n_distinct, quantiles, frequent (item, count; the most frequent first)."""
    at = F.array(*[F.lit(float(p)) for p in probes])
    items = F.array_sort(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(min(ITEMS, max(most, 1)))), lambda a, b: F.when(a["count"] != b["count"], (b["count"] > a["count"]).cast("int") * 2 - 1).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0))
    return sketches.select(
        *by,
        "field",
        "n_total",
        "n_filled",
        F.round(F.when(F.col("n_total") > 0, F.col("n_filled") / F.col("n_total")).otherwise(0.0), 3).alias("fill_rate"),
        F.least(F.hll_sketch_estimate("distinct"), "n_filled").alias("n_distinct"),
        F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", at)).alias("quantiles"),
        F.slice(F.filter(items, lambda x: x["item"].isNotNull()), 1, most).alias("frequent"),
    )


def drift(sketches: DataFrame, order: Sequence[str], span: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """by, order, field, distance, drifted: each run against the runs before it, up to `span` of them.

    The distance is the largest difference of the two distribution functions at `PROBES` of the run; the
    first run of a field has none.
    """
    numbers = sketches.where("quantiles IS NOT NULL")
    before = Window.partitionBy(*by, "field").orderBy(*order).rowsBetween(-span, -1)
    both = numbers.withColumns({"_before": F.kll_merge_agg_double("quantiles").over(before), "_runs": F.count("quantiles").over(before)}).where("_runs > 0")
    grid = F.array(*[F.lit(k / 100) for k in range(1, 100)])
    both = both.withColumns({"_here": F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(p) for p in PROBES])), "_there": F.kll_sketch_get_quantile_double("_before", grid)})
    # the share of hundredths below a value, and not above it: the rank lies between, also where values repeat
    share = lambda test: F.size(F.filter("_there", test)) / 100.0
    off = lambda v, k: F.greatest(share(lambda x: x < v) - F.element_at(F.array(*[F.lit(p) for p in PROBES]), k + 1), F.element_at(F.array(*[F.lit(p) for p in PROBES]), k + 1) - share(lambda x: x <= v) - 0.01)
    apart = F.greatest(F.array_max(F.transform("_here", off)), F.lit(0.0))
    return both.select(*by, *order, "field", apart.alias("distance"), (apart >= DRIFTED).alias("drifted"))
