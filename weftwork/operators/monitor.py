"""What runs say over time: drift of fill rates, back-off, counters, status, previous runs, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the drift rule and of the back-off.
LOW, HIGH, LEAST, MEMORY = 0.25, 0.8, 3, 300
MOST_PENALTY, LEAST_DELAY, MOST_DELAY = 6, 0.5, 30.0


def drift_alerts(history: DataFrame, by: tuple[str, ...] = ("run_id",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The first observation of each field whose rate has dropped: low now, high at some time before."""
    w = Window.partitionBy(*by, "field").orderBy(*order)
    seen = history.withColumns({"_n": F.row_number().over(w), "_best": F.max("rate").over(w.rowsBetween(1 - MEMORY, -1))})
    low = seen.where((F.col("_n") >= LEAST) & (F.col("rate") <= LOW) & (F.col("_best") >= HIGH))
    return low.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first", "_n").withColumnRenamed("_best", "best_before")


def history_tail(history: DataFrame, most: int = 120, by: tuple[str, ...] = ("run_id",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last rates of each field, by a ranking that keeps no more than it returns."""
    w = Window.partitionBy(*by, "field").orderBy(*[F.col(o).desc() for o in order])
    return history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def penalty(verdicts: Column) -> Column:
    """The penalty after an ordered array of verdicts: up when blocked, down when not, 0 to 6."""
    return F.aggregate(verdicts, F.lit(0), lambda p, v: F.when(v == "blocked", F.least(p + 1, F.lit(MOST_PENALTY))).when(v == "ok", F.greatest(p - 1, F.lit(0))).otherwise(p))


def delay(base: Column, p: Column) -> Column:
    return F.when(p > 0, F.least(F.greatest(base, F.lit(LEAST_DELAY)) * F.pow(F.lit(2.0), p), F.lit(MOST_DELAY))).otherwise(base)


def backoff(events: DataFrame, base: float = 0.5, domain: str = "domain", verdict: str = "verdict", order: str = "seq", stretch: int = 10_000) -> DataFrame:
    """Penalty and delay of each domain after its events; order is a number.

    An event maps a penalty p to min(6, max(0, p + s)), and such maps compose to min(hi, max(lo, p + a)).
    So each stretch of the order is folded to three numbers, and a domain's stretches to its penalty: no
    row holds all events of a domain.
    """
    least, most = F.lit(0), F.lit(MOST_PENALTY)
    clamp = lambda x: F.greatest(least, F.least(most, x))
    s = F.when(F.col(verdict) == "blocked", 1).when(F.col(verdict) == "ok", -1).otherwise(0)
    by = events.groupBy(domain, F.floor(F.col(order) / stretch).alias("_part")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), s.alias("s")))).alias("_e"))
    start = F.struct(F.lit(0).alias("a"), least.alias("lo"), most.alias("hi"))
    step = lambda f, e: F.struct((f["a"] + e["s"]).alias("a"), clamp(f["lo"] + e["s"]).alias("lo"), clamp(f["hi"] + e["s"]).alias("hi"))
    maps = by.select(domain, "_part", F.aggregate("_e", start, step).alias("f"))
    folded = maps.groupBy(domain).agg(F.array_sort(F.collect_list(F.struct("_part", "f"))).alias("_m"))
    last = F.aggregate("_m", F.lit(0), lambda p, m: F.least(m["f"]["hi"], F.greatest(m["f"]["lo"], p + m["f"]["a"])))
    return folded.select(domain, last.alias("penalty")).withColumn("delay", delay(F.lit(base), F.col("penalty")))


def tier_memory(events: DataFrame, order: str = "seq") -> DataFrame:
    """domain, tier: the tier of the last good answer that took more than one attempt or was not http."""
    good = events.where("verdict = 'ok' and (attempts > 0 or tier <> 'http')")
    return good.groupBy("domain").agg(F.max_by("tier", order).alias("tier"))


def start_tier(pages: DataFrame, memory: DataFrame, host: str = "host") -> DataFrame:
    """pages with the higher of their own tier and the one remembered for their host."""
    rank = F.create_map(*[F.lit(x) for kv in {"http": 0, "browser": 1, "interactive": 2}.items() for x in kv])
    j = pages.join(memory.select(F.col("domain").alias("_d"), F.col("tier").alias("_t")), F.col(host) == F.col("_d"), "left")
    return j.withColumn("tier", F.when(rank[F.col("_t")] > rank[F.col("tier")], F.col("_t")).otherwise(F.col("tier"))).drop("_d", "_t")


def counters(events: DataFrame, kind: str, name: str) -> DataFrame:
    """kind, counts: a map of each kind's names to their counts."""
    n = events.groupBy(F.col(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name").cast("string"), "n")))).alias("counts"))


def run_status(reason: Column, cancelled: Column) -> Column:
    return F.when(cancelled, "cancelled").when(reason.isin("finished", "max_items", "closespider_itemcount"), "finished").when(reason == "stopped", "stopped").otherwise("failed")


def previous_runs(runs: DataFrame) -> DataFrame:
    """runs with previous_run: the last finished crawl of the same recipe that began earlier."""
    w = Window.partitionBy("recipe_id").orderBy("created_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    fit = F.when((F.col("status") == "finished") & (F.col("kind") == "crawl"), F.col("run_id"))
    return runs.withColumn("previous_run", F.last(fit, ignorenulls=True).over(w))


def expired(table: DataFrame, keep: int, cutoff: Column | None, by: str = "recipe_id", at: str = "created_at", active: tuple[str, ...] = ("queued", "running", "stopping")) -> DataFrame:
    """Rows to prune: beyond the newest `keep` of their owner, or older than the cutoff; active ones stay."""
    w = Window.partitionBy(by).orderBy(F.col(at).desc(), F.col("run_id").desc())
    done = table.where(~F.col("status").isin(*active)) if "status" in table.columns else table
    ranked = done.withColumn("_n", F.row_number().over(w))
    old = F.col(at) < cutoff if cutoff is not None else F.lit(False)
    return ranked.where((F.col("_n") > keep) | old).drop("_n")


def recovered_after_crash(runs: DataFrame) -> DataFrame:
    """Runs that were under way when the server stopped are failed."""
    hit = F.col("status").isin("queued", "running", "stopping")
    return runs.withColumn("reason", F.when(hit, "server_restarted").otherwise(F.col("reason"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("enabled") & F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= now))
