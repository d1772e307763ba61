"""Rules on streams in the order of events: late rows, rows that are too late, restarts, time to live."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import Row
from pyspark.sql.types import StructType

from weftwork.operators import monitor
from weftwork.streaming import ingest, state

SCHEMA = "domain string, ts timestamp, seq long, verdict string, tier string, attempts int"
T0 = datetime.datetime(2024, 1, 1)


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), T0 + datetime.timedelta(minutes=k), k, rng.choice(["blocked", "blocked", "ok", "other", None]), rng.choice(["http", "browser"]), rng.choice([0, 1, None])) for k in range(n)]


def fed(spark, tmp_path, batches, rule):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = ingest.drained(rule(s), f"{tmp_path}/out", f"{tmp_path}/state")
        yield {(r.domain, r.seq): (r.penalty, r.delay, r.tier) for r in out.collect()}


def plain(rows):
    known, step, out = {}, state._backoff(0.5), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        known[r[0]], told = step(known.get(r[0]), Row(*StructType.fromDDL(SCHEMA).names)(*r))
        out[(r[0], r[2])] = told[0][2:]
    return out


def test_late_rows_find_their_place(spark, tmp_path):
    rows = events(120, 1)
    first, late = [r for r in rows[:70] if r[2] % 7 or r[2] < 55], [r for r in rows[55:70] if not r[2] % 7]
    end = ("z", T0 + datetime.timedelta(days=1), 999, "ok", "http", 0)
    seen = list(fed(spark, tmp_path, [first, late + rows[70:], [end]], lambda s: state.backoff(s, "30 minutes")))
    assert 0 < len(seen[0]) < len(first) and set(seen[0]) < set(seen[1])
    assert {k: v for k, v in seen[2].items() if k[0] != "z"} == plain(rows)
    # the last of each domain is what the batch operators say
    batch = monitor.backoff(spark.createDataFrame(rows, SCHEMA)).collect()
    last = {d: seen[2][(d, max(q for e, q in seen[2] if e == d))] for d in ("a", "b", None)}
    assert {r.domain: (r.penalty, r.delay) for r in batch} == {d: v[:2] for d, v in last.items()}
    tiers = {r.domain: r.tier for r in monitor.tier_memory(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert tiers == {d: v[2] for d, v in last.items() if v[2]}


def test_rows_too_late_are_left_out(spark, tmp_path):
    rows = events(60, 2)
    too_late = [rows[3], rows[5]]
    end = ("z", T0 + datetime.timedelta(days=1), 999, "ok", "http", 0)
    *_, got = fed(spark, tmp_path, [[r for r in rows if r not in too_late], too_late, [end]], lambda s: state.backoff(s, "10 minutes"))
    assert {k: v for k, v in got.items() if k[0] != "z"} == plain([r for r in rows if r not in too_late])


def test_drift_rule():
    known, out = None, []
    for x in (0.9, 0.1, 0.1, 0.95, 0.0):
        known, told = state._drift(known, Row("ts", "seq", "rate")(T0, len(out), x))
        out.append([t[2:] for t in told])
    assert out == [[], [], [(0.1, 0.9)], [], []] and known == (5, 0.95, True)


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = [("a", T0 + datetime.timedelta(minutes=m), m, "blocked", "http", 0) for m in (0, 1, 2, 50, 51)] + [("b", T0 + datetime.timedelta(minutes=m), m, "blocked", "http", 0) for m in (0, 20, 40)]
    end = [[("z", T0 + datetime.timedelta(days=d), 999 + d, "ok", "http", 0)] for d in (1, 2)]
    again = [("a", T0 + datetime.timedelta(days=2), 60, "blocked", "http", 0)]
    last = [("z", T0 + datetime.timedelta(days=3), 2000, "ok", "http", 0)]
    *_, got = fed(spark, tmp_path, [[r for r in rows if r[2] < 51], [r for r in rows if r[2] == 51], *end, again, last], lambda s: state.backoff(s, "30 minutes", idle_ms=30 * 60_000))
    assert [got[("a", m)][0] for m in (0, 1, 2, 50, 51, 60)] == [1, 2, 3, 1, 2, 1]
    assert [got[("b", m)][0] for m in (0, 20, 40)] == [1, 2, 3]


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in/0")
    s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert ingest.drained(state.backoff(s, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/state").count() == 0
