"""Sketched profiles: merged runs against one pass, odd values, stored runs."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftwork.operators import sketches

SCHEMA = "run_id long, a string, x double, n int, l array<int>, at timestamp, nothing string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = [(k % 5, rng.choice(["p", "q", "", None, "r"]), rng.choice([rng.gauss(0, 1), float("nan"), float("inf"), None]), rng.randrange(1000), rng.choice([[], None, [1], [1, 2]]), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k), None) for k in range(3000)]
    return spark.createDataFrame(data, SCHEMA).cache()


FIELDS = ["a", "x", "n", "l", "at", "nothing"]


def test_report_of_merged_runs(rows):
    got = {r.field: r for r in sketches.report(sketches.merged(sketches.sketched(rows, FIELDS))).collect()}
    own = rows.collect()
    filled = {f: [r[f] for r in own if r[f] not in (None, "", [])] for f in FIELDS}
    for f in FIELDS:
        assert (got[f].n_total, got[f].n_filled) == (3000, len(filled[f]))
        assert got[f].n_distinct == pytest.approx(len({str(v) for v in filled[f]}), rel=0.03)
    counts = Counter(filled["a"])
    assert [(x["item"], x["count"]) for x in got["a"].frequent] == sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    assert {x["item"]: x["count"] for x in got["l"].frequent} == {"[1]": filled["l"].count([1]), "[1,2]": filled["l"].count([1, 2])}
    numbers = sorted(filled["n"])
    for p, q in zip((0.0, 0.25, 0.5, 0.75, 1.0), got["n"].quantiles, strict=True):
        below, upto = sum(v < q for v in numbers) / len(numbers), sum(v <= q for v in numbers) / len(numbers)
        assert below - 0.0165 <= p <= upto + 0.0165
    assert all(abs(q) < 10 for q in got["x"].quantiles)
    assert got["at"].quantiles[0] == min(filled["at"]).replace(tzinfo=datetime.UTC).timestamp()
    assert got["nothing"].n_distinct == 0 and got["nothing"].quantiles is None and got["nothing"].frequent == [] and got["a"].quantiles is None


def test_merging_in_any_way_counts_alike(rows):
    one = sketches.sketched(rows.withColumn("run_id", F.lit(0)), ["a", "l"])
    many = sketches.sketched(rows, ["a", "l"])
    twice = sketches.merged(sketches.merged(many.withColumn("half", F.col("run_id") % 2), ["half"]))
    shown = [{(r.field, r.n_total, r.n_filled, r.n_distinct, str(r.frequent)) for r in sketches.report(sketches.merged(s)).collect()} for s in (one, many, twice)]
    assert shown[0] == shown[1] == shown[2]
    by_run = sketches.report(sketches.merged(many, ["run_id"]), ["run_id"])
    assert {(r.run_id, r.n_total) for r in by_run.collect()} == {(k, 600) for k in range(5)}


def test_stored_runs_replace_themselves(spark, rows, tmp_path):
    folder = str(tmp_path / "s")
    s = sketches.sketched(rows, ["a", "n"])
    sketches.append(s, folder)
    sketches.append(sketches.sketched(rows.where("run_id = 2").limit(10), ["a", "n"]), folder)
    got = {(r.run_id, r.field): r.n_total for r in sketches.stored(spark, folder).collect()}
    assert got == {(k, f): 10 if k == 2 else 600 for k in range(5) for f in ("a", "n")}


def test_drift(spark):
    rng = random.Random(3)
    data = [(run, field, rng.gauss(5 if (run, field) == (4, "a") else 0, 1), 7 if run < 5 else 9) for run in range(7) for field in "ab" for _ in range(300)]
    s = sketches.sketched(spark.createDataFrame(data, "run_id int, site string, x double, same int"), ["x", "same"], ["site", "run_id"])
    got = {(r.site, r.run_id, r.field): r for r in sketches.drift(s, ["run_id"], by=["site"]).collect()}
    # a third of what comes before run 5 is run 4, which was shifted
    assert len(got) == 2 * 2 * 6 and {k for k, r in got.items() if r.drifted} == {("a", 4, "x"), ("a", 5, "x"), *((x, k, "same") for x in "ab" for k in (5, 6))}
    assert all(r.distance < 0.15 for k, r in got.items() if k[2] == "same" and k[1] < 5)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sketches.sketched(none, FIELDS).count() == 0 == sketches.report(sketches.merged(sketches.sketched(none, FIELDS))).count()
    assert sketches.drift(sketches.sketched(none, FIELDS), ["run_id"]).count() == 0
