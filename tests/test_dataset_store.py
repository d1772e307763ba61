"""The stored dataset against folds in memory, its plans, its versions and what a broken run leaves."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftwork.operators import changes, dataset_store

SCHEMA = "k string, v string, n int, _url string"


def rows_of(spark, rng, keys):
    return spark.createDataFrame([(f"k{k}", rng.choice(["a", "b", None]), rng.randrange(3), f"/{k}") for k in keys], SCHEMA)


def shown(df):
    return sorted((r.id, r.recipe_id, r.key, r.url, tuple(sorted(r.data.items(), key=str)), r.changes, r.runs, r.gone, len(r.history), str(r.first_seen), str(r.last_seen), str(r.last_changed)) for r in df.collect())


def test_equals_folds_in_memory(spark, tmp_path):
    rng = random.Random(4)
    store, data = dataset_store.DatasetStore(spark, tmp_path.as_uri(), 8), changes.empty_dataset(spark)
    assert store.rows().count() == 0
    shapes = set()
    for k in range(7):
        recipe, partial = ("r1", "r2")[k in (1, 4)], k in (2, 3, 5)
        keys = rng.sample(range(40), 3 if partial else 30)
        run, when = rows_of(spark, rng, [*keys, keys[0]]), F.lit(f"2024-01-0{k + 1}")
        folded = changes.fold(data, run, recipe, ["k"], ["n"], when, partial).cache()
        data = folded.drop("action")
        assert store.fold(run, recipe, ["k"], ["n"], when, partial) == k + 1
        assert shown(store.rows()) == shown(data)
        assert sorted(map(tuple, store.actions().select("id", "action").collect())) == sorted((r.id, r.action) for r in folded.where("action is not null").collect() if not partial or r.action != "gone")
        shapes.add(store._version()["touched"] is None)
        # another session's view of the folder
        assert shown(dataset_store.DatasetStore(spark, tmp_path.as_uri(), 3).rows()) == shown(data)
    assert shapes == {True, False}


@pytest.fixture
def filled(spark, tmp_path):
    rng = random.Random(5)
    store = dataset_store.DatasetStore(spark, tmp_path.as_uri(), 8)
    store.fold(rows_of(spark, rng, range(400)), "r", ["k"], ["n"], F.lit("2024-01-01"))
    store.fold(rows_of(spark, rng, range(5)), "r", ["k"], ["n"], F.lit("2024-01-02"), partial=True)
    return store


def exchanges_over_scans(plan):
    """Exchanges of a plan's tree that have a dataset's scan below them."""
    out, above = [], []
    for line in plan.splitlines():
        if not (m := re.match(r"^([\s:|+*\-()\d]*)(\w.*)$", line)):
            continue
        depth = len(m[1])
        above = [(d, n) for d, n in above if d < depth] + [(depth, m[2])]
        if "FileScan" in m[2] and ("base-" in m[2] or "touched-" in m[2]):
            out += [n for _, n in above if n.startswith(("Exchange", "BroadcastExchange"))]
    return out


def test_plans_do_not_shuffle_the_dataset(spark, filled):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = rows_of(spark, random.Random(1), range(3))
        for df in (filled.rows(), filled.folded(run, "r", ["k"], ["n"], F.lit("2024-01-03"), True), filled.folded(run, "r", ["k"], ["n"], F.lit("2024-01-03"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "FileScan" in plan and "Bucketed: true" in plan
            assert exchanges_over_scans(plan) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_partial_runs_leave_the_base(spark, filled, tmp_path):
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "base-1").iterdir()}
    filled.fold(rows_of(spark, random.Random(2), range(3, 9)), "r", ["k"], ["n"], F.lit("2024-01-03"), partial=True)
    assert {p: p.stat().st_mtime_ns for p in Path(tmp_path, "base-1").iterdir()} == files
    assert filled._version()["base"] == "base-1" and filled.touched_share() == 9 / 400
    # beyond a tenth the two become one
    filled.fold(rows_of(spark, random.Random(2), range(50)), "r", ["k"], ["n"], F.lit("2024-01-04"), partial=True)
    assert filled._version()["touched"] is None and filled.rows().count() == 400 and filled.rows().where("runs > 1").count() == 50
    assert filled.actions().count() == 50


def test_versions(spark, filled, tmp_path):
    old = shown(filled.rows(1))
    assert filled.versions() == [1, 2] and filled.rows(1).where("runs > 1").count() == 0
    # a run that broke off leaves tables that no version names
    Path(tmp_path, "touched-3").mkdir()
    Path(tmp_path, "touched-3", "part-0.parquet").write_bytes(b"torn")
    Path(tmp_path, "versions", "_3").write_text("{")
    again = dataset_store.DatasetStore(spark, tmp_path.as_uri())
    assert again.buckets == 8 and shown(again.rows()) == shown(filled.rows()) and shown(again.rows(1)) == old
    again.fold(rows_of(spark, random.Random(2), [7]), "r", ["k"], ["n"], F.lit("2024-01-03"), partial=True)
    assert again.rows().where("runs > 1").count() == 6
    again.drop_before(3)
    assert again.versions() == [3] and not Path(tmp_path, "touched-2").exists() and again.rows().count() == 400


def test_empty_runs(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    store = dataset_store.DatasetStore(spark, tmp_path.as_uri(), 8)
    store.fold(none, "r", ["k"], ["n"], F.lit("2024-01-01"))
    assert store.rows().count() == 0
    store.fold(rows_of(spark, random.Random(1), range(3)), "r", ["k"], ["n"], F.lit("2024-01-02"))
    store.fold(none, "r", ["k"], ["n"], F.lit("2024-01-03"), partial=True)
    assert store.rows().where("gone").count() == 0
    store.fold(none, "r", ["k"], ["n"], F.lit("2024-01-04"))
    assert store.rows().where("gone").count() == 3 and {r.action for r in store.actions().collect()} == {"gone"}
