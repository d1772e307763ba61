"""Walks by frontier on small graphs, against a plain breadth-first walk."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from weftwork.plans import walk


def frames(spark, links, start):
    return spark.createDataFrame(links, "url string, next_url string"), spark.createDataFrame([(u,) for u in start], "url string")


def plain(links, start, most=None, budget=None, leads=None):
    seen, frontier, k = {}, sorted({u for u in start if u is not None}), 1
    while frontier and (most is None or k <= most) and (budget is None or len(seen) < budget):
        frontier = frontier[: None if budget is None else budget - len(seen)]
        seen.update(dict.fromkeys(frontier, k))
        on = [u for u in frontier if leads is None or leads(u, k, frontier)]
        frontier = sorted({b for a, b in links if a in on and b is not None} - set(seen))
        k += 1
    return seen


@pytest.mark.parametrize(("most", "budget"), [(None, None), (3, None), (None, 17), (1, None), (0, None), (4, 9), (None, 0)])
def test_walk_equals_plain(spark, most, budget):
    rng = random.Random(7)
    links = [(f"u{rng.randrange(40)}", rng.choice([None, *[f"u{k}" for k in range(40)]])) for _ in range(70)]
    start = ["u1", "u1", None, "nowhere"]
    got = walk.walk(*frames(spark, links, start), most=most, budget=budget).collect()
    assert len(got) == len({r.url for r in got}) and {r.url: r.page_no for r in got} == plain(links, start, most, budget)


def test_walk_stops_without_new_keys(spark):
    links = [(f"p{k}", f"p{k + 1}") for k in range(9)] + [("p0", "q1"), ("q1", "q2"), ("q2", "q3")]
    items = [("p0", "a", 1), ("p1", "b", 1), ("p2", None, 1), ("p3", None, 1), ("p4", "z", 1), ("q1", "b", 1), ("q1", "c", 2), ("q2", "c", 2)]
    got = walk.walk(*frames(spark, links, ["p0"]), items=spark.createDataFrame(items, "url string, k string, n int"), keys=["k", "n"]).collect()
    # p3 shows a null that p2 showed before, q2 what q1 did; both are visited and lead nowhere
    assert {r.url for r in got} == {"p0", "p1", "p2", "p3", "q1", "q2"}


def test_walk_goes_on_where_it_was_broken_off(spark, tmp_path):
    links, start = frames(spark, [(f"p{k}", f"p{k + 1}") for k in range(12)], ["p0"])
    folder = tmp_path.as_uri()
    assert walk.walk(links, start, most=4, folder=folder).count() == 4
    # a round without its mark counts for nothing
    torn = Path(tmp_path, "visited", "round=5")
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half a file")
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet") if "round=5" not in str(p)}
    got = walk.walk(links, start, folder=folder)
    assert sorted((r.page_no, r.url) for r in got.collect()) == [(k + 1, f"p{k}") for k in range(13)]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_walk_with_items_resumes(spark, tmp_path):
    links, start = frames(spark, [(f"p{k}", f"p{k + 1}") for k in range(6)], ["p0"])
    items = spark.createDataFrame([(f"p{k}", min(k, 3)) for k in range(7)], "url string, k int")
    folder = tmp_path.as_uri()
    walk.walk(links, start, most=3, items=items, keys=["k"], folder=folder)
    for f in Path(tmp_path, "leading", "round=3").iterdir():
        f.unlink()  # broken off between a round and its keys
    got = walk.walk(links, start, items=items, keys=["k"], folder=folder)
    assert {r.url for r in got.collect()} == {f"p{k}" for k in range(5)}


def test_links_are_worked_out_once(spark, tmp_path):
    """rounds read written links, not what the links were made of."""
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(f"/{k}", f"/{k + 1}") for k in range(6)], "url string, next_url string").mapInArrow(told, "url string, next_url string")
    start = spark.createDataFrame([("/0",)], "url string")
    assert walk.walk(links, start, folder=f"file://{tmp_path}/w").count() == 7
    assert made.value == 6
