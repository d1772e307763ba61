"""Whole jobs on the made-up catalogue."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_engine import CATALOGUE, detail_page, item, list_page
from weftwork.operators import changes, rows
from weftwork.plans import recipe as R
from weftwork.plans import run as jobs
from weftwork.sources import readers


@pytest.fixture(scope="module")
def site(spark):
    lists = [(f"https://shop.example/list/page-{n}.html", list_page(n), n) for n in (1, 2, 3)]
    details = [(f"https://shop.example/item/{i}.html", detail_page(i)) for i in range(1, 16)]
    return spark.createDataFrame(lists, "url string, html string, page_no int"), spark.createDataFrame(details, "url string, html string")


def test_run_and_rerun(spark, site, tmp_path):
    r = R.load(CATALOGUE + "incremental: {enabled: true}\nid: shop\n")
    state = spark.createDataFrame([], "url string, lastmod string, content_hash string, fetched_at string")
    first = jobs.run(r, *site, state=state, run_id="r1", now=F.lit("2024-01-01"))
    assert first.items.count() == 15 and not first.partial and first.state.count() == 3 and first.quarantine.count() == 0
    first.items.drop("run_id", "_which", "_detail_url").write.parquet(f"{tmp_path}/r1")
    first.state.write.parquet(f"{tmp_path}/s1")
    before = spark.read.parquet(f"{tmp_path}/r1")
    data = changes.fold(changes.empty_dataset(spark), before, "shop", r.dedupe_key, ["page_no", "_page_url", "_index"], F.lit("2024-01-01")).drop("action")
    data.write.parquet(f"{tmp_path}/d1")
    page = (f"https://shop.example/list/page-{3}.html", list_page(3).replace(item(15), "").replace("£31.00", "£99.00"), 3)
    changed = site[0].where("page_no < 3").unionByName(spark.createDataFrame([page], site[0].schema))
    second = jobs.run(r, changed, site[1], state=spark.read.parquet(f"{tmp_path}/s1"), run_id="r2", now=F.lit("2024-01-02"))
    assert second.partial and second.items.count() == 4
    feed, after = jobs.rerun(r, second, before, spark.read.parquet(f"{tmp_path}/d1"), F.lit("2024-01-02"))
    counts = {x.change: x.n for x in feed.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"changed": 1, "unchanged": 3}
    assert after.where("gone").count() == 0 and after.where("changes = 1").first()["data"]["price"] == "99.0"


def test_preview(site):
    r = R.load(CATALOGUE.replace("css: p.price_color", 'css: "p:nth-child(9)"'))
    report = jobs.preview(r, site[0].drop("page_no"))
    codes = {(x.field, x.code) for x in report.issues.collect()}
    assert {("price", "empty_field"), ("price", "positional_selector"), ("tags", "no_detail_samples")} <= codes
    assert report.ok() and report.containers.where("items = 5").count() == 3
    broken = R.load(CATALOGUE.replace("section#results > article.product_pod", "div.none"))
    assert not jobs.preview(broken, site[0].drop("page_no")).ok()


def test_walk_and_fallback(spark, site):
    links = spark.createDataFrame([(f"https://shop.example/list/page-{n}.html", f"https://shop.example/list/page-{n % 3 + 1}.html") for n in (1, 2, 3)], "url string, next_url string")
    got = jobs.walk(site[0].drop("page_no"), links, ["https://shop.example/list/page-2.html"])
    assert {r.url[-6]: r.page_no for r in got.collect()} == {"2": 1, "3": 2, "1": 3}
    api = spark.createDataFrame([], "a string, b string")
    assert jobs.with_fallback(api, spark.createDataFrame([("x", 1)], "a string, c int")).collect()[0].a == "x"


def test_domains(spark):
    r = R.load(CATALOGUE)
    assert jobs.domains(r) == ["shop.example"]
    df = spark.createDataFrame([("https://shop.example/a",), ("https://www.shop.example/",), ("https://notshop.example/",)], "u string")
    assert df.where(jobs.in_domains(F.col("u"), jobs.domains(r))).count() == 2


def test_recipe_onto_api():
    fields = jobs.json_fields({"productName": "x", "price": "1", "tags": ["a"], "meta": {}, "link": "/a", "n": 3, "ok": True, "title": "t"})
    assert [(f.name, f.type) for f in fields] == [("product_name", "text"), ("price", "price"), ("tags", "list"), ("link", "url"), ("n", "number"), ("ok", "bool"), ("title", "text")]
    r = jobs.onto_api(R.load(CATALOGUE), "https://x/p.json?page={page}", "json:body.items", fields)
    price = next(f for f in r.fields if f.name == "price")
    assert price.alternates[0].css == "p.price_color" and "rating" in [f.name for f in r.fields] and r.list_.alternates
    assert jobs.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_gzip(spark):
    import gzip

    rows = [(b"plain",), (gzip.compress(b"packed"),), (b"\x1f\x8bbroken",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "content binary").select(readers.gunzipped().alias("t")).collect()]
    assert got[:2] == ["plain", "packed"] and got[3] is None


def test_rows_that_ask_for_nothing_are_dealt(spark):
    """rows beyond a budget of detail pages go to many tasks."""
    made = F.create_map(F.lit("a"), F.lit("primary"))
    listed = spark.range(4000).select("id", F.concat(F.lit("/d/"), "id").alias("_detail_url"), F.concat(F.lit("/l/"), "id").alias("_url"), made.alias("_provenance"))
    details = spark.range(4000).select(F.concat(F.lit("/d/"), "id").alias("url"), F.col("id").cast("string").alias("name"), made.alias("_provenance"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows.enrich(listed, details, ["name"], budget=3, order=["id"])
        held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted((r.id, r.name) for r in got.where("name IS NOT NULL").collect()) == [(0, "0"), (1, "1"), (2, "2")]
        assert sum(held) == 4000 and max(held) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
