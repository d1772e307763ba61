"""F3 platform_products: fields of one value are looked up, documents are read once, and what comes out is as walked."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftwork.functions import coerce, jsonpath
from weftwork.plans import compile as plan
from weftwork.plans import platforms
from weftwork.plans import recipe as R

DOCS = [
    {"a": 1, "b": {"c": "x"}}, {"a": None, "b": {"c": None}}, {"a": [{"b": 1}, 2, {"b": None}]}, [{"a": {"b": 3}}, {"a": [{"b": 4}]}, 5], [], {}, None, 7, "text", {"a": [[1, 2], [3]]},
    {"a": {"b": {"c": [1, {"d": 2}]}}}, {"b": [{"c": [{"d": 1}]}, {"c": {"d": 2}}]}, {"a": {"b": {"x": 1}}}, {"a": {"b": []}}, [[{"a": 1}]], {"it's": {"a b": 1.50}}, {"a": {"b": True}},
]
PATHS = ["a", "$.a.b", "b.c", "a[0]", "a[0].b", "a[-1].b", "a[1]", "b.c.d", "b[0].c[0].d", "a[*]", "a.b[*]", "[0].a", "[0][0].a", "a[0][1]", "it's.a b", "a.b.c[1].d", "*", "a.b.x"]


def test_looked_up_as_walked(spark):
    docs = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(DOCS)] + [(99, None), (100, "{broken")], "id int, j string").select("id", F.try_parse_json("j").alias("v"))
    shown = lambda hits: F.transform(hits, lambda x: F.coalesce(F.to_json(x), F.lit("none")))
    for p in PATHS:
        walked, one = jsonpath._walked(F.array("v"), jsonpath.parts(p)), jsonpath.looked_up(F.col("v"), p)
        for r in docs.select("id", shown(jsonpath.resolve(F.col("v"), p)).alias("a"), shown(walked).alias("b"), (one if one is not None else F.lit(None).cast("string")).alias("one"), F.transform(walked, jsonpath.as_text).alias("texts")).collect():
            assert (p, r.id, r.a) == (p, r.id, r.b) and (r.one is None or r.texts == [r.one]), (p, r)


def test_values_of_odd_products(spark):
    """What a shop's fields hold where texts are odd, absent, null or lists."""
    base = {"title": " T \n", "handle": "h", "variants": [{"price": "1.234,50 €", "sku": 5, "available": "Sold out"}]}
    odd = [base, {}, {**base, "title": "", "variants": []}, {**base, "title": ["", "b"], "variants": [{"price": None, "available": True}]}, {**base, "title": {"x": 1}, "variants": [{"price": 12, "available": "true "}, {"price": 3}]}, {**base, "title": None, "handle": "", "variants": {"price": 1}}]
    odd += [{**base, "variants": [{"price": x, "available": y}]} for x, y in (("+7", 1), ("12.345", "no"), ("1,50", ""), ("12\n", "maybe"), ("USD 12.5", False), ("-3.20", "In Stock now"))]
    pages = spark.createDataFrame([("https://s.example/p", json.dumps({"products": odd}))], "url string, body string")
    r = R.Recipe.model_validate({"seeds": ["https://s.example/"], **platforms.endpoint("shopify", "https://s.example")})
    rows = plan.extract(r, pages)
    got = [(x.title, x.price, x.sku, x.available, x.url, x._provenance["price"]) for x in rows.orderBy("_index").collect()]
    u = "https://s.example/products/h"
    first = [("T", 1234.5, "5", False, u, "primary"), (None, None, None, None, None, "missing"), (None, None, None, None, u, "missing"), ('["","b"]', None, None, True, u, "missing"), ('{"x":1}', 12.0, None, True, u, "primary"), (None, None, None, None, None, "missing")]
    assert got[:6] == first
    assert [(x[1], x[3]) for x in got[6:]] == [(7.0, True), (12.345, False), (1.5, None), (12.0, None), (12.5, False), (-3.2, True)]
    text = rows.select("title", "price", "sku", "available", "url")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson") == 1 and text.count("_text_") >= 5


def test_bare_numbers(spark):
    texts = ["1", "+1", "-1.5", "1.25", "1.255", "1\n", " 1", "1,5", "1.234,5", "", None, "x 3 y", "3 000,25", "true", "1."]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", coerce.to_number(F.col("t")).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [1.0, 1.0, -1.5, 1.25, 1.255, 1.0, 1.0, 1.5, 1234.5, None, None, 3.0, 3000.25, None, 1.0]
