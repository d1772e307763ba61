"""Recipes, trees, rows, changes, streams and sinks on small made-up inputs."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork import queries
from weftwork.dom import analysis, blobs, selectors, tree
from weftwork.operators import changes, heal, inference, monitor, outside, rows
from weftwork.plans import compile as plan
from weftwork.plans import recipe as R
from weftwork.plans import run
from weftwork.sources import readers, sinks
from weftwork.streaming import ingest

RATINGS = ["One", "Two", "Three", "Four", "Five"]


def item(i):
    return f'<article class="product_pod" data-id="{i}"><h3><a href="../item/{i}.html" title="Widget {i:02d}">Widget {i:02d}...</a></h3><p class="price_color">£{10 + 1.5 * i:.2f}</p><p class="star-rating {RATINGS[i % 5]}"></p><p class="availability">{"In stock" if i % 4 else "Out of stock"}</p></article>'


def list_page(n):
    body = "".join(item(i) for i in range(5 * n - 4, 5 * n + 1))
    following = f'<li class="next"><a href="page-{n + 1}.html">next</a></li>' if n < 3 else ""
    return f'<html><body><section id="results">{body}</section><ul class="pager"><li class="current">Page {n}{following}</ul></body></html>'


def detail_page(i):
    return f'<html><body><article class="product_page"><h1>Widget {i:02d}</h1><div id="product_description"><h2>About</h2></div><p>Widget {i:02d} is a fine widget.</p><ul class="tags">' + "".join(f'<li class="tag">{t}</li>' for t in "abc"[: i % 3 + 1]) + "</ul></article></body></html>"


CATALOGUE = """
seeds: ["https://shop.example/list/page-1.html"]
list: {container: "section#results > article.product_pod"}
detail: {enabled: true, link: {css: "h3 > a"}}
pagination: {kind: next_link, selector: "li.next > a"}
fields:
  - {name: title, required: true, extract: {css: "h3 > a", attr: title}}
  - {name: price, type: price, extract: {css: p.price_color}}
  - {name: rating, type: enum, enum: [One, Two, Three, Four, Five], extract: {css: p.star-rating, attr: class}}
  - {name: in_stock, type: bool, extract: {css: p.availability}}
  - {name: description, scope: detail, extract: {xpath: "//div[@id='product_description']/following-sibling::p"}}
  - {name: tags, type: list, scope: detail, extract: {css: "ul.tags > li.tag"}}
"""


@pytest.fixture(scope="module")
def site(spark):
    lists = [(f"https://shop.example/list/page-{n}.html", list_page(n), n) for n in (1, 2, 3)]
    details = [(f"https://shop.example/item/{i}.html", detail_page(i)) for i in range(1, 15)]
    return spark.createDataFrame(lists, "url string, html string, page_no int"), spark.createDataFrame(details, "url string, html string")


def test_catalogue_end_to_end(site):
    recipe = R.load(CATALOGUE)
    listed = plan.extract(recipe, site[0])
    whole = rows.enrich(listed, plan.extract_detail(recipe, site[1]), ["description", "tags"])
    got = {r.title: r for r in rows.dedupe(whole, recipe.dedupe_key, ["page_no", "_index"]).collect()}
    assert len(got) == 15
    for i in range(1, 16):
        r = got[f"Widget {i:02d}"]
        assert (r.price, r.rating, r.in_stock) == (10 + 1.5 * i, RATINGS[i % 5], i % 4 != 0)
        assert r._url == f"https://shop.example/item/{i}.html" and r._page_url.endswith(f"page-{(i + 4) // 5}.html")
        if i < 15:
            assert r.description == f"Widget {i:02d} is a fine widget." and r.tags == list("abc"[: i % 3 + 1])
        else:
            assert r.description is None and r._provenance["_detail"] == "missing"
    nexts = {r.url: r.next_url for r in plan.next_pages(recipe, site[0]).collect()}
    assert sorted(v for v in nexts.values() if v) == [f"https://shop.example/list/page-{n}.html" for n in (2, 3)]


def test_page_budget_comes_before_parsing(site):
    recipe = R.load(CATALOGUE.replace("fields:", "limits: {max_pages: 2}\nfields:"))
    df = plan.extract(recipe, site[0])
    assert df.count() == 10


def test_embedded_json(spark):
    html = '<script id="__NEXT_DATA__" type="application/json">{"props": {"items": [{"n": "a", "p": 1.5}, {"n": "b", "p": "2"}]}}</script>'
    recipe = R.load('seeds: ["https://x"]\nlist: {container: "json:__NEXT_DATA__.props.items"}\nfields:\n  - {name: n, extract: {json_path: n}}\n  - {name: p, type: number, extract: {json_path: p}}\n')
    got = plan.extract(recipe, spark.createDataFrame([("https://x", html)], "url string, html string")).orderBy("_index").collect()
    assert [(r.n, r.p, r._url) for r in got] == [("a", 1.5, "https://x#item-0"), ("b", 2.0, "https://x#item-1")]


@pytest.mark.parametrize("bad", ["seeds: []", 'seeds: ["https://x/"]\nunknown: 1', 'seeds: ["https://x/"]\nfields: [{name: Bad, extract: {css: a}}]', 'seeds: ["https://x/"]\nfields: [{name: a, extract: {css: a, xpath: //a}}]', 'seeds: ["https://x/"]\nfields: [{name: a, type: enum, extract: {css: a}}]', 'seeds: ["https://x/"]\ndedupe_key: [zz]', 'seeds: ["https://x/"]\nfields: [{name: a, extract: {css: "a:hover"}}]', 'seeds: ["https://x/"]\npagination: {kind: next_link}'])
def test_bad_recipes(bad):
    with pytest.raises(ValueError):
        R.load(bad)


def test_recipe_round_trip_and_compatibility():
    a = R.load(CATALOGUE)
    b = R.load(a.dump())
    assert a == b and R.incompatible(a, b) == []
    b.seeds = ["https://other"]
    b.fields[0].type = "number"
    assert R.incompatible(a, b) == ["seeds", "fields.title"]
    assert R.load('seeds: ["https://x/"]').unready() == ["no fields", "no list container"]


DOM = '<div id="a" class="x y"><p>one<p>two <b>bold</div><ul><li>1<li class="k">2</ul><br><a href=/u title="t">l</a>'


@pytest.mark.parametrize(
    "sel,want",
    [("p", ["one", "two bold"]), ("div#a.x > p", ["one", "two bold"]), ("li.k", ["2"]), ("li:first-child", ["1"]), ("li:nth-child(2)", ["2"]), ("p + p", ["two bold"]), ("p ~ p", ["two bold"]), ("div, a", ["onetwo bold", "l"]), ("a::attr(href)", ["/u"]), ("b::text", ["bold"]), ("[title=t]", ["l"]), ("li:not(.k)", ["1"]), ("//li[2]", ["2"]), ("//a/@href", ["/u"]), ("//p[contains(., 'two')]/b/text()", ["bold"]), ("//div/following-sibling::ul/li[last()]", ["2"]), (".//li[@class='k']", ["2"])],
)
def test_selectors(sel, want):
    assert selectors.values(tree.parse(DOM), sel) == want


def test_unsupported_selectors_are_refused():
    for s in ("a:hover", "a >> b", "//a[position()>2]", ""):
        with pytest.raises(ValueError):
            selectors.check(s)


def test_blobs():
    html = '<script type="application/ld+json">{"a": 1}</script><script type="application/json" id="s">[1]</script><script>window.__STATE__ = {"q": "}\\"{", "n": [1, {}]}; x</script><script type="application/json" id="bad">{</script>'
    got = blobs.embedded(html)
    assert json.loads(got["ld+json"]) == [{"a": 1}] and got["s"] == "[1]" and json.loads(got["__STATE__"])["n"] == [1, {}] and "bad" not in got


def test_dedupe_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, ""), (4, "", None)], "n int, k string, j string")
    assert sorted(r.n for r in rows.dedupe(df, ["k", "j"], ["n"]).collect()) == [1, 3, 4]


RUN = "title string, price double, _url string, _n int"


def test_diff_and_partial(spark):
    old = spark.createDataFrame([("a", 1.0, "u1", 1), ("b", 2.0, "u2", 2), ("c", 3.0, "u3", 3)], RUN)
    new = spark.createDataFrame([("a", 1.0, "u1", 1), ("b", 9.0, "u2", 1), ("b", 2.5, "u2", 2), ("d", 4.0, "u4", 3)], RUN)
    c = changes.diff_counts(changes.diff(old, new, ["_url"], ["_n"])).first()
    assert (c.old_count, c.new_count, c.added, c.removed, c.changed, c.unchanged) == (3, 3, 1, 1, 1, 1)
    assert changes.diff_counts(changes.diff(old, new, ["_url"], ["_n"], partial=True)).first().removed == 0


def folded(spark, runs, tmp_path):
    data = changes.empty_dataset(spark)
    for k, (got, partial) in enumerate(runs):
        df = spark.createDataFrame([(u, str(p), u, 1) for u, p in got], "u string, price string, _url string, _n int")
        out = changes.fold(data, df, "r", ["_url"], ["_n"], F.lit(f"2024-01-{k + 1:02d}"), partial)
        out.write.parquet(f"{tmp_path}/{k}")
        last = spark.read.parquet(f"{tmp_path}/{k}")
        data = last.drop("action")
    return {r.key: r for r in last.collect()}


def test_fold_gone_and_back(spark, tmp_path):
    runs = [([("a", 1), ("b", 2)], False), ([("a", 1)], True), ([("a", 1)], False), ([("a", 1), ("b", 2)], False)]
    assert folded(spark, runs[:2], tmp_path / "1")["b"].gone is False
    assert folded(spark, runs[:3], tmp_path / "2")["b"].action == "gone"
    back = folded(spark, runs, tmp_path / "3")["b"]
    assert (back.gone, back.action, back.runs, back.changes) == (False, "unchanged", 2, 0)


def test_history_is_bounded(spark, tmp_path):
    got = folded(spark, [([("a", n)], False) for n in range(25)], tmp_path)["a"]
    assert got.changes == 24 and len(got.history) == 20 and got.history[-1]["diff"]["price"]["new"] == "24"


def test_retention(spark):
    runs = spark.createDataFrame([(i, "r", f"2024-01-0{i}", "running" if i == 5 else "finished") for i in range(1, 6)], "run_id int, recipe_id string, created_at string, status string")
    assert sorted(r.run_id for r in monitor.expired(runs, 2, None).collect()) == [1, 2]


def test_clean_urls_and_sitemaps(spark):
    text = '"https://a/1", <https://a/2>\nhttps://a/1 junk ftp://x https://a/3'
    got = readers.clean_urls(spark.createDataFrame([(text,)], "text string"), limit=2).orderBy("pos").collect()
    assert [r.url for r in got] == ["https://a/1", "https://a/2"]
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>/m1.xml</loc></sitemap><sitemap><loc>/m2.xml</loc></sitemap></sitemapindex>'
    one = '<urlset><url><loc>/p{}</loc><lastmod>2024-01-01</lastmod></url><url><loc>/both</loc></url></urlset>'
    maps = spark.createDataFrame([("https://x/s.xml", index), ("https://x/m1.xml", one.format(1)), ("https://x/m2.xml", one.format(2)), ("https://x/bad.xml", "<urlset><url>")], "url string, body string")
    assert sorted(r.loc for r in readers.sitemap_urls(maps, ["https://x/s.xml", "https://x/bad.xml"]).collect()) == ["https://x/both", "https://x/p1", "https://x/p2"]


def test_entries_of_one_address(spark):
    """Each entry, where it is asked for, also of an address that is listed twice."""
    entry = "<url><loc>/p</loc><lastmod>{}</lastmod></url>"
    maps = spark.createDataFrame([("https://x/a.xml", f"<urlset>{entry.format(1)}{entry.format(2)}</urlset>"), ("https://x/b.xml", f"<urlset>{entry.format(3)}</urlset>")], "url string, body string")
    got = readers.sitemap_urls(maps, ["https://x/a.xml", "https://x/b.xml"], every=True)
    assert sorted(r.lastmod for r in got.collect()) == ["1", "2", "3"]
    entries = readers.sitemap(maps)
    start = spark.createDataFrame([("https://x/a.xml",), ("https://x/b.xml",)], "url string")
    assert sorted(r.lastmod for r in readers.sitemap_walk(entries, start, every=True).collect()) == ["1", "2", "3"]
    seen = spark.createDataFrame([("https://x/p", "https://x/a.xml", 1)], "url string, base string, pos int")
    assert sorted(r.lastmod for r in readers.selected_urls(entries.unionByName(entries), seen=seen, every=True).collect()) == ["1", "3"]
    assert readers.selected_urls(entries, seen=seen.select("url")).count() == 0


def test_pages_of_one_address(spark):
    """pages stored under one address stay apart."""
    item = "<html><body><nav><ul>{}</ul></nav></body></html>"
    p = spark.createDataFrame([(1, "https://x/p", item.format("<li><a>a</a><li><a>b</a>")), (2, "https://x/p", item.format("<li><a>c</a>")), (3, "https://x/q", "<p>none</p>")], "page_id long, url string, html string")
    r = R.load("seeds: ['https://x/']\nlist: {container: 'nav > ul > li'}\nfields: [{name: label, extract: {css: a}}, {name: none, extract: {css: b}}]")
    assert sorted((x.page_id, x.label) for x in plan.extract(r, p, keep=["page_id"]).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    shown = run.preview(r, p).containers.collect()
    assert sorted((x["_page_url"], x["items"], x["which"]) for x in shown) == [("https://x/p", 1, "primary"), ("https://x/p", 2, "primary"), ("https://x/q", 0, "missing")]
    seeds = spark.createDataFrame([("f", k, u) for k, u in enumerate(["https://x/p", "https://x/q", "https://x/p", "https://x/q"])], "file string, offset long, line string")
    assert sorted((x.page_id, x.seed_no) for x in readers.seed_pages(seeds, p).collect()) == [(1, 0), (2, 2), (3, 1)]


def test_numbers_of_many_rows(spark):
    """rows are numbered alike whatever the sample that deals them."""
    df = spark.range(40_000, numPartitions=7).select((F.col("id") * 7919 % 40_009).alias("k"), F.sha1(F.col("id").cast("string")).alias("more"))
    want = df.withColumn("w", F.row_number().over(Window.orderBy("k")))
    assert rows.numbered(df, ["k"]).join(want, ["k", "more"]).where("n <> w").count() == 0


def test_spoken_pages(spark):
    """references that the SQL over pages does not know stand as they are."""
    p = spark.createDataFrame([(1, "https://x/", "<title>a &amp; b &quot;c&quot; &&&amp</title>")], "page_id long, url string, html string")
    r = R.load("seeds: ['https://x/']\npage_type: single\nfields: [{name: title, extract: {css: title}}]")
    assert plan.extract(r, queries._spoken(p)).first().title == "a & b &quot;c&quot; &&&amp"


def test_robots():
    rules = readers.robots_rules("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n")
    assert [a for a, _ in rules] == [False, True, False] or len(rules) == 3


def test_platform_needs_a_strong_sign(spark):
    pages = spark.createDataFrame([("weak", '<img src="//cdn.shopify.com/x"><div id="shopify-section-1">', None), ("strong", "x", {"Powered-By": "Shopify"}), ("plugin", '<body class="a woocommerce b">', None)], "url string, html string, headers map<string,string>")
    got = {(r.url, r.platform): r.detected for r in inference.platforms(pages, headers="headers").collect()}
    assert got == {("weak", "shopify"): False, ("strong", "shopify"): True}


def test_healing(spark):
    old = tree.parse(list_page(1))
    price = selectors.nodes(old, "article.product_pod")[0]
    fp = analysis.fingerprint(selectors.nodes(price, "p.price_color")[0], price)
    new = list_page(1).replace("p class=\"price_color\"", "span class=\"amount\"").replace("</p><p class=\"star", "</span><p class=\"star")
    known = spark.createDataFrame([("price", fp)], f"field string, fp struct<{heal.FINGERPRINT}>")
    got = heal.relocate(spark.createDataFrame([("u", new)], "url string, html string"), "article.product_pod", known).first()
    assert got.selector == "span.amount" and got.fill == 1.0
    fixed = heal.patched(R.load(CATALOGUE), {"price": got.selector})
    assert fixed.fields[1].extract.css == "span.amount" and fixed.fields[1].alternates[0].css == "p.price_color"


def test_outside_calls_are_batched_and_filtered(spark):
    df = spark.createDataFrame([(i, "t", None if i % 2 else "have") for i in range(50)], "id int, text string, v string")
    got = outside.call(df, "id", ["text"], ["v"], lambda batch: [{"v": len(batch)} for _ in batch][:-1])
    found = [int(r.v) for r in got.collect() if r.v]
    assert got.count() == 25 and max(found) <= outside.BATCH


def test_stream_fan_out(spark, tmp_path):
    lines = [{"t": "item", "run_id": "r", "seq": i, "row": "{}"} for i in range(3)] + [{"t": "fill", "run_id": "r", "seq": 9, "rate": 0.5}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    s = ingest.read_events(spark, str(tmp_path / "in"))
    q = ingest.fan_out(s, {k: ingest.append_once(f"{tmp_path}/{k}") for k in ("item", "fill")}, f"{tmp_path}/c", {"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/item").count() == 3 and spark.read.parquet(f"{tmp_path}/fill").count() == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a<b", [1, None], {"k": "v"}, "u", None), ("é", [], {}, "w", {"x": "primary"})], "title string, tags array<int>, m map<string,string>, _url string, _provenance map<string,string>")
    columns = sinks.column_order(["title"], df.columns)
    assert columns == ["title", "tags", "m", "_url"]
    sinks.csv_file(df, f"{tmp_path}/a.csv", columns)
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and "1; " in raw.decode("utf-8-sig")
    sinks.json_file(df, f"{tmp_path}/a.json", columns)
    assert json.loads((tmp_path / "a.json").read_text())[1]["title"] == "é"
    sinks.xlsx_file(df, f"{tmp_path}/a.xlsx", columns, "S" * 40)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert "a&lt;b" in z.read("xl/worksheets/sheet1.xml").decode() and "S" * 31 in z.read("xl/workbook.xml").decode()
    sinks.write_jsonl(df, f"{tmp_path}/j", columns)
    assert readers.json_lines(spark, f"{tmp_path}/j", "title string").count() == 2


def test_analysis():
    got = analysis.analyse(list_page(2), "https://shop.example/list/page-2.html")
    assert got["containers"][0]["count"] == 5 and "product_pod" in got["containers"][0]["selector"]
    assert any(f["type"] == "price" for f in got["fields"]) and got["pagination"][0]["kind"] == "next_link"
