"""The node table against the tree it comes from, and its operators against loops over that tree."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from weftwork import job_queries
from weftwork.dom import analysis, nodes, reading, selectors, tree
from weftwork.operators import structure

TAGS = ["div", "ul", "li", "p", "a", "b", "h2", "span", "img"]


def page(rng, n):
    out, open_ = [], []
    for _ in range(n):
        t = rng.choice(TAGS)
        cls = rng.choice(["", ' class="card"', ' class="x card"', ' id="main"'])
        out.append(f"<{t}{cls}{' href=/' + str(rng.randrange(9)) if t == 'a' else ' src=i.png' if t == 'img' else ''}>")
        if t != "img":
            open_.append(t)
        if rng.random() < 0.6:
            out.append(rng.choice(["text ", " £12.50", "2024-03-05", "<!-- c -->", "&amp; more", "  "]))
        while open_ and rng.random() < 0.6:
            out.append(f"</{open_.pop()}>")
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    own = {k: page(rng, 60) for k in range(25)}
    shop = '<ul class="list">' + "".join(f'<li class="card"><h2><a href="/i{k}">Item number {k}</a></h2><span class="cost">£{k}.50</span><p>It is good in {k} ways.</p></li>' for k in range(6)) + '</ul><div class="card"><a href="/x">x</a></div>'
    deep = "<div>" * 3000 + "end"
    return own | {100: shop, 101: deep, 102: "", 103: None, 104: "{}", 105: "just text"}


@pytest.fixture(scope="module")
def table(spark, pages):
    df = spark.createDataFrame([(k, h, f"s{k % 2}") for k, h in pages.items()], "page_id int, html string, site string").repartition(3)
    return nodes.nodes(df).join(df.select("page_id", "site"), "page_id").cache()


def test_nodes_are_the_tree(pages, table):
    got = {}
    for r in table.orderBy("page_id", "pre").collect():
        got.setdefault(r.page_id, []).append(r)
    for k, html in pages.items():
        root = tree.parse(html)
        elements = list(root.walk())
        rows = got.get(k, [])
        assert [r.pre for r in rows] == list(range(len(rows)))
        mine = [r for r in rows if r.tag != "#text"]
        assert [(r.tag, r.attrs, r.step) for r in mine] == [(n.tag, n.attrs, analysis.step(n)) for n in elements]
        at = {r.pre: n for r, n in zip(mine, elements, strict=True)}
        for r in mine:
            n = at[r.pre]
            assert [at[x.pre] for x in mine if r.pre < x.pre <= r.post] == list(n.walk()) if len(mine) < 500 else True
            assert r.parent == -1 if n.parent is root else at[r.parent] is n.parent
            assert "".join(x.own for x in rows[r.pre + 1 : r.post + 1] if x.tag == "#text") == n.text() if len(mine) < 500 else True
    assert set(got) == {k for k in pages if k not in (102, 103, 104)} and got[101][-1].depth == 3000


def test_measures(pages, table):
    order = {}
    for r in sorted(structure.measured(table.where("page_id < 100")).collect(), key=lambda r: r.pre):
        order.setdefault(r.page_id, []).append(r)
    for k, rows in order.items():
        for r, n in zip(rows, tree.parse(pages[k]).walk(), strict=True):
            texts = [x for m in [n, *n.walk()] for x in m.kids if isinstance(x, str)]
            assert r.chars == sum(len(" ".join(x.split())) for x in texts) and r.links == sum(m.tag == "a" for m in [n, *n.walk()])
    got = {(r.page_id, r.step, r.chars, r.links) for r in structure.measured(table.where("page_id = 100")).collect()}
    assert (100, "li.card", len("Item number 0" + "£0.50" + "It is good in 0 ways."), 1) in got and (100, "a", 1, 1) in got and any(s == "ul.list" and n == 6 for _, s, _, n in got)


def test_containers(pages, table):
    found = structure.containers(table)
    got = Counter({(r.page_id, r.selector): r.items for r in found.collect()})
    want = Counter()
    for k, html in pages.items():
        for n in [(root := tree.parse(html)), *root.walk()]:
            for sig, c in Counter(map(analysis.step, n.elements())).items():
                if c >= 3:
                    want[(k, f"{analysis.step(n)} > {sig}" if n.tag not in ("#document", "html", "body") else sig)] += c
    assert got.keys() <= want.keys() and all(want[x] == n for x, n in got.items())
    best = {r.page_id: r.selector for r in structure.best_containers(found).collect()}
    assert best[100] == "ul.list > li.card" == analysis.containers(tree.parse(pages[100]))[0]["selector"]
    by_site = structure.containers(table, by=["site"]).where("selector = 'ul.list > li.card'").collect()
    assert [(r.site, r.items, r.pages) for r in by_site] == [("s0", 6, 1)]


def test_page_containers_of_short_texts(spark, tmp_path):
    """As the SQL has it: paragraphs count whatever their length, list texts by the characters that are written."""
    menu = lambda *texts: "<nav><ul>" + "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(texts)) + "</ul></nav>"
    told = lambda *texts: "<article><h1>x</h1>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    own = [menu("a &amp; b", "c &amp; d", "e &amp; f") + told("One.", "Two.", "Six."), menu("word", "to", "of") + told("", "", ""), menu("wordwordword", "wordwordword", "to") + told("long enough to count", "x"), None, ""]
    spark.createDataFrame(list(enumerate(own)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT page_id, selector, items FROM ({job_queries.SQL['page_containers']})").fetchall())
    assert want == [(0, "article > p", 3), (0, "ul > li", 3), (1, "article > p", 3), (2, "ul > li", 3)]
    assert sorted(tuple(r) for r in job_queries.page_containers(spark, str(tmp_path)).collect()) == want


def test_page_containers_of_long_lists(spark, tmp_path):
    """every item of a list counts for its average, with its whole text."""
    menu = lambda *texts: "<nav><ul>" + "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(texts)) + "</ul></nav>"
    own = [menu(*["ten chars."] * 20, *["no"] * 60), menu(*["no"] * 20, *["ten chars."] * 60), menu("x" * 300, *["to"] * 30), menu("x" * 130, *["to"] * 30)]
    spark.createDataFrame(list(enumerate(own)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT page_id, selector, items FROM ({job_queries.SQL['page_containers']})").fetchall())
    assert want == [(1, "ul > li", 80), (2, "ul > li", 31)]
    assert sorted(tuple(r) for r in job_queries.page_containers(spark, str(tmp_path)).collect()) == want


def test_sibling_runs(pages, table):
    got = Counter((r.page_id, r.step, r.length) for r in structure.sibling_runs(table).collect())
    want = Counter()
    for k, html in pages.items():
        for n in [(root := tree.parse(html)), *root.walk()]:
            steps, i = list(map(analysis.step, n.elements())), 0
            while i < len(steps):
                j = i
                while j < len(steps) and steps[j] == steps[i]:
                    j += 1
                want[(k, steps[i], j - i)] += 1
                i = j
    assert got == want
    more = {r.page_id: r.more for r in structure.folded(structure.sibling_runs(table.where("page_id = 100"))).collect()}
    assert more == {100: 4} and "+4 more li.card" in reading.outline(pages[100])


def test_inside_and_outermost(pages, table):
    """Items of every div: nested ones are left out, and each node knows the outermost one around it."""
    items = structure.items_by(table, None, "div")
    for own in (False, True):
        got = {(r.page_id, r.pre): r.item for r in structure.inside(table, items, own=own).collect()}
        assert len(got) == table.count()
        rows = {}
        for r in table.collect():
            rows.setdefault(r.page_id, []).append(r)
        for k, rs in rows.items():
            if len(rs) > 500:
                continue
            top, reach = [], -1
            for r in sorted(rs, key=lambda r: r.pre):
                if r.step == "div" and r.pre > reach:
                    top.append(r)
                    reach = r.post
            for r in rs:
                around = [i for i, t in enumerate(top) if (t.pre <= r.pre if own else t.pre < r.pre) and r.pre <= t.post]
                assert got[(k, r.pre)] == (around[0] if around else None)


def test_fields_votes_and_hits(spark, table):
    items = structure.items_by(table, "ul.list", "li.card")
    got = {r.selector: (r.fill, r.different, r.kind) for r in structure.fields(table, items).collect()}
    assert got == {"a": (1.0, 6, "text"), "span.cost": (1.0, 6, "price"), "p": (1.0, 6, "text")}
    assert [(r.page_id, r.preference, r.links, r.different) for r in structure.link_votes(table, items).collect()] == [(100, "h2", 6, 6)]
    assert [(r.site, r.preference) for r in structure.link_votes(table, items, by=["site"]).collect()] == [("s0", "h2")]
    wanted = spark.createDataFrame([(100, "ITEM NUMBER 3"), (100, "/i"), (100, "nothing"), (100, "item number 3")], "page_id int, needle string")
    hits = sorted((r.needle, r.step, r.attr or "", r.item, r.fill) for r in structure.text_hits(table, wanted, items).collect())
    assert hits == sorted([("/i", "a", "href", k, 6) for k in range(6)] + [("ITEM NUMBER 3", "a", "", 3, 6), ("item number 3", "a", "", 3, 6)])
    assert structure.text_hits(table, wanted).where("fill <> 0 OR item IS NOT NULL").count() == 0


def test_no_pages(spark):
    none = nodes.nodes(spark.createDataFrame([], "page_id long, html string"))
    items = structure.items_by(none, "ul", "li")
    for df in (none, structure.containers(none), structure.sibling_runs(none), structure.inside(none, items), structure.fields(none, items), structure.link_votes(none, items)):
        assert df.count() == 0
    assert selectors.norm(" a  b ") == "a b" and none.agg(F.count("*")).first()[0] == 0
