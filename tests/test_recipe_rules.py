"""Faults that a recipe is refused for, one by one, and what a recipe becomes on an endpoint."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftwork.plans import compile as plan
from weftwork.plans import recipe as R
from weftwork.plans import run

HEAD = "seeds: ['https://x.example/']\n"
FIELD = "fields: [{name: a, extract: {css: a}%s}]\n"
SOUND = HEAD + FIELD % ""


def transform(body):
    return HEAD + FIELD % f", transforms: [{{{body}}}]"


FAULTS = {
    "kind: replace, value: x": "needs a pattern",
    "kind: regex_replace, value: x": "needs a pattern",
    "kind: regex_replace, pattern: '('": "does not compile",
    "kind: strip_prefix": "needs a value",
    "kind: strip_suffix": "needs a value",
    "kind: prepend": "needs a value",
    "kind: append": "needs a value",
    "kind: shout": "unknown transform",
}
PARTS = {
    "pagination: {kind: next_link}": "needs a selector",
    "pagination: {kind: load_more}": "needs a selector",
    "pagination: {kind: xhr_json}": "needs an address",
    "pagination: {kind: xhr_json, xhr_url_template: 'https://x/{page}'}": "the path of its items",
    "pagination: {kind: url_template, url_template: /p}": "{page}",
    "detail: {enabled: true}": "need a link",
    "source: {kind: urls}": "list of URLs is empty",
    "source: {max_urls: 0}": "one at least",
    "source: {include: '('}": "does not compile",
    "incremental: {refetch_after_days: 0}": "one at least",
    "api: {url_template: '/p?page={page}'}": "http",
    "api: {url_template: 'https://x/p'}": "no place for its page",
    "api: {url_template: 'https://x/p', paging: {kind: cursor, cursor_path: c}}": "no place for its page or cursor",
    "api: {url_template: 'https://x/{page}', paging: {page_size: 0}}": "one item at least",
    "api: {url_template: 'https://x/{page}', body_template: q}": "POST",
    "api: {url_template: 'https://x/{cursor}', paging: {kind: cursor}}": "cursor_path",
    "dedupe_key: [b]": "names no field",
    "unknown: 1": "Extra inputs",
}


@pytest.mark.parametrize("body", FAULTS)
def test_transforms(body):
    with pytest.raises(ValueError, match=FAULTS[body]):
        R.load(transform(body))


@pytest.mark.parametrize("part", PARTS)
def test_parts(part):
    R.load(SOUND)
    with pytest.raises(ValueError, match=PARTS[part].replace("{", r"\{")):
        R.load(SOUND + part + "\n")


def test_seeds_and_scopes():
    for seeds in ("[a]", "['ftp://x/']", "['https://x/', '/b']", "[]"):
        with pytest.raises(ValueError, match="http|at least 1"):
            R.load(f"seeds: {seeds}\n" + FIELD % "")
    with pytest.raises(ValueError, match="detail fields need detail pages"):
        R.load(HEAD + FIELD % ", scope: detail")
    assert R.load(HEAD + "detail: {enabled: true, link: {css: a}}\n" + FIELD % ", scope: detail").detail.enabled


def test_sound_ones():
    for part in ("api: {url_template: 'https://x/p', paging: {kind: none}}", "api: {url_template: 'https://x/p', method: POST, body_template: '{page}'}", "incremental: {refetch_after_days: null}", "pagination: {kind: load_more, selector: button}"):
        R.load(SOUND + part + "\n")
    assert R.load(SOUND).incremental.refetch_after_days == 30
    assert R.load(HEAD + FIELD % ", type: list").fields[0].extract.all and not R.load(SOUND).fields[0].extract.all
    assert not R.load(HEAD + "fields: [{name: a, type: list, extract: {json_path: a}}]\n").fields[0].extract.all


def test_readiness():
    assert R.load(HEAD).unready() == ["no fields", "no list container"]
    assert R.load(SOUND + "list: {container: ' '}\n").unready() == ["no list container"]
    assert R.load(SOUND + "list: {container: li}\napi: {url_template: 'https://x/{page}'}\n").unready() == ["an endpoint needs a json: container"]
    assert R.load(HEAD + "list: {container: li}\npagination: {kind: next_link, selector: ' '}\nfields: [{name: a, extract: {json_path: ' '}}]\n").unready() == ["no place for the next link", "a has nothing to look for"]
    assert R.load(SOUND + "list: {container: li}\n").unready() == [] and R.load(SOUND + "page_type: single\n").unready() == []


OLD = HEAD + """list: {container: li.card, alternates: [li.a, li.b, li.c]}
detail: {enabled: true, link: {css: a}}
dedupe_key: [sku]
fields:
  - {name: title, required: true, description: name, extract: {css: h2}, alternates: [{css: h3}, {css: h4}, {css: h5}]}
  - {name: size, type: enum, enum: [S, M], extract: {css: b}}
  - {name: sku, extract: {css: i}}
  - {name: more, extract: {json_path: m}}
"""


def moved(paging, text=OLD):
    new = [R.Field(name=n, extract=R.Extractor(json_path=n), **x) for n, x in (("title", {}), ("size", {}), ("link", {"type": "url"}), ("more", {"type": "number"}))]
    return run.onto_api(R.load(text), "https://x.example/p.json?page={page}&limit={limit}", "json:body.items[*]", new, paging)


def test_a_recipe_on_an_endpoint():
    r = moved({"page_size": 250})
    f = {x.name: x for x in r.fields}
    assert list(f) == ["title", "size", "link", "more", "sku"]
    assert [e.css for e in f["title"].alternates] == ["h2", "h3", "h4"] and f["title"].required and f["title"].description == "name"
    assert (f["size"].type, f["size"].enum) == ("enum", ["S", "M"]) and f["more"].type == "number" and f["more"].alternates == []
    assert (r.list_.container, r.list_.alternates) == ("json:body.items[*]", ["li.card", "li.a", "li.b"])
    assert r.dedupe_key == ["_url"] and not r.detail.enabled and r.unready() == []


def test_budgets_of_an_endpoint():
    assert (r := moved({"page_size": 250}).limits).max_pages == 100 and r.max_items == 25_000
    assert (r := moved({"page_size": 50}).limits).max_pages == 20 and r.max_items == 1000
    assert (r := moved({}).limits).max_items == 1000
    chosen = moved({"page_size": 250}, OLD + "limits: {max_items: 700}\n").limits
    assert (chosen.max_pages, chosen.max_items) == (100, 700)


def test_a_moved_recipe_reads_more_than_a_thousand_items(spark):
    """Five pages of 250: all rows come, where the old budget stopped at a thousand."""
    rows = spark.range(1250).select(((F.col("id") / 250).cast("int") + 1).alias("page_no"), F.struct(F.col("id").cast("string").alias("title"), F.concat(F.lit("/i/"), "id").alias("link")).alias("item"))
    docs = rows.groupBy("page_no").agg(F.to_json(F.struct(F.collect_list("item").alias("items"))).alias("body"))
    docs = docs.withColumn("url", F.concat(F.lit("https://x.example/p.json?page="), "page_no"))
    r = moved({"page_size": 250})
    assert r.page_budget() == 100 and run.run(r, docs).items.count() == 1250
    assert plan.extract(r, docs).select("title").distinct().count() == 1250
