"""What unknown pages and captured responses are: platforms by weighted signs, responses by how much they look like the page's list."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonpath, pages, urls

DETECTED, STRONG = 6, 4


@dataclass(frozen=True)
class Sign:
    """A sign counts once if one of its needles is in the target, or its pattern matches there."""

    platform: str
    name: str
    weight: int
    needles: tuple[str, ...] = ()
    pattern: str = ""
    target: str = "html"


# The signs of each platform and what they weigh.  Targets are the page, one header, or page and headers.
SIGNS = (
    Sign("shopify", "powered-by header", 6, ("shopify",), target="header:powered-by:lower"),
    Sign("shopify", "server-timing theme/pageType", 4, ("theme;desc", "pageType;desc"), target="header:server-timing"),
    Sign("shopify", "shopify-complexity-score header", 4, pattern=".", target="header:shopify-complexity-score|shopify-complexity-score-v2"),
    Sign("shopify", "_shopify_* cookies", 4, ("_shopify_y", "_shopify_s", "_shopify_essential"), target="header:set-cookie"),
    Sign("shopify", "Shopify.shop global", 5, pattern=r"[\w-]+\.myshopify\.com"),
    Sign("shopify", "theme markup", 3, ("ShopifyAnalytics", "shopify-section-")),
    Sign("shopify", "storefront meta tags", 3, ("shopify-checkout-api-token", "shopify-digital-wallet")),
    Sign("shopify", "cdn.shopify.com assets", 2, ("cdn.shopify.com", "/cdn/shop/")),
    Sign("wordpress", "Link rel=api.w.org header", 5, ("https://api.w.org/",), target="header:link"),
    Sign("wordpress", "<link rel=api.w.org>", 5, pattern=r"""(?i)<link[^>]+rel=["']https://api\.w\.org/["']"""),
    Sign("wordpress", "wp-content / wp-includes assets", 3, ("/wp-content/", "/wp-includes/")),
    Sign("wordpress", "generator meta", 3, pattern=r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']WordPress"""),
    Sign("woocommerce", "woocommerce body class", 4, pattern=r"""(?i)<body[^>]+class=["'][^"']*woocommerce"""),
    Sign("woocommerce", "generator meta", 4, pattern=r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']WooCommerce"""),
    Sign("woocommerce", "woocommerce assets", 3, ("wc-cart-fragments", "/plugins/woocommerce/")),
    Sign("woocommerce", "add-to-cart links", 2, ("?add-to-cart=",)),
    Sign("bigcommerce", "mybigcommerce canonical", 5, ("mybigcommerce.com",), target="all"),
    Sign("bigcommerce", "stencil theme runtime", 4, ("stencil-utils",), target="all"),
    Sign("bigcommerce", "bigcommerce CDN", 5, ("cdn11.bigcommerce.com",), target="all"),
    Sign("squarespace", "Static.SQUARESPACE_CONTEXT", 6, ("SQUARESPACE_CONTEXT",), target="all"),
    Sign("squarespace", "squarespace CDN", 5, ("static1.squarespace.com",), target="all"),
    Sign("squarespace", "squarespace image CDN", 5, ("squarespace-cdn.com",), target="all"),
    Sign("wix", "parastorage assets", 5, ("static.parastorage.com",), target="all"),
    Sign("wix", "wix runtime", 4, ("wix-code",), target="all"),
    Sign("wix", "wix header", 5, ("X-Wix-Request-Id",), target="all"),
    Sign("magento", "Magento modules", 4, ("Magento_",), target="all"),
    Sign("magento", "magento static paths", 3, ("/static/frontend/",), target="all"),
    Sign("magento", "mage runtime", 4, ("mage/cookies",), target="all"),
    Sign("webflow", "webflow runtime", 4, ("webflow.js",), target="all"),
    Sign("webflow", "webflow page attributes", 5, ("data-wf-page",), target="all"),
)


def _target(target: str, html: Column, headers: Column) -> Column:
    if target.startswith("header:"):
        _, name, *low = target.split(":")
        value = F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k).isin(*name.split("|")))), F.lit(0)), F.lit(""))
        return F.lower(value) if low else value
    if target == "all":
        flat = F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
        return F.concat(html, F.lit("\n"), flat)
    return html


def platforms(table: DataFrame, html: str = "html", headers: str | None = None, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """keep, platform, score, detected, signs; best first by rank.  One pass over the pages, no join."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")) if headers else F.create_map().cast("map<string,string>")
    hits = []
    for s in SIGNS:
        where = _target(s.target, body, head)
        test = where.rlike(s.pattern) if s.pattern else F.lit(False)
        for n in s.needles:
            test = test | F.contains(where, F.lit(n))
        hits.append(F.when(test, F.struct(F.lit(s.platform).alias("platform"), F.lit(s.name).alias("name"), F.lit(s.weight).alias("weight"))))
    found = table.select(*keep, F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("_hits"))
    names = sorted({s.platform for s in SIGNS})

    def score(p: str) -> Column:
        own = F.filter("_hits", lambda h: h["platform"] == p)
        total = F.aggregate(own, F.lit(0), lambda a, h: a + h["weight"])
        most = F.coalesce(F.array_max(F.transform(own, lambda h: h["weight"])), F.lit(0))
        return F.struct(F.lit(p).alias("platform"), total.alias("score"), ((total >= DETECTED) & (most >= STRONG)).alias("detected"), F.transform(own, lambda h: h["name"]).alias("signs"))

    each = found.withColumn("_all", F.array(*map(score, names)))
    wordpress = F.exists("_all", lambda x: (x["platform"] == "wordpress") & x["detected"])
    fit = F.filter("_all", lambda x: (x["score"] > 0) & ((x["platform"] != "woocommerce") | F.col("_wp")))
    # a dozen platforms at most, put in order inside the row
    fit = F.transform(fit, lambda x: F.struct((~x["detected"]).alias("a"), (-x["score"]).alias("b"), x["platform"].alias("platform"), x["score"].alias("score"), x["detected"].alias("detected"), x["signs"].alias("signs")))
    ranked = each.withColumn("_wp", wordpress).select(*keep, F.posexplode(F.array_sort(fit)).alias("_at", "_x"))
    return ranked.select(*keep, "_x.platform", "_x.score", "_x.detected", "_x.signs", (F.col("_at") + 1).cast("int").alias("rank"))


# ---- captured responses -------------------------------------------------------------------

ITEMS, STRINGS, PER_LIST = 8, 60, 5
#: Levels below the document that are searched for lists, elements of a list that are entered, keys shown.
DEPTH, ENTERED, KEYS = 6, 3, 12
LISTS = "array<struct<container:string,count:bigint,keys:array<string>,strings:array<string>,first:string>>"


def _strings(v: Any, out: list[str]) -> None:
    """Texts of 4 to 119 characters inside a value, five items of a list, up to sixty."""
    if len(out) < STRINGS:
        if isinstance(v, str):
            if 3 < len(v) < 120:
                out.append(v)
        elif isinstance(v, dict | list):
            for x in v.values() if isinstance(v, dict) else v[:PER_LIST]:
                _strings(x, out)


def lists_in(document: Any, name: str, top: int, least: int = 3) -> list[dict]:
    """Lists most of whose first ten elements are objects, the longest first, as they come in the document."""
    found, todo = [], deque([(document, "", 0)])
    while todo:
        v, path, depth = todo.popleft()
        if depth > DEPTH:
            continue
        if isinstance(v, list):
            objects = [x for x in v[:10] if isinstance(x, dict)]
            if len(v) >= least and len(objects) >= min(least, len(v)):
                strings: list[str] = []
                for x in v[:ITEMS]:
                    _strings(x, strings)
                first = v[0] if isinstance(v[0], dict) else objects[0]
                found.append({"container": f"json:{name}{path}[*]", "count": len(v), "keys": sorted({k for x in objects for k in x})[:KEYS], "strings": strings[:STRINGS], "first": json.dumps(first, ensure_ascii=False)})
            todo.extend((x, f"{path}[{i}]" if path else f".[{i}]", depth + 1) for i, x in enumerate(v[:ENTERED]))
        elif isinstance(v, dict):
            todo.extend((x, f"{path}.{k}", depth + 1) for k, x in v.items())
    return sorted(found, key=lambda f: -f["count"])[:top]


def json_lists(body: Column, name: str = "body", top: int = 5, least: int = 3) -> Column:
    """The lists of objects in JSON texts: container, count, keys, strings of the first items, and the first item as JSON."""

    @F.pandas_udf(LISTS)
    def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> list[dict]:
            try:
                return [] if text is None else lists_in(json.loads(text), name, top, least)
            except (ValueError, RecursionError):
                return []

        for b in batches:
            yield b.map(one)

    return lists(body)


def strings_of(body: Column) -> Column:
    """The texts of 4 to 119 characters in a JSON document, five elements of a list, at most sixty."""

    @F.pandas_udf("array<string>")
    def strings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> list[str]:
            out: list[str] = []
            try:
                _strings(None if text is None else json.loads(text), out)
            except (ValueError, RecursionError):
                return []
            return out

        for b in batches:
            yield b.map(one)

    return strings(body)


def overlap(strings: Column, text: Column) -> Column:
    """The share of an item list's strings that can be read on the page."""
    low = F.lower(text)
    hits = F.size(F.filter(strings, lambda s: F.contains(low, F.lower(s))))
    return F.when((F.size(strings) > 0) & (F.coalesce(text, F.lit("")) != ""), hits / F.size(strings)).otherwise(F.lit(0.0))


def responses(captures: DataFrame, page_text: Column, top: int = 5) -> DataFrame:
    """Captured responses (page, url, method, body) ranked by how much they look like the page's list.

    Scores are worked out where the body and the page's text are; what goes on is a few numbers a list.
    """
    docs = captures.where(F.upper("method").isin("GET", "POST")).withColumns({"_l": json_lists(F.col("body"), top=3), "_text": page_text, "_doc": F.try_parse_json("body")})
    each = F.transform("_l", lambda x: F.struct(x["container"].alias("container"), x["count"].alias("count"), x["keys"].alias("keys"), overlap(x["strings"], F.col("_text")).alias("share")))
    found = docs.select("page", "url", "method", urls.cursor_path(F.col("_doc")).alias("_cursor"), F.inline(each))
    paging = urls.paging(F.col("url"), F.col("count"), None)
    cursor = F.exists(urls.parameters(F.col("url")), lambda x: F.lower(x["k"]).isin(*urls.CURSOR_PARAMS)) & F.col("_cursor").isNotNull()
    by_cursor = (paging["kind"] == "none") & cursor
    paging = F.struct(F.when(by_cursor, "cursor").otherwise(paging["kind"]).alias("kind"), paging["start"].alias("start"), paging["step"].alias("step"), paging["page_size"].alias("page_size"), paging["page_key"].alias("page_key"), F.when(by_cursor, F.col("_cursor")).alias("cursor_path"))
    depth = F.size(F.split("container", r"\.")) - 1
    share = F.col("share")
    score = (
        F.when(depth <= 2, 3).otherwise(0)
        + F.when(share >= 0.4, 5).when(share > 0, 2).otherwise(0)
        + F.when(F.col("url").rlike(urls.API), 2).otherwise(0)
        + F.when(paging["kind"] != "none", 2).otherwise(0)
        + F.floor(F.least("count", F.lit(30)) / 10)
        - F.when(F.col("url").rlike(urls.NOISE), 6).otherwise(0)
        - F.when(F.upper("method") == "POST", 1).otherwise(0)
    )
    scored = found.withColumns({"share": F.round(share, 6), "score": score.cast("int"), "paging": paging}).where("score > 2")
    best = Window.partitionBy("page").orderBy(F.col("score").desc(), F.col("count").desc(), "url", "container")
    one = Window.partitionBy("page", "url", "container").orderBy(F.col("score").desc(), F.col("count").desc())
    kept = scored.withColumn("_d", F.row_number().over(one)).where("_d = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return kept.select("page", "url", "container", "count", "keys", "share", "score", "paging", "rank")


def confirmed(probes: DataFrame, verdicts: DataFrame | None = None, now: Column | None = None, days: int = 7) -> DataFrame:
    """The first candidate endpoint of each page that answers with the list it should, else the reason it does not.

    probes: page, platform, endpoint, order, allowed, status, content_type, redirected, body.
    verdicts: page, platform, at and result of earlier checks; young ones are taken as they are.
    """
    doc = F.try_parse_json("body")
    lists = F.when(F.col("platform") == "shopify", jsonpath.is_array(F.try_variant_get(doc, "$.products", "variant"))).otherwise(jsonpath.is_array(doc))
    why = (
        F.when(~F.col("allowed"), "robots.txt forbids it")
        .when(F.col("redirected"), "it redirects")
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~F.contains(F.lower("content_type"), F.lit("json")), "it is not JSON")
        .when(doc.isNull(), "its JSON is broken")
        .when(~F.coalesce(lists, F.lit(False)), "it is not the list expected")
    )
    judged = probes.withColumn("reason", why)
    if verdicts is not None:
        fresh = verdicts.where(F.timestamp_diff("DAY", F.col("at").cast("timestamp"), now.cast("timestamp")) < days)
        judged = judged.join(fresh.select("page", "platform"), ["page", "platform"], "left_anti")
    best = judged.groupBy("page", "platform").agg(F.min_by("endpoint", F.when(F.col("reason").isNull(), F.col("order"))).alias("endpoint"), F.max_by("reason", "order").alias("last_reason"))
    best = best.select("page", "platform", "endpoint", F.when(F.col("endpoint").isNull(), F.col("last_reason")).alias("reason"))
    if verdicts is None:
        return best
    kept = fresh.select("page", "platform", F.col("result").alias("endpoint"), F.lit(None).cast("string").alias("reason"))
    return best.unionByName(kept)


def page_type_hints(table: DataFrame, html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """keep, prices, dates, scripts, text_chars, login: what a page's text shows without a tree."""
    text = pages.visible_text(F.col(html))
    return table.select(*keep, text.alias("_t"), html).select(
        *keep,
        F.regexp_count("_t", F.lit(pages.PRICE)).alias("prices"),
        F.regexp_count("_t", F.lit(pages.DATE)).alias("dates"),
        pages.script_count(F.col(html)).alias("scripts"),
        F.length("_t").alias("text_chars"),
        F.col(html).rlike(r"""(?i)<input[^>]+type=["']password["']""").alias("login"),
    )
