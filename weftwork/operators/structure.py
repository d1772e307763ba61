"""What the nodes of pages tell, as joins, windows and groups over the node table (`dom.nodes`).

Nothing here parses: repeated containers, items and what lies in them, fields, link votes, runs of like
siblings and texts are found by numbers.  Windows run within a page, joins are on the page and a number.
`by` widens a question from the page to whatever the nodes carry, a host for instance: then the evidence of all its
pages counts together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dom.nodes import TEXT
from ..functions.pages import DATE, PRICE

# A group's least size, the least average text of its items and the most that counts; the least share of
# items that fill a field, and the shares from which it is a price or a date.
LEAST, SHORT, LONG = 3, 8, 400
FILL, PRICES, DATES = 0.5, 0.7, 0.6
#: The least share of different addresses among an item's links, and where its own link is looked for.
DIFFERENT, PREFERENCES = 0.8, ("h1", "h2", "h3", "h4", "")
_OUTER = ("#document", "html", "body")


def _norm(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tag") != TEXT)


def measured(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """Elements with chars (of the texts inside, blanks collapsed) and links inside: running sums, and those at the last node inside."""
    run = Window.partitionBy(page).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.when(F.col("tag") == TEXT, F.length(_norm("own"))).otherwise(0)
    links = ((F.col("tag") == "a") & F.col("attrs").isNotNull()).cast("int")
    sums = nodes.withColumns({"_chars": F.sum(chars).over(run), "_links": F.sum(links).over(run), "_own": links})
    ends = sums.select(page, F.col("pre").alias("post"), F.col("_chars").alias("_c"), F.col("_links").alias("_l"))
    out = sums.where(F.col("tag") != TEXT).join(ends, [page, "post"])
    return out.select(*nodes.columns, (F.col("_c") - F.col("_chars")).alias("chars"), (F.col("_l") - F.col("_links") + F.col("_own")).alias("links"))


def containers(nodes: DataFrame, page: str = "page_id", by: Sequence[str] | None = None, short: float = SHORT) -> DataFrame:
    """by, selector, items, pages, average, linked, score: groups of like siblings under like parents, scored by number, text and links.

    A group counts where some parent holds three at least and its items, all of them, have `short` characters on average; `by` is the page unless it is told.
    """
    by = list(by or [page])
    keys = list(dict.fromkeys([page, *by]))
    e = measured(nodes, page)
    up = elements(nodes).select(page, F.col("pre").alias("parent"), F.col("step").alias("_up"), F.col("tag").alias("_up_tag"))
    j = e.join(up, [page, "parent"], "left")
    css = F.when(F.col("_up").isNull() | F.col("_up_tag").isin(*_OUTER), F.col("step")).otherwise(F.concat("_up", F.lit(" > "), "step"))
    alike = j.withColumns({"selector": css, "_n": F.count(F.lit(1)).over(Window.partitionBy(page, "parent", "step"))}).where(F.col("_n") >= LEAST)
    groups = alike.groupBy(*by, "selector").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct(*keys).alias("pages"), F.avg("chars").alias("average"), F.avg((F.col("links") > 0).cast("double")).alias("linked")
    )
    score = F.round(F.col("items") * F.least("average", F.lit(float(LONG))) * (1 + 0.5 * F.col("linked")), 3)
    return groups.where(F.col("average") >= short).withColumn("score", score)


def best_containers(found: DataFrame, by: Sequence[str] = ("page_id",), most: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "selector")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def sibling_runs(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """page, parent, step, first, length of each run of like siblings: gaps and islands."""
    e = elements(nodes)
    whole, own = Window.partitionBy(page, "parent").orderBy("pre"), Window.partitionBy(page, "parent", "step").orderBy("pre")
    island = F.row_number().over(whole) - F.row_number().over(own)
    return e.withColumn("_island", island).groupBy(page, "parent", "step", "_island").agg(F.min("pre").alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")


def folded(runs: DataFrame, shown: int = 2, beyond: int = 3) -> DataFrame:
    """Runs that an outline folds, with how many of each it leaves out."""
    return runs.where(F.col("length") > beyond).withColumn("more", F.col("length") - shown)


def items_by(nodes: DataFrame, parent_step: str | None, step: str, page: str = "page_id") -> DataFrame:
    """page, item, pre, post of the elements of a step (under a parent of a step), numbered from 0; those inside another are left out."""
    e = elements(nodes).where(F.col("step") == step)
    if parent_step is not None:
        up = elements(nodes).where(F.col("step") == parent_step).select(page, F.col("pre").alias("parent"))
        e = e.join(up, [page, "parent"], "left_semi")
    return outermost(e.select(page, "pre", "post"), page)


def outermost(marked: DataFrame, page: str = "page_id") -> DataFrame:
    """page, item, pre, post of the marked elements that lie in no other."""
    before = Window.partitionBy(page).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    top = marked.select(page, "pre", "post").distinct().withColumn("_reach", F.max("post").over(before)).where(F.col("_reach").isNull() | (F.col("pre") > F.col("_reach")))
    return top.withColumn("item", F.row_number().over(Window.partitionBy(page).orderBy("pre")) - 1).select(page, "item", "pre", "post")


def inside(nodes: DataFrame, items: DataFrame, page: str = "page_id", name: str = "item", own: bool = False) -> DataFrame:
    """Nodes with the item they lie in, null outside all; items as `outermost` has them.

    An item's row is put before its nodes and the last one met is the one around, if it reaches as far:
    one window a page, no join of ranges.  own: an item's element lies in it too.
    """
    first = 0 if own else 1
    marks = items.select(page, F.col("pre").alias("_at"), F.lit(first).alias("_kind"), F.struct(F.col("post").alias("reach"), F.col("item").alias("item")).alias("_item"))
    rows = nodes.withColumns({"_at": F.col("pre"), "_kind": F.lit(1 - first)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(page).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = F.last("_item", ignorenulls=True).over(w)
    out = both.withColumn("_met", met).where(F.col("_item").isNull())
    return out.withColumn(name, F.when(F.col("pre") <= F.col("_met")["reach"], F.col("_met")["item"])).select(*nodes.columns, name)


def fields(nodes: DataFrame, items: DataFrame, page: str = "page_id", by: Sequence[str] | None = None) -> DataFrame:
    """by, selector, fill, different, kind: what items hold, the first filled element of each step in each item."""
    by = list(by or [page])
    rows = inside(elements(nodes), items, page).where(F.col("item").isNotNull())
    value = F.coalesce(F.nullif(_norm("own"), F.lit("")), F.col("attrs")["src"])
    filled = rows.withColumn("value", value).where(F.col("value") != "")
    first = filled.groupBy(*dict.fromkeys([page, *by]), "item", "step").agg(F.min_by("value", "pre").alias("value"))
    total = nodes.select(*dict.fromkeys([page, *by])).distinct().join(items, page).groupBy(*by).agg(F.count(F.lit(1)).alias("_items"))
    share = lambda pattern: F.avg(F.col("value").rlike(pattern).cast("double"))
    found = first.groupBy(*by, F.col("step").alias("selector")).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("value").alias("different"), share(PRICE).alias("_price"), share(DATE).alias("_date"))
    kind = F.when(F.col("_price") > PRICES, "price").when(F.col("_date") > DATES, "date").when(F.col("selector").startswith("img"), "image").otherwise("text")
    out = found.join(total, by).withColumn("fill", F.round(F.col("_n") / F.col("_items"), 3))
    return out.where(F.col("_n") / F.col("_items") >= FILL).select(*by, "selector", "fill", "different", kind.alias("kind"))


def link_votes(nodes: DataFrame, items: DataFrame, page: str = "page_id", by: Sequence[str] | None = None) -> DataFrame:
    """by, preference, links, different: the link to an item's own page, by the first preference that most items have and that differs between them."""
    by = list(by or [page])
    keys = list(dict.fromkeys([page, *by]))
    rows = inside(elements(nodes), items, page)
    heads = outermost(rows.where(F.col("tag").isin(*PREFERENCES[:-1]) & F.col("item").isNotNull()), page)
    # which heading a link stands in, if any; headings do not nest in each other
    named = heads.join(elements(nodes).select(page, "pre", F.col("tag").alias("_head")), [page, "pre"]).select(page, F.col("item").alias("_h"), "_head")
    links = inside(rows, heads, page, "_h").where((F.col("tag") == "a") & (F.coalesce(F.col("attrs")["href"], F.lit("")) != "") & F.col("item").isNotNull())
    links = links.join(named, [page, "_h"], "left").select(*keys, "item", "pre", F.col("attrs")["href"].alias("href"), F.array_compact(F.array("_head", F.lit(""))).alias("_p"))
    first = links.select("*", F.explode("_p").alias("preference")).groupBy(*keys, "item", "preference").agg(F.min_by("href", "pre").alias("href"))
    total = nodes.select(*keys).distinct().join(items, page).groupBy(*by).agg(F.count(F.lit(1)).alias("_items"))
    votes = first.groupBy(*by, "preference").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("different")).join(total, by)
    fit = votes.where((F.col("links") >= F.greatest(F.lit(2), F.floor(F.col("_items") / 2))) & (F.col("different") >= DIFFERENT * F.col("links")))
    # h1 to h4 before a link anywhere
    w = Window.partitionBy(*by).orderBy(F.when(F.col("preference") == "", "z").otherwise(F.col("preference")))
    return fit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "preference", "links", "different")


def text_hits(nodes: DataFrame, wanted: DataFrame, items: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """page, needle, pre, step, attr, item, fill: elements whose own text or attributes hold a text (page, needle), whatever the case.

    attr names the attribute where it is not the text; fill: how many of the page's items hold that step with a text.
    """
    own = elements(nodes).where(~F.col("tag").isin("script", "style", "noscript", "svg", "template", "head"))
    rows = inside(own, items, page) if items is not None else own.withColumn("item", F.lit(None).cast("int"))
    holds = lambda c: F.contains(F.lower(c), F.lower("needle"))
    j = rows.join(wanted.select(page, "needle").distinct(), page)
    attr = F.filter(F.map_entries("attrs"), lambda e: holds(e["value"]))
    j = j.withColumns({"_text": holds(F.col("own")), "_attr": F.get(attr, F.lit(0))["key"]}).where(F.col("_text") | F.col("_attr").isNotNull())
    hits = j.select(page, "needle", "pre", "step", F.when(~F.col("_text"), F.col("_attr")).alias("attr"), "item")
    if items is None:
        return hits.withColumn("fill", F.lit(0).cast("long"))
    said = nodes.where((F.col("tag") == TEXT) & (_norm("own") != "")).select(page, F.col("parent").alias("pre")).distinct()
    fill = rows.where("item IS NOT NULL").join(said, [page, "pre"], "left_semi").groupBy(page, "step").agg(F.count_distinct("item").alias("_fill"))
    return hits.join(fill, [page, "step"], "left").select(*hits.columns, F.when(F.col("item").isNotNull(), F.coalesce("_fill", F.lit(0))).otherwise(0).alias("fill"))
