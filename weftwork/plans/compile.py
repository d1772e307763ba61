"""From a recipe and a table of pages to typed rows.

Markup is read by one Arrow function per recipe: it parses a page once and returns, for each
container node, the raw texts of every extractor.  All that follows (regex, template, transforms,
URL resolution, typing, alternates, defaults, provenance) is Spark expressions.  Recipes on JSON
need no Python at all.  A page budget is applied before pages are parsed, and the detail join is
left out when no field needs it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..dom import selectors, tree
from ..dom.blobs import embedded
from ..functions import coerce, jsonpath, transforms, urls
from ..functions.regex import java_pattern
from ..functions.values import is_filled
from .recipe import Extractor, Field, Recipe

_STRINGS = T.ArrayType(T.StringType())
#: Pages whose extracted texts a task holds at once.
PAGES = 256


def _html(extractor: Extractor) -> bool:
    return extractor.source in ("css", "xpath")


def _slots(fields: list[Field]) -> list[tuple[str, Extractor]]:
    return [(f"{f.name}__{i}", e) for f in fields for i, e in enumerate(f.extractors) if _html(e)]


def _link(recipe: Recipe) -> Extractor | None:
    """The link extractor; a bare element selector means its href."""
    e = recipe.detail.link if recipe.detail.enabled else None
    if e is None or not _html(e) or e.attr or "::" in e.selector or e.selector.rstrip().endswith(("href", "text()")):
        return e
    return e.model_copy(update={"attr": "href"})


def _json_container(recipe: Recipe) -> bool:
    return bool(recipe.list_ and recipe.list_.container.startswith("json:"))


def read_markup(recipe: Recipe) -> Column:
    """struct(which, page, nodes) of the column html."""
    list_slots = _slots([f for f in recipe.fields if f.scope == "list"])
    page_slots = _slots([f for f in recipe.fields if f.scope == "page"])
    link = _link(recipe)
    if link is not None and _html(link):
        list_slots = [*list_slots, ("_link", link)]
    containers = [recipe.list_.container, *recipe.list_.alternates] if recipe.list_ and recipe.page_type == "list" and not _json_container(recipe) else []
    for c in containers:
        selectors.check(c)
    struct = lambda slots: T.StructType([T.StructField(n, _STRINGS) for n, _ in slots] or [T.StructField("_none", T.StringType())])
    schema = T.StructType([T.StructField("which", T.StringType()), T.StructField("page", struct(page_slots)), T.StructField("nodes", T.ArrayType(struct(list_slots)))])

    arrow = to_arrow_type(schema)

    def values(node: tree.Node, slots: list) -> dict:
        return {n: selectors.values(node, e.selector, e.attr) for n, e in slots} or {"_none": None}

    @F.arrow_udf(schema)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            # some pages at a time: a batch has as many pages as the session says, however long they are
            for at in range(0, len(html), PAGES):
                rows = []
                for text in html.slice(at, PAGES):
                    root, which, found = tree.parse(text.as_py()), "missing", []
                    for i, c in enumerate(containers):
                        if found := selectors.nodes(root, c):
                            which = "primary" if not i else f"alt:{i}"
                            break
                    rows.append({"which": which, "page": values(root, page_slots), "nodes": [values(n, list_slots) for n in found]})
                    tree.release(root)
                yield pa.array(rows, arrow)

    return read(F.col("html"))


def embedded_json() -> Column:
    """map<string,string> of the JSON documents in the column html."""

    @F.pandas_udf("map<string,string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(embedded)

    return find(F.col("html"))


def _filtered(raw: Column, e: Extractor) -> Column:
    """Regex and template of an extractor, on its raw values."""
    if e.regex:
        import re

        pattern, group = "(?s)" + java_pattern(e.regex), 1 if re.compile(e.regex).groups else 0
        raw = F.transform(F.filter(raw, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, group))
    if e.template:
        raw = F.transform(F.filter(raw, lambda x: x != ""), lambda x: F.replace(F.lit(e.template), F.lit("{value}"), x))
    return raw


def _spark_type(f: Field) -> str:
    base = coerce.TYPES[f.type]
    return f"array<{base}>" if f.extract.all and not base.startswith("array") else base


def _one(f: Field, e: Extractor, raw: Column, base: Column) -> Column:
    values = _filtered(raw, e)
    if f.transforms:
        values = transforms.chain(values, [t.step() for t in f.transforms])
    if f.type in ("url", "image"):
        values = F.transform(values, lambda x: urls.resolve(base, x))
    return coerce.coerce(values, f.type, f.enum or (), f.extract.all)


def field(f: Field, found: list[Column]) -> tuple[Column, Column]:
    """(value, provenance): the first extractor whose value is filled, else the default."""
    kind = T._parse_datatype_string(_spark_type(f))
    filled = [is_filled(c, kind) for c in found]
    default = F.lit(f.default).cast(kind) if f.default is not None and not isinstance(kind, (T.ArrayType, T.VariantType)) else F.lit(None).cast(kind)
    value, origin = None, None
    for i, (c, ok) in enumerate(zip(found, filled, strict=True)):
        name = F.lit("primary" if not i else f"alt:{i}")
        value = F.when(ok, c) if value is None else value.when(ok, c)
        origin = F.when(ok, name) if origin is None else origin.when(ok, name)
    return value.otherwise(default), origin.otherwise(F.lit("llm_pending" if f.extract.source == "llm" else "missing"))


def _place(document: Column, parent: Column | None, path: str) -> tuple[Column, str]:
    """Where a path is to be read: of an exploded child, what begins with _parent is read in the item it came from."""
    bare = path.strip().removeprefix("$").removeprefix(".")
    if parent is not None and (bare == "_parent" or bare.startswith(("_parent.", "_parent["))):
        return parent, "$" + bare.removeprefix("_parent")
    return document, path


def _raws(f: Field, markup: Column | None, document: Column | None, parent: Column | None = None) -> list[Column]:
    empty = F.array().cast("array<string>")
    out = []
    for i, e in enumerate(f.extractors):
        if _html(e):
            out.append(markup[f"{f.name}__{i}"] if markup is not None else empty)
        elif e.source == "json_path" and document is not None:
            node, path = _place(document, parent, e.json_path)
            out.append(jsonpath.texts(node, path) if e.all or f.type == "list" else F.filter(F.transform(jsonpath.resolve(node, path), jsonpath.as_text), lambda x: x.isNotNull()))
        else:
            out.append(empty)
    return out


def _looked_up(f: Field, e: Extractor, document: Column | None, parent: Column | None) -> Column | None:
    """The text of a field of one value whose path leads to one place; null where it has to be walked."""
    if e.source != "json_path" or document is None or e.all or f.extract.all or f.type == "list" or f.transforms:
        return None
    return jsonpath.looked_up(*_place(document, parent, e.json_path))


def _said(f: Field, e: Extractor, text: Column, base: Column) -> Column:
    """As _filtered and _one have it, of one text instead of an array: functions on arrays are not compiled."""
    if e.regex or e.template:
        text = F.get(_filtered(F.array(text), e), F.lit(0)) if e.regex else F.when(text != "", F.replace(F.lit(e.template), F.lit("{value}"), text))
    return urls.resolve(base, text) if f.type in ("url", "image") else text


def _project(df: DataFrame, fields: list[Field], markup: Column | None, document: Column | None, base: Column, parent: Column | None = None) -> DataFrame:
    # what extractors found are columns of their own, or each place that names one would work it out again
    found = {(f.name, i): _one(f, e, r, base) for f in fields for i, (e, r) in enumerate(zip(f.extractors, _raws(f, markup, document, parent), strict=True))}
    texts, said = {}, {}
    for f in fields:
        for i, e in enumerate(f.extractors):
            text = _looked_up(f, e, document, parent)
            if text is not None:
                own = f"{f.name}__{i}"
                texts[f"_text_{own}"], said[f"_said_{own}"] = text, _said(f, e, F.col(f"_text_{own}"), base)
                found[f.name, i] = F.when(F.col(f"_text_{own}").isNotNull(), coerce.coerce_one(F.col(f"_said_{own}"), f.type, f.enum or ())).otherwise(found[f.name, i])
    for made in (texts, said, {f"_found_{name}__{i}": c for (name, i), c in found.items()}):
        df = df.withColumns(made) if made else df
    columns, origins = {}, []
    for f in fields:
        columns[f.name], origin = field(f, [F.col(f"_found_{f.name}__{i}") for i in range(len(f.extractors))])
        origins += [F.lit(f.name), origin]
    df = df.withColumns(columns) if columns else df
    own = F.create_map(*origins) if origins else F.create_map().cast("map<string,string>")
    return df.withColumn("_provenance", F.map_concat("_provenance", own) if "_provenance" in df.columns else own)


def extract(recipe: Recipe, pages: DataFrame, tier: str = "http", keep: Sequence[str] = (), every: bool = False) -> DataFrame:
    """Rows of list pages: the recipe's fields, _url, _page_url, _fetched_at, _tier, _provenance, _index, _which, _detail_url.

    pages: url, html; and if they are there page_no (budget), fetched_at, body (JSON text).
    keep: columns of pages that rows carry on; every: a page without items has a row too, its _index null.
    """
    if why := recipe.unready():
        raise ValueError("; ".join(why))
    if "page_no" in pages.columns:
        pages = pages.where(F.col("page_no") < recipe.pagination.start + recipe.page_budget() * max(1, recipe.pagination.step))
    at = F.col("fetched_at").cast("string") if "fetched_at" in pages.columns else F.lit(None).cast("string")
    base, carried = F.col("url"), [c for c in ("url", "page_no") if c in pages.columns] + list(keep)
    lists, whole = ([f for f in recipe.fields if f.scope == s] for s in ("list", "page"))
    wants_markup = any(_html(e) for f in recipe.fields if f.scope != "detail" for e in f.extractors) or not _json_container(recipe)
    wants_json = _json_container(recipe) or any(e.source == "json_path" for f in recipe.fields for e in f.extractors)
    df = pages.select(*carried, at.alias("_fetched_at"), *[c for c in ("html", "body") if c in pages.columns])
    if wants_markup and "html" in pages.columns:
        df = df.withColumn("_m", read_markup(recipe))
    if wants_json:
        if "body" in df.columns:
            df = df.withColumn("_body", F.try_parse_json("body"))
            blobs = jsonpath.body_map(F.col("_body"))
        else:
            blobs = F.transform_values(embedded_json(), lambda k, v: F.try_parse_json(v))
        df = df.withColumn("_blobs", blobs)
    markup = F.col("_m") if "_m" in df.columns else None
    # JSON paths outside a JSON node look in the page's documents, by name
    document = F.col("_document") if wants_json else None
    df = df.withColumn("_document", F.to_variant_object("_blobs")) if wants_json else df
    df = _project(df, whole, markup["page"] if markup is not None else None, document, base)
    if recipe.page_type == "single":
        df = df.withColumns({"_index": F.lit(0), "_which": F.lit("page"), "_detail_url": F.lit(None).cast("string")})
        return _finish(recipe, df, whole, tier, keep)
    opened = F.posexplode_outer if every else F.posexplode
    if _json_container(recipe):
        head, _, path = recipe.list_.container.removeprefix("json:").partition(".")
        name, bracket, rest = head.partition("[")
        path = (bracket + rest + ("." + path if path else "")) if bracket else path
        # a column of its own, or each place that names it would walk the document again
        part = jsonpath.body_part(F.col("_body"), name) if "_body" in df.columns else F.try_element_at("_blobs", F.lit(name))
        df = df.withColumn("_hits", jsonpath.resolve(part, path))
        hits = F.col("_hits")
        nodes = F.coalesce(F.when(F.size(hits) == 1, jsonpath.elements(F.get(hits, F.lit(0)))), hits)
        df = df.withColumn("_nodes", nodes).withColumn("_which", F.when(F.size("_nodes") > 0, "primary").otherwise("missing")).drop("_hits")
        nodes = F.col("_nodes")
        df = df.select("*", opened(F.filter(nodes, jsonpath.is_object)).alias("_index", "_node"))
        if recipe.api and recipe.api.explode:
            kids = F.flatten(F.transform(jsonpath.resolve(F.col("_node"), recipe.api.explode), lambda v: F.coalesce(jsonpath.elements(v), F.array(v))))
            df = df.select(*[c for c in df.columns if c not in ("_index", "_node")], F.col("_node").alias("_parent"), opened(F.filter(kids, jsonpath.is_object)).alias("_index", "_kid"))
            df = df.withColumnRenamed("_kid", "_node")
        node_markup, node_document = None, F.col("_node")
    else:
        df = df.withColumn("_which", markup["which"]).select("*", opened(markup["nodes"]).alias("_index", "_node"))
        node_markup, node_document = F.col("_node"), document
    parent = F.col("_parent") if "_parent" in df.columns else None
    df = _project(df, lists, node_markup, node_document, base, parent)
    link = _link(recipe)
    if link is None:
        detail = F.lit(None).cast("string")
    else:
        raw = node_markup["_link"] if _html(link) and node_markup is not None else jsonpath.texts(*_place(node_document, parent, link.json_path)) if link.source == "json_path" else F.array().cast("array<string>")
        found = F.transform(_filtered(raw, link), lambda x: urls.resolve(base, x))
        detail = F.get(F.filter(found, lambda x: x.rlike("^https?://")), F.lit(0))
    if recipe.api is not None:
        detail = F.coalesce(detail, _own_url(recipe)) if recipe.detail.enabled else detail
    return _finish(recipe, df.withColumn("_detail_url", detail), [*whole, *lists], tier, keep)


def _own_url(recipe: Recipe) -> Column:
    """The first url field of a row that is absolute."""
    found = [F.when(F.col(f.name).rlike("^https?://"), F.col(f.name)) for f in recipe.fields if f.type == "url" and not f.extract.all and f.scope != "detail"]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _finish(recipe: Recipe, df: DataFrame, fields: list[Field], tier: str, keep: Sequence[str] = ()) -> DataFrame:
    own = F.coalesce("_detail_url", _own_url(recipe)) if recipe.api is not None else F.col("_detail_url")
    other = F.col("url") if recipe.page_type == "single" else F.concat(F.col("url"), F.lit("#item-"), F.col("_index").cast("string"))
    order = [f.name for f in recipe.fields if f in fields]
    extra = ["page_no"] if "page_no" in df.columns else []
    return df.select(*order, F.coalesce(own, other).alias("_url"), F.col("url").alias("_page_url"), "_fetched_at", F.lit(tier).alias("_tier"), "_provenance", "_index", "_which", "_detail_url", *extra, *keep)


def extract_detail(recipe: Recipe, pages: DataFrame) -> DataFrame:
    """One row per detail page: url, the detail fields, _provenance."""
    single = recipe.model_copy(update={"page_type": "single", "fields": [f.model_copy(update={"scope": "page"}) for f in recipe.fields if f.scope == "detail"], "detail": recipe.detail.model_copy(update={"enabled": False}), "api": None})
    rows = extract(single, pages)
    return rows.select(F.col("_page_url").alias("url"), *[f.name for f in single.fields], "_provenance")


def next_pages(recipe: Recipe, pages: DataFrame) -> DataFrame:
    """url, next_url for next_link pagination."""
    e = Extractor(**{selectors.kind(recipe.pagination.selector): recipe.pagination.selector})
    probe = recipe.model_copy(update={"fields": [Field(name="next_url", type="url", scope="page", extract=e.model_copy(update={"attr": "href"}))], "page_type": "single", "api": None})
    return extract(probe, pages).select(F.col("_page_url").alias("url"), F.when(F.col("next_url").rlike("^https?://"), F.col("next_url")).alias("next_url"))
