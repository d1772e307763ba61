"""Whole jobs: a run of a recipe over stored pages, a preview that judges it, and a re-run with its diff and dataset.

A preview uses the same compiler as a run, so what it shows is what a run gives.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import changes, incremental, profiles, rows
from ..plans import compile as plan
from ..plans import walk as walks
from ..sources import places
from .recipe import Extractor, Field, Recipe

_POSITION = re.compile(r":nth-(?:child|of-type|last-child)|:(?:first|last)-child|\[\d+\]")


@dataclass
class Run:
    """What a run produced; DataFrames are lazy."""

    items: DataFrame
    decided: DataFrame | None = None
    state: DataFrame | None = None
    quarantine: DataFrame | None = None
    stats: dict[str, int] = field(default_factory=dict)

    @property
    def partial(self) -> bool:
        return self.decided is not None and incremental.is_partial(self.decided)


def domains(recipe: Recipe) -> list[str]:
    """Hosts a run may read: those named, else those of its seeds, sources and endpoint."""
    if recipe.allowed_domains:
        return list(recipe.allowed_domains)
    found = [*recipe.seeds, *recipe.source.urls[:50], *filter(None, [recipe.source.sitemap, recipe.api and recipe.api.url_template])]
    return list(dict.fromkeys(m[1].lower() for u in found if (m := re.match(r"https?://([^/?#:]+)", u))))


def in_domains(url: Column, names: list[str]) -> Column:
    """The host is one of the names or below one."""
    host = urls.host(url)
    out = host.isin(*names)
    for n in names:
        out = out | F.endswith(host, F.lit("." + n))
    return out


def run(recipe: Recipe, pages: DataFrame, details: DataFrame | None = None, state: DataFrame | None = None, run_id: str = "run", now: Column | None = None, seen: DataFrame | None = None) -> Run:
    """pages: url, html or body, and if they are there page_no, lastmod, status.  seen: items of a run to go on from."""
    now = now if now is not None else F.current_timestamp()
    source = recipe.source
    if source.include or source.exclude:
        pages = pages.where(urls.allowed(F.col("url"), source.include, source.exclude))
    decided = None
    if recipe.incremental.enabled and state is not None:
        # before any page is parsed
        full = pages.withColumns({c: F.lit(None).cast(k) for c, k in (("lastmod", "string"), ("status", "int")) if c not in pages.columns})
        decided = incremental.decide(full, state, now, recipe.incremental.refetch_after_days)
        pages = decided.where("decision = 'read'")
    listed = plan.extract(recipe, pages)
    order = [c for c in ("page_no", "_page_url", "_index") if c in listed.columns]
    detail_fields = [f.name for f in recipe.fields if f.scope == "detail"]
    if recipe.detail.enabled and detail_fields and details is not None:
        listed = rows.enrich(listed, plan.extract_detail(recipe, details), detail_fields, budget=recipe.limits.max_detail_pages, order=order)
    if recipe.pagination.stop_when_no_new_items and "page_no" in listed.columns:
        listed = rows.until_nothing_new(listed, recipe.dedupe_key)
    once = rows.dedupe_against(listed, seen, recipe.dedupe_key, order) if seen is not None else rows.dedupe(listed, recipe.dedupe_key, order)
    items = rows.limit_items(once, recipe.limits.max_items, order)
    none = pages.join(listed.select("_page_url").distinct(), F.col("url") == F.col("_page_url"), "left_anti") if "html" in pages.columns else None
    entries = incremental.state_entries(decided, recipe.id, run_id, now) if decided is not None else None
    return Run(items.withColumn("run_id", F.lit(run_id)), decided, entries, none)


def with_fallback(api_rows: DataFrame, html_rows: DataFrame, dead: bool | None = None) -> DataFrame:
    """Rows of the endpoint, or of the pages where the endpoint gave none; columns of the former."""
    if dead is None:
        dead = not api_rows.limit(1).count()
    return api_rows if not dead else api_rows.unionByName(html_rows.select(*[c for c in api_rows.columns if c in html_rows.columns]), allowMissingColumns=True)


def rerun(recipe: Recipe, result: Run, before: DataFrame, dataset: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(change feed against the run before, dataset after this one); a partial run removes nothing."""
    order = [c for c in ("page_no", "_page_url", "_index") if c in result.items.columns]
    plain = [c for c in result.items.columns if c not in ("run_id", "_which", "_detail_url")]
    new = result.items.select(*plain)
    feed = changes.diff(before.select(*[c for c in plain if c in before.columns]), new, recipe.dedupe_key, order, result.partial)
    return feed, changes.fold(dataset, new.drop("page_no") if "page_no" in plain and "page_no" not in order else new, recipe.id, recipe.dedupe_key, order, now, result.partial)


def walk(pages: DataFrame, links: DataFrame, start: list[str], most: int = 20) -> DataFrame:
    """Pages reached from the start by next links, with page_no; links: url, next_url.  A page is met once."""
    return walks.reached(pages, links, pages.sparkSession.createDataFrame([(u,) for u in start], "url string"), most=most)


# ---- previews -----------------------------------------------------------------------------


@dataclass
class Report:
    rows: DataFrame
    containers: DataFrame
    stats: DataFrame
    origins: DataFrame
    issues: DataFrame

    def ok(self) -> bool:
        return not self.issues.where("level = 'error'").limit(1).count()


def notes(recipe: Recipe) -> list[tuple[str, str, str]]:
    """What can be said of a recipe without a page: (field, code, level)."""
    out = []
    for f in recipe.fields:
        if any(e.source in ("css", "xpath") and _POSITION.search(e.selector) for e in f.extractors):
            out.append((f.name, "positional_selector", "warning"))
        if f.extract.source == "llm":
            out.append((f.name, "llm_field", "info"))
    if recipe.list_ and _POSITION.search(recipe.list_.container):
        out.append(("", "positional_selector", "warning"))
    return out


def preview(recipe: Recipe, pages: DataFrame, details: DataFrame | None = None) -> Report:
    """A recipe on sample pages: rows, matches, profile, and issues."""
    spark = pages.sparkSession
    # pages are read once, however much is asked of their rows; two stored under one address stay two
    folder = places.shared_folder(spark, "preview")
    plan.extract(recipe, pages.withColumn("_page", F.monotonically_increasing_id()), keep=["_page"], every=True).write.parquet(folder)
    read = spark.read.parquet(folder)
    containers = read.groupBy("_page", "_page_url").agg(F.count("_index").alias("items"), F.coalesce(F.first("_which"), F.lit("missing")).alias("which")).drop("_page")
    got = read.where("_index IS NOT NULL").drop("_page")
    said = notes(recipe)
    sampled = [f for f in recipe.fields if f.extract.source != "llm" and (f.scope != "detail" or details is not None)]
    if details is not None:
        got = rows.enrich(got, plan.extract_detail(recipe, details), [f.name for f in recipe.fields if f.scope == "detail"])
    else:
        said += [(f.name, "no_detail_samples", "info") for f in recipe.fields if f.scope == "detail"]
    names = [f.name for f in sampled]
    stats, origins = profiles.profile(got, names), profiles.provenance(got)
    rules = {f.name: {"required": f.required, "sparse": f.sparse, "list": f.scope == "list", "html_only": recipe.api is not None and all(e.source in ("css", "xpath") for e in f.extractors)} for f in sampled}
    found = profiles.issues(stats, origins, rules)
    least = recipe.list_.min_items if recipe.list_ else 1
    code = F.when(F.col("items") == 0, "api_last_page" if recipe.api else "container_missing").when(F.col("items") < least, "few_items")
    level = F.when(F.col("code") == "container_missing", "error").when(F.col("code") == "few_items", "warning").otherwise("info")
    found = found.unionByName(containers.select(F.lit("").alias("field"), code.alias("code")).where("code is not null").distinct().withColumn("level", level))
    same = profiles.identical_columns(got, [f.name for f in sampled if f.scope == "list"])
    found = found.unionByName(same.select(F.concat("a", F.lit("="), "b").alias("field"), F.lit("identical_columns").alias("code"), F.lit("warning").alias("level")))
    if recipe.detail.enabled:
        share = got.agg(F.avg(F.col("_detail_url").isNotNull().cast("double")).alias("s")).where("s < 0.8")
        found = found.unionByName(share.select(F.lit("").alias("field"), F.lit("detail_links_missing").alias("code"), F.lit("warning").alias("level")))
    if recipe.pagination.kind == "next_link":
        lost = plan.next_pages(recipe, pages).agg(F.count("next_url").alias("n")).where("n = 0")
        found = found.unionByName(lost.select(F.lit("").alias("field"), F.lit("next_link_missing").alias("code"), F.lit("warning").alias("level")))
    if said:
        found = found.unionByName(spark.createDataFrame(said, "field string, code string, level string"))
    return Report(got, containers, stats, origins, found)


# ---- recipes from what was found ----------------------------------------------------------


def unique_names(names: list[str]) -> list[str]:
    """name, name_2, name_3 for repeats."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def json_fields(sample: dict, most: int = 14) -> list[Field]:
    """A field per plain key of an item; nested objects are left to the reader."""
    out: list[Field] = []
    for key, value in sample.items():
        if value is None or isinstance(value, dict) or (isinstance(value, list) and any(isinstance(x, dict) for x in value)):
            continue
        name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()).strip("_") or "field"
        name = (name if name[0].isalpha() else f"f_{name}")[:64]
        if name in {f.name for f in out}:
            continue
        many = isinstance(value, list)
        kind = "list" if many else "bool" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"
        for pattern, hint in (("price|amount|cost|salary|fee|total", "price"), ("image|img|thumb|photo|picture|avatar|cover", "image"), ("url|link|href|permalink|slug|path", "url"), ("date|time|created|updated|published|_at$", "date")):
            if re.search(pattern, key, re.I) and not (hint == "url" and isinstance(value, str) and not value.startswith(("http", "/"))):
                kind = hint
                break
        # every element, not the list as one value
        out.append(Field(name=name, type=kind, required=name in ("title", "name") and kind == "text", extract=Extractor(json_path=f"$.{key}[*]" if many else f"$.{key}", all=many)))
        if len(out) == most:
            break
    return out


# What a page budget written for pages of HTML becomes where a request brings more rows than such a page, and
# from how many rows on; the alternates that a merge keeps.
HTML_LIMITS, API_LIMITS, SMALL_PAGE, ALTERNATES = {"max_pages": 20, "max_items": 1000}, {"max_pages": 100, "max_items": 25_000}, 50, 3
#: What a merged field has from the old one where the new one does not say it.
_KEPT = ("type", "required", "description", "enum")


def onto_api(recipe: Recipe, url_template: str, container: str, fields: list[Field], paging: dict | None = None, platform: str | None = None) -> Recipe:
    """The recipe read from an endpoint, with its HTML extractors and container as alternates for when that fails.

    Fields of like name merge, the others stay.  Budgets that nobody chose are raised where a request brings many rows;
    rows are told apart by their address once a field holds one.
    """
    data = recipe.model_dump(by_alias=True, exclude_none=True)
    old = {f.name: f for f in recipe.fields}
    merged = []
    for f in fields:
        before = old.pop(f.name, None)
        if before and before.extract.source != "json_path":
            told = {k: getattr(before, k) for k in _KEPT if k in before.model_fields_set and k not in f.model_fields_set}
            f = f.model_copy(update={**told, "alternates": before.extractors[:ALTERNATES]})
        merged.append(f)
    merged += old.values()
    data["fields"] = [f.model_dump(exclude_none=True) for f in merged]
    pages = [c for c in ([recipe.list_.container, *recipe.list_.alternates] if recipe.list_ else []) if c.strip() and not c.startswith("json:")]
    data |= {"page_type": "list", "list": {"container": container, "alternates": list(dict.fromkeys(pages))[:ALTERNATES]}, "api": {"url_template": url_template, "paging": paging or {}, **({"platform": platform} if platform else {})}}
    if all(f.scope != "detail" for f in merged):
        data["detail"] = {"enabled": False}
    if ((paging or {}).get("page_size") or 0) > SMALL_PAGE:
        data["limits"] |= {k: API_LIMITS[k] for k, usual in HTML_LIMITS.items() if data["limits"][k] == usual}
    if any(f.type == "url" for f in merged):
        data["dedupe_key"] = ["_url"]
    return Recipe.model_validate(data)
