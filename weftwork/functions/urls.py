"""URLs: origins, resolution, page templates, paging parameters, field names from JSON keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that page, keys of a document that hold a cursor and where they are looked for,
# addresses that are never the data of a page, and addresses that look like an API.
PAGE_PARAMS = ("page", "p", "pagenumber", "page_number", "pageno", "pg", "page[number]")
OFFSET_PARAMS = ("offset", "start", "skip", "from", "_start", "startindex", "page[offset]")
SIZE_PARAMS = ("limit", "per_page", "perpage", "pagesize", "page_size", "size", "count", "_limit", "first", "n", "rows", "page[size]")
CURSOR_PARAMS = ("cursor", "after", "next", "page[cursor]", "continuation")
CURSOR_KEYS = ("next_cursor", "nextcursor", "endcursor", "cursor", "next", "next_page_token")
CURSOR_PLACES = ("meta", "pagination", "page_info", "pageInfo", "links")
NOISE = r"(?i)(analytics|collect|beacon|telemetry|track(ing)?|metrics|pixel|gtm|gtag|segment\.|sentry|datadog|newrelic|hotjar|clarity|recaptcha|consent|cookie|session/ping|heartbeat|log)"
API = r"(?i)(/api/|/v\d+/|\.json|/graphql|/rest/|/query|/search)"


def origin(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/", -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.array_join(closed, "/")


def resolve(base: Column, ref: Column) -> Column:
    """A reference against a base, by RFC 3986, in expressions only."""
    scheme, authority = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*):", 1), F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), authority)
    path = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    ref_path, ref_tail = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    absolute = ref.rlike(r"^[a-zA-Z][\w+.-]*:")
    return (
        F.when(ref.isNull() | base.isNull(), F.lit(None).cast("string"))
        .when(absolute, ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(ref == "", base)
        .when(F.startswith(ref, F.lit("#")), F.concat(root, path, query, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, path, ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, _dots(ref_path), ref_tail))
        .otherwise(F.concat(root, _dots(F.concat(folder, ref_path)), ref_tail))
    )


def page_template(url: Column) -> Column:
    """The URL with its page number as {page}, by query parameter or by path; null without one."""
    by_query, by_path = r"(?i)([?&](?:page|p|pg|pagina|offset|start)=)\d+", r"(?i)(/(?:page|p)/)\d+(/?)$"
    whole = r"(?i)^(.*?[?&](?:page|p|pg|pagina|offset|start)=)\d+(.*)$"
    first = F.regexp_replace(url, whole, r"$1{page}$2")
    return F.when(url.rlike(by_query), first).when(url.rlike(by_path), F.regexp_replace(url, by_path, r"$1{page}$2"))


def allowed(url: Column, include: str | None = None, exclude: str | None = None) -> Column:
    from .regex import java_pattern

    out = url.isNotNull()
    if include:
        out = out & url.rlike(java_pattern(include))
    return out & ~url.rlike(java_pattern(exclude)) if exclude else out


def render(template: Column, page: Column, limit: Column | None = None, cursor: Column | None = None) -> Column:
    out = F.replace(template, F.lit("{page}"), page.cast("string"))
    out = F.replace(out, F.lit("{limit}"), (limit if limit is not None else F.lit(250)).cast("string"))
    return F.replace(out, F.lit("{cursor}"), F.coalesce(cursor, F.lit("")) if cursor is not None else F.lit(""))


def parameters(url: Column) -> Column:
    """array<struct<k, v>> of the query, in order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("v")))


def cursor_path(document: Column) -> Column:
    """Where a document (a variant) keeps its next cursor: a text or whole number under a known key, at the top or one step below; null without one."""

    def found(node: Column, prefix: str) -> Column:
        entries = F.coalesce(F.map_entries(F.when(F.schema_of_variant(node).startswith("OBJECT"), F.try_variant_get(node, "$", "map<string,variant>"))), F.array().cast("array<struct<key:string,value:variant>>"))
        fit = F.filter(entries, lambda e: F.lower(e["key"]).isin(*CURSOR_KEYS) & F.schema_of_variant(e["value"]).isin("STRING", "BIGINT"))
        return F.get(F.transform(fit, lambda e: F.concat(F.lit(prefix), e["key"])), F.lit(0))

    return F.coalesce(found(document, "$."), *[found(F.try_variant_get(document, f"$.{p}", "variant"), f"$.{p}.") for p in CURSOR_PLACES])


def paging(url: Column, count: Column, document: Column | None = None) -> Column:
    """struct(kind, start, step, page_size, page_key, cursor_path) read off the query string; a cursor needs its place in the document too."""
    path = F.lit(None).cast("string") if document is None else cursor_path(document)
    ps = parameters(url)
    find = lambda names: F.get(F.filter(ps, lambda x: F.lower(x["k"]).isin(*names)), F.lit(0))
    page, size, offset, cursor = (find(n) for n in (PAGE_PARAMS, SIZE_PARAMS, OFFSET_PARAMS, CURSOR_PARAMS))
    number = lambda x: F.when(x["v"].rlike(r"^\d+$"), x["v"]).try_cast("long")
    page_size = F.coalesce(F.when(number(size) > 0, number(size)), count.cast("long"))
    kind = F.when(page.isNotNull() | offset.isNotNull(), "page").when(cursor.isNotNull() & path.isNotNull(), "cursor").otherwise("none")
    start = F.when(page.isNotNull(), F.coalesce(number(page), F.lit(1))).when(offset.isNotNull(), F.coalesce(number(offset), F.lit(0)))
    step = F.when(page.isNotNull(), F.lit(1).cast("long")).when(offset.isNotNull(), page_size)
    return F.struct(kind.alias("kind"), start.cast("long").alias("start"), step.alias("step"), page_size.alias("page_size"), F.coalesce(page["k"], offset["k"], F.when(path.isNotNull(), cursor["k"])).alias("page_key"), F.when(kind == "cursor", path).alias("cursor_path"))


def field_name(key: Column) -> Column:
    """snake_case that a recipe accepts."""
    name = F.regexp_replace(F.lower(F.regexp_replace(key, r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[^a-z0-9]+", "_")
    name = F.btrim(name, F.lit("_"))
    return F.substring(F.when(name == "", F.lit("field")).when(~name.rlike("^[a-z]"), F.concat(F.lit("f_"), name)).otherwise(name), 1, 64)


def field_type(key: Column, value: Column) -> Column:
    """Price, image, url or date by the key, else by the JSON text of the value."""
    text = F.btrim(value, F.lit('"'))
    is_text = F.startswith(value, F.lit('"'))
    link = ~is_text | text.rlike("^(?:http|/)")
    return (
        F.when(key.rlike("(?i)(price|amount|cost|salary|fee|total)"), "price")
        .when(key.rlike("(?i)(image|img|thumb|photo|picture|avatar|cover)"), "image")
        .when(key.rlike("(?i)(url|link|href|permalink|slug|path)") & link, "url")
        .when(key.rlike("(?i)(date|time|created|updated|published|_at$)"), "date")
        .when(value.isin("true", "false"), "bool")
        .when(value.rlike(r"^-?\d"), "number")
        .when(F.startswith(value, F.lit("[")), "list")
        .otherwise("text")
    )


# Path segments of a storefront's own pages; what comes before the first is its root.
SHOP_ROUTES = ("collections", "products", "pages", "blogs", "cart", "checkout", "search", "account", "policies", "apps", "tools", "discount", "challenge", "password", "recommendations", "services", "variants", "a", "wpm")


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")


def shop_root(url: Column) -> Column:
    """The storefront of a page: the origin and the segments before a page of the shop or a file."""
    s = _segments(url)
    at = F.transform(s, lambda x: F.lower(x).isin(*SHOP_ROUTES))
    first = F.array_position(at, True)
    count = F.when(first > 0, first - 1).when(F.contains(F.element_at(F.concat(F.array(F.lit("")), s), -1), F.lit(".")), F.size(s) - 1).otherwise(F.size(s)).cast("int")
    head = F.slice(s, F.lit(1), count)
    return F.concat(origin(url), F.when(F.size(head) > 0, F.concat(F.lit("/"), F.array_join(head, "/"))).otherwise(F.lit("")))


def shop_collection(url: Column) -> Column:
    """The collection a URL points at; null for any other page."""
    s = _segments(url)
    at = F.array_position(F.transform(s, F.lower), "collections").cast("int")
    return F.when(at > 0, F.get(s, at))


def shop_bases(url: Column) -> Column:
    """Where a catalogue may be looked for: the collection first, then the storefront."""
    s = _segments(url)
    at = F.array_position(F.transform(s, F.lower), "collections").cast("int")
    own = F.when(shop_collection(url).isNotNull(), F.concat(origin(url), F.lit("/"), F.array_join(F.slice(s, F.lit(1), at + 1), "/")))
    return F.array_distinct(F.filter(F.array(own, shop_root(url)), lambda x: x.isNotNull()))
