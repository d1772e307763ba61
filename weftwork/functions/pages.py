"""Page text, titles, value shapes, and the classifier of blocked and client-rendered pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .transforms import collapse_space

# Fixed values of the classifier.
BLOCK_STATUS = (403, 429, 430, 503)
MARKERS = (
    "just a moment", "checking your browser", "verifying you are human", "verify you are human", "cf-browser-verification",
    "cf-chl", "__cf_chl", "challenge-platform", "challenges.cloudflare.com", "attention required", "px-captcha", "_px-captcha",
    "geo.captcha-delivery.com", "datadome", "_incapsula_resource", "incapsula incident", "sec-if-cpt-container", "ak-challenge",
    "behavioral-content", "access denied", "are you a human", "one more step", "security check", "unusual traffic", "recaptcha",
    "hcaptcha", "turnstile",
)
SHORT = 60_000
SHELL_IDS = ("root", "app", "__next", "__nuxt", "___gatsby", "svelte", "q-app")
PRICE = r"(?i)(?:[$€£¥₹]|USD|EUR|GBP|CHF)\s?\d[\d,.]*|\d[\d,.]*\s?(?:[$€£¥₹]|USD|EUR|GBP|CHF|zł|kr)"
DATE = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2},? \d{4})\b"


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, noscript parts and tags."""
    for part in (r"<script\b[^>]*>.*?</script>", r"<style\b[^>]*>.*?</style>", r"<noscript\b[^>]*>.*?</noscript>", r"<[^>]+>"):
        html = F.regexp_replace(html, f"(?is){part}", " ")
    return collapse_space(html)


def title(html: Column) -> Column:
    return collapse_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def script_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?is)<script\b[^>]*>.*?</script>"))


def first_marker(lower: Column) -> Column:
    """The first marker, in the order of the list, that the text contains."""
    return F.get(F.filter(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(lower, m)), F.lit(0))


def verdict(status: Column, mitigated: Column, body: Column, matched: Column) -> Column:
    """struct(blocked, needs_js, reason, detail) of a page.

    mitigated: the value of the header cf-mitigated; matched: matches of the recipe's container,
    null where it was not tried.
    """
    body = F.coalesce(body, F.lit(""))
    lower = F.lower(F.substring(body, 1, SHORT))
    marker, heading, text = first_marker(lower), F.lower(title(body)), visible_text(body)
    in_title = F.contains(heading, marker)
    asks = F.exists(F.regexp_extract_all(F.lower(body), F.lit(r"(?s)<noscript\b[^>]*>(.*?)</noscript>"), 1), lambda n: F.contains(n, F.lit("javascript")) & n.rlike("enable|requires|turn on"))
    shell = [body.rlike(rf"""(?i)<div[^>]+id=["']{i.replace("-", "[-]")}["'][^>]*>\s*</div>""") for i in SHELL_IDS]
    shell_id = F.coalesce(*[F.when(s, F.lit(i)) for s, i in zip(shell, SHELL_IDS, strict=True)])
    scripts = script_count(body)

    def says(blocked: bool, js: bool, reason: str | None, detail: Column | None = None) -> Column:
        return F.struct(F.lit(blocked).alias("blocked"), F.lit(js).alias("needs_js"), F.lit(reason).cast("string").alias("reason"), (detail if detail is not None else F.lit("")).alias("detail"))

    quoted = F.concat(F.lit("'"), marker, F.lit("'"))
    return (
        F.when(F.coalesce(F.lower(mitigated) == "challenge", F.lit(False)), says(True, False, "cf_mitigated", F.lit("cf-mitigated: challenge header")))
        .when(status.isin(*BLOCK_STATUS), says(True, False, "status", F.concat(F.lit("HTTP "), status.cast("string"), F.coalesce(F.concat(F.lit(" + "), quoted), F.lit("")))))
        .when(marker.isNotNull() & ((F.length(body) < SHORT) | in_title), says(True, False, "challenge_marker", F.concat(quoted, F.when(in_title, F.lit(" in title")).otherwise(F.lit(" in body")))))
        .when(F.coalesce(matched > 0, F.lit(False)), says(False, False, None))
        .when(asks & (F.length(text) < 400), says(False, True, "noscript", F.lit("noscript asks to enable JavaScript")))
        .when((text == "") & (status < 400), says(False, True, "empty_body", F.lit("no visible text")))
        .when((F.length(text) < 200) & shell_id.isNotNull(), says(False, True, "app_shell", F.concat(F.lit("empty #"), shell_id, F.lit(" app shell"))))
        .when(F.coalesce(matched == 0, F.lit(False)) & (scripts >= 1), says(False, True, "selector_missing", F.format_string("selector matched 0; %d scripts, %d chars text", scripts, F.length(text))))
        .otherwise(says(False, False, None))
    )


def value_shape(c: Column) -> Column:
    """Runs of digits as 0, runs of letters as a, of the first 60 characters."""
    c = F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "), 1, 60)
    return F.regexp_replace(F.regexp_replace(c, r"\p{Nd}+", "0"), r"\p{L}+", "a")


def text_shape(c: Column) -> Column:
    """struct(len, digits, currency, words): length class, what occurs, words up to 20."""
    n = F.length(c)
    size = F.when(n == 0, 0).when(n < 12, 1).when(n < 40, 2).when(n < 120, 3).otherwise(4)
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return F.struct(size.alias("len"), c.rlike(r"\d").alias("digits"), c.rlike(r"(?i)[$€£¥₹]|\b(?:usd|eur|gbp)\b").alias("currency"), F.least(words, F.lit(20)).alias("words"))


def looks_like_price(c: Column) -> Column:
    return c.rlike(PRICE)


def looks_like_date(c: Column) -> Column:
    return c.rlike(DATE)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def similarity(a: Column, b: Column) -> Column:
    """Agreement of two element fingerprints, 0 to 1 (struct of tag, id, classes, attrs, path, text, shape, leaf, href, src)."""
    one = lambda test, w: F.when(F.coalesce(test, F.lit(False)), F.lit(float(w))).otherwise(F.lit(0.0))
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    ca, cb = (F.coalesce(x["classes"], F.array().cast("array<string>")) for x in (a, b))
    aa, ab = (F.coalesce(x["attrs"], F.create_map().cast("map<string,string>")) for x in (a, b))
    keys = F.array_union(F.map_keys(aa), F.map_keys(ab))
    agree = F.size(F.filter(keys, lambda k: F.try_element_at(aa, k).eqNullSafe(F.try_element_at(ab, k)))) / F.greatest(F.size(keys), F.lit(1))
    pa, pb = (F.coalesce(x["path"], F.array().cast("array<string>")) for x in (a, b))
    depth = F.greatest(F.size(pa), F.size(pb))
    pairs = F.zip_with(F.reverse(pa), F.reverse(pb), lambda x, y: F.coalesce(x == y, F.lit(False)))
    suffix = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct(F.when(s["on"] & same, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & same).alias("on")))["n"]
    ta, tb = a["text"], b["text"]
    text = F.when(ta["len"] == tb["len"], 0.4).when(F.abs(ta["len"] - tb["len"]) == 1, 0.2).otherwise(0.0) + one(ta["digits"] == tb["digits"], 0.3) + one(ta["currency"] == tb["currency"], 0.3)
    # What each kind of agreement weighs.
    total = (
        one(a["tag"].eqNullSafe(b["tag"]), 0.12)
        + F.when(F.size(F.array_union(ca, cb)) > 0, share(ca, cb) * 0.22).otherwise(0.08)
        + F.when(F.size(keys) > 0, agree * 0.10).otherwise(0.05)
        + one(a["id"].isNotNull() & (a["id"] == b["id"]), 0.05)
        + F.when(depth > 0, suffix / depth * 0.08).otherwise(0.0)
        + F.when(ta.isNotNull() & tb.isNotNull(), text * 0.10).otherwise(0.0)
        + one((a["shape"] != "") & (a["shape"] == b["shape"]), 0.28)
        + one(a["href"].eqNullSafe(b["href"]) & a["src"].eqNullSafe(b["src"]), 0.03)
        + one(a["leaf"] == b["leaf"], 0.02)
    )
    return F.round(F.least(total, F.lit(1.0)), 4)
