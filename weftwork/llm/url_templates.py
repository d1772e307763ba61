"""URL filter by a tree of path templates per host, in DataFrame functions alone.

Rules first: a rule names a host and the start of a path, fits that host and all under it, and the
longest that fits decides.  What the rules decide is the labelled part of a table; the rest is
judged by templates learnt from it.

1. Shape: segments that hold a digit or a percent sign, or are longer than `LONG`, become `*`; URLs of
   one host and one shape are counted together (all, labelled, blocked, and those that end here).
2. Tree: level by level, from the root, the children of a node are generalised.  Where the node is
   variable (more than `WIDE` children of fewer than `THIN` URLs on average) its thin children become
   `*`.  The others are told apart by two shares, of blocked URLs and of URLs that end there: against
   their siblings' each is higher, lower or no different (two-proportion z beyond `Z`).  Children alike in both
   are similar branches and merge into one wildcard, `*` with a sign for each share that differs
   (`+`, `-` blocked; `^`, `v` ending); a child that is like no other keeps its name.  The first `LEVELS`
   segments are nodes; what follows them is one more segment.
3. Purity: a template's share of blocked URLs, smoothed by `PRIOR` URLs of its host's share, which is
   smoothed by as many of the whole table's.  From `REJECT` on a template is blocked.

The table is grouped to one row per host and shape before anything is joined; nodes are joined by
host, parent and child, and each URL meets its shape's verdict in one join.

Defined results: a null URL and one without `://` has an empty host and path; such rows are one
template of the host ''.  Hosts keep ports and users; only A-Z is lower-cased.  Repeated rows count
each and get equal results; null identifiers are carried.  With nothing labelled all is allowed.
An empty table gives no rows.  Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, start of the path, verdict) as a query's contract fixes them.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LONG = 24
LEVELS = 3
WIDE, THIN = 16, 3
#: z of the difference between two shares that one in twenty like branches exceeds, squared below.
Z = 1.96
PRIOR = 4.0
REJECT = 0.5
_COUNTS = ("n", "labelled", "blocked")
#: A share's count and what it is a share of, and the signs of a higher and a lower one.
_SHARES = (("blocked", "labelled", "+", "-"), ("ends", "n", "^", "v"))
_SEGMENTS = [f"s{k}" for k in range(LEVELS + 1)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, empty where there are none."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path start, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path without outer and repeated slashes, its variable segments as stars."""
    one = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    # long segments first: what is left is short enough to search for a digit
    return F.regexp_replace(F.regexp_replace(one, f"[^/]{{{LONG + 1},}}", "*"), "[^/]*[0-9%][^/]*", "*")


def differ(x: Column, n: Column, y: Column, m: Column) -> Column:
    """z squared of the shares x / n and y / m, each with half an observation more of either kind."""
    p, q, both = (x + 0.5) / (n + 1.0), (y + 0.5) / (m + 1.0), (x + y + 0.5) / (n + m + 1.0)
    return (p - q) * (p - q) / (both * (1.0 - both) * (1.0 / (n + 1.0) + 1.0 / (m + 1.0)))


def sign(x: Column, n: Column, y: Column, m: Column, more: str, less: str) -> Column:
    return F.when(differ(x, n, y, m) < Z * Z, "").when((x + 0.5) / (n + 1.0) > (y + 0.5) / (m + 1.0), more).otherwise(less)


def _level(shapes: DataFrame, k: int) -> DataFrame:
    """The shapes with segment k generalised and put behind their prefix."""
    child, node = _SEGMENTS[k], ["host", "prefix"]
    ends = F.col("n") if k == LEVELS else F.when(F.col(_SEGMENTS[k + 1]) == "", F.col("n")).otherwise(0)
    branches = shapes.where(F.col(child) != "").groupBy(*node, child).agg(*[F.sum(c).alias(c) for c in _COUNTS], F.sum(ends).alias("ends"))
    whole = branches.groupBy(*node).agg(F.count("*").alias("wide"), *[F.sum(c).alias(f"all_{c}") for c in (*_COUNTS, "ends")])
    variable = (F.col("wide") > WIDE) & (F.col("all_n") < THIN * F.col("wide")) & (F.col("n") <= THIN)
    signs = [sign(F.col(c), F.col(of), F.col(f"all_{c}") - F.col(c), F.col(f"all_{of}") - F.col(of), *marks) for c, of, *marks in _SHARES]
    branches = branches.join(whole, node).select(*node, child, F.when(variable, "*").otherwise(F.concat(F.lit("*"), *signs)).alias("kind"), variable.alias("thin"))
    kinds = branches.groupBy(*node, "kind").agg(F.count("*").alias("like"), F.max("thin").alias("any_thin"))
    merged = (F.col("like") > 1) | F.col("any_thin")
    told = branches.join(kinds, [*node, "kind"]).select(*node, child, F.when(merged, F.col("kind")).otherwise(F.col(child)).alias("as"))
    out = shapes.join(told, [*node, child], "left")
    # what ends before this level has no child
    prefix = F.when(F.col("as").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "as"))
    return out.select("host", "shape", prefix.alias("prefix"), *[c for c in _SEGMENTS if c != child and _SEGMENTS.index(c) > k], *_COUNTS)


def templates(judged: DataFrame) -> DataFrame:
    """Every shape of every host with its template, and the template's smoothed share of blocked URLs.

    judged: host, shape, verdict (allow, block, or null where nothing is known) of each URL."""
    counts = F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")
    shapes = judged.groupBy("host", "shape").agg(*counts)
    cut = F.split("shape", "/", LEVELS + 1)
    shapes = shapes.select("host", "shape", F.lit("").alias("prefix"), *[F.coalesce(F.get(cut, F.lit(k)), F.lit("")).alias(s) for k, s in enumerate(_SEGMENTS)], *_COUNTS)
    shapes = common.written(shapes, "shapes")
    for k in range(LEVELS + 1):
        shapes = common.written(_level(shapes, k), "tree")
    total = shapes.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = ((total.blocked or 0) + 1.0) / ((total.labelled or 0) + 2.0)
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    hosts = shapes.groupBy("host").agg(*sums).select("host", ((F.col("blocked") + PRIOR * prior) / (F.col("labelled") + PRIOR)).alias("of_host"))
    found = shapes.groupBy("host", "prefix").agg(*sums).join(hosts, "host")
    found = found.select("host", "prefix", ((F.col("blocked") + PRIOR * F.col("of_host")) / (F.col("labelled") + PRIOR)).alias("blocked_share"))
    return shapes.select("host", "shape", "prefix").join(found, ["host", "prefix"]).select("host", "shape", F.concat("prefix", F.lit("/")).alias("template"), "blocked_share")


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per URL: ident, host, path, rule, verdict, template, blocked_share."""
    link = F.col(common.quoted(url)).cast("string")
    host, path = parts(link)
    rows = pages.select(F.col(common.quoted(ident)).alias("ident"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("verdict"), shape(F.col("path")).alias("shape"))
    known = common.written(templates(rows), "templates")
    by_method = F.when(F.col("blocked_share") >= REJECT, "block").otherwise("allow")
    out = rows.join(known, ["host", "shape"], "left")
    return out.select(F.col("ident").alias(ident), "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "template", "blocked_share")


def _rules_sql(rules: Sequence[tuple[str, str, str]]) -> str:
    named = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for h, p, v in named)
    return f"CASE {when} END"


def sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The query as DuckDB SQL."""
    differ_sql = lambda x, n, y, m: "(({0}+0.5)/({1}+1.0)-({2}+0.5)/({3}+1.0))*(({0}+0.5)/({1}+1.0)-({2}+0.5)/({3}+1.0))/((({0}+{2}+0.5)/({1}+{3}+1.0))*(1.0-({0}+{2}+0.5)/({1}+{3}+1.0))*(1.0/({1}+1.0)+1.0/({3}+1.0)))".format(x, n, y, m)  # noqa: E731, UP032
    sign_sql = lambda c, of, more, less: f"CASE WHEN {differ_sql(c, of, f'(all_{c}-{c})', f'(all_{of}-{of})')} < {Z * Z!r} THEN '' WHEN ({c}+0.5)/({of}+1.0) > (all_{c}-{c}+0.5)/(all_{of}-{of}+1.0) THEN '{more}' ELSE '{less}' END"
    kind = " || ".join(sign_sql(*x) for x in _SHARES)
    cut = ", ".join([f"split_part(shape, '/', {k + 1}) AS s{k}" for k in range(LEVELS)] + [f"regexp_extract(shape, '^(?:[^/]*/){{{LEVELS}}}((?s:.*))$', 1) AS s{LEVELS}"])
    levels = []
    for k in range(LEVELS + 1):
        ends = "n" if k == LEVELS else f"CASE WHEN s{k + 1} = '' THEN n ELSE 0 END"
        levels.append(f"""
        b{k} AS (SELECT host, prefix, s{k}, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked, sum({ends})::DOUBLE AS ends
               FROM t{k} WHERE s{k} <> '' GROUP BY ALL),
        w{k} AS (SELECT *, wide > {WIDE} AND all_n < {THIN} * wide AND n <= {THIN} AS thin
               FROM (SELECT *, count(*) OVER p AS wide, sum(n) OVER p AS all_n, sum(labelled) OVER p AS all_labelled, sum(blocked) OVER p AS all_blocked, sum(ends) OVER p AS all_ends
                     FROM b{k} WINDOW p AS (PARTITION BY host, prefix))),
        k{k} AS (SELECT *, CASE WHEN thin THEN '*' ELSE '*' || {kind} END AS kind FROM w{k}),
        m{k} AS (SELECT host, prefix, s{k}, CASE WHEN count(*) OVER p > 1 OR bool_or(thin) OVER p THEN kind ELSE s{k} END AS star FROM k{k} WINDOW p AS (PARTITION BY host, prefix, kind)),
        t{k + 1} AS (SELECT t{k}.* REPLACE (CASE WHEN star IS NULL THEN prefix ELSE prefix || '/' || star END AS prefix) FROM t{k} LEFT JOIN m{k} USING (host, prefix, s{k})),""")
    last = f"t{LEVELS + 1}"
    return f"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, {_rules_sql(rules)} AS fit,
               regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^/|/$', '', 'g'), '[^/]{{{LONG + 1},}}', '*', 'g'), '[^/]*[0-9%][^/]*', '*', 'g') AS shape FROM v),
        c AS (SELECT host, shape, '' AS prefix, count(*) AS n, count(fit) AS labelled, count(*) FILTER (starts_with(fit, 'block')) AS blocked FROM r GROUP BY host, shape),
        t0 AS (SELECT *, {cut} FROM c),{"".join(levels)}
        g AS (SELECT (sum(blocked) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS prior FROM {last}),
        h AS (SELECT host, (sum(blocked) + {PRIOR}::DOUBLE * any_value(prior)) / (sum(labelled) + {PRIOR}::DOUBLE) AS of_host FROM {last}, g GROUP BY host),
        f AS (SELECT host, prefix, (sum(blocked) + {PRIOR}::DOUBLE * any_value(of_host)) / (sum(labelled) + {PRIOR}::DOUBLE) AS share FROM {last} JOIN h USING (host) GROUP BY host, prefix)
        SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
               coalesce(split_part(fit, ' ', 1), CASE WHEN share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, prefix || '/' AS template
        FROM r JOIN {last} USING (host, shape) JOIN f USING (host, prefix)"""
