"""Dates and prices as told, by vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions import coerce, told

NOW = "2024-06-01 12:00:00"
DATES = {
    "5. März 1996": "1996-03-05",
    "5 mars 1996": "1996-03-05",
    "le 1er août 2024": "2024-08-01",
    "Freitag, den 13. Dezember 2024": "2024-12-13",
    "13 de septiembre de 2024": "2024-09-13",
    "3 dic. 2024, 18:30": "2024-12-03T18:30:00",
    "12. Okt. 2024 um 9:05 Uhr": "2024-10-12T09:05:00",
    "12. Oktober 2024, 18 Uhr": "2024-10-12T18:00:00",
    "le 4 févr. 2023 à 7h45": "2023-02-04T07:45:00",
    "March 3rd, 2024 at 12:15 am": "2024-03-03T00:15:00",
    "Mar 3 2024 11pm": "2024-03-03T23:00:00",
    "2024 mayo 7": "2024-05-07",
    "1.2.24": "2024-02-01",
    "31/12/99": "1999-12-31",
    "12/31/1999": "1999-12-31",
    "7 juillet": "2024-07-07",
    "enero 2023": "2023-01-01",
    "vor einer Woche": "2024-05-25T12:00:00",
    "il y a 2 heures": "2024-06-01T10:00:00",
    "hace un año": "2023-06-01T12:00:00",
    "dans 3 jours": "2024-06-04T12:00:00",
    "in 2 Monaten": "2024-08-01T12:00:00",
    "dentro de una hora": "2024-06-01T13:00:00",
    "Gestern": "2024-05-31T12:00:00",
    "AUJOURD’HUI": "2024-06-01T12:00:00",
    "mañana": "2024-06-02T12:00:00",
    "avant-hier": "2024-05-30T12:00:00",
    "31. Februar 2024": None,
    "5 foo 2024": None,
    "12.30.45": "2045-12-30",
    "13.30.45": None,
    "3 mars 2024 25:10": None,
    "13 pm 3 mars 2024": None,
    "Lieferung am 5. März 1996": None,
    "vor langer Zeit": None,
    "": None,
    None: None,
}
PRICES = {
    ("$1,234.50", "en"): (1234.5, "USD"),
    ("1.234,50 €", "de"): (1234.5, "EUR"),
    ("1.234 €", "de"): (1234.0, "EUR"),
    ("1.234 €", "en"): (1.234, "EUR"),
    ("1.234 €", None): (1234.0, "EUR"),
    ("1,234 USD", "en"): (1234.0, "USD"),
    ("1,234 kg", "fr"): (1.234, None),
    ("1 234,5 euros", "fr"): (1234.5, "EUR"),
    ("1 234 567,89 EUR", "fr"): (1234567.89, "EUR"),
    ("CHF 1'234.50", "de"): (1234.5, "CHF"),
    ("12 Franken", "de"): (12.0, "CHF"),
    ("1.234.567", "en"): (1234567.0, None),
    ("0.125", "es"): (0.125, None),
    ("-3,99 dólares", "es"): (-3.99, "USD"),
    ("£7", "en"): (7.0, "GBP"),
    ("ab 99,- Euro", "de"): (99.0, "EUR"),
    ("europe 5", "en"): (5.0, None),
    ("US$5", "en"): (5.0, "USD"),
    ("gratis", "es"): None,
    (None, "en"): None,
}


def test_dates(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(DATES)], "k int, t string")
    got = {r.k: r.iso for r in df.select("k", coerce.to_date(F.col("t"), F.lit(NOW).cast("timestamp")).alias("iso")).collect()}
    assert {t: got[k] for k, t in enumerate(DATES)} == DATES


def test_order_of_a_language(spark):
    df = spark.createDataFrame([("3/4/2024",), ("13/4/2024",), ("4/13/2024",), ("2024-4-3",)], "t string")
    show = lambda language: [str(r[0])[:10] for r in df.select(told.timestamp(F.col("t"), F.lit(NOW).cast("timestamp"), language)).collect()]
    assert show("en") == ["2024-03-04", "2024-04-13", "2024-04-13", "2024-04-03"]
    assert show("fr") == show(None) == ["2024-04-03", "2024-04-13", "2024-04-13", "2024-04-03"]


def test_prices(spark):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(PRICES)], "k int, t string, lang string")
    got = {r.k: r.p for r in df.select("k", told.price(F.col("t"), F.col("lang")).alias("p")).collect()}
    assert {x: got[k] and tuple(got[k]) for k, x in enumerate(PRICES)} == PRICES


def test_a_text_is_worked_out_once(spark):
    """However many forms are tried, the plan holds the text's own expression once, also where it tells from now."""
    df = spark.createDataFrame([("5 Mar 2024",)], "t string")
    text = F.concat(F.col("t"), F.lit(" marker"))
    for iso in (coerce.to_date(text, F.lit(NOW).cast("timestamp")), coerce.relative(text, F.lit(NOW).cast("timestamp"))):
        plan = df.select(iso.alias("iso"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(" marker") == 1
