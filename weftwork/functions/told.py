"""Dates and prices as people write them in English, German, French and Spanish, by tables and JVM expressions.

A date text is cut into a time of day and tokens; weekdays, articles and ordinals go, month names become
numbers, and what is left must be one of a few sequences.  Sequences of numbers alone are read year first where the
first has four digits, else in the order of the language; where that cannot be, in the other.  Texts told from
now ("vor 3 Tagen", "il y a une heure") count from now.  A text with any other word is no date.

A price's decimal mark is the last of two different marks, or a single one that does not stand before
three digits alone; where it does, the language decides.  Blanks and apostrophes separate thousands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .transforms import strip

# Names in four languages, without accents, and what they stand for.
MONTHS = {
    1: "january jan januar janner janvier janv enero ene",
    2: "february feb februar fevrier fevr fev febrero",
    3: "march mar marz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug aout agosto ago",
    9: "september sept sep septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez decembre diciembre dic",
}
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thurs friday fri saturday sat sunday sun "
    "montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonnabend sonntag so "
    "lundi lun mardi mercredi mer jeudi jeu vendredi ven samedi sam dimanche dim "
    "lunes martes miercoles mie jueves jue viernes vie sabado sab domingo dom"
)
FILLERS = "the of at on st nd rd th am den der dem um uhr le la les a las er de del el los y"
UNITS = {
    "second": "second seconds sec secs sekunde sekunden seconde secondes segundo segundos",
    "minute": "minute minutes min mins minuten minuto minutos",
    "hour": "hour hours hr hrs stunde stunden heure heures hora horas",
    "day": "day days tag tage tagen jour jours dia dias",
    "week": "week weeks woche wochen semaine semaines semana semanas",
    "month": "month months monat monate monaten mois mes meses",
    "year": "year years jahr jahre jahren an ans annee annees ano anos",
}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
NUMBERS = "a an one ein eine einem einer un une una uno"
DAYS = {-2: "vorgestern avant-hier anteayer", -1: "yesterday gestern hier ayer", 0: "today now heute jetzt aujourd'hui maintenant hoy ahora", 1: "tomorrow morgen demain manana", 2: "ubermorgen apres-demain"}
CURRENCIES = {
    "USD": "$ us$ usd dollar dollars dolar dolares",
    "EUR": "€ eur euro euros",
    "GBP": "£ gbp pound pounds pfund livre livres libra libras",
    "CHF": "chf franken sfr fr francs franc francos",
    "JPY": "¥ jpy yen",
    "INR": "₹ inr rupee rupees rupien roupies rupias",
}
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñç’", "aaaaaaeeeeiiiiooooouuuunc'"
#: Which number comes first in a language, and its decimal mark.
FIRST, DECIMAL = {"en": "month", "de": "day", "fr": "day", "es": "day"}, {"en": ".", "de": ",", "fr": ",", "es": ","}


def _table(names: dict) -> Column:
    """A map from each name to its key."""
    pairs = [(n, k) for k, own in names.items() for n in own.split()]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def bound(value: Column, body) -> Column:
    """A body over a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(words: str) -> str:
    """An alternation, the longest first."""
    return "|".join(sorted(words.split(), key=lambda w: (-len(w), w)))


def plain(c: Column) -> Column:
    """Lower case without accents, one blank between words."""
    return F.regexp_replace(F.translate(F.lower(strip(c)), ACCENTS, PLAIN), r"[\s  ]+", " ")


_CLOCK = r"(?:^|[\s,t])(\d{1,2})(?:[:h]|\.(?=\d\d ?uhr))(\d{2})(?::(\d{2}))?(?:[.,]\d+)? ?(?:([ap])\.?m\b\.?|uhr|h\b)?(?: ?z$)?"
_HOUR = r"(?:^|[\s,])(\d{1,2}) ?(?:(?:uhr|h|heures)|([ap])\.?m\.?)(?=[\s,]|$)"


def _time(text: Column) -> Column:
    """Struct of seconds since midnight (`at`: null where no time of day is told, -1 where there can be none such) and the `rest` of a text."""

    def clock(pattern: str, half: int, *smaller: int) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")
        told = bound(F.struct(part(1).alias("hour"), F.regexp_extract(text, pattern, half).alias("half")), _hour)
        minute, second = ([F.coalesce(part(k), F.lit(0)) for k in smaller] + [F.lit(0)] * 2)[:2]
        at = bound(F.struct(told.alias("h"), minute.alias("m"), second.alias("s")), lambda t: F.when((t["h"] < 24) & (t["m"] < 60) & (t["s"] < 60), t["h"] * 3600 + t["m"] * 60 + t["s"]).when(t["h"].isNotNull(), -1))
        return F.struct(at.alias("at"), F.regexp_replace(text, pattern, " ").alias("rest"))

    return F.when(text.rlike(_CLOCK), clock(_CLOCK, 4, 2, 3)).when(text.rlike(_HOUR), clock(_HOUR, 2)).otherwise(F.struct(F.lit(None).cast("int").alias("at"), text.alias("rest")))


def _hour(told: Column) -> Column:
    hour, half = told["hour"], told["half"]
    return F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)


def timestamp(c: Column, now: Column | None = None, language: str | None = None) -> Column:
    """The date and time that a text tells in any of the languages; numbers alone in the order of `language` (day first without one)."""
    now = F.current_timestamp() if now is None else now
    return bound(plain(c), lambda text: _timestamp(text, now, language))


def _timestamp(text: Column, now: Column, language: str | None) -> Column:
    return F.coalesce(bound(_time(text), lambda t: _dated(t["at"], t["rest"], now, language)), relative(text, now))


def _dated(at: Column, rest: Column, now: Column, language: str | None) -> Column:
    words = F.regexp_extract_all(rest, F.lit(r"([a-z]+|\d+)"), 1)
    skip = F.array(*[F.lit(w) for w in dict.fromkeys((WEEKDAYS + " " + FILLERS).split())])
    months = _table(MONTHS)
    # "mar" is a month before a weekday, as only one of them can stand beside a number
    kept = F.filter(words, lambda w: ~F.array_contains(skip, w))
    tokens = F.array_join(F.transform(kept, lambda w: F.coalesce(F.concat(F.lit("m"), F.try_element_at(months, w).cast("string")), F.when(w.rlike(r"^\d{1,4}$"), w), F.lit("?"))), " ")
    fixed = bound(tokens, lambda code: F.when(~F.contains(code, F.lit("?")), _calendar(code, now, language)))
    seconds = F.coalesce(at, F.lit(0))
    return F.when(seconds >= 0, fixed + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def _calendar(code: Column, now: Column, language: str | None) -> Column:
    """The date of a sequence of numbers and months."""
    number = lambda pattern, k: F.nullif(F.regexp_extract(code, pattern, k), F.lit("")).cast("int")

    def date(pattern: str, y: int, m: int, d: int) -> Column:
        year = number(pattern, y) if y else F.year(now)
        short = F.length(F.regexp_extract(code, pattern, y)) == 2 if y else F.lit(False)
        year = F.when(short, year + F.when(year < 69, 2000).otherwise(1900)).otherwise(year)
        whole = F.format_string("%04d-%02d-%02d", year, number(pattern, m), number(pattern, d) if d else F.lit(1))
        return F.when(code.rlike(pattern), F.to_timestamp(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd"))))

    tries = [
        date(r"^(\d{1,2}) m(\d+) (\d{4}|\d{2})$", 3, 2, 1),
        date(r"^m(\d+) (\d{1,2}) (\d{4})$", 3, 1, 2),
        date(r"^(\d{4}) m(\d+) (\d{1,2})$", 1, 2, 3),
        date(r"^(\d{4}) (\d{1,2}) (\d{1,2})$", 1, 2, 3),
    ]
    numeric = r"^(\d{1,2}) (\d{1,2}) (\d{4}|\d{2})$"
    orders = [date(numeric, 3, 2, 1), date(numeric, 3, 1, 2)]
    tries += orders[::-1] if FIRST.get(language or "", "day") == "month" else orders
    tries += [date(r"^(\d{1,2}) m(\d+)$", 0, 2, 1), date(r"^m(\d+) (\d{1,2})$", 0, 1, 2), date(r"^m(\d+) (\d{4})$", 2, 1, 0)]
    return F.coalesce(*tries)


def relative(text: Column, now: Column) -> Column:
    """A time told from now; text is plain."""
    units, many = _any(" ".join(UNITS.values())), f"\\d{{1,6}}|{_any(NUMBERS)}"
    forms = [(rf"^(?:vor|il y a|hace)(?: etwa| environ| unos| unas)? ({many}) ?({units})$", -1), (rf"^({many}) ?({units}) ago$", -1), (rf"^(?:in|dans|en|dentro de) ({many}) ?({units})$", 1)]
    out = []
    for pattern, sign in forms:
        count = F.regexp_extract(text, pattern, 1)
        n = F.when(count.rlike(r"^\d"), count.try_cast("int")).otherwise(1) * sign
        unit = F.try_element_at(_table(UNITS), F.regexp_extract(text, pattern, 2))
        months = F.when(unit == "month", n).when(unit == "year", n * 12).otherwise(0)
        seconds = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in kv]), unit), F.lit(0)) * n
        out.append(F.when(text.rlike(pattern), now + F.make_ym_interval(F.lit(0), months) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)))
    days = F.try_element_at(_table(DAYS), text)
    return F.coalesce(*out, now + F.make_dt_interval(days))


def price(c: Column, language: str | Column | None = None) -> Column:
    """struct of amount and currency (null where none is told); null where there is no number."""
    return bound(plain(c), lambda text: _price(text, language))


def _price(text: Column, language: str | Column | None) -> Column:
    raw = F.regexp_extract(text, r"[-+]?(?:\d[\d.,' ]*\d|\d)", 0)
    amount = bound(F.regexp_replace(raw, "[' ]", ""), lambda bare: _amount(bare, language))
    told = F.regexp_extract(text, rf"(?:^|[^a-z])({'|'.join(w for w in _any(' '.join(CURRENCIES.values())).replace('$', '[$]').split('|') if w[0].isalpha())})(?![a-z])|([$€£¥₹])", 0)
    currency = F.try_element_at(_table(CURRENCIES), F.regexp_replace(told, "[^a-z$€£¥₹]", ""))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def _amount(bare: Column, language: str | Column | None) -> Column:
    """A number by its marks."""
    dots, commas = (F.length(bare) - F.length(F.replace(bare, F.lit(m), F.lit(""))) for m in (".", ","))
    last = F.regexp_extract(bare, r"([.,])[^.,]*$", 1)
    names = F.create_map(*[F.lit(x) for kv in DECIMAL.items() for x in kv])
    own = F.lit(None).cast("string") if language is None else F.try_element_at(names, F.lit(language) if isinstance(language, str) else language)
    mark = (
        F.when((dots > 0) & (commas > 0), last)
        .when((dots > 1) | (commas > 1), "")
        # one mark: before three digits, and after no more than three, it may be either
        .when((dots + commas == 1) & ~bare.rlike(r"^[-+]?[1-9]\d{0,2}[.,]\d{3}$"), last)
        .when((dots + commas == 1) & (F.coalesce(own, F.lit("")) == last), last)
        .otherwise("")
    )
    digits = F.when(mark == ",", F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(mark == ".", F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(bare, "[.,]", ""))
    return F.when(bare != "", digits).try_cast("double")
