"""From text to typed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import told
from .transforms import strip

# What says yes and what says no.
YES = ("true", "yes", "y", "1", "in stock", "available", "on", "✓", "✔")
NO = ("false", "no", "n", "0", "out of stock", "unavailable", "sold out", "off", "✗", "✘")
#: Date forms in the order they are tried; all but the last few have no time of day.
DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "d.M.yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
TIMES = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm")
#: How the English months begin, and all texts that `relative` knows.
_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_FROM_NOW = "^in | ago$|^(?:yesterday|tomorrow|today|now|just now|last week)$"
#: A number that needs no reading.
_BARE = r"^[-+]?\d+(?:\.\d{1,2})?\z"
_CURRENCY = r"(?i)[$€£¥₹]|\b(?:usd|eur|gbp|chf|jpy|inr|sek|nok|dkk|pln)\b|zł|kr\b"


def to_number(c: Column) -> Column:
    """The first number in a text, by the mark that stands before its last one or two digits."""
    found = lambda c: F.regexp_replace(F.trim(F.regexp_extract(F.replace(c, F.lit(" "), F.lit(" ")), r"[-+]?\d[\d,.\s]*", 0)), r"\s+$", "")
    return F.when(c.rlike(_BARE), c.try_cast("double")).otherwise(told.bound(found(c), _by_mark).try_cast("double"))


def _by_mark(raw: Column) -> Column:
    mark = F.regexp_extract(raw, r"([.,])\d{1,2}$", 1)
    bare = F.replace(raw, F.lit(" "), F.lit(""))
    marked = told.bound(mark, lambda mark: F.when(mark == ",", F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(mark != "", F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(raw, r"[,\s]", "")))
    return F.when(raw != "", marked)


def to_price(c: Column) -> Column:
    """A number without its currency; a mark before three digits and none after separates thousands."""
    return F.when(c.rlike(_BARE), c.try_cast("double")).otherwise(to_number(strip(F.regexp_replace(c, _CURRENCY, " "))))


def to_bool(c: Column) -> Column:
    """Whole words first; then phrases of more than two letters, the negative ones before the others."""
    says = lambda t, words: t.rlike("|".join(w for w in words if len(w) > 2))
    plain = F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))
    return plain.otherwise(told.bound(F.lower(strip(c)), lambda t: F.when(t.isin(*YES), F.lit(True)).when(t.isin(*NO), F.lit(False)).when(says(t, NO), F.lit(False)).when(says(t, YES), F.lit(True))))


def to_enum(c: Column, options: Sequence[str]) -> Column:
    """The option equal to the text, else the first contained in it; case does not count."""
    if not options:
        return c
    t, out = F.lower(strip(c)), None
    for test in (lambda o: t == o.lower(), lambda o: F.contains(t, F.lit(o.lower()))):
        for o in options:
            out = F.when(test(o), F.lit(o)) if out is None else out.when(test(o), F.lit(o))
    return out


def relative(t: Column, now: Column) -> Column:
    """A time told from now: "3 days ago", "in 2 hours", "an hour ago", "yesterday", "last week"; null for other texts."""
    low = F.regexp_replace(F.lower(t), r"\s+", " ")
    return told.bound(low, lambda low: F.when(low.rlike(_FROM_NOW), _relative(low, now)))


def _relative(low: Column, now: Column) -> Column:
    ago = r"^(?:about |over |almost )?(an?|one|\d{1,6}) ?(seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|[smhdwy]) ago$"
    ahead = r"^in (?:about )?(an?|one|\d{1,6}) (seconds?|minutes?|hours?|days?|weeks?|months?|years?)$"
    back = low.rlike(ago)
    count, unit = (F.when(back, F.regexp_extract(low, ago, k)).otherwise(F.regexp_extract(low, ahead, k)) for k in (1, 2))

    def moved(n: Column, unit: Column) -> Column:
        is_ = lambda *names: unit.rlike("^(?:" + "|".join(names) + ")$")
        months = F.when(is_("months?"), n).when(is_("years?", "y"), n * 12).otherwise(0)
        seconds = F.when(is_("seconds?", "secs?", "s"), n).when(is_("minutes?", "mins?", "m"), n * 60).when(is_("hours?", "hrs?", "h"), n * 3600).when(is_("days?", "d"), n * 86400).when(is_("weeks?", "w"), n * 604800).otherwise(0)
        return now + F.make_ym_interval(F.lit(0), months) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)

    n = F.when(count.isin("a", "an", "one"), 1).otherwise(count.try_cast("int")) * F.when(back, -1).otherwise(1)
    told_ = F.when(back | low.rlike(ahead), told.bound(F.struct(n.alias("n"), unit.alias("unit")), lambda x: moved(x["n"], x["unit"])))
    days = F.when(low == "yesterday", -1).when(low == "tomorrow", 1).when(low.isin("today", "now", "just now"), 0).when(low == "last week", -7)
    return F.coalesce(told_, now + F.make_dt_interval(days))


def to_timestamp(c: Column, now: Column | None = None) -> Column:
    """Fixed forms, with month names in any case and after weekdays and ordinals; forms without a year take now's, told ones count from now.

    What they leave is read as told in other languages (`told`).  A form is tried only on texts that begin as it does: a try that fails is dear."""
    now = F.current_timestamp() if now is None else now
    return told.bound(strip(c), lambda s: told.bound(_bare(s), lambda t: F.coalesce(_numbered(t), told.bound(_named(t), lambda n: _worded(n, now)), relative(t, now), told.timestamp(s, now))))


def _bare(s: Column) -> Column:
    """Without the weekday before and the ordinal's letters."""
    return F.regexp_replace(F.regexp_replace(s, r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+", ""), r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")


def _named(t: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(t, r"(?i)\bsept\b", "Sep"), r"\.(?=\s|$)", ""))


def _tried(t: Column, begins: str, forms: Sequence[str]) -> Column:
    return F.when(t.rlike(begins), F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms]))


def _numbered(t: Column) -> Column:
    """Dates in numbers; one with a zone is cast."""
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"), t.try_cast("timestamp"))
    return F.coalesce(_tried(t, r"^[+-]?\d+-", (*TIMES, DATES[0])), _tried(t, r"^[+-]?\d+/", (DATES[1], DATES[3])), _tried(t, r"^[+-]?\d+\.", DATES[2:3]), zoned)


def _worded(n: Column, now: Column) -> Column:
    """Dates with an English month, with a year or without."""
    short = told.bound(F.concat(n, F.lit(" "), F.year(now).cast("string")), lambda y: F.coalesce(*[F.try_to_timestamp(y, F.lit(f)) for f in ("d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")]))
    day_first, month_first = rf"(?i)^[+-]?\d+ (?:{_MONTH})", rf"(?i)^(?:{_MONTH})"
    return F.coalesce(_tried(n, day_first, DATES[4:6]), _tried(n, month_first, DATES[6:]), F.when(n.rlike(rf"{day_first}\p{{L}}*$|{month_first}\p{{L}}* [+-]?\d+$"), short))


def to_date(c: Column, now: Column | None = None) -> Column:
    """ISO text: a date at midnight, else date and time."""

    def shown(at: Column) -> Column:
        midnight = F.date_format(at, "HH:mm:ss") == "00:00:00"
        return F.when(midnight, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))

    return told.bound(to_timestamp(c, now), shown)


def to_text(c: Column) -> Column:
    t = strip(c)
    return F.when(t != "", t)


def to_json(c: Column) -> Column:
    """The document as a variant; text that is no JSON becomes a JSON string."""
    quoted = F.to_json(F.array(c))
    return F.coalesce(F.try_parse_json(c), F.parse_json(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))


def coerce_one(c: Column, kind: str, options: Sequence[str] = ()) -> Column:
    match kind:
        case "number":
            return to_number(c)
        case "price":
            return to_price(c)
        case "bool":
            return to_bool(c)
        case "date":
            return to_date(c)
        case "enum":
            return to_enum(c, options)
        case "json":
            return to_json(c)
    return to_text(c)


def coerce(values: Column, kind: str, options: Sequence[str] = (), many: bool = False) -> Column:
    """An array of texts to one typed value (the first that has one), or to a list of them."""
    inner = "text" if kind == "list" else kind
    found = F.filter(F.transform(values, lambda x: coerce_one(x, inner, options)), lambda x: x.isNotNull())
    if many or kind == "list":
        return found
    return F.get(found, F.lit(0))


#: The Spark type of each field type.
TYPES = {"text": "string", "number": "double", "price": "double", "date": "string", "url": "string", "image": "string", "bool": "boolean", "enum": "string", "list": "array<string>", "json": "variant"}
