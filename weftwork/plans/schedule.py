"""When schedules fire next: five-field cron in a time zone, or an interval; and what a tick starts."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SECONDS = 60
_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = {n: i for names in (("sun", "mon", "tue", "wed", "thu", "fri", "sat"),) for i, n in enumerate(names)} | {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def _field(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        else:
            first, _, last = span.partition("-")
            a = _NAMES[first] if first in _NAMES else int(first)
            b = (_NAMES[last] if last in _NAMES else int(last)) if last else (high if step else a)
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(a, b + 1, int(step or 1)))
    return frozenset(out)


class Cron:
    def __init__(self, text: str):
        parts = text.split()
        if len(parts) != 5:
            raise ValueError("cron needs five fields")
        self.minutes, self.hours, self.days, self.months, week = (_field(p, *r) for p, r in zip(parts, _RANGES, strict=True))
        self.week = frozenset(d % 7 for d in week)
        self.any_day, self.any_week = parts[2] == "*", parts[4] == "*"

    def _day(self, t: datetime) -> bool:
        by_day, by_week = t.day in self.days, (t.weekday() + 1) % 7 in self.week
        return by_day and by_week if self.any_day or self.any_week else by_day or by_week

    def after(self, t: datetime, zone: str = "UTC") -> datetime:
        """The first minute after t that fits, as UTC."""
        now = t.astimezone(ZoneInfo(zone)).replace(second=0, microsecond=0) + timedelta(minutes=1)
        end = now + timedelta(days=366 * 5)
        while now < end:
            if now.month not in self.months or not self._day(now):
                now = (now + timedelta(days=1)).replace(hour=0, minute=0)
            elif now.hour not in self.hours:
                now = now.replace(minute=0) + timedelta(hours=1)
            elif now.minute not in self.minutes:
                now += timedelta(minutes=1)
            else:
                return now.astimezone(UTC)
        raise ValueError("never fires")


def next_fire(now: datetime, cron: str | None = None, seconds: int | None = None, zone: str = "UTC") -> datetime:
    """Counted from now, so missed firings fall together."""
    if cron:
        return Cron(cron).after(now, zone)
    return now + timedelta(seconds=max(LEAST_SECONDS, seconds or 0))


def tick(schedules: DataFrame, runs: DataFrame, now: Column, most: int = 2) -> DataFrame:
    """Due schedules that may start: none of their recipe runs, and no more than the free places, oldest first."""
    active = runs.where(F.col("status").isin("queued", "running", "stopping"))
    free = max(0, most - active.count())
    due = schedules.where(F.col("enabled") & F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= now))
    return due.join(active.select("recipe_id").distinct(), "recipe_id", "left_anti").orderBy("next_run_at").limit(free)
