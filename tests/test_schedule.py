"""Cron against a minute-by-minute walk; reading helpers."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest

from weftwork.dom import reading
from weftwork.plans.schedule import Cron, next_fire

START = datetime(2024, 2, 27, 22, 58, 30, tzinfo=UTC)


@pytest.mark.parametrize("text", ["* * * * *", "*/15 3-5 * * *", "0 0 29 2 *", "30 6 * * mon-fri", "0 12 1,15 * 0", "5 4 1 mar *"])
def test_cron(text):
    c, t = Cron(text), START.replace(second=0)
    while True:
        t += timedelta(minutes=1)
        day, week = t.day in c.days, (t.weekday() + 1) % 7 in c.week
        fits = day and week if c.any_day or c.any_week else day or week
        if t.minute in c.minutes and t.hour in c.hours and t.month in c.months and fits:
            break
    assert c.after(START) == t


def test_zones_and_intervals():
    assert next_fire(START, cron="0 9 * * *", zone="Europe/Berlin").hour == 8
    assert next_fire(START, seconds=5) == START + timedelta(seconds=60)
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            Cron(bad)


PAGE = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(6)) + "</ul></nav><h2>Head</h2><p>Some <b>bold</b> text</p><script>x</script>"


def test_reading():
    assert "+4 more li" in reading.outline(PAGE)
    md = reading.markdown(PAGE)
    assert "## Head" in md and "Some **bold** text" in md and "- [Item 0](/0)" in md and "x\n" not in md
    hit = reading.search(PAGE, "item 3", "nav li")[0]
    assert hit["selector"] == "a" and hit["fill"] == 6
    assert reading.probe_selector(PAGE, "nav a", "nav li")["matches"] == 6 and reading.probe_selector(PAGE, "a:hover")["matches"] == -1
