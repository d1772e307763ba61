"""State per key on streams, in the order of events: back-off, tiers and drift as they change.

These rules do not commute, so rows are held until the watermark has passed them and then taken in order
of time and number; a row that is late by less than the watermark's delay finds its place, one that
is later is left out.  State lives in the store of the stream (value state for what a rule knows, a list of the
rows that wait), timers in event time wake a key when its rows are due.  With `idle`, what is known of a key is forgotten when its events
pause for longer, so ended runs leave nothing behind.  A restart from the checkpoint goes on with what was held.

The session needs the RocksDB state store, which `ready` sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.monitor import HIGH, LEAST, LEAST_DELAY, LOW, MOST_DELAY, MOST_PENALTY

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A rule: what is known (None at first) and a row give what is known after it, and the rows to tell.
Step = Callable[[tuple | None, Row], tuple[tuple, list[tuple]]]


def ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Applies a rule to each key's rows in order of (ts, seq)."""

    def __init__(self, step: Step, known: StructType, held: StructType, out: Sequence[str], idle_ms: int | None):
        self.step, self.schemas, self.out, self.idle_ms = step, (known, held), out, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.schemas[0])
        self.last = handle.getValueState("last", "at long")
        self.held = handle.getListState("held", self.schemas[1])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - the interface's names
        names = self.schemas[1].names
        new = [tuple(r[c] for c in names) for r in rows]
        if new:
            self.held.appendList(new)
            # one timer for the first of them: it takes all that is due, and sets the next
            self._timer(_ms(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        due_at = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due, wait = sorted((r for r in rows if _ms(r[0]) <= due_at), key=lambda r: (r[0], r[1])), [r for r in rows if _ms(r[0]) > due_at]
        if due:
            if wait:
                self.held.put(wait)
            else:
                self.held.clear()
            known, told = tuple(self.known.get()) if self.known.exists() else None, []
            last = self.last.get()[0] if self.last.exists() else _ms(due[0][0])
            row = Row(*self.schemas[1].names)
            for r in due:
                if self.idle_ms is not None and _ms(r[0]) - last > self.idle_ms:
                    known = None
                known, some = self.step(known, row(*r))
                told += some
                last = max(last, _ms(r[0]))
            self.known.update(known)
            self.last.update((last,))
            if self.idle_ms is not None:
                self._timer(last + self.idle_ms + 1)
            for t in told:
                yield Row(**dict(zip(self.out, (*key, *t), strict=True)))
        elif not wait and self.idle_ms is not None and self.last.exists() and self.last.get()[0] + self.idle_ms < due_at:
            self.known.clear()
            self.last.clear()
        if wait:
            self._timer(_ms(min(r[0] for r in wait)))

    def _timer(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _ms(ts) -> int:
    return int(ts.timestamp() * 1000)


def in_order(events: DataFrame, by: Sequence[str], columns: Sequence[str], step: Step, known: str, told: str, delay: str, idle_ms: int | None = None) -> DataFrame:
    """Rows that a rule tells: by, then `told`.  events have ts, seq, by and the columns; known: the rule's own values."""
    spark = events.sparkSession
    ready(spark)
    slim = events.select(*by, "ts", "seq", *columns).where("ts IS NOT NULL").withWatermark("ts", delay)
    held = StructType([slim.schema[c] for c in ("ts", "seq", *columns)])
    out = StructType([*[slim.schema[c] for c in by], *StructType.fromDDL(told).fields])
    processor = InOrder(step, StructType.fromDDL(known), held, out.names, idle_ms)
    return slim.groupBy(*by).transformWithState(processor, out, "Append", "EventTime")


# ---- the rules ----------------------------------------------------------------------------


def _backoff(base: float) -> Step:
    def step(known: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        penalty, tier = known or (0, None)
        if row.verdict == "blocked":
            penalty = min(penalty + 1, MOST_PENALTY)
        elif row.verdict == "ok":
            penalty = max(penalty - 1, 0)
            if (row.attempts or 0) > 0 or row.tier != "http":
                tier = row.tier
        delay = min(max(base, LEAST_DELAY) * 2.0**penalty, MOST_DELAY) if penalty else base
        return (penalty, tier), [(row.ts, row.seq, penalty, delay, tier)]

    return step


def backoff(events: DataFrame, delay: str, base: float = 0.5, idle_ms: int | None = None) -> DataFrame:
    """domain, ts, seq, penalty, delay, tier after each event; events: domain, ts, seq, verdict, tier, attempts.

    The tier is that of the last good answer that took more than one attempt or was not http.
    """
    return in_order(events, ["domain"], ["verdict", "tier", "attempts"], _backoff(base), "penalty int, tier string", "ts timestamp, seq long, penalty int, delay double, tier string", delay, idle_ms)


def _drift(known: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
    seen, best, told = known or (0, -1.0, False)
    seen, out = seen + 1, []
    if not told and seen >= LEAST and row.rate <= LOW and best >= HIGH:
        out, told = [(row.ts, row.seq, row.rate, best)], True
    return (seen, max(best, row.rate), told), out


def drift(events: DataFrame, delay: str, by: Sequence[str] = ("run_id", "field"), idle_ms: int | None = None) -> DataFrame:
    """by, ts, seq, rate, best_before: the first observation of each field whose rate has dropped; events: by, ts, seq, rate."""
    return in_order(events.where(F.col("rate").isNotNull()), by, ["rate"], _drift, "seen long, best double, told boolean", "ts timestamp, seq long, rate double, best_before double", delay, idle_ms)
