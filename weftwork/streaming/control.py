"""Runs that are watched and stopped: progress, a stop that lets a batch end, and hooks around a run."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Counts over the batches of all queries of a session; `every` seconds at least lie between two reports."""

    def __init__(self, report: Callable[[dict[str, Any]], None], every: float = 2.0):
        self.report, self.every, self.last = report, every, 0.0
        self.rows = self.batches = 0

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        if time.monotonic() - self.last >= self.every:
            self.last = time.monotonic()
            self.report({"rows": self.rows, "batches": self.batches, "batch": event.progress.batchId})

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.report({"rows": self.rows, "batches": self.batches, "error": event.exception})


def stop_gracefully(query: StreamingQuery, wait: float = 15.0, poll: float = 0.2) -> bool:
    """Stop a query between batches; after `wait` seconds in the midst of one.  True where a batch was let end."""
    until = time.monotonic() + wait
    while query.isActive and time.monotonic() < until:
        if not query.status["isTriggerActive"]:
            query.stop()
            return True
        time.sleep(poll)
    if query.isActive:
        query.stop()
        return False
    return True


def run_until(query: StreamingQuery, asked_to_stop: Callable[[], bool], poll: float = 1.0, wait: float = 15.0) -> str:
    """Look once in a while whether a run is to stop; finished, stopped or failed."""
    while query.isActive:
        if asked_to_stop():
            stop_gracefully(query, wait)
            return "stopped"
        query.awaitTermination(poll)
    return "failed" if query.exception() else "finished"


def with_hooks(work: Callable[[], Any], on_finished: Callable[[str, Any], None] | None = None, on_page_failed: Callable[[Any], None] | None = None, failed: Callable[[Any], list] | None = None) -> Any:
    """The result of a run; hooks see each failed page and how the run ended.  A hook's own error does not fail the run."""

    def call(hook: Callable | None, *args: Any) -> None:
        if hook is not None:
            try:
                hook(*args)
            except Exception:  # noqa: BLE001 - a hook is a stranger's code
                pass

    try:
        result = work()
    except Exception as e:
        call(on_finished, "failed", e)
        raise
    for page in failed(result) if failed else ():
        call(on_page_failed, page)
    call(on_finished, "finished", result)
    return result
