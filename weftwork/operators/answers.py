"""Answers of an outside function, kept by what was asked: each different request is asked once, whatever fails.

A request is the JSON of a row's inputs; rows that ask the same share an answer.  Requests are dealt by
hash into buckets, and a task takes those of its buckets that no stored answer is for.  It asks some at
once on threads, tries again with growing pauses where the function raises or leaves an answer out, and stores
what came every few answers, each time as a file of its own put in place whole.  A task that is lost, or a job that
broke off, finds those files and asks only for the rest; so does any later job over the same folder.

A request that fails in all tries is not stored: its fields are null now, and it is asked again next time.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import places
from .outside import Provider, needs_values

BUCKETS, AT_ONCE, TRIES, PAUSE, FLUSH = 64, 8, 4, 0.5, 200
_SCHEMA = pa.schema([("id", pa.string()), ("answer", pa.string())])


class Asker:
    """One task's way to the outside: so many calls at once, so many a second, tries with pauses that double."""

    def __init__(self, provider: Provider, batch: int, at_once: int, rate: float | None, tries: int, pause: float):
        self.provider, self.batch, self.at_once, self.tries, self.pause = provider, batch, at_once, tries, pause
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def _wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))

    def _call(self, requests: list[tuple[str, dict]]) -> dict[str, dict]:
        """Answers by id; what a call leaves out or raises for is asked again, alone from the second time on."""
        found: dict[str, dict] = {}
        left = [requests]
        for k in range(self.tries):
            again = []
            for some in left:
                self._wait()
                try:
                    got = self.provider([r for _, r in some])
                except Exception:  # noqa: BLE001 - any fault of the outside function is its own
                    got = []
                found.update((i, a) for (i, _), a in zip(some, got, strict=False) if a)
                again += [[x] for x in some if x[0] not in found]
            left = again
            if not left:
                break
            if k + 1 < self.tries:
                time.sleep(self.pause * 2**k)
        return found

    def answers(self, requests: Iterable[tuple[str, dict]]) -> Iterator[tuple[str, dict]]:
        """(id, answer) as they come, of some calls at a time."""
        window: list[list[tuple[str, dict]]] = []
        with ThreadPoolExecutor(self.at_once) as pool:
            def flush() -> Iterator[tuple[str, dict]]:
                for found in pool.map(self._call, window):
                    yield from found.items()
                window.clear()

            for r in requests:
                if not window or len(window[-1]) == self.batch:
                    if len(window) == self.at_once:
                        yield from flush()
                    window.append([])
                window[-1].append(r)
            yield from flush()


class Answers:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def stored(self) -> DataFrame:
        """id, answer of all requests that were answered."""
        schema = "id string, answer string, bucket int"
        fs, root = places.filesystem(self.folder)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return self.spark.createDataFrame([], schema).drop("bucket")
        # two tasks of one bucket, of which one was thought lost, may have asked the same
        return self.spark.read.schema(schema).parquet(self.folder).groupBy("id").agg(F.min("answer").alias("answer"))

    def ask(self, rows: DataFrame, key: str, inputs: Sequence[str], fields: Sequence[str], provider: Provider, batch: int = 1, at_once: int = AT_ONCE, rate: float | None = None, tries: int = TRIES, pause: float = PAUSE, flush: int = FLUSH, parts: int | None = None) -> DataFrame:
        """key and the fields as text, for rows that lack a field.

        provider: a list of mappings of the inputs to a list of mappings of the fields.  rate: calls a second of the whole
        job, shared evenly by its `parts` tasks.
        """
        request = F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})
        wanted = rows.where(needs_values(rows, fields)).select(key, request.alias("_request"))
        wanted = wanted.withColumn("_ask", F.sha2(F.concat_ws("\x1f", F.lit(",".join(fields)), "_request"), 256))
        parts = parts or min(self.buckets, 2 * self.spark.sparkContext.defaultParallelism)
        open_ = wanted.select("_ask", "_request").distinct().join(self.stored().select(F.col("id").alias("_ask")), "_ask", "left_anti")
        dealt = open_.withColumn("_bucket", F.pmod(F.xxhash64("_ask"), F.lit(self.buckets)).cast("int")).repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_ask")
        settings = (provider, batch, at_once, rate / parts if rate else None, tries, pause)
        folder, names = self.folder, list(fields)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = places.filesystem(folder)
            asker, asked = Asker(*settings), 0
            for bucket, requests in _by_bucket(batches):
                place = f"{root}/bucket={bucket}"
                fs.create_dir(place, recursive=True)
                known = _known(fs, place)
                held: list[tuple[str, str]] = []
                for i, answer in asker.answers((i, json.loads(r)) for i, r in requests if i not in known):
                    held.append((i, json.dumps({f: None if answer.get(f) is None else str(answer[f]) for f in names})))
                    if len(held) >= flush:
                        asked += _store(fs, place, held)
                asked += _store(fs, place, held)
            yield pa.record_batch([pa.array([asked], pa.int64())], names=["asked"])

        dealt.select("_bucket", "_ask", "_request").mapInArrow(work, "asked long").agg(F.sum("asked")).collect()  # one number
        said = F.from_json("_answer", ", ".join(f"`{f}` string" for f in fields))
        got = wanted.select(key, "_ask").join(self.stored().select(F.col("id").alias("_ask"), F.col("answer").alias("_answer")), "_ask", "left")
        return got.select(key, *[said[f].alias(f) for f in fields])


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, str]]]]:
    """The requests of each bucket, which come one after the other."""
    rows = ((k, i, r) for b in batches for k, i, r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead:
        bucket = ahead[0]

        def own() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead and ahead[0] == bucket:  # noqa: B023 - read before the next bucket begins
                yield ahead[1:]
                ahead = next(rows, None)

        yield bucket, own()


def _known(fs: pafs.FileSystem, place: str) -> set[str]:
    """The ids a bucket has answers for."""
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".parquet")]
    return {i for f in files for i in pq.read_table(f, columns=["id"], filesystem=fs, partitioning=None).column(0).to_pylist()}


def _store(fs: pafs.FileSystem, place: str, held: list[tuple[str, str]]) -> int:
    """Put answers in place whole, and forget them."""
    n = len(held)
    if n:
        name = uuid.uuid4().hex
        pq.write_table(pa.table(list(map(pa.array, zip(*held, strict=True))), schema=_SCHEMA), f"{place}/_{name}", filesystem=fs)
        fs.move(f"{place}/_{name}", f"{place}/{name}.parquet")
        held.clear()
    return n


def flaky(provider: Provider, fails: Callable[[dict, int], bool]) -> Provider:
    """A provider that raises for requests as told by the request and how often it was asked: for tests of what calls it."""
    times: dict[str, int] = {}

    def call(requests: list[dict]) -> list[dict]:
        for r in requests:
            k = json.dumps(r, sort_keys=True)
            times[k] = times.get(k, 0) + 1
            if fails(r, times[k]):
                raise TimeoutError(k)
        return provider(requests)

    return call
