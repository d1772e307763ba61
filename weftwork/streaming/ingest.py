"""Run events as a stream: fan-out by kind, keyed de-duplication, counters (`state` has what hangs on order)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "t string, ts timestamp, run_id string, seq long, url string, field string, rate double, row string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    """JSON lines as they arrive; broken lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(folder)


def replay(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stored table as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(events: DataFrame, keys: Sequence[str], time: str | None = None, watermark: str | None = None) -> DataFrame:
    """The first event of each key: for the life of the run, or within a watermark that bounds the state."""
    if watermark:
        return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def counted(events: DataFrame, kind: str = "t") -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("events"))


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, trigger: dict[str, Any] | None = None, kind: str = "t") -> StreamingQuery:
    """Each micro-batch, split by kind; a sink gets its rows and the batch number, by which it can be idempotent."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for k, sink in sinks.items():
                sink(df.where(F.col(kind) == k), number)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def append_once(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, so a batch that runs again replaces itself."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def drained(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote; complete results replace each other."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(folder)
    last: list[int] = []

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{number}")
        last.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{last[-1]}")
