"""Connected components of links between identifiers, as DataFrame joins.

Alternating large-star and small-star steps: each round connects every node's larger neighbours
to the smallest one around, then its smaller neighbours.  Rounds grow with the logarithm of the
longest path.  A star of any size is one aggregate row per node, never a list in one task.
Lineage is cut by writing the links of each round to the shared folder.

Defined results: links with a null end and links of a node with itself count for nothing, repeated
links once.  Nodes may be numbers or byte strings.  An empty table gives an empty result; columns
besides the two named play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def led(batches: Iterable[pa.RecordBatch], leaders: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id) of one task, sorted: (bucket, leader, id) of the buckets of several ids.

    The leader is the least id; its own row is left out unless `leaders` is set.  Repeated rows
    count once.  Nothing is held but the last row, however large a bucket is.
    """
    bucket, leader, before = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        k, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        head = np.concatenate([[bucket is None or k[0] != bucket], k[1:] != k[:-1]])
        run = np.maximum.accumulate(np.where(head, np.arange(len(k)), -1))
        lead = np.where(run < 0, leader, ids[np.maximum(run, 0)])
        keep = ~head & (ids != np.concatenate([[before], ids[:-1]]))
        if leaders:
            # a leader goes before its first follower, which can be in the next batch
            first = keep & (np.concatenate([[before], ids[:-1]]) == lead)
            twice = np.repeat(np.arange(len(k)), keep.astype(np.int64) + first)
            own = np.concatenate([[True], twice[1:] != twice[:-1]]) & first[twice] if len(twice) else np.zeros(0, bool)
            out = k[twice], lead[twice], np.where(own, lead[twice], ids[twice])
        else:
            out = k[keep], lead[keep], ids[keep]
        bucket, leader, before = k[-1], lead[-1], ids[-1]
        yield pa.record_batch([pa.array(c) for c in out], names=["bucket", "leader", "id"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b): for every node, its neighbours on one side point at the least around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least identifier reachable; nodes without links are absent."""
    spark = links.sparkSession
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    paths = [common.scratch_path(spark, "links")]
    with common.tidy(spark):
        now.write.parquet(paths[0])
    schema = now.schema

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(spark.read.schema(schema).parquet(paths[0]))
    for _ in range(most_rounds):
        now = spark.read.schema(schema).parquet(paths[-1])
        if len(paths) > 2:
            common.drop_path(spark, paths[-3])
        step = _star(_star(now, True), False)
        paths.append(common.scratch_path(spark, "links"))
        with common.tidy(spark):
            step.write.parquet(paths[-1])
        after = spark.read.schema(schema).parquet(paths[-1])
        if (now_mark := mark(after)) == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now_mark
    raise RuntimeError("components did not settle")
