"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the digest contracts, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one of the tables; also makes this package importable in Python workers."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package by the path the driver has it under."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or one of our own where it is unset and there is one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends: what is written needs them no more."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _SCRATCH:
        with contextlib.suppress(Exception):  # the session may be gone already
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop, wherever it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_number(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def text_of(column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that a table does not have yet, whatever the case of its letters."""
    have = {c.lower() for c in taken}
    while f"_{name}" in have:
        name = f"_{name}"
    return f"_{name}"


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named by their places: functions on batches cannot be asked for names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def quoted(name: str) -> str:
    """A column's name as it must be asked for, dots and all."""
    return "`" + name.replace("`", "``") + "`"
