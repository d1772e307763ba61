"""A training corpus from raw documents: five corpus operators, each on all its predecessor kept.

run() writes what a stage returns to the shared folder and reads it again for the next one, so a
lost executor costs the tasks of one stage.  All stages but the last return the columns of their
input, whatever their names; a null text counts as empty throughout; an empty table runs through
and stays empty.

Of rows that repeat an identifier, those with equal or nearly equal texts become one, the others
stay; a null identifier is no reason to drop a row, but an equal text is.  Ties go to the smallest
identifier, then to the least text hash.  Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import bpe, decontaminate, exact_dedup, minhash, quality
from weftwork.llm.common import fold_of, scratch_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go; rows of fold 2 stay out of its training."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), allowed=fold_of(F.col("_key"), 4) != 2)
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest identifier stays."""
    return minhash.deduplicate(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the digests of each text's ids and of what they decode to."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", leak_stage),
    ("encode", token_stage),
]

#: No SQL: a trained model, seeded registers and a vocabulary take part; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
