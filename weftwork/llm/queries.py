"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, exact_dedup, lines, minhash, ppm, quality, substrings, token_files, toxicity, url_templates, whitening
from .common import fold_of, scratch_path, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.pairs(docs, table(spark, sf_dir, "benchmark"))


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep_text=False)


def op3_simhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), allowed=fold_of(F.col("_key"), 4) != 2)
    out = quality.classify(docs, model, keep_text=False)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return token_files.read_digests(spark, folder)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("blocked_share")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_ordinal_toxicity": op2_ordinal_toxicity,
    "op3_simhash_lines": op3_simhash_lines,
    "op4_patricia_exact_dedup": op4_patricia_exact_dedup,
    "op5_suffix_array_repeats": op5_suffix_array_repeats,
    "op6_factorisation_quality": op6_factorisation_quality,
    "op7_bpe_transducer": op7_bpe_transducer,
    "op8_hyperminhash_near_dedup": op8_hyperminhash_near_dedup,
    "op9_ppm_scores": op9_ppm_scores,
    "op10_arrow_token_files": op10_arrow_token_files,
    "op11_token_alignment": op11_token_alignment,
    "op12_url_templates": op12_url_templates,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SQL: dict[str, str] = {
    "op4_patricia_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op12_url_templates": url_templates.sql(),
}
