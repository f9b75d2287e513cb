"""From raw documents to token ids: five stages, each one operator of ``evalkiln.llm`` over all that its predecessor kept.

Each stage begins with ``tidy``: what the driver holds of the plans, shuffles and broadcasts before it is let go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalkiln.llm import bpe, decontaminate, language, secrets, similar
from evalkiln.llm.common import tidy, written

#: A prediction with a smaller share is a rejection.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text) and those whose language is in doubt go.

    Repeated rows go or stay together; columns may have any name; an empty table stays empty.
    """
    tidy(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = language.identify(rows, language.learned(docs), keep=["row"])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the smallest id, of rows with one id the first.

    Near duplicates share 0.8 of their five-word shingles. A document without an id stays if its group has none with one.
    Documents without a word are one group; repeated rows are one document; an empty table stays empty.
    """
    tidy(spark)
    return similar.first_of_groups(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go.

    Null and empty texts stay; repeated rows go or stay together; columns may have any name.
    """
    tidy(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by marks, and n_chars follows the text.

    Null texts stay null and keep their n_chars; empty texts and repeated rows stay as they are; columns may have any name.
    """
    tidy(spark)
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the text decoded from them.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and rows without an id stay.
    """
    tidy(spark)
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]
#: SQL expresses none of these models and hashes; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
