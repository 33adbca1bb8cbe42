"""A corpus pipeline of five operators: from raw documents to cleaned ones with rates for training.

``run`` applies ``STAGES`` in order.  Every stage takes (spark, docs, sf_dir) and works on
all rows it is given; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language_id, mixing, near_dup, secret_scan
from palimpsest.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; learned from the labelled rows of ``docs``."""
    return language_id.identify(docs, language_id.fitted(docs)).where(~F.col("rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dup.one_of_each(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text and counts its characters anew; no document goes."""
    found = secret_scan.scan(docs, secret_scan.trained(docs))
    some = F.size("all_spans") > 0
    masked = found.withColumn("text", F.when(some, secret_scan.redacted(F.col("text"), F.col("all_spans"))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the rates and copies that bring the sources to equal token totals, by label and by posterior.

    A row says how often its text is to be read (``copies``, 0 for not at all); the rows stay.
    """
    return mixing.mix(docs, docs, domain_col="source", keep=True, both=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: Classifiers and similarity joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
