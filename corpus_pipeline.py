"""A corpus pipeline of five stages over `documents`: language ID, near duplicates, decontamination, PII, mixture.

Each stage works on all rows that the one before it kept. A stage's result is written as Parquet below the shared
scratch folder and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, langid, mixing, ngram_join, pii
from tallyforge.llm.queries import WEIGHTS, mixing_levels
from tallyforge.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no language go; those in several stay, however even their shares."""
    return langid.with_language(docs, langid.learn(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five words a shingle, similarity 0.8.

    A document is told by its id and its text, so different texts under one id are different documents. Of rows that
    repeat both one stays, and of a group the smallest id; NULL ids come last. Documents without words all stay, one of
    those that repeat id and text.
    """
    taken = {c.lower() for c in docs.columns}
    name, *marks = [n for n in ("row_key", *(f"mark_{i}" for i in range(len(taken) + 2))) if n not in taken][:3]
    # The marks tell id and text by 128 bits; rows that stay meet their texts by the marks, so texts are shuffled once. They are
    # about as many as the documents, so none of them goes through the driver.
    marked = docs.withColumns({m: F.xxhash64(F.lit(i), "doc_id", "text") for i, m in enumerate(marks)})
    keyed = marked.select("text", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *[F.col(m).alias(f"h{i}") for i, m in enumerate(marks)]).alias(name))
    least = ngram_join.similar_groups(keyed, 5, 80, name).where(F.col(name) == F.col("component_id"))
    kept = written(least.select(*[F.col(name)[f"h{i}"].alias(m) for i, m in enumerate(marks)]).distinct(), "kept")
    return marked.join(kept.hint("merge"), marks, "left_semi").dropDuplicates(marks).drop(*marks)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to marks, and n_chars is that of the new text."""
    return pii.redact(docs, pii.learn(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to target weights; a row for each document and epoch."""
    return mixing.mixed(docs, mixing_levels(), WEIGHTS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Mixtures by EM and boosted trees are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
