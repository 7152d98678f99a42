"""The corpus pipeline: from raw documents to packed training sequences.

Stages in order: quality rules, near-duplicates, decontamination, personal data,
packing.  Each stage takes all documents that the one before it kept and is
written as Parquet in the shared folder before the next begins.  All but the last
return the columns of `documents` and no others.

In every stage a null text is an empty one (which the quality rules reject), a
null doc_id is an id that comes after all others, equal rows are judged alike,
and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.decontaminate import uncontaminated
from tracelake.llm.neardup import first_of_classes
from tracelake.llm.packing import pack
from tracelake.llm.pseudonyms import pseudonymise, session_key
from tracelake.llm.quality import passing
from tracelake.llm.session import shared_dir, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return passing(docs.select(*COLUMNS))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that of the smallest id.  Rows of one id with different texts are different documents."""
    return first_of_classes(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    return uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; n_chars follows the text where it changed."""
    done = pseudonymise(docs.select(*COLUMNS), session_key(spark))
    return done.withColumn("n_chars", F.when(F.col("n_changed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL has no near-duplicates by sketches and no tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written before the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
