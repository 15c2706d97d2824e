"""The training-data pipeline: each stage works on all that its predecessor kept, written as Parquet in between.

Every stage takes any documents: an empty table gives an empty one; null texts count as empty, null ids and sources are
values like any other; further columns, whatever their names, come back with their values from all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.llm import mixing, near_dups, pii, quality_rules, sentencepiece
from trajlens.llm.common import read, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, unchanged; a null or empty text fails them, repeated rows stay or go together."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more): the smallest id.

    Rows that repeat exactly are one; texts without words are like none and all stay.
    """
    return near_dups.keep_one(docs, shingle=5, percent=80)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data; n_chars follows the text. A null text stays null with its n_chars."""
    df = pii.replace_entities(docs, pii.session_key(spark, pii.TRIAL_KEY))
    if "n_chars" in df.columns:
        changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        df = df.select(*[changed.alias(c) if c == "n_chars" else F.col(c) for c in df.columns])
    return df


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times; rows that repeat exactly are taken alike, and sources without words not at all."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each row; a null text has no ids and decodes to the empty text."""
    return sentencepiece.encode(docs, sentencepiece.read_model(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_dedup),
    ("pii surrogates", surrogates),
    ("mixing", mix),
    ("sentencepiece", tokens),
]

#: Surrogates, hash choices of near duplicates and segmentation can't be written in SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
