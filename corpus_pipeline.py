"""From raw documents to packed sequences: stages of the training-data pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlynx.llm import mixing, near_text, packing, quality, suffixes
from ledgerlynx.llm.common import share_of, table

#: Bytes of a repeat: fewer than 51 words of four letters and their blanks have.
REPEAT = 200
#: Half the words a packing worker remembers: workers still hold what earlier stages left.
REMEMBERED = 50_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    params = quality.QualityParams()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit_quality(docs, labels, params)
    kept = quality.score_quality(docs.select(*COLUMNS), model, params.accept)
    return kept.where("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of equal or near-equal texts: the one with the least id.

    Different texts under one id both stay; so do all documents without words or an id.
    """
    return near_text.without_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of ``REPEAT`` bytes that occur anywhere else."""
    kept = suffixes.remove_repeats(docs.select(*COLUMNS), suffixes.RepeatParams(length=REPEAT, parts=4))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources ask for."""
    mixed = mixing.mixed_documents(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences."""
    return packing.pack_documents(docs, packing.PackParams(words=REMEMBERED))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL expresses the trained and hashed stages; a test holds them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = share_of(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
