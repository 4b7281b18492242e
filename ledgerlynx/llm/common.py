"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Word count of the corpus operators: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def share_of(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` in the cluster's shared folder and read it back."""
    return materialise(df, name)


def finite(vec: Column) -> Column:
    """True for a vector that is not null, holds only finite numbers and is not zero."""
    good = F.forall(
        vec,
        lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)),
    )
    return F.coalesce(good & F.exists(vec, lambda x: x != 0), F.lit(False))


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each value of ``key``; rows without a key all stay.

    Only repeated keys are looked for, so rows of single keys are not sorted or grouped.
    """
    repeated = df.groupBy(key).count().where((F.col("count") > 1) & F.col(key).isNotNull())
    repeated = share_of(repeated.select(key), "repeated-keys")
    if not repeated.limit(1).count():
        return df
    single = df.join(repeated, key, "left_anti")
    more = df.join(repeated, key, "left_semi").dropDuplicates([key])
    return single.unionByName(more.select(*single.columns))
