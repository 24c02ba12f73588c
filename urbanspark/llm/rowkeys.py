"""Keys that tell rows apart where ids are null or repeated, for stages that judge rows and drop some.

A key is (doc_id, hash of the text): it orders like the id, is never null and is the same
whenever the row is read, so decisions need no checkpoint of the texts. Rows that agree
in id and text have one key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions.session import broadcast_if_small, checkpointed

#: Names that the stages use; ``apart`` sees to it that no column of the documents has one.
KEY, GONE = "__row_key", "__gone_key"
#: Keys up to this many are broadcast (about 40 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of each row."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull()).alias("text")))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of keyed ``docs``, where doc_id is the key."""
    return docs.select(F.col(KEY).alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Keyed ``docs`` without the rows whose keys are the first column of ``dropped``."""
    gone = checkpointed(dropped.select(F.col(dropped.columns[0]).alias(GONE)).distinct())
    return docs.join(broadcast_if_small(gone, BROADCAST_KEYS), F.col(KEY).eqNullSafe(F.col(GONE)), "left_anti")


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that works on documents whose columns have any names: those that begin like its own are set aside under others."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (n for n in (f"kept_{i}" for i in range(2 * len(taken) + 1)) if n not in taken)
        names = {c: next(free) for c in docs.columns if c.startswith("__")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir, **options)
        return out.withColumnsRenamed({new: old for old, new in names.items()})

    return run
