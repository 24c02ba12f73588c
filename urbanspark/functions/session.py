"""Session helpers shared by every operator that cuts lineage or sizes a broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder; on
    a cluster a folder of one machine would lose what other machines write.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves that at most ``max_rows`` rows are sent.

    Beyond the bound the frame is returned unhinted and the join shuffles.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df
