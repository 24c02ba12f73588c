"""Ranks and prefix sums over whole tables in two steps, so that no task holds a hot group.

A range sort deals the rows; each row's place is its place in its partition and the total
of the partitions before it. What is gathered per partition is one row of totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions.session import checkpointed

#: Bits of a monotonic id that count the rows of a partition.
ROW_BITS = 33


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted and written once, with ``r``: its partition and its place there, ascending in the order."""
    return checkpointed(df.orderBy(*order).withColumn("r", F.monotonically_increasing_id()))


def _skips(sorted_df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(part, skip_*) of each partition: one row a partition, so it may be broadcast."""
    totals = sorted_df.groupBy(F.shiftright("r", ROW_BITS).alias("part")).agg(*(c.alias(n) for n, c in sums.items()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(totals.select("part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"skip_{n}") for n in sums)))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank``, dense from 0 in the order, instead of ``r``."""
    rows = ordered(df, *order)
    place = F.col("r").bitwiseAND((1 << ROW_BITS) - 1)
    return rows.withColumn("part", F.shiftright("r", ROW_BITS)).join(_skips(rows, {"rank": F.count("*")}), "part").withColumn("rank", F.col("skip_rank") + place).drop("part", "skip_rank", "r")


def running(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows of ``ordered`` with the sum of each value over all rows before each, under its name."""
    inner = W.partitionBy("part").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    parted = rows.withColumn("part", F.shiftright("r", ROW_BITS)).withColumns({f"inside_{n}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in values.items()})
    joined = parted.join(_skips(rows, {n: F.sum(c) for n, c in values.items()}), "part")
    return joined.withColumns({n: F.col(f"skip_{n}") + F.col(f"inside_{n}") for n in values}).drop("part", *(f"{k}_{n}" for k in ("skip", "inside") for n in values))
