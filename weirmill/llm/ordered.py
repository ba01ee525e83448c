"""Running sums and dense numbers over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(*cols: Column, seed: int) -> Column:
    """A seeded 64-bit hash, the same in every run and on every cluster."""
    return F.xxhash64(F.lit(seed), *cols)


def running_sum(df: DataFrame, group: list[str], order: Column, value: Column, cells: int, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same ``group`` that come before this one in ``order``.

    ``order`` is a non-null 64-bit hash. A group is cut into ``cells`` ranges of it: sums within a cell come from a window
    over that cell alone, and sums over whole cells from a table of at most ``cells`` rows a group, so that a group
    holding a third of all rows is still spread over all tasks. Choose ``cells`` in proportion to the rows.
    """
    at = df.withColumn("__o", order).withColumn("__v", value)
    at = at.withColumn("__c", F.shiftright("__o", 40).cast("long") + F.lit(1 << 23))  # the upper 24 bits, from 0 on
    at = at.withColumn("__c", F.floor(F.col("__c") * F.lit(cells) / F.lit(1 << 24)).cast("int"))
    sums = at.groupBy(*group, "__c").agg(F.sum("__v").alias("__t"))
    before = W.partitionBy(*group).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__c").alias("__d"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__b"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    inner = W.partitionBy(*group, "__c").orderBy("__o").rowsBetween(W.unboundedPreceding, -1)
    got = at.withColumn("__w", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    got = got.join(sums, [F.col("__c") == F.col("__d"), *same])
    return got.select(*df.columns, (F.col("__w") + F.col("__b")).alias(out))
