"""Running sums in the order of a number without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirmill.operators.skew import heavy_keys
from weirmill.session import write_table

RANGES = 64


def ranges(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``__p``: the number of the range, cut at approximate quantiles of ``order``, a row of a heavy key falls in, nulls and
    the rows of all other keys in the first. Equal values fall in one range."""
    heavy = heavy_keys(df, [key])
    hot = [r[0] for r in heavy.collect()]  # at most 2,000
    if not hot:
        return df.withColumn("__p", F.lit(0))
    at = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith(("timestamp", "date")) else F.col(order)
    cuts = df.agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 1000).alias("c")).first()["c"] or []
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < at)), F.lit(0)) if cuts else F.lit(0)
    marks = heavy.select(F.col(key).alias("__h"), F.lit(True).alias("__hot"))
    return df.join(F.broadcast(marks), F.col(key) == F.col("__h"), "left").select(*df.columns, F.when(F.col("__hot"), part).otherwise(0).alias("__p"))


def carried(df: DataFrame, key: list[str], whole: Column, over: str = "before") -> DataFrame:
    """Of rows with a range ``__p``: add ``__carry``, the greatest ``whole`` of the key's ranges before (or the least of those
    ``after``) the row's own. What is carried comes from a table with at most ``RANGES`` rows a key, so that the rows of a key
    that holds a tenth of all are spread over its ranges."""
    f, frame = (F.max, (W.unboundedPreceding, -1)) if over == "before" else (F.min, (1, W.unboundedFollowing))
    per = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__p").alias("__q")).agg(f(whole).alias("__w"))
    line = W.partitionBy(*(f"__k{i}" for i in range(len(key)))).orderBy("__q").rowsBetween(*frame)
    per = per.withColumn("__carry", f("__w").over(line)).drop("__w")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    return df.join(per, [F.col("__p") == F.col("__q"), *same], "left").select(*df.columns, "__carry")


def running(df: DataFrame, order: Column, sums: dict[str, Column], descending: bool = False, ties: Column | None = None) -> DataFrame:
    """Add, under each name, the sum of the column over this row and all before it in ``order``; equal orders follow
    ``ties``. Rows are cut into ranges at approximate quantiles; a window runs within each range, and the sums of the
    ranges before come from a table of at most ``RANGES`` rows."""
    d = write_table(df.withColumn("__o", order), "ordered")
    cuts = d.agg(F.percentile_approx("__o", [k / RANGES for k in range(1, RANGES)], 1000).alias("c")).first()["c"] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col("__o") > F.lit(c)).cast("int")
    d = d.withColumn("__p", -part if descending else part)
    keys = [F.desc("__o") if descending else F.asc("__o"), *([ties] if ties is not None else [])]
    inner = W.partitionBy("__p").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    whole = d.groupBy("__p").agg(*(F.sum(c).alias(f"__s{k}") for k, c in enumerate(sums.values())))
    whole = whole.select(F.col("__p").alias("__q"), *(F.coalesce(F.sum(f"__s{k}").over(before), F.lit(0)).alias(f"__b{k}") for k in range(len(sums))))
    got = d.select(*d.columns, *(F.sum(c).over(inner).alias(f"__i{k}") for k, c in enumerate(sums.values())))
    got = got.join(F.broadcast(whole), F.col("__p") == F.col("__q"))  # at most RANGES rows
    return got.select(*df.columns, *((F.col(f"__i{k}") + F.col(f"__b{k}")).alias(n) for k, n in enumerate(sums)))
