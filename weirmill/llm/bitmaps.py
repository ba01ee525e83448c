"""Exact distinct counts by compressed bitmaps that can be merged; the error bound is zero.

Identifiers are dictionary-encoded to whole numbers by the day they first occur on: within a part of a day they are dense
from 0 on, and every part has a range of its own, so that the numbers of one day lie together. The numbers of each day and
group are set in bitmaps cut into buckets of ``WIDTH`` bits; only buckets that hold a bit exist. Bitmaps of coarser groups
are the OR of finer ones, identifiers common to two groups their AND, and a count is a count of bits.

Defined results: a null identifier is none; a null day or group is a group of its own; repeated rows change nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirmill.llm.ordered import seeded
from weirmill.session import checked_broadcast, write_table

#: Bits of a bucket; at most the 32,768 of Spark's own bitmaps. A container takes an eighth as many bytes.
WIDTH = 2048
#: A day is numbered in one part for so many of its rows, in 4,096 at most.
PART_ROWS, MOST_PARTS = 200_000, 4096


def _number(df: DataFrame, day: str) -> Column:
    """A whole number for each day (a date, a time or a whole number), -1 for null."""
    c = F.unix_date(F.to_date(day)) if dict(df.dtypes)[day].startswith(("date", "timestamp")) else F.col(day)
    return F.coalesce(c.cast("long"), F.lit(-1))


def dictionary(df: DataFrame, keys: list[str], ident: str, day: str) -> DataFrame:
    """``(ident, cells, bucket, bit)``: the number of each identifier, in two parts, and the distinct ``keys`` it occurs under.

    One shuffle brings an identifier's keys together (distinct ones only, there are no more than days times groups) and one
    its day's part. A busy day has parts in proportion to its rows, counted before from the day alone."""
    known = df.filter(F.col(ident).isNotNull()).select(*keys, ident, _number(df, day).alias("__n"))
    sizes = df.groupBy(_number(df, day).alias("__m")).agg(F.least(F.ceil(F.count("*") / PART_ROWS), F.lit(MOST_PARTS)).cast("int").alias("__parts"))  # a row a day
    first = known.groupBy(ident).agg(F.collect_set(F.struct(*keys)).alias("cells"), F.min("__n").alias("__n"))
    first = first.join(checked_broadcast(sizes), F.col("__n") == F.col("__m"))
    first = first.withColumn("__p", F.pmod(seeded(F.col(ident), seed=5), F.col("__parts")))
    rank = F.row_number().over(W.partitionBy("__n", "__p").orderBy(ident)) - 1
    at = F.shiftleft(F.col("__n") + F.lit(1 << 26), 36) + F.shiftleft(F.col("__p").cast("long"), 24)
    return first.withColumn("__r", rank).select(ident, "cells", (at + F.floor(F.col("__r") / WIDTH)).alias("bucket"), (F.col("__r") % WIDTH).cast("long").alias("bit"))


def _trim(bits):
    return F.substring(bits, 1, WIDTH // 8)


def containers(df: DataFrame, keys: list[str], ident: str, day: str) -> DataFrame:
    """``(keys ..., bucket, bits)``: the partial results. ``day`` is one of the keys."""
    coded = dictionary(df, keys, ident, day).select(F.inline("cells"), "bucket", "bit")
    placed = coded.repartition(*keys, "bucket")  # rows of a few bytes move, not bitmaps being built
    return placed.groupBy(*keys, "bucket").agg(_trim(F.bitmap_construct_agg("bit")).alias("bits"))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """OR of partial results: those of several inputs, or of finer keys."""
    return parts.select(*keys, "bucket", "bits").repartition(*keys, "bucket").groupBy(*keys, "bucket").agg(_trim(F.bitmap_or_agg("bits")).alias("bits"))


def count(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct identifiers of each group of ``parts``, which must not hold a bucket of it twice."""
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).cast("long").alias("distinct_count"))


def common_of_all(parts: DataFrame, group: str) -> DataFrame:
    """``(a, b, common_count)`` for each two groups, the smaller first, that have identifiers in common: AND of their bitmaps,
    bucket by bucket. Groups are categories: a bucket holds a bitmap of each. ``parts`` must not hold a bucket of a group twice."""
    p = parts.filter(F.col(group).isNotNull())
    a, b = (p.select("bucket", F.col(group).alias(n), F.col("bits").alias(f"bits_{n}")) for n in "ab")
    both = a.join(b, "bucket").filter("a < b").select("a", "b", "bucket", F.explode(F.array("bits_a", "bits_b")).alias("bits"))
    shared = both.groupBy("a", "b", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return shared.groupBy("a", "b").agg(F.sum(F.bitmap_count(_trim(F.col("bits")))).cast("long").alias("common_count")).filter("common_count > 0")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: identifiers in both of two merged results, by AND of their bitmaps."""
    both = a.select("bucket", "bits").unionAll(b.select("bucket", "bits")).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter("n = 2").agg(F.coalesce(F.sum(F.bitmap_count(_trim(F.col("bits")))), F.lit(0)).cast("long").alias("common_count"))


def distinct_counts(df: DataFrame, keys: list[str], ident: str, day: str) -> DataFrame:
    """``(grouping, keys ..., distinct_count)`` for every combination of ``keys``, the empty one included.

    Each combination is merged from the written result of the next finer one, the partial results being built once.
    Keys outside a combination are null; ``grouping`` names those in it.
    """
    level = {tuple(keys): write_table(containers(df, keys, ident, day), "bitmaps")}
    types = dict(df.dtypes)
    parts = []
    for size in range(len(keys), -1, -1):
        for some in combinations(keys, size):
            if some not in level:
                finer = next(k for k in level if len(k) == size + 1 and set(some) <= set(k))
                merged = merge(level[finer], list(some))
                level[some] = write_table(merged, "bitmaps") if size else merged
            shown = [F.col(k) if k in some else F.lit(None).cast(types[k]).alias(k) for k in keys]
            parts.append(count(level[some], list(some)).select(F.lit("+".join(some)).alias("grouping"), *shown, "distinct_count"))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got
