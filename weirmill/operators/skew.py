"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

Defined results: rows without a key are left out; rows without a record id count as rows, not as records; repeated rows
of a record count once among records. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this part of all rows; fewer keys than the inverse can.
HEAVY_PART = 1 / 1000
SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], part: float = HEAVY_PART) -> DataFrame:
    """The keys over ``part`` of all rows, at most ``2 / part``, by one scan and without a shuffle of the others: a sketch
    of frequent items counts all rows and tracks enough of them to miss no heavy key; it may name one that is lighter."""
    most = int(2 / part)
    name = F.to_json(F.struct(*keys))
    tracked = min(1 << 20, 1 << (4 * most - 1).bit_length())
    got = df.select(name.alias("k")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k, {most}, {tracked})").alias("top")).first()
    rows = [(r["item"],) for r in got["top"] or [] if r["item"] is not None and r["count"] > got["n"] * part]
    schema = df.select(*keys).schema
    found = df.sparkSession.createDataFrame(rows, "k string")
    return found.select(F.from_json("k", schema).alias("k")).select("k.*")


def heavy_of(counts: DataFrame, keys: list[str], n: str, part: float = HEAVY_PART) -> DataFrame:
    """The keys over ``part`` of the whole of counts already made, at most ``1 / part``."""
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    return counts.sparkSession.createDataFrame(counts.filter(F.col(n) > total * part).select(*keys).collect(), counts.select(*keys).schema)


def salted(df: DataFrame, keys: list[str], salt_by: Column, heavy: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add ``salt``: 0 for light keys, for heavy ones a number below ``salts`` from a hash of ``salt_by``. It is random
    over the rows but not over attempts: a task run again after a loss gives its rows the same salts."""
    hot = heavy.select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)), F.lit(True).alias("__hot"))
    same = [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys)]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return df.join(F.broadcast(hot), same, "left").select(*df.columns, salt.alias("salt"))  # at most 2 / HEAVY_PART rows


def two_stage(df: DataFrame, keys: list[str], record: str, stage1: list[Column], stage2: list[Column], part: float = HEAVY_PART, salts: int = SALTS) -> DataFrame:
    """Partial results per key and salt, merged by key.

    Rows move once, to the task of their key and salt: the salt alone spreads a heavy key. There they are brought together
    per record (a record falls under one salt of a key, so what is distinct by record is exact) and per key and salt, with
    no further shuffle; only the partial results move again. ``stage1`` are aggregates over a record's rows, ``stage2`` over
    the records; they must combine (sum, min, max ...) and see the names of stage 1.
    """
    heavy = heavy_keys(df, keys, part)
    by = salted(df, keys, F.coalesce(F.col(record).cast("string"), F.lit("")), heavy, salts).repartition(*keys, "salt")
    partial = by.groupBy(*keys, "salt", record).agg(*stage1).groupBy(*keys, "salt").agg(*stage2)
    merged = [merge_of(partial, c) for c in partial.columns if c not in (*keys, "salt")]
    return partial.groupBy(*keys).agg(*merged)


def merge_of(partial: DataFrame, column: str) -> Column:
    """How partial results of one column combine: names starting with ``min_`` or ``max_`` by these, others by sum."""
    f = {"min_": F.min, "max_": F.max}.get(column[:4], F.sum)
    return f(column).alias(column)
