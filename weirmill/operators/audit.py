"""Counting operators of a table audit: frequencies, distinct values, dates, quality cubes, digests.

Nulls are values of their own in frequencies (shown as null) and count once among distinct values; an empty string is
not null. Empty tables give empty frequencies and zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """``(dim, value, n)``: the frequency of every value of each column, all in one scan (grouping sets)."""
    cells = df.select(*(F.col(d).cast("string").alias(d) for d in dims)).groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"), *(F.grouping(d).alias(f"__{d}") for d in dims))
    dim = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims))
    value = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.col(d)) for d in dims))
    return cells.select(dim.alias("dim"), value.alias("value"), "n")


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def filtered_counts(df: DataFrame, condition: Column, dim: str) -> DataFrame:
    return df.filter(condition).groupBy(dim).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """One row: rows and exact distinct values of ``col``, null being one value and the empty string another."""
    return df.agg(F.count("*").alias("rows"), (F.count_distinct(col) + F.max(F.col(col).isNull().cast("int")).cast("long")).alias("distinct_values"))


#: The key of null in a map of counts, which no value has; JSON has no other way to tell it from the empty string.
NULL_KEY = "\x00null"


def report(df: DataFrame, dims: list[str], distinct: str, cross: tuple[str, str], where: Column, filtered: str) -> DataFrame:
    """One row with the whole audit as JSON: rows, a map of counts for each dimension, distinct values, two-key counts
    (``a|b``) and filtered counts. The maps hold one entry a category value, not a row; null stands under ``NULL_KEY``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias(c)
    counts = value_counts(df, dims).withColumn("value", text("value")).groupBy("dim").agg(as_map("m")).agg(F.map_from_entries(F.collect_list(F.struct("dim", "m"))).alias("counts"))
    pairs = df.select(F.concat(text(cross[0]), F.lit("|"), text(cross[1])).alias("value")).groupBy("value").agg(F.count("*").alias("n")).agg(as_map("cross"))
    some = df.filter(where).select(text(filtered).alias("value")).groupBy("value").agg(F.count("*").alias("n")).agg(as_map("filtered"))
    one = distinct_values(df, distinct)
    tag = lambda d: d.withColumn("k", F.lit(1))
    joined = tag(one).join(tag(counts), "k").join(tag(pairs), "k").join(tag(some), "k").drop("k")  # one row each
    return joined.select(F.to_json(F.struct("*")).alias("report"))


def date_audit(df: DataFrame, col: str) -> DataFrame:
    """``(month, rows, missing, invalid, first, last)`` of a date kept as text; rows without a valid date have no month.
    Only this column is read."""
    raw = F.trim(F.col(col).cast("string"))
    d = df.select(F.nullif(raw, F.lit("")).alias("raw")).withColumn("d", F.when(F.col("raw").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring("raw", 1, 10), "yyyy-MM-dd")))
    return d.groupBy(F.trunc("d", "month").alias("month")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("raw").isNull()).alias("missing"),
        F.count_if(F.col("raw").isNotNull() & F.col("d").isNull()).alias("invalid"), F.min("d").alias("first"), F.max("d").alias("last"),
    )


def quality_cube(df: DataFrame, dims: list[str], **tests: Column) -> DataFrame:
    """Rows and rows passing each test, for every combination of ``dims``; ``level`` names those in it."""
    keyed = df.select(*(F.col(d).cast("string").alias(d) for d in dims), *(t.alias(n) for n, t in tests.items()))
    got = keyed.cube(*dims).agg(F.count("*").alias("rows"), *(F.count_if(F.col(n)).alias(n) for n in tests), *(F.grouping(d).alias(f"__{d}") for d in dims))
    level = F.concat_ws("+", *(F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims))
    return got.select(level.alias("level"), *dims, "rows", *tests)


def before_after(df: DataFrame, dims: list[str], kept: Column) -> DataFrame:
    """``(dim, value, before, after)``: rows of every value of each dimension, all and those kept, in one scan. A null test
    keeps nothing."""
    keyed = df.select(*(F.col(d).cast("string").alias(d) for d in dims), F.coalesce(kept, F.lit(False)).alias("__kept"))
    cells = keyed.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("before"), F.count_if("__kept").alias("after"), *(F.grouping(d).alias(f"__{d}") for d in dims))
    dim = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims))
    value = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.col(d)) for d in dims))
    return cells.select(dim.alias("dim"), value.alias("value"), "before", "after")


def strata_with_problems(df: DataFrame, strata: list[str], problem: Column, enlarge_above: float, drop_above: float) -> DataFrame:
    """``(strata ..., rows, problems, action)``: a stratum is dropped or enlarged where the share of rows with a problem is
    above the given shares, else kept. A null test is no problem."""
    per = df.groupBy(*strata).agg(F.count("*").alias("rows"), F.count_if(problem).alias("problems"))
    share = F.col("problems") / F.col("rows")
    return per.withColumn("action", F.when(share > drop_above, "drop").when(share > enlarge_above, "enlarge").otherwise("keep"))


def enough(phishing: Column, domains: Column, least_phishing: int = 150, least_domains: int = 50) -> Column:
    """Whether a branch is large enough for more than description."""
    return (phishing >= least_phishing) & (domains >= least_domains)


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``: a bounded top-k, no sort of the table."""
    return df.orderBy(*keys).limit(n)


def manifest(inputs: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``(name, rows, sha256)``: a digest of each input of a run over the given columns."""
    got = None
    for name, (df, keys) in inputs.items():
        one = digest(df, keys).select(F.lit(name).alias("name"), "rows", "sha256")
        got = one if got is None else got.unionByName(one)
    return got


def digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows and an order-free digest of the content: the sum and the exclusive or of 60-bit parts of each row's
    SHA-256 over its columns in the order of ``keys``, then the SHA-256 of these. Needs no sort of the table."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)").cast("long")
    got = df.select(part.alias("p")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("p").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("s"), F.coalesce(F.bit_xor("p"), F.lit(0)).alias("x"))
    return got.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("sha256"))


def accepted(df: DataFrame, reject: dict[str, Column]) -> DataFrame:
    """Add ``reason``: the name of the first test that rejects the row, null for accepted rows. A null test rejects nothing."""
    reason = F.coalesce(*(F.when(c, F.lit(n)) for n, c in reject.items()))
    return df.withColumn("reason", reason)
