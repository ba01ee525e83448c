"""Reading the project's tables and the preparations several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.functions.hosts import host
from weirmill.functions.text import category, label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_audit with its values read as categories; unused columns are pruned."""
    u = table(spark, sf_dir, "url_audit")
    values = {c: category(F.col(c)) for c in ("source", "tier", "scenario", "split", "lang")}
    return u.withColumns({**values, "label": label(F.col("label")), "day": F.to_date("collected_at")})


def url_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``host``, read from the free-text domain. It comes from a generator of one row, so that a filter on it can't
    be pushed below and have every domain read twice."""
    u = url_values(spark, sf_dir)
    return u.select("*", F.explode(F.array(host(F.col("domain")))).alias("host"))
