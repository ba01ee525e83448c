"""Other readers and writers: JSON of one document, JSON lines, Parquet by split, append-only stores, run folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirmill.operators.contract import assert_blind
from weirmill.session import put_text

FORBIDDEN = {"label", "target", "tier", "split", "source_label", "group_id", "is_https", "collected_at", "sha256"}


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file, nested as it is; with a schema nothing is inferred."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def variants(spark: SparkSession, path: str) -> DataFrame:
    """``(path, doc)``: each file parsed as a variant, for documents without a fixed schema."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))


def corpus(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Parquet files ``<split>-*.parquet`` with ``source_split``."""
    parts = [spark.read.parquet(f"{root}/{s}-*.parquet").withColumn("source_split", F.lit(s)) for s in splits]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p, allowMissingColumns=True)
    return got


def append_passes(df: DataFrame, path: str) -> None:
    """Append annotation passes; earlier ones are never overwritten."""
    df.write.mode("append").parquet(path)


def final_passes(passes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last pass of each key; all stay in the store."""
    w = W.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return passes.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def blind_view(df: DataFrame, allow: list[str]) -> DataFrame:
    """Only the allowed columns, none of which may tell the class, source, time or group."""
    assert_blind(allow, FORBIDDEN)
    return df.select(*allow)


def write_run(folder: str, predictions: DataFrame, notes: str = "", **parts: dict) -> None:
    """A new run folder, all of it where Spark writes: predictions as JSON lines by the executors, small parts as JSON and the
    notes by the driver. A folder that has a part already is refused."""
    spark = predictions.sparkSession
    predictions.write.json(f"{folder}/predictions.jsonl")
    for name, part in parts.items():
        put_text(spark, f"{folder}/{name}.json", json.dumps(part, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    put_text(spark, f"{folder}/notes.md", notes)


#: Fields of a manifest of sources and of a project's settings that operators read; others are ignored.
SOURCES = "sources array<struct<source_id string, version string, revision string, url string, sha256 string, license string>>"


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a source of a manifest; missing fields are null."""
    return json_document(spark, path, SOURCES).select(F.inline("sources"))


def settings(spark: SparkSession, path: str, schema: str) -> dict:
    """The settings of one JSON document under a schema, nested, as a dictionary; the driver gets this one row."""
    return json_document(spark, path, schema).first().asDict(recursive=True)


def unnested(doc: DataFrame, array: str, *fields: str) -> DataFrame:
    """The elements of a nested array as rows ``(position, fields ...)``; null and empty arrays give none."""
    e = doc.select(F.posexplode(array).alias("position", "e"))
    return e.select("position", *(F.col(f"e.{f}").alias(f.replace(".", "_")) for f in fields))
