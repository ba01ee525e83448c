"""The audit archive: a ZIP with a CSV table, a manifest and other members. Everything is text, nothing is inferred."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators import audit
from weirmill.session import put_text, write_table

DIMS = ["label", "source", "tier", "scenario", "split", "lang"]


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, member, size, sha256)`` of every member of the archives at ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(at, i.filename, i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist()], columns=["archive", "member", "size", "sha256"])

    return _archives(spark, path).select("path", "content").mapInPandas(run, "archive string, member string, size long, sha256 string")


def csv_rows(spark: SparkSession, path: str, member: str, columns: list[str], batch: int = 20_000) -> DataFrame:
    """Rows of a CSV member as strings: byte-order mark dropped, quoted commas and line breaks kept, an empty field an
    empty string, a missing trailing field null; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    held = []
                    for row in csv.DictReader(io.TextIOWrapper(f, encoding="utf-8-sig", newline="")):
                        held.append([row.get(c) for c in columns])
                        if len(held) == batch:
                            yield pd.DataFrame(held, columns=columns, dtype=object)
                            held = []
                    yield pd.DataFrame(held, columns=columns, dtype=object)

    return _archives(spark, path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def audit_archive(spark: SparkSession, path: str, version: str, member: str = "data/dataset_url.csv", manifest: str = "MANIFEST.txt") -> dict:
    """The audit report of one archive. The member is unpacked once into a written table; the driver gets category counts."""
    rows = write_table(csv_rows(spark, path, member, [*DIMS, "domain"]), "archive")
    counts: dict[str, dict] = {d: {} for d in DIMS}
    for r in audit.value_counts(rows, DIMS).collect():  # one row a category value
        counts[r["dim"]][r["value"]] = r["n"]
    one = audit.distinct_values(rows, "domain").first()
    inside = write_table(members(spark, path), "members")
    held = inside.agg(F.max(F.when(F.col("member") == member, F.col("sha256"))).alias("h"), F.count_if(F.col("member").endswith(".html")).alias("html")).first()
    whole = _archives(spark, path).select(F.sha2("content", 256).alias("h"), "content")

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": [zipfile.ZipFile(io.BytesIO(c)).read(manifest).decode() for c in b["content"]]})

    listed = whole.select("content").mapInPandas(text, "t string").filter(F.contains("t", F.lit(held["h"]))).count() > 0
    pair = audit.cross_counts(rows, "source", "label").collect()
    return {
        "version": version,
        "archive_sha256": whole.select("h").first()["h"],
        "csv_sha256": held["h"],
        "rows": one["rows"],
        "counts": counts,
        "unique_domain_field": one["distinct_values"],
        "source_label": {f"{r['source']}|{r['label']}": r["n"] for r in pair},
        "phishing_scenario": {r["scenario"]: r["n"] for r in audit.filtered_counts(rows, F.col("label") == "phishing", "scenario").collect()},
        "csv_hash_in_manifest": listed,
        "archive_html_files": held["html"],
    }


def write_report(spark: SparkSession, report: dict, path: str) -> str:
    """The report as indented JSON with its characters kept, put where no file is; gives the text."""
    text = json.dumps(report, ensure_ascii=False, indent=2)
    put_text(spark, path, text)
    return text
