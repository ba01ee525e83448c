"""How often every distinct value or term occurs and in how many records, kept up to date by signed deltas.

A store holds a log of what was delivered and withdrawn for each record, partitioned by a hash of the record, and counts
of every value, partitioned by a hash of the value. A batch of added, changed or deleted records is aggregated alone: with
the log of the partitions its records fall in it gives signed changes of occurrences and records of each value, which are
merged into the partitions of the counts they fall in. So a batch costs what it touches, not what came before it. New
files are made current by a manifest of the next number, which is written beside and renamed; a batch that fails leaves
the manifests as they were and can be applied again. A partition of the log in more than ``PARTS`` files is rewritten net.

A field is one value a row or, as an array, several: the words of a text.

Defined results: a null value is no value, a null array none; a row without a record id adds to occurrences, not to
records; a record delivered several times, with the same or other values, counts once under each value it holds.
"""

from __future__ import annotations

import json
import uuid
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from weirmill.session import names_in, put_text, read_text

#: The pseudo-field under which all rows and records are counted.
ALL = "*"
#: Versions of a partition of the log that are read together before it is rewritten as one.
PARTS = 8
#: Rows of a partition that callers size their stores for.
BUCKET_ROWS = 500_000
COUNTS = "field string, value string, occurrences long, records long, bucket int"


def buckets_for(rows: int) -> int:
    """Partitions in proportion to the rows."""
    return max(1, -(-rows // BUCKET_ROWS))


class TermCounts:
    """Persistent partitioned counts of the values of ``fields`` under ``path``, a folder all executors share. The numbers
    of partitions are those the store was made with."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], log_buckets: int = 16, count_buckets: int = 16):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), list(fields)
        there = [n for n in names_in(spark, f"{self.path}/manifests") if n.endswith(".json")]
        fresh = {"version": 0, "log_buckets": log_buckets, "count_buckets": count_buckets, "schema": None, "log": {}, "counts": {}}
        self.manifest = json.loads(read_text(spark, f"{self.path}/manifests/{there[-1]}")) if there else fresh

    def _read(self, kind: str, schema: StructType | str, versions: dict[str, list[int]]) -> DataFrame | None:
        """The given partitions of each version; the others are pruned."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{v}").filter(F.col("bucket").isin(bs)) for v, bs in sorted(versions.items())]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def log(self, buckets: list[int] | None = None) -> DataFrame | None:
        """``(record, fields ..., n, bucket)``: signed deliveries of the records of some partitions, or of all."""
        by: dict[str, list[int]] = {}
        for b, versions in self.manifest["log"].items():
            if buckets is None or int(b) in buckets:
                for v in versions:
                    by.setdefault(v, []).append(int(b))
        if not by:
            return None
        return self._read("log", self._log_schema(), by)

    def _write(self, df: DataFrame, kind: str, version: str, buckets: int) -> list[int]:
        """Write a version, a task and file a partition; gives the partitions there are."""
        at = f"{self.path}/{kind}/{version}"
        df.repartition(buckets, "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(at)
        return [int(n.split("=")[1]) for n in names_in(self.spark, at) if n.startswith("bucket=")]

    def apply(self, batch: DataFrame) -> None:
        """Apply ``batch(record, fields ..., op)``: op ``add`` delivers a row of a record, ``replace`` puts its rows in
        place of all earlier ones of the record, ``delete`` withdraws all earlier ones (its values are not read)."""
        m, cols = self.manifest, ["record", *self.fields]
        number, log_buckets, count_buckets = m["version"] + 1, m["log_buckets"], m["count_buckets"]
        version = f"{number}-{uuid.uuid4().hex}"  # no other writer's folder, nor one of an attempt that failed
        own = F.pmod(F.xxhash64("record"), F.lit(log_buckets))
        staged = batch.select(*cols, F.coalesce("op", F.lit("add")).alias("op"), F.when(F.col("record").isNull(), F.pmod(F.xxhash64(*self.fields), F.lit(log_buckets))).otherwise(own).cast("int").alias("bucket"))
        schema = batch.select(*cols).schema.jsonValue()
        wiping = F.col("op").isin("replace", "delete") & F.col("record").isNotNull()
        change = staged.filter("op <> 'delete'").select(*cols, "bucket", F.lit(1).alias("n"))
        if m["log"]:
            met = staged.filter("record is not null").groupBy("bucket").agg(F.max(wiping).alias("w")).collect()  # at most one a partition
            wiped = self.log([r["bucket"] for r in met if r["w"]])
            if wiped is not None:
                gone = staged.filter(wiping).select("record").distinct().hint("merge")  # ids of a batch have no bound: never broadcast
                change = change.unionByName(wiped.join(gone, "record", "left_semi").select(*cols, "bucket", (-F.col("n")).alias("n")))
            old = self.log([r["bucket"] for r in met])
        else:
            old = None
        change = change.groupBy(*cols, "bucket").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")
        written = self._write(change, "log", version, log_buckets)
        log = {b: list(v) for b, v in m["log"].items()}
        for b in written:
            log.setdefault(str(b), []).append(version)
        self.manifest = {**m, "schema": m["schema"] or schema, "log": log}
        change = self._read("log", self._log_schema(), {version: written})
        counts = dict(m["counts"])
        if change is not None:
            deltas = self._deltas(change, old).withColumn("bucket", F.pmod(F.xxhash64("field", "value"), F.lit(count_buckets)).cast("int"))
            if counts:
                touched = [r["bucket"] for r in deltas.select("bucket").distinct().collect()] if count_buckets > 1 else [0]  # at most one a partition
                held = self._read("counts", COUNTS, self._by_version(counts, touched))
                deltas = deltas if held is None else deltas.unionByName(held)
            else:
                touched = list(range(count_buckets))
            merged = deltas.groupBy("bucket", "field", "value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 or records <> 0")
            there = self._write(merged, "counts", version, count_buckets)
            for b in touched:
                counts.pop(str(b), None)
            counts |= {str(b): version for b in there}
        long = [int(b) for b, v in log.items() if len(v) > PARTS]
        if long:  # withdrawn deliveries go, the rest becomes one file a partition
            net = self.log(long).groupBy(*cols, "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")
            left = self._write(net, "log", f"{version}-net", log_buckets)
            log |= {str(b): [f"{version}-net"] for b in left}
            log = {b: v for b, v in log.items() if int(b) not in long or int(b) in left}
        self.manifest = {**self.manifest, "version": number, "log": log, "counts": counts}
        try:
            put_text(self.spark, f"{self.path}/manifests/{number:012d}.json", json.dumps(self.manifest))
        except BaseException:
            self.manifest = m
            raise

    def _log_schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"]).add("n", "long").add("bucket", IntegerType())

    @staticmethod
    def _by_version(counts: dict[str, str], buckets: list[int] | None = None) -> dict[str, list[int]]:
        by: dict[str, list[int]] = {}
        for b, v in counts.items():
            if buckets is None or int(b) in buckets:
                by.setdefault(v, []).append(int(b))
        return by

    def _deltas(self, change: DataFrame, old: DataFrame | None) -> DataFrame:
        """Signed ``(field, value, occurrences, records)`` of one batch. Rows of a record are brought together once; the
        counts per record and value and the signs need no further shuffle of records."""
        both = change.select("record", *self.fields, "n", F.lit(0).cast("long").alias("was"))
        if old is not None:
            touched = old.join(change.select("record").distinct().hint("merge"), "record", "left_semi")
            both = both.unionByName(touched.select("record", *self.fields, F.lit(0).cast("long").alias("n"), F.col("n").alias("was")))
        one = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
        several = {f for f in self.fields if isinstance(change.schema[f].dataType, ArrayType)}
        terms = F.array(one(ALL, F.lit(ALL)), *(one(f, F.col(f)) for f in self.fields if f not in several))
        for f in sorted(several):
            terms = F.concat(terms, F.coalesce(F.transform(f, partial(one, f)), F.array().cast("array<struct<field:string,value:string>>")))
        spread = lambda d: d.select("record", "n", "was", F.inline(terms)).filter(F.col("value").isNotNull())
        known = spread(both.filter(F.col("record").isNotNull()).repartition("record"))
        per = known.groupBy("record", "field", "value").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        sign = F.when((F.col("was") <= 0) & (F.col("was") + F.col("n") > 0), 1).when((F.col("was") > 0) & (F.col("was") + F.col("n") <= 0), -1).otherwise(0)
        per = per.select("field", "value", "n", sign.alias("sign"))
        loose = spread(change.filter(F.col("record").isNull()).withColumn("was", F.lit(0).cast("long"))).select("field", "value", "n", F.lit(0).alias("sign"))
        return per.unionByName(loose).groupBy("field", "value").agg(F.sum("n").cast("long").alias("occurrences"), F.sum("sign").cast("long").alias("records"))

    def counts(self) -> DataFrame:
        """``(field, value, occurrences, records)``, the whole collection under the field ``*``."""
        got = self._read("counts", COUNTS, self._by_version(self.manifest["counts"]))
        if got is None:
            return self.spark.createDataFrame([], "field string, value string, occurrences long, records long")
        return got.drop("bucket")

    def marked(self, rare_below: Column, common_above: Column) -> DataFrame:
        """``(field_name, field_value, occurrences, records, mark)``; mark is ``rare``, ``common`` or null. The bounds are
        expressions over the count ``total`` of all records."""
        counts = self.counts()
        total = counts.filter(F.col("field") == ALL).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total")).first()["total"]
        got = counts.filter(F.col("field") != ALL).withColumn("total", F.lit(total).cast("long"))
        mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above, "common")
        return got.select(F.col("field").alias("field_name"), F.col("value").alias("field_value"), "occurrences", "records", mark.alias("mark"))
