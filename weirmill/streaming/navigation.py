"""Snapshots of pages and requests as streams and in batch: the newest revision of each navigation wins, whatever order they
arrive in.

Rows without a navigation or revision are left out. Equal revisions are ordered by phase (content over URL only), then
by the later time. Repeated requests within the watermark count once. State is bounded: it goes when the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirmill.operators.contract import request_error, status_code
from weirmill.operators.ordered import carried, ranges


def _newest(grouped) -> DataFrame:
    return grouped.agg(F.max(F.struct("dom_revision", "phase", "ts")).alias("m"), F.count("*").alias("received"))


def latest(df: DataFrame) -> DataFrame:
    """Batch form: ``(navigation_id, dom_revision, phase, ts)`` of the newest snapshot, by aggregation, without a sort."""
    known = df.filter("navigation_id is not null and dom_revision is not null")
    return _newest(known.groupBy("navigation_id")).select("navigation_id", "m.*", "received")


def latest_stream(stream: DataFrame, delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """Streaming form, update mode: the newest snapshot of each navigation within windows of ``span``, a row whenever it or the
    number received changes. A built-in aggregate; a window's state is dropped once the watermark has passed it, and what comes
    later than ``delay`` behind is discarded. :func:`merge_updates` brings the windows of a navigation together."""
    known = stream.filter("navigation_id is not null and dom_revision is not null").withWatermark("ts", delay)
    return _newest(known.groupBy("navigation_id", F.window("ts", span).alias("w"))).select("navigation_id", F.col("w.start").alias("window_start"), "m.*", "received")


def merge_updates(updates: DataFrame) -> DataFrame:
    """The result of :func:`latest` from all rows :func:`latest_stream` gave, in any order."""
    per = updates.groupBy("navigation_id", "window_start").agg(F.max(F.struct("dom_revision", "phase", "ts")).alias("m"), F.max("received").alias("received"))
    return per.groupBy("navigation_id").agg(F.max("m").alias("m"), F.sum("received").alias("received")).select("navigation_id", "m.*", "received")


def requests(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """``(body)``: a stream of requests, one JSON text a line, from files put into a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files).load(folder).select(F.col("value").alias("body"))


def responses(stream: DataFrame, versions: list[str]) -> DataFrame:
    """``(request_id, navigation_id, dom_revision, phase, error, status_code, preprocessing_version)`` of each request, stream or batch:
    what a response or a diagnostic log may hold, nothing of the body and no address."""
    got = stream.select("body", request_error(F.col("body")).alias("error"))
    field = lambda k: F.get_json_object("body", f"$.{k}").alias(k)
    kept = got.select(field("request_id"), field("navigation_id"), field("dom_revision").cast("long"), field("phase"), "error", field("preprocessing_version"))
    return kept.withColumn("status_code", status_code(F.col("error"), F.col("preprocessing_version").isin(versions)))


def once(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each ``request_id`` once within the watermark of ``ts``."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def stale_discard(df: DataFrame) -> DataFrame:
    """Batch form: add ``stale``, true where an earlier row of the navigation had a revision as new or newer."""
    d = carried(ranges(df, "navigation_id", "ts"), ["navigation_id"], F.col("dom_revision"))
    before = W.partitionBy("navigation_id", "__p").orderBy("ts", "dom_revision").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("stale", F.coalesce(F.greatest(F.max("dom_revision").over(before), "__carry") >= F.col("dom_revision"), F.lit(False))).drop("__p", "__carry")


def debounce(df: DataFrame, key: str, time: str, quiet: Column) -> DataFrame:
    """Rows followed by no other of their key within ``quiet`` seconds: the last of each burst."""
    d = carried(ranges(df, key, time), [key], F.col(time), "after")
    following = F.coalesce(F.lead(time).over(W.partitionBy(key, "__p").orderBy(time)), F.col("__carry"))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return d.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") > quiet.cast("long") * 1_000_000)).drop("__gap", "__p", "__carry")


def outcomes(df: DataFrame, tab: str, start: str, ms: Column, timeout_ms: int = 5000) -> DataFrame:
    """Add ``outcome`` of content requests of which a tab has one at a time: ``superseded`` where the tab's next request starts
    before this one has ended, ``unable_to_assess`` where it takes longer than the client waits or has no duration, else
    ``answered``. A timeout is never a negative."""
    d = carried(ranges(df.withColumn("__ms", ms), tab, start), [tab], F.col(start), "after")
    following = F.coalesce(F.lead(start).over(W.partitionBy(tab, "__p").orderBy(start)), F.col("__carry"))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    waits = F.least(F.coalesce("__ms", F.lit(timeout_ms)), F.lit(timeout_ms)) * 1000
    why = F.when(F.coalesce(gap < waits, F.lit(False)), "superseded").when(F.col("__ms").isNull() | (F.col("__ms") > timeout_ms), "unable_to_assess").otherwise("answered")
    return d.withColumn("outcome", why).drop("__ms", "__p", "__carry")


def rate_limited(df: DataFrame, key: str, time: str, window: str, limit: int) -> DataFrame:
    """``(key, window_start, n)`` of tumbling windows with more rows than the limit; works on streams with a watermark."""
    return df.groupBy(key, F.window(time, window).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")
