"""What an analysis service computes, as functions of frames: features of a snapshot, the response of each, health and model.

Nothing here reads a label, fetches an address or runs a page. Features of a page depend on the page and the dictionary alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.functions import html
from weirmill.functions.hosts import host, with_registrable
from weirmill.functions.text import claims, requests
from weirmill.operators import contract, matching

VERSION = "0.1.0"
ZONES = {"title": "title", "heading": "heading", "form": "login_text", "main": "text"}


def extract(snapshots: DataFrame, dictionary: DataFrame, psl: DataFrame) -> DataFrame:
    """``(snapshot_id, host, registrable, forms, password_inputs, iframes, links, link_foreign_share, asks, claims, zones, org_id)`` of
    ``snapshots(snapshot_id, url, html)``. ``zones`` are those in which an organisation is named, ``org_id`` is the one named in
    most of them, the first of equals. Pages without text have null ``asks``. Other columns are not read."""
    s = snapshots.select("snapshot_id", host(F.col("url")).alias("host"), html.profile(F.col("html")).alias("p"))
    s = with_registrable(s, "host", psl)
    zones = F.array(*(F.struct(F.lit(z).alias("zone"), F.col(f"p.{f}").alias("text")) for z, f in ZONES.items()))
    z = s.select("snapshot_id", F.inline(zones)).filter("text <> ''").withColumn("at", F.concat_ws("|", F.col("snapshot_id").cast("string"), "zone"))
    named = matching.alias_matches(z, "at", "text", dictionary).select(F.col("id").alias("at"), "org_id").distinct()
    per = z.select("snapshot_id", "zone", "at").join(named, "at").groupBy("snapshot_id", "org_id").agg(F.array_sort(F.collect_set("zone")).alias("zones"))  # at most four
    best = per.groupBy(F.col("snapshot_id").alias("sid")).agg(F.min(F.struct((-F.size("zones")).alias("n"), "org_id", "zones")).alias("m"))
    foreign = F.size(F.filter("p.links", lambda a: a.rlike("^(?i)(https?:)?//") & ~F.coalesce(host(a) == F.col("host"), F.lit(False))))
    asks = F.when(F.col("p.text") != "", requests(F.col("p.text")))
    got = s.select(
        "snapshot_id", "host", "registrable", "p.forms", "p.password_inputs", "p.iframes", F.size("p.links").alias("links"), F.try_divide(foreign, F.size("p.links")).alias("link_foreign_share"),
        asks.alias("asks"), claims(F.col("p.text")).alias("claims"),
    )
    return got.join(best, F.col("snapshot_id") == F.col("sid"), "left").select(*got.columns, F.col("m.zones").alias("zones"), F.col("m.org_id").alias("org_id"))


def respond(requests_: DataFrame, score: Column, threshold: float, signals: Column, model: dict, relation: Column) -> DataFrame:
    """Add ``response``: the JSON text of the answer to ``requests_(request_id, navigation_id, dom_revision, phase, org_id ...)``. A null
    score is insufficient content. ``signals`` is an array of codes; each gets its static message."""
    limit = F.when(score.isNotNull(), F.lit(threshold))
    one = lambda c: F.struct(c.alias("code"), F.col("org_id").alias("org_candidate_id"), relation.alias("domain_relation"), F.coalesce(contract.message(c), F.lit("")).alias("message"))
    fields = {
        "request_id": F.col("request_id"), "navigation_id": F.col("navigation_id"), "dom_revision": F.col("dom_revision"), "phase": F.col("phase"),
        "status": F.when(score.isNull(), "insufficient_content").otherwise("completed"), "verdict": contract.verdict(score, limit), "score": score, "threshold": limit,
        "model": F.struct(*(F.lit(model[k]).alias(k) for k in contract.MODEL)), "signals": F.slice(F.transform(F.when(score.isNull(), F.array().cast("array<string>")).otherwise(signals), one), 1, contract.MAX_LIST),
        "limitations": F.when(score.isNull(), F.array(F.lit("insufficient_text_or_dom"))).otherwise(F.array().cast("array<string>")),
        "timing_ms": F.struct(*(F.lit(0).alias(k) for k in contract.TIMING)),
    }
    return requests_.withColumn("response", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}))


def health(ready: bool) -> str:
    return json.dumps({"status": "ok", "model_ready": ready, "api_version": VERSION})


def model(active: dict | None) -> str | None:
    """The active model's metadata under the contract's keys; null, as for a service that is not ready, without one."""
    return json.dumps({k: active[k] for k in contract.MODEL}) if active else None
