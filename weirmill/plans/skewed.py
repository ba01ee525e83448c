"""Problem 6: results per host and per source though a few hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators.skew import two_stage
from weirmill.plans.sql import URLS
from weirmill.plans.tables import url_records, url_values


def p6_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host and per source: rows, records, phishing records, first and last collection, greatest delay in seconds."""
    u = url_records(spark, sf_dir)
    keyed = u.select(
        "record_id", (F.col("label") == "phishing").cast("int").alias("bad"), "collected_at",
        (F.unix_timestamp("ingested_at") - F.unix_timestamp("collected_at")).alias("delay"),
        F.inline(F.array(F.struct(F.lit("domain").alias("field_name"), F.col("host").alias("field_value")), F.struct(F.lit("source").alias("field_name"), F.col("source").alias("field_value")))),
    ).filter("field_value is not null")
    stage1 = [F.count("*").alias("rows"), F.max("bad").alias("bad"), F.min("collected_at").alias("first"), F.max("collected_at").alias("last"), F.max("delay").alias("delay")]
    stage2 = [
        F.sum("rows").alias("rows"), F.count("record_id").alias("records"), F.count_if((F.col("bad") == 1) & F.col("record_id").isNotNull()).alias("phishing_records"),
        F.min("first").alias("min_collected_at"), F.max("last").alias("max_collected_at"), F.max("delay").alias("max_delay_s"),
    ]
    return two_stage(keyed, ["field_name", "field_value"], "record_id", stage1, stage2)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host and source held by at least one in a hundred of all records."""
    total = url_values(spark, sf_dir).select(F.count_distinct("record_id").alias("n")).first()["n"]
    return p6_key_results(spark, sf_dir).filter(F.col("records") * 100 >= total).filter("records > 0").select("field_name", "field_value")


QUERIES = {"p6_found": p6_found, "p6_key_results": p6_key_results}

_KEYED = "select 'domain' as f, host as v, * from u where host is not null union all select 'source', source, * from u where source is not null"
ORACLES = {
    "p6_found": f"""with {URLS}, k as ({_KEYED}), n as (select count(distinct record_id) as total from u)
select f as field_name, v as field_value from k, n group by f, v, total having count(distinct record_id) * 100 >= total""",
    "p6_key_results": f"""with {URLS}, k as ({_KEYED})
select f as field_name, v as field_value, count(*) as "rows", count(distinct record_id) as records, count(distinct case when label = 'phishing' then record_id end) as phishing_records,
  min(collected_at) as min_collected_at, max(collected_at) as max_collected_at, max(cast(floor(epoch(ingested_at)) as bigint) - cast(floor(epoch(collected_at)) as bigint)) as max_delay_s
from k group by f, v""",
}
