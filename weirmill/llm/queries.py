"""The training-data queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.functions.hosts import host, with_registrable
from weirmill.functions.text import blank_pieces, category
from weirmill.llm import bitmaps, frequency, leak, mixing, overlap, sample, skeleton, splits
from weirmill.plans.tables import table, url_records, url_values
from weirmill.session import scratch_path, write_table

FIELDS = ["source", "scenario", "tier", "label"]


def _graph(spark: SparkSession, sf_dir: str) -> splits.Graph:
    u = url_records(spark, sf_dir).select("record_id", "host", "label", "split")
    u = with_registrable(u, "host", table(spark, sf_dir, "psl"))
    return splits.build(u, "record_id", ["registrable"], F.col("label"), F.col("split"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "split_target").select(category(F.col("split")).alias("split"), "share_bp")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r["split"], r["share_bp"]) for r in _targets(spark, sf_dir).collect()]
    return splits.assign(_graph(spark, sf_dir), targets)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains whose records have two or more different splits."""
    return splits.split_entities(_graph(spark, sf_dir))


def p1_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group and the new split of every record."""
    return _assigned(spark, sf_dir).select(F.col("record").alias("record_id"), F.col("component").alias("group_id"), "split")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split and label under the new splits, and the deviation of their share from the target."""
    return splits.report(_assigned(spark, sf_dir), _targets(spark, sf_dir))


def p1_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that belong together by registrable domain or by equal text, over any number of steps: the group of each,
    named by its least document."""
    d = table(spark, sf_dir, "documents").select("doc_id", host(F.col("domain")).alias("host"), F.when(F.length("text") > 0, F.md5(F.col("text").cast("binary"))).alias("text_id"))
    d = with_registrable(d, "host", table(spark, sf_dir, "psl"))
    g = splits.build(d.select("doc_id", "registrable", "text_id"), "doc_id", ["registrable", "text_id"], F.lit(None).cast("string"))
    return splits.groups_of(g).select(F.col("record").alias("doc_id"), "group_id", "size")


def _hosted(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Record, host and split of every delivery, its host read once."""
    return write_table(url_records(spark, sf_dir).select("record_id", "host", "split", *more), "hosted")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and an evaluation record whose hosts are equal or one edit apart."""
    rows = _hosted(spark, sf_dir)
    return overlap.record_pairs(rows, overlap.host_pairs(rows))


def p2_host_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and an evaluation host, equal or one edit apart, with their records."""
    rows = _hosted(spark, sf_dir)
    return overlap.pair_counts(rows, overlap.host_pairs(rows))


def p2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and evaluation hosts whose vectors of character grams have a cosine of at least 0.9."""
    rows = _hosted(spark, sf_dir).filter("host is not null")
    per = write_table(rows.groupBy(F.col("host").alias("text")).agg(F.max(F.col("split") == "train").alias("t"), F.max(F.col("split").isin("val", "test")).alias("e")), "hosts")
    near = overlap.cosine_join(per.filter("t").select("text"), per.filter("e").select("text"), 0.9)
    return near.select(F.col("a").alias("host_a"), F.col("b").alias("host_b"), F.round("cosine", 9).alias("cosine"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records that overlap with train, per split and source."""
    rows = _hosted(spark, sf_dir, "source")
    return overlap.report(rows, overlap.host_pairs(rows))


def _draws(spark: SparkSession, sf_dir: str):
    targets = table(spark, sf_dir, "sample_target")
    u = url_values(spark, sf_dir)
    p = table(spark, sf_dir, "pilot_profile")
    units = {
        "url_audit": u.select(F.col("record_id").alias("id"), F.concat("label", F.lit("|"), "scenario").alias("category")),
        "pilot_profile": p.select(F.col("row_idx").alias("id"), category(F.col("lang")).alias("category")),
    }
    for name, rows in units.items():
        yield name, *sample.draw(rows, targets.filter(F.col("draw_from") == name))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with fewer records there than wanted: the draw took all and fell short."""
    a, b = (r.filter("short and drawn = available").select(F.lit(n).alias("draw_from"), "category") for n, _, r in _draws(spark, sf_dir))
    return a.unionByName(b)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn records."""
    a, b = (s.select(F.lit(n).alias("draw_from"), "id", "category") for n, s, _ in _draws(spark, sf_dir))
    return a.unionByName(b)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, available and drawn of every target, and what is missing."""
    a, b = (r.select(F.lit(n).alias("draw_from"), "*") for n, _, r in _draws(spark, sf_dir))
    return a.unionByName(b)


def _delivered(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("record_id").alias("record"), *FIELDS, *(c for c in rows.columns if c == "host"), "ingested_at")


def _store(spark: SparkSession, fields: list[str], rows: int) -> frequency.TermCounts:
    n = frequency.buckets_for(rows)
    return frequency.TermCounts(spark, scratch_path(spark, "term-counts"), fields, log_buckets=n, count_buckets=n)


def _batches(rows: DataFrame) -> tuple[list[DataFrame], int]:
    """The rows in three batches in the order of ingestion, up to 8, 9 and 10 tenths of the time, and how many there are."""
    ends = rows.agg(F.unix_micros(F.min("ingested_at")).alias("a"), F.unix_micros(F.max("ingested_at")).alias("b"), F.count("*").alias("n")).first()
    a, length = ends["a"] or 0, max(1, (ends["b"] or 0) - (ends["a"] or 0))
    at = (F.coalesce(F.unix_micros("ingested_at"), F.lit(a)) - F.lit(a)) / F.lit(length)
    cuts = ((-1.0, 0.8), (0.8, 0.9), (0.9, 2.0))
    return [rows.filter((at > low) & (at <= high)) for low, high in cuts], ends["n"]


def _counts(spark: SparkSession, sf_dir: str) -> frequency.TermCounts:
    """The store after three batches of deliveries."""
    batches, n = _batches(_delivered(url_values(spark, sf_dir)))
    store = _store(spark, FIELDS, n)
    for rows in batches:
        store.apply(rows.select("record", *FIELDS, F.lit("add").alias("op")))
    return store


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("total")
    return _counts(spark, sf_dir).marked(total / 500, total / 2)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values held by fewer than one in 500 of all records, or by more than half."""
    return _marked(spark, sf_dir).filter("mark is not null").select("field_name", "field_value")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and records of every distinct value, and its mark."""
    return _marked(spark, sf_dir)


def p4_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts where later deliveries replace a record's earlier ones and records whose last delivery names no host are
    deleted: the same three batches, then the deletions."""
    rows = _delivered(url_records(spark, sf_dir))
    batches, n = _batches(rows.filter("record is not null"))
    store = _store(spark, FIELDS, n)
    last = F.max(F.struct("ingested_at", *FIELDS, "host")).alias("last")  # of a record's deliveries in a batch
    for i, some in enumerate(batches):
        kept = some.groupBy("record").agg(last).select("record", "last.*")
        store.apply(kept.select("record", *FIELDS, F.lit("replace" if i else "add").alias("op")))
    gone = rows.filter("record is not null").groupBy("record").agg(last).filter("last.host is null")
    store.apply(gone.select("record", *(F.lit(None).cast("string").alias(f) for f in FIELDS), F.lit("delete").alias("op")))
    return store.marked(F.col("total") / 500, F.col("total") / 2)


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of every word of the texts; words in fewer than 3 documents or more than half are marked."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")
    store = _store(spark, ["word"], docs.count())
    store.apply(docs.select(F.col("doc_id").alias("record"), words.alias("word"), F.lit("add").alias("op")))
    return store.marked(F.lit(3), F.col("total") / 2).select(F.col("field_value").alias("word"), "occurrences", F.col("records").alias("documents"), "mark")


def p5_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts per day, source, scenario and every combination of these. Error bound: zero."""
    u = url_records(spark, sf_dir).select("day", "source", "scenario", "host")
    return bitmaps.distinct_counts(u, ["day", "source", "scenario"], "host", "day").withColumn("error_bound", F.lit(0))


def p5_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that each two sources have in common."""
    u = url_records(spark, sf_dir).select("day", "source", "host")
    parts = bitmaps.merge(bitmaps.containers(u, ["day", "source"], "host", "day"), ["source"])
    got = bitmaps.common_of_all(write_table(parts, "bitmaps"), "source")
    return got.select(F.col("a").alias("source_a"), F.col("b").alias("source_b"), "common_count")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they share at least twelve consecutive words with."""
    return leak.pairs(_leaks(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked: documents, documents with the whole item, most words shared."""
    return leak.item_report(_leaks(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str, tokens) -> mixing.Plan:
    return mixing.plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), tokens)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose quota is beyond their tokens times the most repeats, a token being a piece between blanks."""
    return mixing.report(_mix(spark, sf_dir, blank_pieces(F.col("text")))).filter("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, sizes in tokens of a public tokenizer."""
    return mixing.choose(_mix(spark, sf_dir, mixing.tokenizer_lengths(F.col("text"))))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, routed and actual share of every source, sizes in tokens of a public tokenizer."""
    p = _mix(spark, sf_dir, mixing.tokenizer_lengths(F.col("text")))
    return mixing.report(p, mixing.choose(p))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with different texts that look the same."""
    return skeleton.look_alike_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document with text, and its size."""
    return skeleton.class_report(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    return table(spark, sf_dir, "documents").select("doc_id", skeleton.one_form(F.col("text")).alias("form"))


QUERIES = {f.__name__: f for f in (p1_found, p1_assign, p1_report, p1_linked, p2_found, p2_host_pairs, p2_similar, p2_report, p3_found, p3_sample, p3_report, p4_found, p4_counts, p4_changed, p4_terms, p5_distinct_hosts, p5_common, p7_found, p7_items, p8_found, p8_mix, p8_report, p9_found, p9_classes, p9_forms)}
