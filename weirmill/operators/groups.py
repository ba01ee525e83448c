"""Groups that must stay on one side of a split: duplicates, components, folds, cuts in time.

Rows with a null key or text belong to no group. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirmill.functions.shingles import plain_words, shingle_hashes, word_hashes
from weirmill.operators.metrics import hash32
from weirmill.operators.ordered import running
from weirmill.session import scratch_dir, write_table

SHINGLE = 5
THRESHOLD = 0.8
#: Bands times rows of the MinHash signature: a pair of similarity 0.8 shares a band with a chance above 0.9999.
BANDS, ROWS = 24, 4


def exact_duplicates(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(id, class_id, copies)``: class of equal texts by SHA-256, named by its least id."""
    t = df.filter(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("h"))
    per = t.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return t.join(per, "h").select("id", "class_id", "copies")


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(id, s, bands)``: sorted distinct shingles of each text and the hash of each MinHash band."""
    mix = np.random.default_rng(17).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    for b in batches:
        out = []
        for ident, text in zip(b["id"], b["text"]):
            h = word_hashes(plain_words(text))
            s = np.unique(shingle_hashes(h, min(SHINGLE, max(len(h), 1))))  # a shorter text is one shingle
            if not len(s):
                continue
            least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
            for at in range(0, len(s), 4096):
                x = s[at : at + 4096, None] * mix
                np.minimum(least, ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=least)
            bands = shingle_hashes(np.arange(ROWS, dtype=np.uint64), 1)[None, :] ^ least.reshape(BANDS, ROWS)
            keys = np.array([shingle_hashes(r, ROWS)[0] for r in bands])
            out.append((ident, s.view(np.int64), keys.view(np.int64)))
        yield pd.DataFrame(out, columns=["id", "s", "bands"])


def near_duplicates(df: DataFrame, ident: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of representatives of different texts with shingle similarity of ``threshold`` or more.

    Copies of a text are one representative, so a text held by a third of all rows costs one row. Candidates share a
    band of the MinHash signature and every candidate is verified exactly over whole texts; AQE splits the join of a
    band that many different texts share.
    """
    t = df.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("h")).agg(F.min(ident).cast("long").alias("id"), F.first(text).alias("text"))
    t = write_table(t.select("id", "text").mapInPandas(_signatures, "id long, s array<long>, bands array<long>"), "signatures")
    keys = t.select("id", F.size("s").alias("n"), F.posexplode("bands").alias("b", "k"))
    met = keys.select(F.col("id").alias("id_a"), F.col("n").alias("na"), "b", "k").join(keys.select(F.col("id").alias("id_b"), F.col("n").alias("nb"), "b", "k"), ["b", "k"])
    pairs = met.filter((F.col("id_a") < F.col("id_b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))).select("id_a", "id_b").distinct()  # sizes too far apart can't be similar
    sets = pairs.join(t.select(F.col("id").alias("id_a"), F.col("s").alias("sa")), "id_a").join(t.select(F.col("id").alias("id_b"), F.col("s").alias("sb")), "id_b")
    both = F.size(F.array_intersect("sa", "sb"))
    return sets.select("id_a", "id_b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, group_id)``: the least id each node is connected to. ``nodes(id)``, ``edges(id_a, id_b)``.

    Minimum labels over edges in both directions with shortcuts; lineage is cut each round in the shared folder. Only
    nodes on edges take part, all others are their own group.
    """
    scratch_dir(edges.sparkSession)  # where lineage is cut
    e = edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).filter("a <> b")
    e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).checkpoint()
    for _ in range(max_rounds):
        near = e.join(now.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        roots = now.select(F.col("a").alias("r"), F.col("l").alias("rl"))
        step = now.join(near, "a").join(roots, F.least("l", "m") == F.col("r")).select("a", F.least("m", "rl", "l").alias("n"), "l").checkpoint()
        now = step.select("a", F.col("n").alias("l"))
        if step.filter("n <> l").isEmpty():
            return nodes.select("id").distinct().join(now, F.col("id") == F.col("a"), "left").select("id", F.coalesce("l", "id").alias("group_id"))
    raise RuntimeError(f"groups still change after {max_rounds} rounds")


def without(df: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the ``keys`` (id, hash, group ...) with any row of ``registry``: an anti join a key. Null keys
    exclude nothing."""
    for k in keys:
        df = df.join(registry.select(F.col(k).alias("__k")).filter("__k is not null").distinct(), F.col(k) == F.col("__k"), "left_anti")
    return df


def in_several(df: DataFrame, key: str, source: str, ident: str) -> DataFrame:
    """``(key, sources, rows)`` of the keys, as a content hash, found under two sources or more. Counted on the map side."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key, source).agg(F.count(ident).alias("rows"))
    return per.groupBy(key).agg(F.count(source).alias("sources"), F.sum("rows").alias("rows")).filter("sources > 1")


def source_roles(df: DataFrame, source: str, label: str) -> DataFrame:
    """``(source, n_pos, n_neg, role)``: a source of benign rows only is a challenge set of its own (``challenge``), one with
    both classes is pooled, one of phishing only can't be (``one_class``). ``label`` is 1, 0 or null."""
    per = df.groupBy(source).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return per.withColumn("role", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), "pooled").when(F.col("n_neg") > 0, "challenge").when(F.col("n_pos") > 0, "one_class"))


def sources_of_all_folds(df: DataFrame, source: str, fold: str, label: str, k: int) -> DataFrame:
    """``(source)`` of the sources with rows of both classes in each of the ``k`` folds."""
    per = df.groupBy(source, fold).agg(F.max(F.col(label) == 1).alias("p"), F.max(F.col(label) == 0).alias("n"))
    return per.groupBy(source).agg(F.count_if(F.col("p") & F.col("n")).alias("whole")).filter(F.col("whole") == k).select(source)


def nested_folds(df: DataFrame, group: str, outer: int, inner: int, seed: int) -> DataFrame:
    """Add ``outer_fold`` and ``inner_fold`` of the row's group: two levels of one seeded hash, so that whoever holds out an
    outer fold splits the rest by groups again. Null groups have neither."""
    level = lambda name, k: F.when(F.col(group).isNotNull(), (hash32(F.lit(f"{name}{seed}"), group) % k).cast("int"))
    return df.withColumns({"outer_fold": level("outer", outer), "inner_fold": level("inner", inner)})


def folds(df: DataFrame, group: str, label: Column, k: int, seeds: list[int]) -> DataFrame:
    """``(group_id, seed, fold, n, n_pos)``: groups dealt to folds in a seeded order, those with a positive row and those
    without apart, so that classes stay even. With fewer groups than folds of a kind some folds stay empty."""
    per = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.count("*").alias("n"), F.count_if(label).alias("n_pos"))
    per = write_table(per.withColumn("kind", (F.col("n_pos") == 0).cast("int")), "folds")
    size = {r["kind"]: r["count"] for r in per.groupBy("kind").count().collect()}
    runs = [(seed, kind) for seed in seeds for kind in (0, 1)]  # all runs stand in one line, one after the other
    before = F.lit(0).cast("long")
    for i, _ in enumerate(runs):
        before = F.when(F.col("run") == i, F.lit(sum(size.get(kind, 0) for _, kind in runs[:i]))).otherwise(before)
    line = per.select("*", F.inline(F.array(*(F.struct(F.lit(i).alias("run"), F.lit(s).cast("int").alias("seed"), F.lit(kind).alias("of")) for i, (s, kind) in enumerate(runs))))).filter("kind = of")
    order = F.col("run").cast("long") * F.lit(1 << 32) + hash32(F.col("seed"), F.col("group_id"))
    got = running(line, order, {"r": F.lit(1)}, ties=F.asc("group_id"))
    return got.select("group_id", "seed", ((F.col("r") - 1 - before) % k).cast("int").alias("fold"), "n", "n_pos")


def leak_check(df: DataFrame, group: str, role: str) -> DataFrame:
    """Groups in more than one role: must be empty."""
    return df.groupBy(group).agg(F.count_distinct(role).alias("roles")).filter("roles > 1")


def temporal(df: DataFrame, date: str, group: str, quantiles: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Add ``period`` (train, validation, test) and ``dropped_reason``. The cut is the first day whose cumulative share
    reaches the quantile, so a day is never split; a row whose group occurs in an earlier period is dropped."""
    d = df.withColumn("__d", F.to_date(date))
    per = d.filter("__d is not null").groupBy("__d").agg(F.count("*").alias("n")).withColumn("c", F.sum("n").over(W.orderBy("__d"))).withColumn("t", F.sum("n").over(W.partitionBy()))  # a row a day
    cut = per.agg(*(F.min(F.when(F.col("c") >= q * F.col("t"), F.col("__d"))).alias(f"__q{k}") for k, q in enumerate(quantiles)))
    q0, q1 = (F.lit(x).cast("date") for x in cut.first())
    got = d
    rank = F.when(F.col("__d") <= q0, 0).when(F.col("__d") <= q1, 1).when(F.col("__d").isNotNull(), 2)
    got = got.withColumn("__r", rank)
    first = got.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.min("__r").alias("__f"))
    got = got.join(first, F.col(group) == F.col("__g"), "left")
    why = F.when(F.col("__r").isNull(), "no_date").when(F.col("__f") < F.col("__r"), "group_seen_earlier")
    period = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.col("__r") + 1)
    return got.select(*df.columns, period.alias("period"), why.alias("dropped_reason"))


def stratified(df: DataFrame, ident: str, strata: list[str], fraction: float, seed: int) -> DataFrame:
    """The first ``ceil(fraction * n)`` rows of each stratum in a seeded order that any engine repeats. The order within
    a stratum comes from ranges of the hash, so a large stratum is spread."""
    d = df.withColumn("__h", hash32(F.lit(seed), F.col(ident)))
    d = d.withColumn("__c", F.shiftright("__h", 22).cast("int"))  # 1,024 ranges
    per = d.groupBy(*strata, "__c").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*strata)
    per = per.withColumn("__before", F.sum("__n").over(w.orderBy("__c")) - F.col("__n")).withColumn("__of", F.sum("__n").over(w))
    side = per.select(*(F.col(s).alias(f"__s{k}") for k, s in enumerate(strata)), F.col("__c").alias("__d"), "__before", "__of")
    same = [F.col(s).eqNullSafe(F.col(f"__s{k}")) for k, s in enumerate(strata)]
    got = d.withColumn("__i", F.row_number().over(W.partitionBy(*strata, "__c").orderBy("__h", ident))).join(side, [F.col("__c") == F.col("__d"), *same])
    return got.filter(F.col("__before") + F.col("__i") <= F.ceil(F.lit(fraction) * F.col("__of"))).select(*df.columns)
