"""Splits that keep related records together.

Records and their entities (author, source, registrable domain ...) form a bipartite graph. Minimum labels are
propagated over it, all records of one component form a group, and whole groups are dealt to the splits so that the
share of records and the mix of labels in each split come near the targets.

Defined results: rows without a record id are left out; null entities link nothing, so a record without any entity is
its own group; repeated rows are one record; a record with several labels counts under the smallest; a null label is a
label of its own. Columns with any other name are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.llm.ordered import running_sum, seeded
from weirmill.session import scratch_dir, write_table

#: Groups with more than this part of all records are dealt one by one; there are fewer than its inverse.
HEAVY_PART = 1 / 2000
#: So many labels, the commonest, are balanced each by itself, the others together.
LABELS = 200
CELL_ROWS = 50_000


@dataclass
class Graph:
    """``records``: one row a record with its first entity; ``bridges``: edges of records with several entities;
    ``labels``: component of each entity that a bridge reaches (None if there is no bridge)."""

    records: DataFrame
    bridges: DataFrame | None
    labels: DataFrame | None


def propagate(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Minimum-label propagation over ``edges(record, entity)``; gives ``(entity, component)``.

    Every round an entity takes the least label of its records and a record the least of its entities; then labels are
    shortened by following each label's own label, so that chains close in a logarithmic number of rounds. Lineage is
    cut each round with a checkpoint in the shared folder.
    """
    scratch_dir(edges.sparkSession)  # where lineage is cut
    now = edges.groupBy("entity").agg(F.min("entity").alias("component"))
    for _ in range(max_rounds):
        by_record = edges.join(now, "entity").groupBy("record").agg(F.min("component").alias("least"))
        by_entity = edges.join(by_record, "record").groupBy("entity").agg(F.min("least").alias("least"))
        roots = now.select(F.col("entity").alias("root"), F.col("component").alias("further"))
        step = (
            now.join(by_entity, "entity")
            .join(roots, F.col("least") == F.col("root"), "left")
            .select("entity", F.least("component", "least", "further").alias("new"), F.col("component").alias("old"))
            .checkpoint()
        )
        now = step.select("entity", F.col("new").alias("component"))
        if step.filter("new <> old").isEmpty():
            return now
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def build(df: DataFrame, record: str, entities: list[str], label: Column, split: Column | None = None) -> Graph:
    """The bipartite graph of ``df`` and its components.

    A record with one entity can't pass a label on from one entity to another, so the propagation runs over the edges
    of the records with several (the bridges); all others take the label of their entity. The result is the same as
    over all edges, and the records are shuffled once.
    """
    named = [F.when(F.col(e).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(e).cast("string"))) for i, e in enumerate(entities)]
    if len(named) == 1:
        named = [F.col(entities[0]).cast("string")]
    rows = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.array_compact(F.array(*named)).alias("es"), label.alias("label"), (F.lit(None).cast("string") if split is None else split).alias("split"))
    records = rows.groupBy("record").agg(
        F.min("label").alias("label"),
        F.min(F.array_min("es")).alias("entity"),
        F.max(F.array_max("es")).alias("last"),
        F.min("split").alias("low"),
        F.max("split").alias("high"),
    )
    records = write_table(records, "records")
    several = records.filter("entity < last").select("record")
    if several.isEmpty():
        return Graph(records, None, None)
    bridges = rows.join(several, "record", "left_semi").select("record", F.explode("es").alias("entity"), "split")
    bridges = write_table(bridges.groupBy("record", "entity").agg(F.min("split").alias("low"), F.max("split").alias("high")), "bridges")
    return Graph(records, bridges, propagate(bridges.select("record", "entity")))


def grouped(g: Graph) -> DataFrame:
    """``records`` with ``component``: of its entity, or the record's own."""
    own = F.coalesce(F.col("entity"), F.concat(F.lit("record "), F.col("record").cast("string")))
    if g.labels is None:
        return g.records.withColumn("component", own)
    return g.records.join(g.labels, "entity", "left").withColumn("component", F.coalesce("component", own))


def split_entities(g: Graph) -> DataFrame:
    """``(entity)`` of each entity whose records have two or more different values of the given split."""
    edges = g.records.filter("entity is not null and entity = last").select("entity", "low", "high")
    if g.bridges is not None:
        edges = edges.unionByName(g.bridges.select("entity", "low", "high"))
    return edges.groupBy("entity").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("entity")


def groups_of(g: Graph) -> DataFrame:
    """``(record, group_id, size)``: the group of each record named by its least record. Counted on the map side."""
    records = grouped(g).select("record", "component")
    per = records.groupBy("component").agg(F.min("record").alias("group_id"), F.count("*").alias("size"))
    return records.join(per, "component").select("record", "group_id", "size")


def balance(sizes: list[tuple[str, list[int]]], totals: list[int], shares: dict[str, float]) -> tuple[dict[str, str], dict[str, list[int]]]:
    """Deal groups with label counts one by one, largest first, each to the split where the sum over labels of squared
    relative deviation from the target is least. Gives the split of each group and the label counts of each split."""
    held = {s: [0] * len(totals) for s in shares}
    want = {s: [max(p * t, 1e-9) for t in totals] for s, p in shares.items()}
    got: dict[str, str] = {}
    for name, counts in sorted(sizes, key=lambda x: (-sum(x[1]), x[0])):
        rise = lambda s: sum(c * (2 * (h - w) + c) / w for c, h, w in zip(counts, held[s], want[s]) if c)  # noqa: B023, E731
        best = min(shares, key=lambda s: (rise(s), s))
        got[name] = best
        held[best] = [h + c for h, c in zip(held[best], counts)]
    return got, held


def assign(g: Graph, targets: list[tuple[str, float]], seed: int = 17) -> DataFrame:
    """``(record, component, label, split)``: a split for every record, the same for all records of a component.

    The groups over ``HEAVY_PART`` of all records (fewer than 2,000, so small enough for the driver) are dealt one by
    one by :func:`balance`. All others are stratified by the rarest label they hold, so that each label's groups are
    shared out among themselves; within a stratum they stand in a seeded order and the line of their records of that label is cut at
    what the heavy groups left of each split's target. A stratum so comes within one light group of its share, whatever
    the number of groups.
    """
    shares = {s: p for s, p in targets if s is not None and p}
    if not shares:
        raise ValueError("no split has a share")
    whole = sum(shares.values())
    shares = {s: p / whole for s, p in sorted(shares.items())}
    spark = g.records.sparkSession
    records = grouped(g).select("record", "component", F.coalesce("label", F.lit("")).alias("label"))
    total = g.records.count()
    if not total:
        return records.withColumn("split", F.lit(None).cast("string"))
    counts = g.records.groupBy(F.coalesce("label", F.lit("")).alias("label")).count().orderBy(F.desc("count"), "label").limit(LABELS)
    kept = sorted(((r["label"], r["count"]) for r in counts.collect()), key=lambda x: (x[1], x[0]))  # rarest first
    names, totals = [n for n, _ in kept], [n for _, n in kept]
    totals.append(total - sum(totals))
    per = [F.count_if(F.col("label") == n) for n in names] + [F.count_if(~F.col("label").isin(names))]
    groups = write_table(records.groupBy("component").agg(F.count("*").alias("n"), F.array(*per).alias("by")), "groups")
    heavy = groups.filter(F.col("n") > total * HEAVY_PART).select("component", "by").collect()
    dealt, held = balance([(r["component"], list(r["by"])) for r in heavy], totals, shares)

    light = groups.filter(F.col("n") <= total * HEAVY_PART).withColumn("stratum", F.coalesce(*(F.when(F.col("by")[k] > 0, F.lit(k)) for k in (len(names), *range(len(names))))))
    n_light = light.agg(F.count("*").alias("n")).first()["n"]
    light = light.withColumn("own", F.col("by")[F.col("stratum")])  # records of the stratum's label: what is cut
    light = running_sum(light, ["stratum"], seeded(F.col("component"), seed=seed), F.col("own"), max(1, -(-n_light // CELL_ROWS)), "before")
    strata = light.groupBy("stratum").agg(F.sum("own").alias("of")).withColumnRenamed("stratum", "s")
    light = light.join(F.broadcast(strata), F.col("stratum") == F.col("s"))  # a row a label, at most 201
    at = (F.col("before") + F.col("own") / 2) / F.col("of")
    left = [[max(0.0, shares[s] * t - held[s][k]) for s in shares] for k, t in enumerate(totals)]
    left = [x if sum(x) else list(shares.values()) for x in left]
    chosen = F.lit(list(shares)[-1])
    for k in range(len(totals)):
        cuts, run = [], 0.0
        for x in left[k]:
            run += x / sum(left[k])
            cuts.append(run)
        pick = F.lit(list(shares)[-1])
        for s, c in reversed(list(zip(shares, cuts))[:-1]):
            pick = F.when(at < c, F.lit(s)).otherwise(pick)
        chosen = F.when(F.col("stratum") == k, pick).otherwise(chosen)
    light = light.select("component", chosen.alias("split"))

    table = spark.createDataFrame([(c, s) for c, s in sorted(dealt.items())] or [(None, None)], "heavy string, of_heavy string")
    with_heavy = records.join(F.broadcast(table), F.col("component") == F.col("heavy"), "left")  # fewer than 2,000 rows
    done = with_heavy.filter("heavy is not null").select("record", "component", "label", F.col("of_heavy").alias("split"))
    rest = with_heavy.filter("heavy is null").select("record", "component", "label").join(light, "component")
    return done.unionByName(rest.select(*done.columns))


def report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Records of every split and label, their share of the label's records, and the deviation from the split's target."""
    shares = {r["split"]: r["bp"] / 10_000 for r in targets.groupBy("split").agg(F.sum("share_bp").alias("bp")).collect() if r["split"] is not None}
    per = F.array(*(F.struct(F.lit(s).alias("split"), F.count_if(F.col("split") == s).alias("records"), F.lit(p).alias("target")) for s, p in sorted(shares.items())))
    by_label = assigned.groupBy("label").agg(F.count("*").alias("of"), per.alias("per")).select("label", "of", F.inline("per"))
    share = F.col("records") / F.col("of")
    return by_label.select("split", "label", "records", F.round(share, 6).alias("share"), F.round(share - F.col("target"), 6).alias("deviation"))


__all__ = ["Graph", "assign", "balance", "build", "grouped", "groups_of", "propagate", "report", "split_entities"]
