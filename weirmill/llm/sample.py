"""A sample whose share of each category meets given target proportions, drawn by the cube method.

A unit of category c starts with the inclusion probability n_c / N_c, n_c being the rows wanted and N_c those there are.
Flight phases move the probabilities of a cell along vectors that keep the sum of every category indicator, until each
category has at most one undecided unit in the cell; cells are independent and run in parallel. Undecided units, at
most one a category and cell, merge upward, 64 cells into one, and fly again; landing decides what is left at the top.
Probabilities are kept as whole numbers of 1/N_c, so the balance is exact.

Defined results: rows without an id are left out, repeated rows are one unit; a unit with several categories counts
under the smallest; units without a category or with one that has no target are never drawn but count in the total. A
category with fewer units than wanted is drawn whole and reported. Empty tables draw nothing and fall short everywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.session import write_table

CELL_ROWS = 50_000
MERGE = 64
#: Target tables are parameters; a larger one is refused.
MAX_CATEGORIES = 10_000
UNIT = "cell long, id long, category int, p long, of long"


def _uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Seeded numbers in [0, 1) that depend on the id and the turn only, so a repeated task draws the same."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def flight(ids: np.ndarray, category: np.ndarray, p: np.ndarray, of: np.ndarray, seed: int, level: int) -> np.ndarray:
    """Move probabilities ``p / of`` until each category has at most one that is neither 0 nor 1.

    The indicators of different categories have no unit in common, so the vectors that keep all their sums are spanned
    by differences of two units of one category. Each turn takes disjoint such pairs and moves each along its vector to
    the border, up or down with the chances that keep the expectation; every pair decides at least one of its units.
    """
    p = p.copy()
    turn = 0
    live = np.flatnonzero((p > 0) & (p < of))
    while len(live) > 1:
        u = _uniform(ids[live], seed, level * 1000 + 2 * turn)
        live = live[np.lexsort((u, category[live]))]
        c = category[live]
        first = np.concatenate([[True], c[1:] != c[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        even = (np.arange(len(c)) - start) % 2 == 0
        lead = np.flatnonzero(even[:-1] & (c[1:] == c[:-1]))
        if not len(lead):
            break
        i, j = live[lead], live[lead + 1]
        up, down = np.minimum(of[i] - p[i], p[j]), np.minimum(p[i], of[j] - p[j])
        rise = _uniform(ids[i], seed, level * 1000 + 2 * turn + 1) * (up + down) < down
        move = np.where(rise, up, -down)
        p[i] += move
        p[j] -= move
        live = live[(p[live] > 0) & (p[live] < of[live])]
        turn += 1
    return p


def _fly(seed: int, level: int, last: bool):
    """applyInPandas: the flight of one cell and, in the last one, the landing; units of probability 0 are dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, of = pdf["id"].to_numpy(), pdf["of"].to_numpy()
        p = flight(ids, pdf["category"].to_numpy(), pdf["p"].to_numpy(), of, seed, level)
        if last:
            undecided = (p > 0) & (p < of)
            p = np.where(undecided, np.where(_uniform(ids, seed, -1) * of < p, of, 0), p)
        return pdf.assign(p=p)[p > 0]

    return run


def draw(units: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)`` of ``units(id long, category)`` under ``targets(category, share_bp, draw_pct, min_rows)``.

    A category is wanted ``share_bp / 10,000 * draw_pct / 100`` times all units, rounded up, and at least ``min_rows``.
    sample: ``(id, category)``. report, one row a category of the targets: ``available, wanted, drawn, residual, short``;
    residual is drawn minus wanted, short says whether the unrounded wish can't be met.
    """
    spark = units.sparkSession
    rows = units.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("category").alias("category"))
    rows = write_table(rows, "units")
    total = rows.count()
    wish = targets.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.max(F.coalesce("share_bp", F.lit(0)) * F.coalesce("draw_pct", F.lit(0))).cast("long").alias("rate"),
        F.max(F.coalesce("min_rows", F.lit(0))).cast("long").alias("least"),
    )
    wish = wish.orderBy("category").limit(MAX_CATEGORIES + 1).collect()
    if len(wish) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} target categories")
    table = spark.createDataFrame([(k, r["category"], r["rate"], r["least"]) for k, r in enumerate(wish)], "k int, name string, rate long, least long")
    there = {r["category"]: r["n"] for r in rows.join(F.broadcast(table), F.col("category") == F.col("name"), "left_semi").groupBy("category").agg(F.count("*").alias("n")).collect()}
    plan = []
    for k, r in enumerate(wish):
        n, per_million = there.get(r["category"], 0), r["rate"] * total
        wanted = max(-(-per_million // 1_000_000), r["least"])
        plan.append((k, r["category"], n, wanted, min(wanted, n), n * 1_000_000 < per_million or n < r["least"]))
    plan_df = spark.createDataFrame(plan, "k int, name string, available long, wanted long, p long, short boolean")
    known = rows.join(F.broadcast(plan_df), F.col("category") == F.col("name"))
    start = known.filter("p > 0").select(F.col("id").cast("long").alias("id"), F.col("k").alias("category"), "p", F.col("available").alias("of"))
    certain = start.filter("p = of")
    cells = max(1, -(-sum(n for _, _, n, _, p, _ in plan if 0 < p < n) // CELL_ROWS))
    live = start.filter("p < of").select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(cells)).alias("cell"), "id", "category", "p", "of")
    chosen, level = [certain.select("id", "category")], 0
    while True:
        last = cells == 1

        flown = write_table(live.groupBy("cell").applyInPandas(_fly(seed, level, last), UNIT), "flown")
        chosen.append(flown.filter("p = of").select("id", "category"))
        if last:
            break
        live = flown.filter("p < of").withColumn("cell", F.floor(F.col("cell") / MERGE))
        cells, level = -(-cells // MERGE), level + 1
    sample = chosen[0]
    for x in chosen[1:]:
        sample = sample.unionByName(x)
    drawn = sample.groupBy(F.col("category").alias("c")).agg(F.count("*").alias("drawn"))
    report = plan_df.join(drawn, F.col("k") == F.col("c"), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.select(F.col("name").alias("category"), "available", "wanted", "drawn", (F.col("drawn") - F.col("wanted")).alias("residual"), "short")
    named = sample.join(F.broadcast(plan_df.select(F.col("k"), F.col("name"))), F.col("category") == F.col("k")).select("id", F.col("name").alias("category"))
    return named, report
