"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Documents of one text are one unit that belongs to every source it was delivered by; units with the same set of sources
form a pattern, of which there are at most two to the number of sources. Token capacity flows from patterns to source
quotas; a pattern's tokens cost nothing the first time, and one more each further time, so that what repeats is spread
and sources draw on texts of their own first. Then documents are chosen in a seeded order until each flow is met.

Defined results: documents whose source has no target are left out; null and empty text has no tokens and is not chosen; a source without documents
gets nothing and falls short; rows without a document id are left out, a repeated id counts once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.functions.text import category
from weirmill.llm.ordered import running_sum, seeded
from weirmill.session import write_table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CELL_ROWS = 50_000
#: Source shares are in this many parts; flows are in tokens times it, so that quotas are whole.
PARTS = 10_000
#: A membership pattern is a set of bits in a long; more targets are refused, none is left out.
MOST_SOURCES = 62


def tokenizer_lengths(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each text under a public tokenizer's file; 0 for null. The driver's file is handed to every executor."""
    SparkSession.active().sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = _tokenizers.get(name)
        if t is None:
            t = _tokenizers[name] = Tokenizer.from_file(SparkFiles.get(name))
            t.encode_special_tokens = True
        return pd.Series([len(e) for e in t.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return lengths(text)


_tokenizers: dict = {}


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each edge ``(from, to, capacity, cost)`` of a cheapest maximum flow: successive shortest paths with
    potentials. Costs are not negative. A graph here has a node a pattern and source, whatever the documents."""
    out: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(v)
    potential = [0] * n
    while True:
        best, via = {source: 0}, {}
        queue, done = [(0, source)], set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                y, far = to[e], d + cost[e] + potential[x] - potential[to[e]]
                if room[e] and far < best.get(y, far + 1):
                    best[y], via[y] = far, e
                    heapq.heappush(queue, (far, y))
        if sink not in best:
            return [room[2 * k + 1] for k in range(len(edges))]
        for x in range(n):
            potential[x] += best.get(x, best[sink])
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


@dataclass
class Plan:
    """``docs``: (doc_id, source, tokens, pattern); ``flow``: tokens times ``PARTS`` by (pattern, source); ``capacity``:
    the tokens there are; ``targets``: (share, most repeats) of each source; ``total``: T."""

    docs: DataFrame
    flow: dict[tuple[int, str], int]
    capacity: dict[tuple[int, str], int]
    targets: dict[str, tuple[int, int]]
    total: int


def plan(docs: DataFrame, targets: DataFrame, tokens: Column) -> Plan:
    """Route tokens to quotas. ``docs(doc_id, text, source)``, ``targets(source, share_bp, max_repeat)``."""
    wish = targets.groupBy(category(F.col("source")).alias("source")).agg(F.sum("share_bp").cast("long").alias("bp"), F.max("max_repeat").cast("long").alias("most")).filter("source is not null").collect()
    want = {r["source"]: (r["bp"] or 0, r["most"] or 0) for r in sorted(wish, key=lambda r: r["source"])}
    names = sorted(want)
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    d = docs.filter(F.col("doc_id").isNotNull()).withColumn("s", category(F.col("source"))).filter(F.col("s").isin(names))
    d = d.select("doc_id", F.col("s").alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_id")).filter("tokens > 0")
    d = write_table(d.groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "text_id")).alias("v")).select("doc_id", "v.*"), "mix_documents")
    bit = F.lit(0).cast("long")
    for k, s in enumerate(names):
        bit = F.when(F.col("source") == s, F.lit(1 << k).cast("long")).otherwise(bit)
    texts = d.groupBy("text_id").agg(F.bit_or(bit).alias("pattern"), F.max("tokens").alias("unique"))
    unique = {r["pattern"]: int(r["u"]) for r in texts.groupBy("pattern").agg(F.sum("unique").alias("u")).collect()}  # at most one a set of sources
    d = write_table(d.join(texts.select("text_id", "pattern"), "text_id").select("doc_id", "source", "tokens", "pattern"), "mix_patterns")
    there = {(r["pattern"], r["source"]): int(r["t"]) for r in d.groupBy("pattern", "source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(there.values())

    at = {p: 2 + k for k, p in enumerate(sorted(unique))}
    of = {s: 2 + len(at) + k for k, s in enumerate(names)}
    edges = []
    for p, u in sorted(unique.items()):
        room = sum(t * want[s][1] for (q, s), t in there.items() if q == p)
        for level in range(max(m for _, m in want.values())):
            edges.append((0, at[p], u * PARTS, level))
        edges.append((0, at[p], room * PARTS, max(m for _, m in want.values())))
    routes = sorted(there)
    begin = len(edges)
    edges += [(at[p], of[s], there[p, s] * want[s][1] * PARTS, 0) for p, s in routes]
    edges += [(of[s], 1, bp * total, 0) for s, (bp, _) in want.items()]
    flow = min_cost_flow(2 + len(at) + len(of), edges, 0, 1)
    return Plan(d, dict(zip(routes, flow[begin:])), there, want, total)


def choose(p: Plan, seed: int = 17) -> DataFrame:
    """``(doc_id, source, tokens, repeats)``: how often each document is taken. All documents of a pattern and source are
    taken as often as the flow holds them whole; those first in the seeded order once more, up to the flow."""
    spark = p.docs.sparkSession
    rows = []
    for key, t in sorted(p.capacity.items()):
        whole, rest = divmod(p.flow.get(key, 0), t * PARTS) if t else (0, 0)
        rows.append((*key, whole, rest / PARTS))
    plan_df = spark.createDataFrame(rows, "p long, s string, whole long, rest double")
    n = p.docs.count()
    d = running_sum(p.docs, ["pattern", "source"], seeded(F.col("doc_id"), seed=seed), F.col("tokens"), max(1, -(-n // CELL_ROWS)), "before")
    d = d.join(F.broadcast(plan_df), (F.col("pattern") == F.col("p")) & (F.col("source") == F.col("s")))  # a row a pattern and source
    more = (F.col("before") + F.col("tokens") / 2 < F.col("rest")).cast("long")
    return d.select("doc_id", "source", "tokens", (F.col("whole") + more).alias("repeats")).filter("repeats > 0")


def report(p: Plan, chosen: DataFrame | None = None) -> DataFrame:
    """A row a source: ``target_share, quota_tokens, own_tokens, max_repeat, routed_tokens, short`` and, of ``chosen``,
    ``actual_tokens, actual_share``. short: the quota is beyond what the repeats allow."""
    rows = []
    for s, (bp, most) in p.targets.items():
        own = sum(t for (_, q), t in p.capacity.items() if q == s)
        routed = sum(f for (_, q), f in p.flow.items() if q == s)
        rows.append((s, bp / PARTS, bp * p.total / PARTS, own, most, routed / PARTS, routed < bp * p.total))
    got = p.docs.sparkSession.createDataFrame(rows, "source string, target_share double, quota_tokens double, own_tokens long, max_repeat long, routed_tokens double, short boolean")
    if chosen is None:
        return got
    used = chosen.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"))
    got = got.join(used, F.col("source") == F.col("s"), "left").drop("s").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    every = sum(r["actual_tokens"] for r in used.collect()) or 1  # a row a source
    return got.withColumn("actual_share", F.col("actual_tokens") / F.lit(float(every)))
