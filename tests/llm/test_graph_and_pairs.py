import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirmill.llm import overlap, sample, splits
from weirmill.llm.ordered import running_sum, seeded

TARGETS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]
ROWS = "record long, author string, site string, label string, split string, component string"


def _graph(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return splits.build(df, "record", ["author", "site"], F.col("label"), F.col("split"))


def test_groups_follow_shared_entities(spark):
    rnd = random.Random(4)
    data = [(i, f"a{rnd.randrange(150)}" if rnd.random() < 0.8 else None, f"s{rnd.randrange(120)}" if rnd.random() < 0.5 else None, rnd.choice(["p", "b", None]), rnd.choice(["train", "val", None]), "x") for i in range(300)]
    data += [(7, "a1", "s2", "p", "test", "x"), (7, "a1", "s2", "p", "test", "x"), (None, "a1", "a2", "p", "train", "x")]
    g = _graph(spark, data)
    got = {r.record: r.component for r in splits.grouped(g).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, a, s, *_ in data:
        for e in (a and f"0:{a}", s and f"1:{s}"):
            if r is not None and e:
                up[find(e)] = find(r)
    assert set(got) == set(range(300))
    want = {}
    for r in range(300):
        want.setdefault(find(r), set()).add(got[r])
    assert all(len(c) == 1 for c in want.values()) and len(want) == len(set(got.values()))
    by = {}
    for r, a, s, _, split, _ in data:
        for e in (a and f"0:{a}", s and f"1:{s}"):
            if r is not None and e and split:
                by.setdefault(e, set()).add(split)
    assert {r.entity for r in splits.split_entities(g).collect()} == {e for e, v in by.items() if len(v) > 1}


def test_long_chain_is_one_group(spark):
    g = _graph(spark, [(i, f"a{i:03d}", f"a{i + 1:03d}", "p", None, "x") for i in range(60)] + [(100, "a000", None, "p", None, "x")])
    edges = spark.createDataFrame([(i, f"e{i + k:03d}") for i in range(60) for k in (0, 1)], "record long, entity string")
    assert {r.component for r in splits.propagate(edges).collect()} == {"e000"}
    assert splits.grouped(g).filter("record = 100 or record = 0").select("component").distinct().count() == 1


def test_split_shares(spark):
    rnd = random.Random(5)
    data = [(i, "hot" if rnd.random() < 0.3 else f"a{rnd.randrange(4000)}", None, rnd.choices(["p", "b", "r", "q", None], [80, 15, 2, 0.1, 3])[0], None, "x") for i in range(20_000)]
    got = splits.assign(_graph(spark, data), TARGETS)
    rows = got.collect()
    assert len(rows) == len({r.record for r in rows}) == 20_000
    assert got.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    for s, p in TARGETS:
        assert abs(sum(r.split == s for r in rows) / 20_000 - p) < 0.01
    report = splits.report(got, spark.createDataFrame([("train", 7000), ("val", 1500), ("test", 1500)], "split string, share_bp long"))
    n = Counter(r[3] or "" for r in data)
    assert report.count() == 15 and all(abs(r.deviation) < 0.01 for r in report.collect() if n[r.label] >= 400)
    assert all(abs(r.deviation) * n[r.label] <= 6 for r in report.collect() if n[r.label] < 400)
    assert splits.assign(_graph(spark, []), TARGETS).count() == 0
    assert {tuple(r) for r in splits.assign(_graph(spark, data), TARGETS).collect()} == {tuple(r) for r in rows}


def test_running_sum(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, i % 5) for i in range(500)], "g int, id long, v long")
    got = running_sum(df, ["g"], seeded(F.col("id"), seed=1), F.col("v"), 9, "b").withColumn("h", seeded(F.col("id"), seed=1)).collect()
    for g in (0, 1, 2, None):
        run = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.h):
            assert r.b == run
            run += r.v
    assert len(got) == 500


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("alphabet", ["ab.", "abcdefghijklmnop0123456789ệ."])
def test_near_strings_match_brute_force(spark, alphabet):
    rnd = random.Random(6)
    base = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 24))) for _ in range(150)} | {"aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000 + ".test"}
    other = set(list(base)[:40])
    for s in base:
        i = rnd.randrange(len(s))
        other |= {s[:i] + s[i + 1 :], s[:i] + "q" + s[i:], s[:i] + "z" + s[i + 1 :], s + s[-1]}
    other = {s for s in other if len(s) > 1}
    want = {(a, b) for a in base for b in other if _one_edit(a, b)}
    frame = lambda x: spark.createDataFrame([(s,) for s in sorted(x)], "text string")
    got = overlap.near_strings(frame(base), frame(other)).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(0 < r.cosine <= 1 for r in got)


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_cosine_join_matches_brute_force(spark, threshold):
    rnd = random.Random(12)
    words = ["login", "bank", "pay", "post", "shop", "mail", "a", "zz"]
    base = sorted({"-".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) + rnd.choice([".test", ".example"]) for _ in range(160)})
    other = sorted({s if rnd.random() < 0.2 else s[: (i := rnd.randrange(len(s)))] + rnd.choice(["x", "", "-new"]) + s[i:] for s in base} | {"x", "y" * 300})
    n = np.bincount((overlap.grams(base + other, overlap.GRAM)[2] % np.uint64(overlap.CELLS)).astype(int), minlength=overlap.CELLS)
    weights = 1 + np.log(n.max() / np.maximum(n, 1))
    vector = lambda s: Counter(int(x) for x in overlap.grams([s], overlap.GRAM)[2])
    w = lambda x: weights[x % overlap.CELLS]
    va, vb = {s: vector(s) for s in base}, {s: vector(s) for s in other}
    norm = lambda v: sum(c * w(x) for x, c in v.items()) ** 0.5
    want = {}
    for a, x in va.items():
        for b, y in vb.items():
            cos = sum(min(c, y[g]) * w(g) for g, c in x.items()) / (norm(x) * norm(y))
            if cos >= threshold:
                want[a, b] = cos
    frame = lambda x: spark.createDataFrame([(s,) for s in [*x, None]], "text string").filter("text is not null")
    got = {(r.a, r.b): r.cosine for r in overlap.cosine_join(frame(base), frame(other), threshold).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 30
    assert overlap.cosine_join(frame(base), frame([]), threshold).count() == 0


def test_hot_hosts_are_spread(spark, rows):
    data = [(i, "hot.test", "train") for i in range(4000)] + [(10_000 + i, h, "val") for i, h in enumerate(["hots.test", "hot.test", "cold.test"])] + [(20_000 + i, f"c{i:04d}.example", "train") for i in range(2000)]
    df = spark.createDataFrame(data, "record_id long, host string, split string")
    pairs = overlap.host_pairs(df)
    got = overlap.record_pairs(df, pairs)
    assert rows(got) == {(i, j) for i in range(4000) for j in (10_000, 10_001)}
    join = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("salt" in x for x in join)
    counted = rows(overlap.pair_counts(df, pairs))
    assert counted == {("hot.test", "hot.test", False, 4000, 1), ("hot.test", "hots.test", True, 4000, 1)}


def test_record_pairs(spark, rows):
    data = [(1, "a.test", "train"), (1, "a.test", "train"), (2, "a.test", "val"), (3, "b.test", "test"), (4, "ab.test", "val"), (5, None, "val"), (None, "a.test", "val"), (6, "a.test", None), (7, "zz.test", "train")]
    df = spark.createDataFrame(data, "record_id long, host string, split string").withColumn("text", F.lit("clash"))
    pairs = overlap.host_pairs(df)
    assert rows(overlap.record_pairs(df, pairs)) == {(1, 2), (1, 3), (1, 4)}
    rep = overlap.report(df.withColumn("source", F.lit(None).cast("string")), pairs)
    assert rows(rep) == {("val", None, 3, 1, 2), ("test", None, 1, 0, 1)}
    assert overlap.record_pairs(df.limit(0), overlap.host_pairs(df.limit(0))).count() == 0


def test_draw(spark):
    data = [(i, ("x" if i % 10 < 6 else "y" if i % 10 < 9 else None)) for i in range(5000)] + [(1, "x"), (None, "x"), (6000, "rare"), (6001, "rare")]
    units = spark.createDataFrame(data, "id long, category string").withColumn("p", F.lit(1))
    targets = spark.createDataFrame([("x", 5000, 10, 1), ("y", 3000, 10, 1), ("rare", 10, 10, 3), ("none", 10, 10, 1), (None, 5, 5, 5), ("y", 3000, 10, 1)], "category string, share_bp long, draw_pct long, min_rows long")
    old, sample.CELL_ROWS = sample.CELL_ROWS, 40
    try:
        s, report = sample.draw(units, targets)
        drawn = s.collect()
        again = {tuple(r) for r in sample.draw(units, targets)[0].collect()}
    finally:
        sample.CELL_ROWS = old
    r = {x.category: x for x in report.collect()}
    assert (r["x"].wanted, r["x"].drawn, r["y"].wanted, r["y"].drawn) == (251, 251, 151, 151)
    assert r["rare"].short and r["rare"].drawn == 2 and r["rare"].residual == -1 and r["none"].short and not r["x"].short
    assert len({x.id for x in drawn}) == len(drawn) == 404 and again == {tuple(x) for x in drawn}
    assert sample.draw(units.limit(0), targets)[1].filter("short").count() >= 1


def test_inclusion_is_even():
    import numpy as np

    hits = np.zeros(60)
    for seed in range(400):
        p = sample.flight(np.arange(60), np.zeros(60, int), np.full(60, 15), np.full(60, 60), seed, 0)
        assert p.sum() == 900 and set(p) <= {0, 60}
        hits += p == 60
    assert abs(hits / 400 - 0.25).max() < 0.11
