import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirmill.llm import bitmaps, frequency, leak, mixing, skeleton
from weirmill.session import scratch_path


def _brute(rows):
    occ, rec = {}, {}
    for r, *vs in rows:
        for f, v in zip("ab", vs):
            if v is not None:
                occ[f, v] = occ.get((f, v), 0) + 1
                rec.setdefault((f, v), set()).add(r)
    return {k: (n, len(rec[k] - {None})) for k, n in occ.items()}


def test_counts_follow_changes(spark):
    store = frequency.TermCounts(spark, scratch_path(spark, "t"), ["a", "b"], log_buckets=4, count_buckets=4)
    schema = "record long, a string, b string, op string"
    rnd = random.Random(7)
    rows = []
    for step in range(4):
        batch = [(rnd.randrange(30), rnd.choice("xyz"), rnd.choice(["p", None, f"u{step}"]), "add") for _ in range(40)] + [(None, "x", None, None)]
        fresh = [(100 + step, "x", "q", "replace"), (step, "w", "q", "replace"), (step, "w2", None, "replace"), (step + 10, None, None, "delete")]
        gone = {step, step + 10}
        batch = [r for r in batch if r[0] not in gone]
        rows = [r for r in rows if r[0] not in gone] + [r[:3] for r in batch + fresh if r[3] != "delete"]
        store.apply(spark.createDataFrame(batch + fresh, schema).withColumn("n", F.lit(9)))
        store = frequency.TermCounts(spark, store.path, ["a", "b"], log_buckets=4, count_buckets=4)  # as found on disk
        got = {(r.field, r.value): (r.occurrences, r.records) for r in store.counts().filter("field <> '*'").collect()}
        assert got == _brute(rows)
    total = store.counts().filter("field = '*'").first()
    assert (total.occurrences, total.records) == (len(rows), len({r[0] for r in rows} - {None}))
    before = store.manifest["version"]
    store.apply(spark.createDataFrame([], schema))
    assert store.manifest["version"] == before + 1 and {(r.field, r.value): (r.occurrences, r.records) for r in store.counts().filter("field <> '*'").collect()} == _brute(rows)
    marks = store.marked(F.col("total") / 5, F.col("total") / 2).collect()
    assert {r.mark for r in marks} == {"rare", "common", None}
    assert all((r.mark == "rare") == (r.records * 5 < total.records) and (r.mark == "common") == (r.records * 2 > total.records) for r in marks)


def test_a_batch_reads_what_it_touches(spark, monkeypatch):
    schema = "record long, a string, b array<string>, op string"
    store = frequency.TermCounts(spark, scratch_path(spark, "t"), ["a", "b"], log_buckets=8, count_buckets=8)
    want = {}
    monkeypatch.setattr(frequency, "PARTS", 3)
    read, plain = [], frequency.TermCounts.log
    monkeypatch.setattr(frequency.TermCounts, "log", lambda self, buckets=None: read.append(buckets) or plain(self, buckets))
    for step in range(frequency.PARTS + 3):
        batch = [(i, f"v{i % 3}", ["x", "x", f"w{i}", None], "add") for i in range(200)] if step == 0 else [(7, f"new{step}", None if step % 2 else [], "replace")]
        read.clear()
        store.apply(spark.createDataFrame(batch, schema))
        if step:
            assert all(len(b) == 1 for b in read if b) and read
            held = plain(store, read[-1])
            plan = held._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") <= frequency.PARTS and len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) == plan.count("FileScan")
            assert held.select(F.input_file_name().alias("f")).distinct().count() <= frequency.PARTS
        want |= {r[0]: r for r in batch}
    got = {(r.field, r.value): (r.occurrences, r.records) for r in store.counts().collect()}
    occ = {}
    for r in want.values():
        for k in [("*", "*"), ("a", r[1]), *(("b", v) for v in r[2] or [] if v)]:
            occ.setdefault(k, []).append(r[0])
    assert got == {k: (len(v), len(set(v))) for k, v in occ.items()}


def test_a_failed_batch_changes_nothing(spark, monkeypatch):
    schema = "record long, a string, op string"
    path = scratch_path(spark, "t")
    store = frequency.TermCounts(spark, path, ["a"], 2, 2)
    store.apply(spark.createDataFrame([(1, "x", "add")], schema))
    more = spark.createDataFrame([(2, "x", "add"), (1, "y", "replace")], schema)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(frequency, "put_text", crash)
    with pytest.raises(OSError):
        store.apply(more)
    monkeypatch.undo()
    for again in (store, frequency.TermCounts(spark, path, ["a"])):
        assert {tuple(r) for r in again.counts().filter("field = 'a'").collect()} == {("a", "x", 1, 1)}
    store.apply(more)
    assert {tuple(r) for r in frequency.TermCounts(spark, path, ["a"]).counts().filter("field = 'a'").collect()} == {("a", "x", 1, 1), ("a", "y", 1, 1)}
    late = frequency.TermCounts(spark, path, ["a"])
    late.manifest = {**late.manifest, "version": late.manifest["version"] - 1}  # another writer was first
    with pytest.raises(FileExistsError):
        late.apply(more)
    assert {tuple(r) for r in frequency.TermCounts(spark, path, ["a"]).counts().filter("field = 'a'").collect()} == {("a", "x", 1, 1), ("a", "y", 1, 1)}


def test_bitmaps_are_exact_and_merge(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(["s", "t", None]), f"h{rnd.randrange(5000)}" if rnd.random() < 0.95 else None) for _ in range(6000)]
    df = spark.createDataFrame(rows, "day int, src string, host string").withColumn("bucket", F.lit(1))
    got = {(r.grouping, r.day, r.src): r.distinct_count for r in bitmaps.distinct_counts(df, ["day", "src"], "host", "day").collect()}
    want = {}
    for d, s, h in rows:
        if h:
            for k in (("day+src", d, s), ("day", d, None), ("src", None, s), ("", None, None)):
                want.setdefault(k, set()).add(h)
    assert got == {k: len(v) for k, v in want.items()}
    monkeypatch.setattr(bitmaps, "PART_ROWS", 500)
    codes = [(r.bucket, r.bit) for r in bitmaps.dictionary(df, ["day", "src"], "host", "day").collect()]
    assert len(set(codes)) == len(codes) == len({h for _, _, h in rows if h})
    parts_of = {}
    for bucket, bit in codes:
        parts_of.setdefault(bucket >> 24, []).append((bucket & 0xFFFFFF) * bitmaps.WIDTH + bit)
    assert len(parts_of) > 4 and all(sorted(v) == list(range(len(v))) for v in parts_of.values())  # dense within a part
    assert {(r.grouping, r.day, r.src): r.distinct_count for r in bitmaps.distinct_counts(df, ["day", "src"], "host", "day").collect()} == got
    parts = bitmaps.containers(df, ["day", "src"], "host", "day").filter("src is not null").persist()
    by = bitmaps.merge(parts, ["src"]).persist()
    both = bitmaps.common(by.filter("src = 's'"), by.filter("src = 't'")).first().common_count
    assert both == len({h for _, s, h in rows if s == "s" and h} & {h for _, s, h in rows if s == "t" and h})
    every = {(r.a, r.b): r.common_count for r in bitmaps.common_of_all(by, "src").collect()}
    assert every == {("s", "t"): both}
    twice = bitmaps.merge(parts.unionAll(parts), ["day", "src"])
    assert {tuple(r) for r in bitmaps.count(twice, ["src"]).collect()} == {tuple(r) for r in bitmaps.count(parts, ["src"]).collect()}
    assert bitmaps.distinct_counts(df.limit(0), ["day", "src"], "host", "day").filter("distinct_count > 0").count() == 0


def test_skeleton(spark):
    one = skeleton.skeleton
    same = [
        ("Đường dẫn", unicodedata.normalize("NFD", "Đường dẫn")), ("Đường", "Ðường"), ("paypal", "раураӏ"), ("code 12", "ｃｏｄｅ　１２"), ("find", "ﬁnd"), ("a b", " a \n\n b "),
        ("people", "peo­p​le"), ("x-y", "x‑y"), ("Tel", "Τеl"), ("ấ", "ấ"), ("giá", "ɡіá"),
    ]
    for a, b in same:
        assert one(a) == one(b), (a, b)
    ascii_ = [chr(c) for c in range(33, 127)]
    assert len({one(c) for c in ascii_}) == len(ascii_)
    for a, b in [("a", "á"), ("A", "a"), ("rn", "m"), ("0", "O"), ("1", "l"), ("ab", "a b"), ("ạ", "ậ"), ("đ", "d")]:
        assert one(a) != one(b)
    assert one(None) is None and one("​ \n") == "" and one("") == ""
    assert [v for v in skeleton.look_alikes().values() if one(v) != v] == []
    blanks = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert all(skeleton.reader().prototypes[ord(c)] == " " for c in blanks)
    long = "ѕрасе " * 200_000
    assert one(one(long)) == one(long) == ("space " * 200_000).strip()


def test_letters_of_one_shape_in_any_script(spark):
    for c, to in zip("\u03f9\u050c\u13aa\u2c9f\ua4ee\u217d\u2160\u216f\ua4f2\u2c9e", "CGAoAcIMIO"):
        assert skeleton.skeleton(f"a{c}") == "a" + to
        assert skeleton.words(f"A{c}") == ["a" + to.lower()]
    assert skeleton.skeleton("\u2167") == "VIII"


def test_look_alike_pairs(spark, rows):
    texts = ["paypal a", "раураӏ a", "paypal  a", "paypal a", "", None, "Paypal a", "​", " ", "other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text_id", F.lit(0))
    docs = docs.unionAll(docs.filter("doc_id = 1")).unionAll(docs.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    want = {(i, j) for i, j in itertools.combinations(range(10), 2) if texts[i] and texts[j] and texts[i] != texts[j] and skeleton.skeleton(texts[i]) == skeleton.skeleton(texts[j])}
    assert rows(skeleton.look_alike_pairs(docs)) == want == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (7, 8)}
    assert skeleton.class_report(docs).filter("doc_id = 0").first().variants == 3
    assert skeleton.look_alike_pairs(docs.limit(0)).count() == 0


def test_leaks_match_brute_force(spark, rows, monkeypatch):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)] + ["ngân", "hàng", "Đèo"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(8, 40)))) for i in range(30)] + [(90, None), (91, ""), (None, "w1 " * 20)]
    docs = []
    for i in range(120):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            s = items[rnd.randrange(30)][1].split()
            k = rnd.randrange(len(s))
            part = s[k : k + rnd.randint(9, 16)]
            w[3:3] = [x.upper().replace("A", "Α") if rnd.random() < 0.3 else x + "," for x in part]
        docs.append((i, "  ".join(w)))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (None, items[0][1]), (502, "filler " * 100_000 + items[3][1] + " " + items[4][1])]
    grams = {i: {tuple(ws[k : k + 12]) for k in range(len(ws) - 11)} for i, t in items if i is not None for ws in [skeleton.words(t)]}
    want = {(d, i) for d, t in docs if d is not None for ws in [skeleton.words(t)] for k in range(len(ws) - 11) for i, g in grams.items() if tuple(ws[k : k + 12]) in g}
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumn("at", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = leak.leaks(*frames)
    assert rows(leak.pairs(got)) == want and len(want) > 20
    assert leak.leaks(frames[0], frames[1].limit(0)).count() == 0 and leak.leaks(frames[0].limit(0), frames[1]).count() == 0
    covered = {}
    for d, t in docs:
        if d is not None:
            held = {tuple(ws[k : k + 12]) for ws in [skeleton.words(t)] for k in range(len(ws) - 11)}
            for i, t2 in items:
                ws = skeleton.words(t2)
                at = [k for k in range(len(ws) - 11) if i is not None and tuple(ws[k : k + 12]) in held]
                if at:
                    covered[d, i] = max(covered.get((d, i), (0, 0)), (len({k + x for k in at for x in range(12)}), len(ws)))
    assert {(r.doc_id, r.item_id): (r.shared_words, r.item_words) for r in leak.shared(got).collect()} == covered
    assert leak.item_report(got).count() == len({i for _, i in want})
    full = np.full(1 << (leak.LEAST_BITS - 3), 255, np.uint8)  # a filter that lets everything through loses nothing
    monkeypatch.setattr(leak, "_filter", lambda *_: (full, leak.LEAST_BITS))
    monkeypatch.setattr(leak, "small", lambda *_: False)  # and neither does the salted join
    monkeypatch.setattr(leak, "CHUNK", 500)
    assert rows(leak.pairs(leak.leaks(*frames))) == want


def test_words_of_pieces_are_words_of_the_text(spark):
    form = skeleton.reader()
    rnd = random.Random(11)
    alphabet = "aΣσς.' \u2028\t\u00a0é\u0301\u200bİıДж-_ｆﬁⅣ가\u1100\u1161ǅß½①ấ\u3000\u0345"
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        assert form.words(text) == list(form._read(text)), text
        assert len(form.word_hashes(text)) == len(form.words(text))
    assert form.words(None) == [] and len(form.word_hashes(None)) == 0


def test_flow_is_cheapest():
    edges = [(0, 2, 5, 0), (0, 2, 5, 1), (0, 3, 4, 0), (2, 4, 10, 0), (3, 4, 4, 0), (3, 5, 4, 0), (4, 1, 7, 0), (5, 1, 4, 0)]
    flow = mixing.min_cost_flow(6, edges, 0, 1)
    assert flow[6] + flow[7] == 11 and sum(f * e[3] for f, e in zip(flow, edges)) == 2


def test_mix(spark, rows):
    rnd = random.Random(10)
    docs = [(i, " ".join("w" for _ in range(rnd.randint(1, 50))) + f" d{i}", rnd.choice(["A", " a", "b", "B\n", "c", None, "zz"])) for i in range(600)]
    docs += [(1000, docs[0][1], "b"), (1001, None, "a"), (1002, "", "c"), (5, docs[5][1], docs[5][2]), (None, "x", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("pattern", F.lit(1)).withColumn("tokens", F.lit(2))
    targets = spark.createDataFrame([("a", 3000, 2), ("b", 2000, 2), ("c", 4900, 2), ("none", 100, 5)], "source string, share_bp long, max_repeat long")
    p = mixing.plan(df, targets, F.size(F.split("text", " ")).cast("long") * F.col("text").isNotNull().cast("long"))
    chosen = mixing.choose(p)
    report = {r.source: r for r in mixing.report(p, chosen).collect()}
    own = {s: report[s].own_tokens for s in report}
    for s, (bp, most) in p.targets.items():
        assert report[s].short == (bp * p.total > most * own[s] * 10_000)
        assert abs(report[s].routed_tokens - min(bp * p.total / 10_000, most * own[s])) < 1e-6
        assert abs(report[s].actual_tokens - report[s].routed_tokens) <= 51
    assert report["none"].short and all(r.repeats <= p.targets[r.source][1] for r in chosen.collect())
    assert rows(chosen) == rows(mixing.choose(p))
    empty = mixing.plan(df.limit(0), targets, F.lit(0).cast("long"))
    assert mixing.choose(empty).count() == 0 and mixing.report(empty).count() == 4
