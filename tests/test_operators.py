import datetime as dt
import itertools
import json
import random
import unicodedata

from pyspark.sql import functions as F

from weirmill.functions import text
from weirmill.operators import audit, contract, groups, matching, metrics, models
from weirmill.operators.skew import two_stage
from weirmill.streaming import navigation

SCORED = [(s, 1) for s in (0.9, 0.8, 0.8, 0.4)] + [(s, 0) for s in (0.8, 0.3, 0.2, 0.1)]


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_thresholds(spark):
    s = scored(spark, [*SCORED, (None, 1), (0.95, None)])
    r = metrics.threshold_at(s, 0.25).first()
    assert (r.threshold, r.tp, r.fp) == (0.4, 4, 1)
    assert metrics.threshold_at(s, 0.01).first().threshold == 0.9
    assert metrics.threshold_at(scored(spark, [(0.9, 0), (0.5, 1)]), 0.01).first().undefined_reason == "no_feasible"
    assert metrics.threshold_at(scored(spark, [(0.9, 1)]), 0.01).first().undefined_reason == "no_benign"
    assert metrics.threshold_at(scored(spark, []), 0.01).first().undefined_reason == "no_benign"


def test_confusion_and_precision(spark):
    c = metrics.confusion(scored(spark, [*SCORED, (None, 1)]), 0.8).first()
    assert (c.tp, c.fn, c.fp, c.tn, c.recall) == (3, 1, 1, 3, 0.75)
    assert metrics.pr_auc(scored(spark, SCORED)).first()[0] == round(0.25 + 0.5 * 0.75 + 0.25 * 0.8, 9)
    assert metrics.pr_auc(scored(spark, [])).first()[0] is None


def test_kappa(spark):
    pairs = [("p", "p")] * 20 + [("p", "b")] * 5 + [("b", "p")] * 10 + [("b", "b")] * 15 + [(None, "p")]
    k = metrics.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert (k.n, k.p_o, k.p_e, k.kappa) == (50, 0.7, 0.5, 0.4)
    assert metrics.kappa(spark.createDataFrame([("p", "p")], "a string, b string"), "a", "b").first().kappa is None


def test_bootstrap_draws_all_groups(spark):
    s = spark.createDataFrame([(f"g{i}", 0.5, i % 2) for i in range(6)], "g string, score double, label int")
    got = {(r.metric, r.config): r for r in metrics.bootstrap(s, "g", {"a": 0.4, "b": 0.9}, 200).collect()}
    assert got["recall", "a"].low == got["recall", "a"].high == 1.0 and got["recall_delta", "b-a"].high == -1.0
    assert got["recall", "a"].n_valid + got["recall", "a"].n_invalid == 200 and got["recall", "a"].n_invalid > 0


def test_audit(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, ""), ("b", "x")], "p string, q string")
    n = {(r.dim, r.value): r.n for r in audit.value_counts(df, ["p", "q"]).collect()}
    assert n == {("p", "a"): 2, ("p", None): 1, ("p", "b"): 1, ("q", "x"): 2, ("q", None): 1, ("q", ""): 1}
    assert tuple(audit.distinct_values(df, "q").first()) == (4, 3)
    one = audit.digest(df, ["p", "q"]).first().sha256
    assert one == audit.digest(df.repartition(3).orderBy(F.desc("q")), ["p", "q"]).first().sha256
    assert one != audit.digest(df.unionAll(df), ["p", "q"]).first().sha256


def test_date_audit_reads_one_column(spark, tmp_path):
    rows = [("2024-09-30", 1), ("2024-10-01", 2), (None, 3), ("2025-02-30", 4), ("n/a", 5), (" ", 6)]
    spark.createDataFrame(rows, "date string, label int").write.parquet(str(tmp_path / "c"))
    df = audit.date_audit(spark.read.parquet(str(tmp_path / "c")), "date")
    assert "ReadSchema: struct<date:string>" in df._jdf.queryExecution().toString()
    got = {r.month: (r.rows, r.missing, r.invalid) for r in df.collect()}
    assert got == {dt.date(2024, 9, 1): (1, 0, 0), dt.date(2024, 10, 1): (1, 0, 0), None: (4, 2, 2)}


def test_two_stage_is_exact_on_hot_keys(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(50)}", rnd.randrange(400), rnd.random()) for _ in range(3000)] + [(None, 1, 0.0), ("hot", None, 0.5)]
    df = spark.createDataFrame(data, "key string, record_id long, v double")
    got = two_stage(df, ["key"], "record_id", [F.count("*").alias("rows"), F.max("v").alias("v")], [F.sum("rows").alias("rows"), F.count("record_id").alias("records"), F.max("v").alias("max_v")])
    want = {k: (len(g := [x for x in data if x[0] == k]), len({x[1] for x in g} - {None}), max(x[2] for x in g)) for k in {x[0] for x in data} - {None}}
    assert {r.key: (r.rows, r.records, r.max_v) for r in got.filter("key is not null").collect()} == want
    assert two_stage(df.limit(0), ["key"], "record_id", [F.count("*").alias("rows")], [F.sum("rows").alias("rows")]).count() == 0


def test_components_and_folds(spark, rows):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (5, 5)], "id_a long, id_b long")
    got = dict(rows(groups.components(nodes, edges)))
    assert {got[i] for i in range(21)} == {0} and got[31] == 30 and got[25] == 25
    df = spark.createDataFrame([(f"g{i // 3}", i % 2) for i in range(60)] + [(None, 1)], "g string, y int")
    f = groups.folds(df, "g", F.col("y") == 1, 5, [17, 42]).collect()
    assert len(f) == 40 and {sum(1 for r in f if r.seed == 17 and r.fold == k) for k in range(5)} == {4}


def test_near_duplicates_match_brute_force(spark, rows):
    rnd = random.Random(2)
    texts = []
    for _ in range(40):
        w = [rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(60)]
        texts += [" ".join(w), " ".join([*w[:-1], "z"]), " ".join(w[:30])]
    texts += [texts[0], None, "", "one two"]
    sh = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set()
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    want = {(i, j) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if len(sh(a) & sh(b)) >= 0.8 * len(sh(a) | sh(b))}
    got = rows(groups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").select("id_a", "id_b"))
    assert got == want and len(want) >= 40


def test_temporal_keeps_days_whole(spark):
    rows = [(f"g{i % 7}", dt.date(2024, 1, 1 + i // 4)) for i in range(40)] + [("g1", None)]
    got = groups.temporal(spark.createDataFrame(rows, "g string, d date"), "d", "g").collect()
    by_day = {}
    for r in got:
        by_day.setdefault(r.d, set()).add(r.period)
    assert all(len(p) == 1 for p in by_day.values())
    assert {r.dropped_reason for r in got if r.d is None} == {"no_date"} and any(r.dropped_reason == "group_seen_earlier" for r in got)


def test_matching(spark, rows):
    dic = spark.createDataFrame([("O1", "Sao Khuê Bank", ["SKB"], None), ("O2", "Micro", None, ["paypal"])], "org_id string, display_name string, aliases array<string>, service_names array<string>")
    docs = spark.createDataFrame([(1, "SKB và sao khuê bank, skbx"), (2, None), (3, "")], "id long, t string")
    assert rows(matching.alias_matches(docs, "id", "t", dic)) == {(1, "O1", "skb", 1), (1, "O1", "sao khuê bank", 1)}
    values = spark.createDataFrame([("paypa1",), ("Micr0",), ("mcro",), ("skb",), (None,), ("sao khue bank",)], "v string")
    assert rows(matching.fuzzy_aliases(values, "v", dic).select("value", "alias", "distance")) == {("paypai", "paypal", 1), ("micro", "micro", 0), ("mcro", "micro", 1), ("sao khue bank", "sao khuê bank", 1)}
    rules = spark.createDataFrame([("O1", "brand.test", "first_party_identity"), ("O1", "sites.brand.test", "user_content_hosting")], "org_id string, hostname string, role string")
    hosts = spark.createDataFrame([("login.brand.test",), ("notbrand.test",), ("brand.example.net",), ("u.sites.brand.test",)], "h string")
    assert rows(matching.boundary_matches(hosts, "h", rules).select("host", "role")) == {("login.brand.test", "first_party_identity"), ("u.sites.brand.test", "user_content_hosting")}
    assert "NestedLoop" not in matching.boundary_matches(hosts, "h", rules)._jdf.queryExecution().toString()


def test_names_in_any_spelling(spark, rows):
    dic = spark.createDataFrame([("O1", unicodedata.normalize("NFD", "Sao Khuê Bank"), ["SKB"], None), ("O2", "Điện", None, ["paypal"])], "org_id string, display_name string, aliases array<string>, service_names array<string>")
    texts = ["Sao Khuê Bank", unicodedata.normalize("NFD", "SAO KHUÊ BANK"), "Ｓａｏ Khuê Bank", "Sao Khu\u00adê Ba\u200bnk", "sao khue bank", "dien DIEN Điện", "SKB™ 𝗦𝗞𝗕 pay\u2060pal", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = [(i, "O1", "sao khuê bank", 1) for i in range(4)] + [(5, "O2", "điện", 1), (6, "O1", "skb", 2), (6, "O2", "paypal", 1)]
    assert rows(matching.alias_matches(docs, "id", "t", dic)) == set(found)
    bare = {r[:4] for r in rows(matching.alias_readings(docs, "id", "t", dic).filter("reading = 'no_accents'").select("id", "org_id", "alias", "occurrences"))}
    assert bare == {*found, (4, "O1", "sao khuê bank", 1), (5, "O2", "điện", 3)} - {(5, "O2", "điện", 1)}
    values = spark.createDataFrame([(t,) for t in texts[:4]], "v string")
    assert rows(matching.fuzzy_aliases(values, "v", dic).select("value", "alias", "distance")) == {("sao khuê bank", "sao khuê bank", 0)}


def test_fuzzy_names_with_digits(spark, rows):
    dic = spark.createDataFrame([("O1", "bank 1010", ["a100"], None)], "org_id string, display_name string, aliases array<string>, service_names array<string>")
    values = spark.createDataFrame([("Bank 1010",), ("bank 101",), ("a100",), ("aioo",)], "v string")
    got = rows(matching.fuzzy_aliases(values, "v", dic).select("value", "alias", "distance"))
    assert got == {("bank ioio", "bank 1010", 0), ("bank ioi", "bank 1010", 1), ("aioo", "a100", 0)}


def test_document_frequencies_read_all_training_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3, f"w{i % 7} v{i % 5}", float(i % 2), 1.0) for i in range(300)], "id long, fold int, t string, label double, n double")
    seen = {"idf": [], "lr": []}

    def watch(base, name):
        def _fit(self, dataset):
            seen[name].append(dataset.count())
            return base._fit(self, dataset)

        return type(base.__name__, (base,), {"_fit": _fit})

    monkeypatch.setattr(models, "IDF", watch(models.IDF, "idf"))
    monkeypatch.setattr(models, "LogisticRegression", watch(models.LogisticRegression, "lr"))
    assert models.out_of_fold(df, "id", "fold", 3, "t", ["n"], fit_rows=150).count() == 300
    assert seen["idf"] == [200] * 6 and len(seen["lr"]) == 3 and all(60 < n < 140 for n in seen["lr"])


REQUEST = {"request_id": "11111111-1111-4111-8111-111111111111", "navigation_id": "22222222-2222-4222-8222-222222222222", "dom_revision": 1, "phase": "url_content", "url": "https://example.org/account", "html": "<p>x</p>", "preprocessing_version": "snapshot-v1", "capture_mode": "rendered_dom"}
ADDRESS = {k: v for k, v in REQUEST.items() if k != "html"} | {"phase": "url_only", "capture_mode": "url_only", "dom_revision": 0}
MODEL = {"model_id": "demo", "variant": "M3", "preprocessing_version": "snapshot-v1", "dictionary_version": "d", "score_semantics": "uncalibrated_model_score"}
SIGNAL = {"code": "sensitive_form_detected", "org_candidate_id": None, "domain_relation": "not_applicable", "message": "m"}
DONE = {k: REQUEST[k] for k in ("request_id", "navigation_id", "dom_revision", "phase")} | {"status": "completed", "verdict": "warning", "score": 0.82, "threshold": 0.75, "model": MODEL, "signals": [SIGNAL], "limitations": ["example"], "timing_ms": {"preprocess": 3, "extract": 8, "infer": 2, "server_total": 14}}
UNABLE = DONE | {"status": "insufficient_content", "verdict": "unable_to_assess", "score": None, "threshold": None, "signals": []}


def _errors(spark, f, cases):
    got = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b string").select("i", f(F.col("b")).alias("e")).collect()
    return [(cases[r.i], r.e) for r in got if r.e != cases[r.i][1]]


def test_request_contract(spark):
    without = lambda d, k: {x: v for x, v in d.items() if x != k}
    wrong = {"request_id": ["n", 1, None], "navigation_id": ["n", 2, None], "dom_revision": [-1, 1.5, "1", None], "phase": ["x", None], "url": ["file:///x", "https://a b", "", "https://a.test/" + "x" * 8192, 3], "preprocessing_version": ["", "v" * 65, None], "capture_mode": ["x", None]}
    cases = [(REQUEST, None), (ADDRESS, None), (REQUEST | {"capture_mode": "stored_html"}, None), (REQUEST | {"dom_revision": 0}, None), (REQUEST | {"html": "x" * 1_000_000}, None)]
    for base in (REQUEST, ADDRESS):
        cases += [(base | {k: v}, k) for k, vs in wrong.items() for v in vs] + [(without(base, k), k) for k in wrong]
        cases += [(base | {"score": 1}, "unknown_key"), (base | {"capture_mode": "url_only" if base is REQUEST else "rendered_dom"}, "capture_mode")]
    cases += [(REQUEST | {"html": ""}, "html"), (REQUEST | {"html": 5}, "html"), (REQUEST | {"html": None}, "html_missing"), (without(REQUEST, "html"), "html_missing"), (ADDRESS | {"html": "<p>"}, "html_unexpected")]
    cases += [(REQUEST | {"html": "x" * 1_000_001}, "html_too_long"), (REQUEST | {"html": "é" * 1_048_577}, "body_too_large")]
    texts = [(json.dumps(d, ensure_ascii=False), e) for d, e in cases] + [("{", "bad_json"), ("[]", "bad_json"), (None, "bad_json"), ('{"a":1,"a":2}', "bad_json")]
    assert _errors(spark, contract.request_error, texts) == []
    codes = spark.createDataFrame([("body_too_large", "a", False), ("url", "a", False), (None, "b", False), (None, "a", False), ("url", "a", True), (None, "a", None)], "e string, v string, busy boolean")
    got = codes.select(contract.status_code(F.col("e"), F.col("v") == "a", {429: F.col("busy")})).collect()
    assert [r[0] for r in got] == [413, 422, 409, 200, 429, 200]


def test_response_contract(spark):
    without = lambda d, k: {x: v for x, v in d.items() if x != k}
    cases = [(DONE, None), (UNABLE, None), (DONE | {"score": 0.8234567891}, None), (DONE | {"score": 1e-05, "verdict": "no_indication"}, None), (DONE | {"score": 1, "threshold": 1}, None), (DONE | {"score": 0.75}, None)]
    cases += [(without(DONE, k), "missing_key") for k in DONE] + [(DONE | {"html": "x"}, "unknown_key"), (DONE | {"status": "insufficient"}, "status")]
    cases += [(DONE | {"score": v}, "score") for v in (1.01, -0.1, None, "0.8")] + [(DONE | {"threshold": v}, "threshold") for v in (2, None, "0.1")]
    cases += [(DONE | {"verdict": v}, "verdict") for v in ("no_indication", "unable_to_assess", None)] + [(UNABLE | {"verdict": "no_indication"}, "verdict"), (UNABLE | {"score": 0.1}, "score"), (UNABLE | {"threshold": 0.1}, "threshold")]
    cases += [(DONE | {"model": m}, "model") for m in (None, "m", MODEL | {"x": 1}, MODEL | {"variant": "M4"}, MODEL | {"model_id": ""}, MODEL | {"score_semantics": "p"}, *(without(MODEL, k) for k in MODEL))]
    cases += [(DONE | {"signals": [s]}, "signals") for s in (1, SIGNAL | {"x": 1}, SIGNAL | {"code": ""}, SIGNAL | {"domain_relation": "own"}, SIGNAL | {"message": "m" * 301}, SIGNAL | {"org_candidate_id": 1}, *(without(SIGNAL, k) for k in SIGNAL))]
    cases += [(DONE | {"signals": [SIGNAL] * 21}, "signals"), (DONE | {"signals": {}}, "signals"), (DONE | {"signals": [SIGNAL | {"org_candidate_id": "O1"}] * 20}, None)]
    cases += [(DONE | {"limitations": v}, "limitations") for v in (None, ["x" * 201], [1], ["a"] * 21)] + [(DONE | {"timing_ms": v}, "timing_ms") for v in (None, {}, DONE["timing_ms"] | {"infer": -1}, DONE["timing_ms"] | {"x": 1}, DONE["timing_ms"] | {"infer": "2"})]
    assert _errors(spark, contract.response_error, [(json.dumps(d), e) for d, e in cases] + [(None, "bad_json"), ("3", "bad_json")]) == []
    v = spark.createDataFrame([(0.5, 0.5), (0.4, 0.5), (None, 0.5), (0.9, None)], "s double, t double").select(contract.verdict(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in v] == ["warning", "no_indication", "unable_to_assess", "unable_to_assess"]


def test_report_with_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "x"), ("", "x")], "p string, q string")
    got = json.loads(audit.report(df, ["p", "q"], "q", ("p", "q"), F.lit(True), "q").first()[0])
    assert got["counts"]["q"] == {"\u0000null": 1, "": 1, "x": 2} and got["counts"]["p"] == {"a": 2, "\u0000null": 1, "": 1}
    assert got["cross"] == {"a|\u0000null": 1, "a|": 1, "\u0000null|x": 1, "|x": 1} and got["filtered"] == {"\u0000null": 1, "": 1, "x": 2}


def _as_of(left, right):
    out = []
    for i, k, t in left:
        seen = [(rt, v) for rk, rt, v in right if rk == k and k is not None and rt is not None and t is not None and rt <= t and v is not None]
        last = max(seen)[0] if seen else None
        out.append((i, max(v for rt, v in seen if rt == last) if seen else None))
    return set(out)


def test_as_of_carries_over_ranges(spark, rows):
    rnd = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    key = lambda: "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "c"])
    left = [(i, key(), day(rnd.randrange(3000))) for i in range(400)] + [(900, "hot", None), (901, "none", day(5))]
    right = [(key(), day(rnd.randrange(3000)), rnd.choice([1, 2, None])) for _ in range(150)] + [("hot", None, 7), ("hot", day(10), 5), ("hot", day(10), 3)]
    got = matching.as_of(spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v int"), "k", "t", "u", "v", "last")
    assert rows(got.select("i", "last")) == _as_of(left, right)
    assert matching.as_of(spark.createDataFrame([], "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v int"), "k", "t", "u", "v", "last").count() == 0


def test_client_outcomes(spark, rows):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    data = [("t", at(0), 900), ("t", at(1), 3000), ("t", at(2), 6000), ("t", at(20), None), ("u", at(0), 5000), ("u", at(5), 5001)]
    got = navigation.outcomes(spark.createDataFrame(data, "tab string, ts timestamp, ms int"), "tab", "ts", F.col("ms"))
    assert rows(got.select("tab", "ts", "outcome")) == {("t", at(0), "answered"), ("t", at(1), "superseded"), ("t", at(2), "unable_to_assess"), ("t", at(20), "unable_to_assess"), ("u", at(0), "answered"), ("u", at(5), "unable_to_assess")}


def test_scopes_and_relations(spark, rows):
    rules = spark.createDataFrame([("O1", "brand.test", None, "first_party_identity"), ("O1", "brand.test", "/shop/", "authorized_service"), ("O1", "u.brand.test", None, "user_content_hosting")], "org_id string, hostname string, path_prefix string, role string")
    urls = spark.createDataFrame([("brand.test", "/shop/x"), ("brand.test", "/shop"), ("brand.test", "/shopping"), ("a.u.brand.test", "/shop/x"), ("notbrand.test", "/"), (None, "/"), ("brand.test", None)], "h string, p string")
    got = rows(matching.scope_matches(urls, "h", F.col("p"), rules).select("host", "path", "role"))
    first, shop, user = "first_party_identity", "authorized_service", "user_content_hosting"
    assert got == {("brand.test", "/shop/x", shop), ("brand.test", "/shop", shop), ("brand.test", "/shopping", first), ("a.u.brand.test", "/shop/x", user), ("brand.test", "/", first)}
    cases = [(None, first, "O1", "not_applicable"), ("O1", user, "O1", "unverified_shared_hosting"), ("O1", first, "O1", "verified_first_party"), ("O1", shop, "O1", "verified_authorized"), ("O1", first, "O2", "mismatch"), ("O1", None, None, "unverified"), ("O1", "unverified", "O1", "unverified")]
    df = spark.createDataFrame(cases, "org string, role string, rule_org string, want string")
    assert df.filter(matching.relation(F.col("org"), F.col("role"), F.col("rule_org")) != F.col("want")).count() == 0


def test_selection(spark, rows):
    df = spark.createDataFrame([(1, "h1", "g1"), (2, "h2", "g2"), (3, None, "g1"), (4, "h4", None), (5, "h5", "g5")], "id int, sha string, g string")
    assert rows(groups.without(df, df.filter("id in (1, 4)"), ["id", "sha", "g"]).select("id")) == {(2,), (5,)}
    assert groups.without(df, df.limit(0), ["id"]).count() == 5
    nested = groups.nested_folds(df, "g", 5, 3, 42).collect()
    assert len({(r.outer_fold, r.inner_fold) for r in nested if r.g == "g1"}) == 1 and [r.outer_fold for r in nested if r.g is None] == [None]
    s = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("c", 1), ("d", None)], "s string, y int")
    assert rows(groups.source_roles(s, "s", "y").select("s", "role")) == {("a", "pooled"), ("b", "challenge"), ("c", "one_class"), ("d", None)}
    q = audit.before_after(s, ["s"], F.col("y") == 1)
    assert rows(q) == {("s", "a", 2, 1), ("s", "b", 1, 0), ("s", "c", 1, 1), ("s", "d", 1, 0)}
    m = spark.createDataFrame([(17, 0.5, "x"), (17, 0.7, "x"), (42, 0.6, "x"), (42, None, "x")], "seed int, v double, c string")
    r = metrics.dispersion(m, "v", "seed", ["c"]).first()
    assert (r.runs, r.mean, r.sd_runs, r.sd_seeds) == (3, 0.6, 0.1, 0.0)


def test_texts(spark):
    t = spark.createDataFrame([("Đăng nhập để xác thực tài khoản",), ("One-time code",), (None,), ("ab",)], "t string")
    got = t.select(text.claims(F.col("t")).alias("c"), text.requests(F.col("t")).alias("r"), text.char_ngrams(F.col("t"), 3).alias("g")).collect()
    assert [r.c for r in got] == [["sign_in", "verify_account"], [], [], []] and [r.r for r in got] == [False, True, False, False]
    assert got[1].g[:2] == ["One", "ne-"] and got[2].g == [] == got[3].g
