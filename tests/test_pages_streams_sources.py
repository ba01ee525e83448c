import hashlib
import json
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weirmill.functions import html, urls
from weirmill.__main__ import main
from weirmill.operators import service
from weirmill.sources import archive, files
from weirmill.streaming import navigation

PAGE = '<title>T &amp; t</title><h1>Head</h1><script>var t="</p>"</script><!-- <p>no</p> --><p>Say <b>hi</b></p><form action="https://b.test/x">Name<input type="password" value="s"><textarea>mine</textarea></form><iframe></iframe><a href="/x" onclick="go()">l</a><p>open'


def test_page():
    text, title, heading, login, forms, inputs, passwords, iframes, links, actions = html.parse(PAGE)
    assert (title, heading, forms, inputs, passwords, iframes, links, actions) == ("T & t", "Head", 1, 1, 1, 1, ["/x"], ["https://b.test/x"])
    assert "var" not in text and "no" not in text.split() and text.endswith("open") and "Name" in login
    assert html.parse(None)[0] is None and html.parse("")[0] == ""
    clean = html.clean(PAGE)
    assert "onclick" not in clean and "mine" not in clean and 'value="s"' not in clean and "script" not in clean


TOKENS = [
    "<title>", "T &amp; t", "</title>", "<body>", "<h1>", "Head", "</h1>", "<!-- <p>no</p> -->", "<p>", "Say 5 &lt; 6", "</p>", '<form action="https://b.test/x">', "Name",
    '<input type="password" value="s">', "</form>", '<iframe src="/i">', "</iframe>", '<a href="/x?a=1&amp;b=2">', "link", "</a>", "<script>", "var t = 1", "</script>", "end", "</body>", "</html>",
]


def _by_tokens(n):
    """The profile of the first ``n`` characters, from the tokens that are whole and the part of a cut text."""
    text, zones, opened, found = [], {"title": [], "h1": [], "form": []}, [], []
    for t in TOKENS:
        part, n = t[: max(n, 0)], n - len(t)
        if part == "<" or (part and part[0] != "<"):
            words = " ".join(html.entities.unescape(part).split())
            (zones["title"] if "title" in opened else [] if "script" in opened else text).append(words)
            for z in {"h1", "form"} & set(opened):
                zones[z].append(words)
        elif part == t and t[1] == "/":
            opened.remove(t[2:-1]) if t[2:-1] in opened else None
        elif part == t and t[1] != "!":
            found.append(t)
            opened.append(t[1:-1].split()[0])
    count = lambda tag: sum(f.startswith(tag) for f in found)
    tags = count("<form"), count("<input"), count("<input"), count("<iframe")
    return (*(" ".join(x) for x in (text, zones["title"], zones["h1"], zones["form"])), *tags, ["/x?a=1&b=2"] * count("<a "), ["https://b.test/x"] * count("<form"))


def test_every_page_is_parsed(spark, tmp_path):
    page = "".join(TOKENS)
    pages = {str(n): page[:n] for n in range(len(page) + 1)}
    spark.createDataFrame([*pages.items(), *pages.items(), ("null", None)], "sha256 string, html string").write.parquet(str(tmp_path / "corpus.parquet"))
    got = {r.sha256: tuple(r)[1:] for r in entry.queries()["page_parsed"](spark, str(tmp_path)).collect()}
    assert got.pop("null") == (None, None, None, None, None, 0, 0, 0, 0, [], [])
    assert got == {k: (len(v), *_by_tokens(len(v))) for k, v in pages.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<script>", "</script>", "a & b", "<input value='x'>", "<textarea>", "</textarea>", "<div contenteditable>", "</div>", "&amp;", "<a onclick=x href='y'>", "<", '"']), max_size=12))
def test_clean_is_idempotent(parts):
    once = html.clean("".join(parts))
    assert html.clean(once) == once


def test_urls(spark):
    cases = {
        "https://u:p@a.example.com/p?k=v&z=#top": ("ok", "https://a.example.com/p?k=*&z=*"), "http://my_host.example.com/x": ("ok", "http://my_host.example.com/x"),
        "http://a.example.com/?q=a|b": ("ok", "http://a.example.com/?q=*"), "a.example.com/x": ("scheme_added", "http://a.example.com/x"), "file:///etc/x": ("invalid", None),
        "javascript:1": ("invalid", None), "": ("invalid", None), None: ("invalid", None), "http://a.test/" + "x" * 8180: ("too_long", None), "HTTPS://A.Test/B": ("ok", "https://a.test/B"),
    }
    u = F.col("u")
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.status(u).alias("s"), urls.normalize(u).alias("n")).collect()
    assert {r.u: (r.s, r.n) for r in got} == cases


def test_archive(spark, tmp_path):
    body = '﻿label,source,tier,scenario,split,lang,domain,other\nphishing,s1,gold,bank,train,vi,"a,b",x\nbenign,s1,gold,gov,test,vi,"two\nlines",y\nphishing,ệ,gold,bank,train,vi,a\n'.encode()
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data/dataset_url.csv", body)
        z.writestr("MANIFEST.txt", hashlib.sha256(body).hexdigest())
        z.writestr("x.html", "")
        z.writestr("X.HTML", "")
    report = archive.audit_archive(spark, str(path), "v")
    assert list(report) == ["version", "archive_sha256", "csv_sha256", "rows", "counts", "unique_domain_field", "source_label", "phishing_scenario", "csv_hash_in_manifest", "archive_html_files"]
    assert report["rows"] == 3 and report["unique_domain_field"] == 3 and report["counts"]["source"] == {"s1": 2, "ệ": 1}
    assert report["source_label"] == {"s1|phishing": 1, "s1|benign": 1, "ệ|phishing": 1} and report["phishing_scenario"] == {"bank": 2}
    assert report["csv_hash_in_manifest"] and report["archive_html_files"] == 1 and report["archive_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    text = archive.write_report(spark, report, str(tmp_path / "r.json"))
    assert "ệ" in text and json.loads(text) == report and not text.endswith("\n")


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data/dataset_url.csv", "label,source,tier,scenario,split,lang,domain\nphishing,s,gold,bank,train,vi,a.test\n")
        z.writestr("MANIFEST.txt", "none")
    main(["audit", str(path), "v1", str(tmp_path / "report.json")], spark)
    assert json.loads(capsys.readouterr().out)["rows"] == 1 and json.loads((tmp_path / "report.json").read_text())["version"] == "v1"
    main(["query", "audit_distinct", "/root/testdata/sf0.001", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_run_folder_and_documents(spark, tmp_path, rows):
    p = spark.createDataFrame([(1, 0.5)], "id int, score double")
    files.write_run(str(tmp_path / "run"), p, notes="first", metrics={"recall": 0.5}, manifest={"đ": "x"})
    assert json.loads((tmp_path / "run/manifest.json").read_text()) == {"đ": "x"} and (tmp_path / "run/notes.md").read_text() == "first" and (tmp_path / "run/predictions.jsonl").is_dir()
    try:
        files.write_run(str(tmp_path / "run"), p)
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e) or "ALREADY_EXISTS" in str(e)
    (tmp_path / "s.json").write_text('{"sources": [{"source_id": "a", "sha256": "h", "more": 1}, {"source_id": "b"}], "x": {"folds": 5, "seeds": [17, 42]}}')
    assert rows(files.source_manifest(spark, str(tmp_path / "s.json")).select("source_id", "sha256")) == {("a", "h"), ("b", None)}
    assert files.settings(spark, str(tmp_path / "s.json"), "x struct<folds int, seeds array<int>>") == {"x": {"folds": 5, "seeds": [17, 42]}}
    assert rows(files.unnested(files.json_document(spark, str(tmp_path / "s.json")), "sources", "source_id")) == {(0, "a"), (1, "b")}


def test_snapshot_features_know_no_labels(spark):
    dic = spark.createDataFrame([("O1", "Sao Khuê", ["SKB"], None), ("O2", "Micro", None, None)], "org_id string, display_name string, aliases array<string>, service_names array<string>")
    psl = spark.createDataFrame([("test", "rule")], "suffix string, kind string")
    page = '<title>SKB</title><h1>SKB sign in</h1><p>Micro: nhập mật khẩu</p><form><input type="password"></form><a href="https://b.test/">x</a><a href="/y">y</a>'
    df = spark.createDataFrame([("1", "https://a.test/x", page, "phish"), ("2", "https://a.test/", None, "benign"), ("3", None, "<p></p>", None)], "snapshot_id string, url string, html string, label string")
    got = {r.snapshot_id: r for r in service.extract(df, dic, psl).collect()}
    assert (got["1"].org_id, got["1"].zones, got["1"].asks, got["1"].claims, got["1"].link_foreign_share) == ("O1", ["heading", "main", "title"], True, ["sign_in"], 0.5)
    assert got["2"].asks is None and got["3"].asks is None and got["3"].host is None and got["2"].org_id is None
    flipped = service.extract(df.withColumn("label", F.lit("benign")).withColumn("org_id", F.lit("O9")), dic, psl)
    assert {r.snapshot_id: r for r in flipped.collect()} == got
    assert json.loads(service.health(True))["model_ready"] is True and service.model(None) is None


def test_files(spark, tmp_path, rows):
    (tmp_path / "d.json").write_text('{"message": {"parts": [[2024, 1]], "n": [], "ok": true}}')
    assert files.json_document(spark, str(tmp_path / "d.json")).select("message.parts", "message.ok").first() == ([[2024, 1]], True)
    assert files.variants(spark, str(tmp_path / "d.json")).select(F.try_variant_get("doc", "$.message.ok", "boolean")).first()[0] is True
    p = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "k string, n int, v string")
    files.append_passes(p, str(tmp_path / "p"))
    files.append_passes(p.limit(1).withColumn("n", F.lit(3)), str(tmp_path / "p"))
    assert files.final_passes(spark.read.parquet(str(tmp_path / "p")), ["k"], ["n"]).first().n == 3
    try:
        files.blind_view(p.withColumn("label", F.lit(1)), ["k", "label"])
        raise AssertionError
    except ValueError:
        pass


def test_stream_equals_batch(spark, tmp_path, rows):
    data = [(n, r, r % 2, f"2024-01-01 00:00:{(r * 7 + n) % 60:02d}") for n in range(5) for r in (3, 1, 4, 1, 5, 2)] + [(None, 1, 0, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(data, "navigation_id long, dom_revision long, phase int, t string").select("navigation_id", "dom_revision", "phase", F.to_timestamp("t").alias("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = navigation.latest_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q.foreachBatch(lambda batch, n: batch.write.parquet(str(tmp_path / f"out/batch={n}"))).start().awaitTermination(120)
    updates = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert rows(navigation.merge_updates(updates)) == rows(navigation.latest(df)) and updates.count() >= 5
    late = navigation.stale_discard(df.filter("navigation_id = 0")).filter("stale").count()
    assert late > 0 and navigation.debounce(df.filter("navigation_id = 0"), "navigation_id", "ts", F.lit(100)).count() == 1
