import pytest
from pyspark.sql import functions as F

from weirmill.functions import text
from weirmill.functions.hosts import host, with_registrable

HOSTS = {
    "HTTPS://u:p@Login.Brand.test.:8443/": "login.brand.test", "hxxps[://]a[.]b(.)test/x": "a.b.test", "www.a.test.": "a.test", "www.test": "www.test",
    "//x.y.test?q": "x.y.test", "ftp://1.2.3.4:21": "1.2.3.4", "n/a": None, "-": None, "không rõ": None, "": None, None: None, "ａ．test": "ａ.test",
    "a [.] b [.] test": "a.b.test", "　a.test\xa0": "a.test", "a[dot]b.test": "a.b.test", "localhost": None, "a..test": None, "http://u@v@w.test/": "w.test",
    "x" * 50_000 + ".test": "x" * 50_000 + ".test", "www.www.a.test": "www.a.test", "hxxp://nhanh.a[.]test/?ref=sms#top": "nhanh.a.test",
}


def test_host(spark):
    got = spark.createDataFrame([(k,) for k in HOSTS], "d string").select("d", host(F.col("d")).alias("h")).collect()
    assert {r.d: r.h for r in got} == HOSTS


PSL = [("test", "rule"), ("com.test", "rule"), ("example", "rule"), ("khu.example", "wildcard"), ("chinh.khu.example", "exception"), ("shop.com.test", "rule")]
REGISTRABLE = {
    "a.b.test": "b.test", "x.com.test": "x.com.test", "com.test": None, "y.x.com.test": "x.com.test", "a.shop.com.test": "a.shop.com.test", "shop.com.test": None,
    "q.p.khu.example": "q.p.khu.example", "p.khu.example": None, "khu.example": "khu.example", "a.chinh.khu.example": "chinh.khu.example", "chinh.khu.example": "chinh.khu.example",
    "a.b.unknown": None, None: None,
}


@pytest.mark.parametrize("rules", [PSL, []])
def test_registrable(spark, rules):
    psl = spark.createDataFrame(rules, "suffix string, kind string")
    hosts = spark.createDataFrame([(k,) for k in REGISTRABLE], "h string")
    got = {r.h: r.registrable for r in with_registrable(hosts, "h", psl).collect()}
    assert got == (REGISTRABLE if rules else dict.fromkeys(REGISTRABLE))


def test_values(spark):
    df = spark.createDataFrame([("　 PHISH\n",), ("Phishing ",), ("",), (" \xa0",), (None,), ("phish ing",)], "v string")
    got = [(r.l, r.c) for r in df.select(text.label(F.col("v")).alias("l"), text.category(F.col("v")).alias("c")).collect()]
    assert got == [("phishing", "phish"), ("phishing", "phishing"), (None, None), (None, None), (None, None), ("phish ing", "phish ing")]
    n = spark.createDataFrame([("a b\n\nc ",), ("",), (None,), ("   ",)], "t string").select(text.blank_pieces(F.col("t")).alias("n")).collect()
    assert [r.n for r in n] == [3, 0, 0, 0]
    marks = spark.createDataFrame([(n, f"a{chr(n)}b") for n in range(1, 0x11000) if not 0xD800 <= n < 0xE000], "n int, t string")
    assert {r.n for r in marks.filter(text.blank_pieces(F.col("t")) == 2).collect()} == {ord(c) for c in text.BLANKS}
