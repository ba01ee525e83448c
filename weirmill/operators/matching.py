"""Organisations in text and hosts: aliases, fuzzy aliases, rules on DNS boundaries, relations, as-of lookups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirmill.functions.text import spelled
from weirmill.operators.ordered import carried, ranges
from weirmill.session import checked_broadcast

#: Characters that read as another within names.
CONFUSED, READ_AS = "01", "oi"
#: Cells of the filter of first words of names.
FIRST_CELLS = 1 << 12


def plain(c: Column) -> Column:
    """One spelling, lower case, runs of blanks as one; the original stays beside it."""
    return F.trim(F.regexp_replace(F.lower(spelled(c)), "\\s+", " "))


def variant(c: Column) -> Column:
    """A reading with controlled confusables (0 as o, 1 as i)."""
    return F.translate(plain(c), CONFUSED, READ_AS)


def words(c: Column, accents: bool = True) -> Column:
    return F.filter(F.split(F.lower(spelled(c, accents)), "[^\\p{L}\\p{M}\\p{N}]+"), lambda x: x != "")


def _readings(c: Column) -> Column:
    """Both readings of ``c``, as rows ``(reading, w)``."""
    return F.inline(F.array(*(F.struct(F.lit(r).alias("reading"), words(c, accents).alias("w")) for r, accents in (("written", True), ("no_accents", False)))))


def names(dictionary: DataFrame) -> DataFrame:
    """``(org_id, alias, n_words)``: display name, aliases and services of every organisation as runs of words."""
    return _names(dictionary).filter("reading = 'written'").select("org_id", "alias", "n_words").distinct()


def _names(dictionary: DataFrame) -> DataFrame:
    """``(org_id, alias, reading, run, n_words)``: the words of every name in both readings."""
    every = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("service_names", F.array().cast("array<string>")))
    a = dictionary.select("org_id", F.explode(every).alias("name")).filter("name is not null")
    a = a.select("org_id", F.array_join(words(F.col("name")), " ").alias("alias"), _readings(F.col("name")))
    return a.select("org_id", "alias", "reading", F.array_join("w", " ").alias("run"), F.size("w").alias("n_words")).filter("n_words > 0").distinct()


def alias_readings(docs: DataFrame, ident: str, text: str, dictionary: DataFrame) -> DataFrame:
    """``(id, org_id, alias, reading, occurrences)`` of names on word boundaries: word runs of the lengths there are, from words
    a name may begin with, joined by equality with the names; never a scan of every name in every text. Which words those are is
    told by a filter of fixed size, which may let others through. Both sides are brought to one spelling; ``no_accents`` compares
    both without accents, so it holds what ``written`` holds."""
    a = _names(dictionary)
    cell = lambda w: F.pmod(F.xxhash64(w), F.lit(FIRST_CELLS)).cast("int")
    known = a.agg(F.collect_set("n_words").alias("lengths"), F.collect_set(cell(F.substring_index("run", " ", 1))).alias("cells")).first()  # at most FIRST_CELLS numbers
    lengths, cells = sorted(known["lengths"]) or [1], set(known["cells"])
    may = F.from_json(F.lit(json.dumps([i in cells for i in range(FIRST_CELLS)])), "array<boolean>")  # a constant
    w = docs.filter(F.col(text).isNotNull()).select(F.col(ident).alias("id"), _readings(F.col(text))).filter(F.size("w") > 0)
    w = w.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.get(may, cell(F.get("w", i - 1))))).filter(F.size("at") > 0)
    runs = lambda n: F.transform(F.filter("at", lambda i: i <= F.size("w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))
    grams = w.select("id", "reading", F.explode(F.concat(*(runs(n) for n in lengths))).alias("run"))
    return grams.join(checked_broadcast(a.drop("n_words")), ["reading", "run"]).groupBy("id", "org_id", "alias", "reading").agg(F.count("*").alias("occurrences"))


def alias_matches(docs: DataFrame, ident: str, text: str, dictionary: DataFrame) -> DataFrame:
    """``(id, org_id, alias, occurrences)`` of the names as written."""
    return alias_readings(docs, ident, text, dictionary).filter("reading = 'written'").drop("reading")


def fuzzy_aliases(values: DataFrame, col: str, dictionary: DataFrame) -> DataFrame:
    """``(value, org_id, alias, distance)`` of distinct values within one edit of a name of up to six characters, two of
    a longer one; plain readings are compared with plain ones and variants with variants, and the smaller distance stands
    (``value`` is the variant). Both sides meet on parts: of a name cut into one part more than edits, one stands unchanged
    in the value, shifted by no more than the edits; candidates are then measured exactly. Names under four characters are
    left to the exact match."""
    both = lambda c: F.inline(F.array(F.struct(F.lit(0).alias("kind"), c.alias("read")), F.struct(F.lit(1).alias("kind"), F.translate(c, CONFUSED, READ_AS).alias("read"))))
    a = names(dictionary).select("org_id", "alias", F.length("alias").alias("la"), both(F.col("alias")).alias("kind", "name")).filter("la >= 4").withColumn("k", F.when(F.col("la") <= 6, 1).otherwise(2))
    cut = lambda i: F.floor(F.col("la") * i / (F.col("k") + 1)).cast("int")
    a = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    a = a.select("org_id", "alias", "kind", "name", "la", "k", cut(F.col("i")).alias("at"), (cut(F.col("i") + 1) - cut(F.col("i"))).alias("n"))
    a = a.withColumn("part", F.expr("substring(name, at + 1, n)"))
    v = values.select(plain(F.col(col)).alias("plain")).filter("plain <> ''").distinct()
    v = v.select(F.translate("plain", CONFUSED, READ_AS).alias("value"), both(F.col("plain")).alias("kind", "read")).distinct()
    sizes = sorted(r["n"] for r in a.select("n").distinct().collect())
    grams = lambda n: F.when(F.length("read") >= n, F.transform(F.sequence(F.lit(1), F.length("read") - (n - 1)), lambda i: F.struct((i - 1).alias("off"), F.substring(F.col("read"), i, F.lit(n)).alias("part")))).otherwise(F.array().cast("array<struct<off:int,part:string>>"))
    g = v.select("value", "kind", "read", F.inline(F.concat(*(grams(n) for n in sizes)))) if sizes else v.select("value", "kind", "read", F.lit(0).alias("off"), F.lit("").alias("part")).limit(0)
    close = g.join(checked_broadcast(a), ["kind", "part"]).filter((F.abs(F.col("off") - F.col("at")) <= F.col("k")) & (F.abs(F.length("read") - F.col("la")) <= F.col("k")))
    got = close.select("value", "read", "org_id", "alias", "name", "k").distinct().withColumn("distance", F.levenshtein("read", "name"))
    return got.filter("distance <= k").groupBy("value", "org_id", "alias").agg(F.min("distance").alias("distance"))


def suffixes(h: Column) -> Column:
    """Every suffix of a host at a label boundary."""
    l = F.split(h, "\\.")  # noqa: E741
    return F.transform(F.sequence(F.lit(1), F.size(l)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(l, -k, k), ".").alias("suffix")))


def boundary_matches(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """``(host, rule_host, role, org_id)``: the longest rule whose host is the host or a parent of it at a label boundary.
    ``rules(org_id, hostname, role)``. Suffixes are joined by equality, so ``notbrand.test`` never meets ``brand.test``."""
    h = hosts.select(F.col(host).alias("host")).filter("host is not null").distinct()
    s = h.select("host", F.inline(suffixes(F.col("host"))))
    got = s.join(checked_broadcast(rules.select(F.lower("hostname").alias("suffix"), "org_id", "role")), "suffix")
    return got.groupBy("host").agg(F.max(F.struct("k", "suffix", "role", "org_id")).alias("m")).select("host", F.col("m.suffix").alias("rule_host"), "m.role", "m.org_id")


def scope_matches(urls: DataFrame, host: str, path: str, rules: DataFrame) -> DataFrame:
    """``(host, path, rule_host, path_prefix, role, org_id)``: the rule with the longest host, then the longest path, that
    covers a page. ``rules(org_id, hostname, path_prefix, role)``; a prefix ends at a path segment, null covers every path."""
    u = urls.select(F.col(host).alias("host"), F.coalesce(path, F.lit("/")).alias("path")).filter("host is not null").distinct()
    s = u.select("host", "path", F.inline(suffixes(F.col("host"))))
    r = rules.select(F.lower("hostname").alias("suffix"), F.rtrim(F.coalesce("path_prefix", F.lit("")), F.lit("/")).alias("path_prefix"), "org_id", "role")
    got = s.join(checked_broadcast(r), "suffix").filter((F.col("path_prefix") == "") | (F.col("path") == F.col("path_prefix")) | F.col("path").startswith(F.concat("path_prefix", F.lit("/"))))
    best = got.groupBy("host", "path").agg(F.max(F.struct("k", F.length("path_prefix").alias("n"), "suffix", "path_prefix", "role", "org_id")).alias("m"))
    return best.select("host", "path", F.col("m.suffix").alias("rule_host"), "m.path_prefix", "m.role", "m.org_id")


def relation(org: Column, role: Column, rule_org: Column) -> Column:
    """The relation of a page's host with the organisation it names, given the longest rule that covers the host: shared
    hosting goes before everything else, a host of another organisation is a mismatch, no rule says nothing."""
    own = F.coalesce(org == rule_org, F.lit(False))
    first, other = role.startswith("first_party"), role == "authorized_service"
    return (
        F.when(org.isNull(), "not_applicable").when(role == "user_content_hosting", "unverified_shared_hosting")
        .when(own & first, "verified_first_party").when(own & other, "verified_authorized")
        .when(~own & (first | other), "mismatch").otherwise("unverified")
    )


def names_in_url(urls: DataFrame, ident: str, url: str, dictionary: DataFrame) -> DataFrame:
    """``(id, org_id)`` of the organisations one of whose one-word names is a token of the address (runs of letters and digits)."""
    one = names(dictionary).filter("n_words = 1").select("org_id", F.col("alias").alias("token")).distinct()
    t = urls.filter(F.col(url).isNotNull()).select(F.col(ident).alias("id"), F.explode(F.array_distinct(F.split(F.lower(url), "[^\\p{L}\\p{N}]+"))).alias("token"))
    return t.join(checked_broadcast(one), "token").select("id", "org_id").distinct()


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """Add the ``value`` of the latest row of ``right`` with the key at or before ``left_time``; null where there is none.
    Both sides are merged in time within ranges of the key, no range join, and the latest value is carried over from range to
    range. Times of a side may repeat (the greatest value of the latest time is taken); null values and times are passed over."""
    l_ = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.struct(*left.columns).alias("__row"))
    r_ = right.filter(F.col(right_time).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(right_time).alias("__t")).agg(F.max(value).alias("__v"))
    r_ = r_.select("__k", "__t", F.lit(0).alias("__side"), "__v", F.lit(None).cast(l_.schema["__row"].dataType).alias("__row"))
    both = carried(ranges(l_.unionByName(r_), "__k", "__t"), ["__k"], F.when(F.col("__v").isNotNull(), F.struct("__t", "__v")))
    seen = F.last("__v", ignorenulls=True).over(W.partitionBy("__k", "__p").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0))
    got = both.withColumn(out, F.when(F.col("__t").isNotNull(), F.coalesce(seen, F.col("__carry.__v"))))
    return got.filter("__side = 1").select("__row.*", out)
