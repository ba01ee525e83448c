"""Host names and registrable domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.functions.text import BLANK_CLASS
from weirmill.session import checked_broadcast

LABEL = "[\\p{L}\\p{N}\\p{M}_-]++"
#: A host as most rows have it: nothing to drop, no www.
PLAIN = "^(?!www\\.)[a-z0-9_-]++(?:\\.[a-z0-9_-]++)++$"
#: A link in whole: blanks, scheme, user, one www label before a longer host, the host (captured), closing dot, port, the rest.
LINK = (
    f"(?s)^{BLANK_CLASS}*+(?:(?:[a-z][a-z0-9+.-]*+:)?[/\\\\]{{2,}}+)?(?:[^/\\\\?#@]*+@)*+(?:www\\.(?=[^./\\\\:?#]++\\.[^./\\\\:?#]))?"
    f"({LABEL}(?:\\.{LABEL})++)\\.?(?::[0-9]*+)?\\.?{BLANK_CLASS}*+(?:[/\\\\?#].*+)?$"
)


def host(c: Column) -> Column:
    """The host a free-text domain or link stands for, in lower case; null where it names none.

    Blanks, scheme, user, port, path, query, fragment, the closing dot and one leading ``www`` label are dropped and
    the spellings feeds use to defang a link (``hxxp``, ``[.]``, ``(.)``, ``[:]``) are read as the link. A value
    without at least two labels (filler words, ``n/a``, ``-``) names no host. Plain hosts, most rows, take one match
    that can't backtrack; only rows with brackets or wide characters are rewritten before they are read as a link.
    """
    raw = F.lower(c)
    link = F.translate(raw, "．。｡：／？＃＠", "...:/?#@")
    link = F.regexp_replace(link, f"{BLANK_CLASS}*[\\[({{]{BLANK_CLASS}*(?:\\.|dot){BLANK_CLASS}*[\\])}}]{BLANK_CLASS}*", ".")
    link = F.regexp_replace(link, "[\\[({](:|://)[\\])}]", "$1")
    link = F.when(raw.rlike("[\\[({．。｡：／？＃＠]"), link).otherwise(raw)
    return F.when(raw.rlike(PLAIN), raw).otherwise(F.try_element_at(F.regexp_extract_all(link, F.lit(LINK), F.lit(1)), F.lit(1)))


def rule_depth(psl: DataFrame) -> int:
    """Labels in the longest rule."""
    row = psl.agg(F.max(F.size(F.split("suffix", "\\."))).alias("d")).first()
    return int(row["d"] or 0)


def with_registrable(df: DataFrame, host_col: str, psl: DataFrame, out: str = "registrable") -> DataFrame:
    """Add the registrable domain of ``host_col``: its longest suffix in ``psl`` plus one label.

    A ``wildcard`` row makes each label directly below its suffix part of the suffix; an ``exception`` row is a
    registrable domain itself. Null for a null host, a host that is itself a suffix, and one with no suffix in the
    list. One map-side lookup for each label depth the list knows (five in the public list), no shuffle.
    """
    depth = rule_depth(psl)
    if depth == 0:
        return df.withColumn(out, F.lit(None).cast("string"))
    kinds = psl.select(F.lower("suffix").alias("suffix"), "kind").groupBy("suffix").agg(
        F.max(F.col("kind") == "rule").alias("r"),
        F.max(F.col("kind") == "wildcard").alias("w"),
        F.max(F.col("kind") == "exception").alias("e"),
    )
    labels = F.size(F.split(host_col, "\\."))
    names, got = df.columns, df
    for k in range(1, depth + 1):
        key = F.substring_index(F.col(host_col), ".", -k)
        side = checked_broadcast(kinds.select(F.struct("r", "w", "e").alias(f"__k{k}"), F.col("suffix").alias(f"__s{k}")))
        got = got.join(side, (key == F.col(f"__s{k}")) & (labels >= k), "left")
    hit = lambda k, x: F.coalesce(F.col(f"__k{k}.{x}"), F.lit(False))
    longest = F.greatest(F.lit(0), *(F.when(hit(k, "r"), F.lit(k)).otherwise(0) for k in range(1, depth + 1)), *(F.when(hit(k, "w") & (labels > k), F.lit(k + 1)).otherwise(0) for k in range(1, depth + 1)))
    by_rule = F.when((longest > 0) & (labels > longest), last_labels(F.col(host_col), labels, longest + 1))
    value = reduce(lambda rest, k: F.when(hit(k, "e"), F.substring_index(F.col(host_col), ".", -k)).otherwise(rest), range(1, depth + 1), by_rule)
    return got.select(*names, value.alias(out))


def last_labels(h: Column, labels: Column, n: Column) -> Column:
    """The last ``n`` labels of ``h``, a column number of them."""
    return F.array_join(F.slice(F.split(h, "\\."), labels - n + 1, n), ".")
