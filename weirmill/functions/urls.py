"""URL functions that stay in the JVM. ``parse_url`` is not used: it gives null for underscores, IDN and ``|``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 8192
SCHEME = "^(?i)(https?)://"


def status(url: Column) -> Column:
    """``ok``, ``scheme_added`` (a host without scheme), ``too_long`` or ``invalid`` (also for null and empty)."""
    u = F.trim(url)
    return (
        F.when(u.isNull() | (u == ""), "invalid")
        .when(F.length(u) > MAX_LENGTH, "too_long")
        .when(u.rlike("^(?i)https?://[^\\s/?#]+[^\\s]*$"), "ok")
        .when(u.rlike("^[0-9A-Za-z_-]+(\\.[0-9A-Za-z_-]+)+([/?#:][^\\s]*)?$"), "scheme_added")
        .otherwise("invalid")
    )


def repaired(url: Column) -> Column:
    """The URL with a scheme, null if it is not usable."""
    s, u = status(url), F.trim(url)
    return F.when(s == "ok", u).when(s == "scheme_added", F.concat(F.lit("http://"), u))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, path, parameter names with their values replaced by ``*``; no user, no fragment."""
    u = F.regexp_replace(repaired(url), "#.*$", "")
    u = F.regexp_replace(u, "^([A-Za-z]+://)[^/?#]*@", "$1")
    head = F.lower(F.regexp_extract(u, "^[A-Za-z]+://[^/?]*", 0))
    path = F.regexp_extract(u, "^[A-Za-z]+://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(u, "\\?(.*)$", 1)
    return F.concat(head, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.regexp_replace(query, "=[^&]*", "=*"))))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(normalize(url), "^([A-Za-z]+)://", 1))


def host_of(url: Column) -> Column:
    """The host of a URL without user, port and closing dot."""
    h = F.regexp_extract(normalize(url), "^[a-z]+://([^/?:]*)", 1)
    return F.nullif(F.regexp_replace(h, "\\.$", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(normalize(url), "^[a-z]+://[^/?]*([^?]*)", 1)


def param_names(url: Column) -> Column:
    """Names of the query parameters, sorted and joined by commas."""
    q = F.regexp_extract(normalize(url), "\\?(.*)$", 1)
    names = F.filter(F.transform(F.split(q, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1)), lambda n: n != "")
    return F.array_join(F.array_sort(F.array_distinct(names)), ",")


def lexical(url: Column) -> dict[str, Column]:
    """Lengths and counts of the URL's characters and labels."""
    n, h = normalize(url), host_of(url)
    return {
        "url_chars": F.length(n), "host_chars": F.length(h), "host_labels": F.size(F.split(h, "\\.")),
        "digits": F.regexp_count(n, F.lit("[0-9]")), "hyphens": F.regexp_count(h, F.lit("-")),
        "path_depth": F.regexp_count(path(url), F.lit("/[^/]")), "parameters": F.regexp_count(n, F.lit("=\\*")),
        "has_user": F.trim(url).rlike("^[A-Za-z]+://[^/?#]*@"), "is_ip": h.rlike("^[0-9]+(\\.[0-9]+){3}$"),
    }
