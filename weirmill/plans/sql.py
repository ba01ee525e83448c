"""Pieces of the SQL that queries are checked against."""

from __future__ import annotations

from weirmill.functions.text import BLANKS


def category(c: str) -> str:
    return f"nullif(trim(lower({c}), '{BLANKS}'), '')"


def label(c: str) -> str:
    return f"(case when {category(c)} = 'phish' then 'phishing' else {category(c)} end)"


def host(c: str) -> str:
    """Step by step: defang, then drop scheme, rest, user, port, closing dot and www; two labels at least."""
    x = f"trim(lower({c}), '{BLANKS}')"
    x = f"regexp_replace({x}, '[\\[({{]\\s*(\\.|dot)\\s*[\\])}}]', '.', 'g')"
    for pattern in ("^([a-z][a-z0-9+.-]*:)?[/\\\\]{2,}", "[/\\\\?#].*$", "^.*@", "\\.?(:[0-9]*)?\\.?$"):
        x = f"regexp_replace({x}, '{pattern}', '')"
    x = f"regexp_replace({x}, '^www\\.([^.]+\\.[^.])', '\\1')"
    return f"nullif(regexp_extract({x}, '^[\\p{{L}}\\p{{N}}\\p{{M}}_-]+(\\.[\\p{{L}}\\p{{N}}\\p{{M}}_-]+)+$'), '')"


URLS = f"""
u as (select record_id, {label('label')} as label, {category('source')} as source, {category('tier')} as tier,
  {category('scenario')} as scenario, {category('split')} as split, {host('domain')} as host, collected_at, ingested_at,
  cast(collected_at at time zone 'UTC' as date) as day from url_audit)"""
