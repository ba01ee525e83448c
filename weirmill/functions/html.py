"""HTML by parser (Arrow batches) and, for what SQL can check, by patterns. Nothing is executed or fetched.

Null HTML gives null text and zero counts; truncated HTML is read as far as it goes, a tag or comment cut by the end is
left out; whole pages are read.
"""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILE = (
    "text string, title string, heading string, login_text string, forms int, inputs int, password_inputs int, iframes int, "
    "links array<string>, actions array<string>"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template"}
_CUT = re.compile(r"<(?:!--.*|[a-z/!?][^>]*)", re.I | re.S)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.zones, self.open = [], {"title": [], "heading": [], "login": []}, []
        self.n = {"forms": 0, "inputs": 0, "password_inputs": 0, "iframes": 0}
        self.links, self.actions = [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.n["forms"] += 1
            self.actions.append(a.get("action", ""))
        elif tag == "input":
            self.n["inputs"] += 1
            self.n["password_inputs"] += a.get("type", "").lower() == "password"
        elif tag == "iframe":
            self.n["iframes"] += 1
        elif tag == "a" and "href" in a:
            self.links.append(a["href"])
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if _SILENT & set(self.open):
            return
        if "title" in self.open:
            self.zones["title"].append(data)
            return
        self.parts.append(data)
        if self.open and self.open[-1] in ("h1", "h2", "h3"):
            self.zones["heading"].append(data)
        if "form" in self.open:
            self.zones["login"].append(data)


def _join(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def parse(page: str | None) -> tuple:
    """The profile of one page, in the order of ``PROFILE``."""
    if page is None:
        return (None, None, None, None, 0, 0, 0, 0, [], [])
    p = _Page()
    p.feed(page)
    if p.cdata_elem is None and _CUT.fullmatch(p.rawdata):
        p.rawdata = ""  # else the parser reads it as text
    p.close()
    z = p.zones
    return (_join(p.parts), _join(z["title"]), _join(z["heading"]), _join(z["login"]), *p.n.values(), p.links, p.actions)


def profile(page: Column) -> Column:
    """A struct with the fields of ``PROFILE``."""

    @F.pandas_udf(PROFILE)
    def run(pages: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in PROFILE.split(", ")]
        return pd.DataFrame([parse(p if isinstance(p, str) else None) for p in pages], columns=names)

    return run(page)


class _Clean(HTMLParser):
    """Writes the page again without scripts, handlers and filled-in values."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out, self.silent, self.secret = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
            return
        if self.silent:
            return
        kept = [(k, v) for k, v in attrs if not k.startswith("on") and not (tag in ("input", "textarea", "option") and k == "value") and not (v or "").strip().lower().startswith("javascript:")]
        self.out.append("<" + tag + "".join(f' {k}="{entities.escape(v)}"' if v is not None else f" {k}" for k, v in kept) + ">")
        if tag not in _VOID and (self.secret or tag == "textarea" or any(k == "contenteditable" and (v or "true").lower() != "false" for k, v in attrs)):
            self.secret.append(tag)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if not self.silent and tag not in _VOID:
            if tag in self.secret:
                while self.secret.pop() != tag:
                    pass
            self.out.append(f"</{tag}>")

    def _text(self, data):
        if not self.silent and not self.secret:
            self.out.append(data)

    handle_data = _text

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")


def clean(page: str | None) -> str | None:
    """Sanitised HTML; cleaning it again changes nothing."""
    if page is None:
        return None
    p = _Clean()
    p.feed(page)
    p.close()
    return "".join(p.out)


def sanitize(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(clean, na_action="ignore")

    return run(page)


def pattern_profile(page: Column) -> dict[str, Column]:
    """The part of the profile that patterns give on well-formed pages, in the JVM."""
    bare = F.regexp_replace(page, "(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>|<title[^>]*>.*?</title>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
    count = lambda p: F.coalesce(F.regexp_count(page, F.lit(p)), F.lit(0))
    return {
        "html_chars": F.length(page), "text_chars": F.length(text), "forms": count("(?i)<form[ >]"), "inputs": count("(?i)<input[ >]"),
        "password_inputs": count("(?i)<input[^>]*type=\"password\""), "links": count("(?i)<a [^>]*href="), "scripts": count("(?i)<script[ >]"),
    }
