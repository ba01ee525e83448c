"""Text and category values as column expressions that stay in the JVM; Unicode forms in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters, then the invisible blanks.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "\u180e\u200b\u2060\ufeff"
BLANK_CLASS = (
    "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u180E\\u200B\\u2060\\uFEFF]"
)


def strip(c: Column) -> Column:
    """Without blanks of any kind around it."""
    return F.trim(c, F.lit(BLANKS))


def category(c: Column) -> Column:
    """A category value: lower case, no blanks around; null where nothing is left."""
    return F.nullif(strip(F.lower(c)), F.lit(""))


def label(c: Column) -> Column:
    """A class label: as :func:`category`, with ``phish`` read as ``phishing``."""
    v = category(c)
    return F.when(v == "phish", F.lit("phishing")).otherwise(v)


def blank_pieces(c: Column) -> Column:
    """Number of pieces between blanks of any kind; 0 for null and blank text."""
    return F.coalesce(F.regexp_count(c, F.lit("[^\\p{IsWhite_Space}\\x1C-\\x1F\\u180E\\u200B\\u2060\\uFEFF]++")), F.lit(0)).cast("long")


def char_ngrams(c: Column, n: int) -> Column:
    """All runs of ``n`` characters, in order; none of a shorter or null text."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


# Phrases by which a page claims to be official or asks to sign in.
CLAIMS = {
    "sign_in": "đăng nhập|sign in|log in", "verify_account": "xác (?:minh|thực) tài khoản|verify (?:your |the )?account", "official": "cổng thông tin chính thức|trang chính thức|official (?:portal|site|page)",
}
# What a page asks for when it asks for what must not be given away.
REQUESTS = "mật khẩu|mã otp|mã xác thực|số thẻ|căn cước|password|passcode|one-time code|\\botp\\b|card number|identity number"


def claims(c: Column) -> Column:
    """Names of the claim phrases a text holds, in the order of ``CLAIMS``; none of a null text."""
    return F.array_compact(F.array(*(F.when(F.lower(c).rlike(p), F.lit(k)) for k, p in CLAIMS.items())))


def requests(c: Column) -> Column:
    """Whether a text asks for a password, a code or an identity; false for a null text."""
    return F.coalesce(F.lower(c).rlike(REQUESTS), F.lit(False))


class _Letters(dict):
    """Code point to the plain letters it stands for, filled by rule as characters are met. Signs keep their form: the
    letters of a trade mark sign are no part of the word before it."""

    def __missing__(self, code: int) -> str | None:
        c, to = chr(code), unicodedata.normalize("NFKC", chr(code))
        unseen = unicodedata.category(c) == "Cf" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F or 0xE0100 <= code <= 0xE01EF
        wide = unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<small>")) and len(to) == 1
        self[code] = None if unseen else to if wide or unicodedata.category(c)[0] in "LMN" else c
        return self[code]


_LETTERS = _Letters()


def one_spelling(text: str) -> str:
    """Composed, wide and styled letters plain, nothing invisible inside."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_LETTERS))


def without_accents(text: str) -> str:
    """:func:`one_spelling` without accents, ``đ`` as ``d``."""
    if text.isascii():
        return text
    apart = unicodedata.normalize("NFD", one_spelling(text))
    return unicodedata.normalize("NFC", "".join(c for c in apart if unicodedata.category(c) != "Mn")).replace("đ", "d").replace("Đ", "D")


def spelled(c: Column, accents: bool = True) -> Column:
    """:func:`one_spelling` or :func:`without_accents` of a column; null stays null."""
    one = one_spelling if accents else without_accents

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(c)
