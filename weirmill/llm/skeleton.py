"""One form for text that looks the same: a confusables skeleton.

Decompose, replace every character by its prototype, decompose again: characters without a visible mark go, wide and
narrow forms, ligatures and mathematical alphabets become plain, letters of other scripts with the shape of a Latin
one become that one, every run of blanks becomes one space and none is left at the ends. ASCII stands for itself, so
case and all ASCII characters stay apart. The result is composed again, which neither joins nor splits classes.

Defined results: null stays null; text without a visible mark becomes empty. Documents with null or empty text belong to
no class. Whole texts are read, of any length.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.session import write_table

# Readings that go before the published ones, most of them the commonest look-alikes of Latin letters.
LOOK_ALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜ", "ABESIJKMHOPCTYXYQW")),  # Cyrillic capitals
    **dict(zip("аеһіјорѕсԁԛгѵԝхуүӏ", "aehijopscdqrvwxyyl")),  # Cyrillic small letters
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿ", "ABEZHIKMNOPTYXJ")),  # Greek capitals
    **dict(zip("αγινορσυϲϳ", "ayivopoucj")),  # Greek small letters
    **dict(zip("ՍՏՕԼհոսօզցյ", "USOLhnuoqgj")),  # Armenian
    **dict(zip("ɑɡıɩȷʏƽ", "agiijys")),  # other Latin
    **dict(zip("ÐƉ", "ĐĐ")),
    **dict(zip("‐‑‒–−⁃˗﹘", "--------")),
    **dict(zip("‘’‛′ʼʹ‵", "'''''''")),
    **dict(zip("“”‟″〃", '"""""')),
    **dict(zip("‚⸲․⁄∕∶ː꞉ǃ∗‹›ꓽ∼˜", ",,.//:::!*<>:~~")),
    "…": "...",
    "‥": "..",
}
# Characters without a visible mark that are not format characters by category.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0x180B, 0x180E)]))
#: Pieces between blanks whose words are remembered, and the longest that is.
KEEP, KEEP_CHARS = 300_000, 64


def _kind(c: str) -> str:
    k = unicodedata.category(c)
    return k if k in ("Lu", "Ll") else {"L": "Ll", "N": "N"}.get(k[0], "S")


def _plain(text: str) -> bool:
    """Of visible ASCII characters and letters of a Latin alphabet."""
    return all("!" <= c <= "~" or unicodedata.name(c, "").startswith("LATIN") for c in text)


def derive(skeletons: dict[str, str]) -> dict[str, str]:
    """Character to prototype, of the published skeletons whose prototype is of ASCII characters or Latin letters.

    The published table folds some ASCII characters together (0 with O, 1 and I with l ...). A character with such a
    prototype stands for the ASCII character of its own kind: capital, small letter (caseless letters too, but for those named after
    the capital), digit or sign. Where its
    compatibility form has the same skeleton, as a Roman numeral's, it stands for that.
    """
    folded: dict[str, list[str]] = {}
    for c in map(chr, range(0x21, 0x7F)):
        folded.setdefault(skeletons.get(c, c), []).append(c)
    whole = lambda t: "".join(skeletons.get(c, c) for c in unicodedata.normalize("NFD", t))
    table = {}
    for c, p in skeletons.items():
        if c < "\x80" or c.isspace() or unicodedata.normalize("NFD", c) != c:
            continue
        like = unicodedata.normalize("NFKC", c)
        if like != c and whole(like) == p and _plain(like):
            to = like
        else:
            ascii_ = folded.get(p, [])
            named = [a for a in ascii_ if unicodedata.category(c) == "Lo" and unicodedata.name(c).split()[-1] == a]
            to = next((a for a in named or ascii_ if named or _kind(a) == _kind(c)), p if _plain(p) or not ascii_ else ascii_[0])
        if to and to != c and _plain(to):
            table[c] = to
    return table


@cache
def look_alikes() -> dict[str, str]:
    """The table of look-alikes, on the driver: derived from the confusables (UTS #39) of the ICU library in Spark's own
    JVM, asked once for all characters. Hangul syllables decompose; unassigned and private characters have no shape."""
    chars = [c for c in map(chr, range(0x21, 0x20000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and not "\uac00" <= c <= "\ud7a3" and not c.isspace()]
    builder = getattr(SparkSession.active()._jvm.com.ibm.icu.text, "SpoofChecker$Builder")()
    got = builder.build().getSkeleton("\n".join(chars)).split("\n")
    table = derive({c: g for c, g in zip(chars, got, strict=True) if c != g}) | LOOK_ALIKES
    while (further := {c: "".join(table.get(x, x) for x in to) for c, to in table.items()}) != table:  # the prototype of a prototype
        table = further
    return table


class _Prototypes(dict):
    """Code point to prototype, filled by rule as characters are met."""

    def __init__(self, table: dict[str, str]) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in self.table:
            to = self.table[c]
        elif c in UNSEEN or kind == "Cf" or 0xE0100 <= code <= 0xE01EF or (kind == "Cc" and not c.isspace()):
            to = None
        elif c.isspace() or c == "⠀":
            to = " "
        else:
            tag, _, parts = unicodedata.decomposition(c).partition(" ")
            ligature = tag == "<compat>" and (0xFB00 <= code <= 0xFB17)
            letter = tag == "<compat>" and kind[0] in "LN" and " " not in parts
            if tag in ("<wide>", "<narrow>", "<font>") or ligature or letter:
                to = "".join(chr(int(x, 16)) for x in parts.split()).translate(self)
            else:
                to = c
        self[code] = to
        return to


class _Cases(dict):
    """For words compared without regard to case: a letter stands for the small prototype of its other case too."""

    def __init__(self, table: dict[str, str]) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, code: int) -> str:
        c = chr(code)
        other = [self.table.get(x) for x in (c.lower(), c.upper())]
        to = next((x.lower() for x in other if x), c) if c in c.lower() + c.upper() and not c.isascii() else c
        kind = unicodedata.category(c)[0]
        self[code] = to if kind in "LNM" else " "
        return self[code]


class _Pieces(dict):
    """Piece of text between blanks to what ``read`` makes of it; forgets all when it grows beyond ``KEEP``."""

    def __init__(self, read) -> None:
        super().__init__()
        self.read = read

    def __missing__(self, piece: str):
        got = self.read(piece)
        if len(piece) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = got
        return got


class OneForm:
    """Reads texts in their one form. It travels to the executors with the functions that use it, the table in it.

    A blank of any kind separates words whatever stands beside it, so a text's words are those of its pieces between
    blanks, and what a piece reads as is remembered.
    """

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        self.prototypes, self.cases = _Prototypes(table), _Cases(table)
        self._words, self._hashes = _Pieces(self._read), _Pieces(lambda p: tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self._words[p]))

    def __reduce__(self):
        return OneForm, (self.table,)

    def skeleton(self, text: str | None) -> str | None:
        """The one form of ``text``."""
        if text is None:
            return None
        if text.isascii() and text.isprintable():
            return " ".join(text.split(" ")) if "  " not in text and text[:1] != " " != text[-1:] else " ".join(text.split())
        form = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(self.prototypes))
        return unicodedata.normalize("NFC", " ".join(form.split()))

    def _read(self, piece: str) -> tuple[str, ...]:
        return tuple(self.skeleton(piece).lower().translate(self.cases).split())

    def words(self, text: str | None) -> list[str]:
        """Runs of letters and digits (with their accents) of the one form, in lower case."""
        got: list[str] = []
        for p in (text or "").split():
            got += self._words[p]
        return got

    def word_hashes(self, text: str | None) -> np.ndarray:
        """64-bit hashes of :meth:`words`."""
        got: list[int] = []
        for p in (text or "").split():
            got += self._hashes[p]
        return np.fromiter(got, np.uint64, len(got))


@cache
def reader() -> OneForm:
    """The reader of this driver."""
    return OneForm(look_alikes())


def skeleton(text: str | None) -> str | None:
    """The one form of ``text``, on the driver."""
    return reader().skeleton(text)


def words(text: str | None) -> list[str]:
    """The words of the one form of ``text``, on the driver."""
    return reader().words(text)


def one_form(text: Column) -> Column:
    """:func:`skeleton` of a column."""
    form = reader()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(form.skeleton, na_action="ignore")

    return run(text)


def form_digest(text: Column) -> Column:
    """128 bits of the one form: what is shuffled in place of whole texts."""
    form = reader()

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.blake2b(form.skeleton(t).encode("utf-8", "surrogatepass"), digest_size=16).digest(), na_action="ignore")

    return run(text)


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_id, form_id)`` of every document with text: 128-bit ids of its text and of its one form."""
    d = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    return d.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_id"), form_digest(F.col("text")).alias("form_id"))


def class_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, variants, documents)``: the class of each document, how many different texts it holds and how
    many documents. Copies are counted on the map side, so that a class of a third of all rows stays spread."""
    c = write_table(classes(docs), "classes")
    per = c.groupBy("form_id", "text_id").agg(F.count("*").alias("n")).groupBy("form_id").agg(F.count("*").alias("variants"), F.sum("n").alias("documents"))
    return c.join(per, "form_id").select("doc_id", F.lower(F.hex("form_id")).alias("class_id"), "variants", "documents")


def look_alike_pairs(docs: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, smaller first, of documents with different texts of one form.

    Different texts of a class are paired first, then their documents are put in: copies of one text never meet.
    """
    c = write_table(classes(docs), "classes")
    variants = c.select("form_id", "text_id").distinct()
    several = variants.groupBy("form_id").agg(F.count("*").alias("n")).filter("n > 1").select("form_id")
    variants = variants.join(several, "form_id")
    pairs = variants.withColumnRenamed("text_id", "ta").join(variants.withColumnRenamed("text_id", "tb"), "form_id").filter("ta < tb").select("ta", "tb")
    a = c.select(F.col("doc_id").alias("da"), F.col("text_id").alias("ta"))
    b = c.select(F.col("doc_id").alias("db"), F.col("text_id").alias("tb"))
    got = pairs.join(a, "ta").join(b, "tb")
    return got.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).filter("doc_id_a <> doc_id_b").distinct()
