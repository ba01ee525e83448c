"""Evaluation passages in a corpus: a prefix-filtered set join on word shingles with exact verification.

A passage is ``PASSAGE`` consecutive words of an item; its set are its shingles of ``SHINGLE`` words. A document holds
the passage only if it holds all of them, one after the other. So the corpus is read once, and what is kept of it are
segments: runs of shingles that all may be of items, long enough for a passage. Shingles are ordered by how rare they
are in the segments; one necessary prefix token of each passage, its rarest shingle, is joined with the segments' tokens.
Where a segment has the token, the passage must fit before and after it (position and length bounds); what is left is
compared word by word over a window the size of the passage.

Which shingles may be of items is told by a bit filter of bounded size: on large item sets it lets more through, which
costs rows and no result. Items never reach the driver; equal passages of several items are looked up once.

Defined results: null and empty texts, and those of fewer than ``PASSAGE`` words, hold no passage; rows without an id are
left out; a document and item are reported once, however often the passage is there and the row repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.functions.shingles import shingle_hashes
from weirmill.llm.skeleton import reader
from weirmill.operators.skew import heavy_of, salted
from weirmill.session import checked_broadcast, small, write_table

PASSAGE = 12
SHINGLE = 5
TOKENS = PASSAGE - SHINGLE + 1
#: Bits of the filter: sixteen a shingle within these powers of two. At most 8 MB is sent to every task.
LEAST_BITS, MOST_BITS = 16, 26
#: Words looked at together within a task.
CHUNK = 200_000
SALTS = 64


def _passages(items: DataFrame) -> DataFrame:
    """``(item_id, at, item_words, passage, shingles)`` of every passage of every item."""
    form = reader()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["item_id", "at", "item_words", "passage", "shingles"]
        for b in batches:
            for item, text in zip(b["item_id"], b["text"]):
                ws = form.words(text)
                sh = shingle_hashes(form.word_hashes(text), SHINGLE).view(np.int64)
                for low in range(0, len(ws) - PASSAGE + 1, CHUNK // PASSAGE):
                    high = min(low + CHUNK // PASSAGE, len(ws) - PASSAGE + 1)
                    yield pd.DataFrame([(item, k, len(ws), " ".join(ws[k : k + PASSAGE]), sh[k : k + TOKENS]) for k in range(low, high)], columns=names)

    known = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return known.mapInPandas(run, "item_id long, at int, item_words int, passage string, shingles array<long>")


def _places(shingles: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each shingle."""
    mask = np.uint64((1 << bits) - 1)
    return shingles & mask, (shingles >> np.uint64(37)) & mask


def _filter(passages: DataFrame, total: int) -> tuple[np.ndarray, int]:
    """The bit filter of all passages' shingles, in bytes, and its size as a power of two. Executors bring it together; the
    driver gets one number for 64 bits."""
    bits = min(max(int(np.ceil(np.log2(16 * total))), LEAST_BITS), MOST_BITS)
    mask = F.lit((1 << bits) - 1).cast("long")
    h = passages.select(F.explode("shingles").alias("h"))
    at = h.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 37).bitwiseAND(mask))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return filled.view(np.uint8), bits


def _segments(docs: DataFrame, filled: np.ndarray, bits: int) -> DataFrame:
    """``(doc_id, start, words, shingles)`` of every longest run of shingles that pass the filter, if it holds a passage."""
    sent, form = docs.sparkSession.sparkContext.broadcast(filled), reader()

    def look(ids: list, texts: list[str], hashed: list[np.ndarray]) -> pd.DataFrame:
        size = np.fromiter(map(len, hashed), np.int64, len(hashed))
        first = np.cumsum(size) - size
        sh = shingle_hashes(np.concatenate([*hashed, np.zeros(0, np.uint64)]), SHINGLE)
        hit = np.ones(len(sh), bool)
        for at in _places(sh, bits):
            hit &= (sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        for k in range(1, SHINGLE):  # shingles over the end of a text
            over = first[1:] - k
            hit[over[(over >= 0) & (over < len(sh))]] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        low, high = edge[::2], edge[1::2]
        long = high - low >= TOKENS
        out, read = [], {}
        for a, b in zip(low[long].tolist(), high[long].tolist()):
            d = int(np.searchsorted(first, a, "right")) - 1
            ws = read.get(d)
            if ws is None:
                read = {d: (ws := form.words(texts[d]))}
            s = a - int(first[d])
            out.append((ids[d], s, ws[s : b - int(first[d]) + SHINGLE - 1], sh[a:b].view(np.int64)))
        return pd.DataFrame(out, columns=["doc_id", "start", "words", "shingles"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, hashed, n = [], [], [], 0
            for i, text in zip(b["doc_id"], b["text"]):
                h = form.word_hashes(text)
                if len(h) < PASSAGE:
                    continue
                ids.append(i), texts.append(text), hashed.append(h)
                n += len(h)
                if n >= CHUNK:
                    yield look(ids, texts, hashed)
                    ids, texts, hashed, n = [], [], [], 0
            if ids:
                yield look(ids, texts, hashed)

    return docs.mapInPandas(run, "doc_id long, start int, words array<string>, shingles array<long>")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, at, item_words)``: each passage of an item that stands in a document, by its first word in the
    item, and all words of the item."""
    spark = docs.sparkSession
    passages = write_table(_passages(items).withColumn("passage_id", F.unhex(F.md5(F.col("passage").cast("binary")))), "passages")
    total = passages.count()
    if not total:
        return spark.createDataFrame([], "doc_id long, item_id long, at int, item_words int")
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    segments = write_table(_segments(docs, *_filter(passages, total)), "segments")

    tokens = segments.select("doc_id", "start", F.size("shingles").alias("n_tokens"), F.posexplode("shingles").alias("pos", "token"))
    counts = write_table(tokens.groupBy("token").agg(F.count("*").alias("n")), "token_counts")
    unique = passages.groupBy("passage_id").agg(F.first("passage").alias("passage"), F.first("shingles").alias("shingles"))
    ordered = unique.select("passage_id", F.posexplode("shingles").alias("off", "token")).join(counts, "token", "left")
    prefix = ordered.groupBy("passage_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "token")).alias("p")).filter("p.n > 0")  # else no document can hold it
    prefix = prefix.select("passage_id", F.col("p.off").alias("off"), F.col("p.token").alias("token")).join(unique.select("passage_id", "passage"), "passage_id")
    prefix = write_table(prefix, "prefixes")

    if small(prefix, 100_000):  # passages of twelve words each, sent only below this count and its bytes
        met = tokens.join(checked_broadcast(prefix), "token")
    else:
        heavy = heavy_of(counts, ["token"], "n")
        spread = prefix.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "token", "left")
        spread = spread.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
        met = salted(tokens, ["token"], F.struct("doc_id", "start", "pos"), heavy, SALTS).join(spread, ["token", "salt"])
    fits = met.withColumn("from", F.col("pos") - F.col("off")).filter((F.col("from") >= 0) & (F.col("from") + TOKENS <= F.col("n_tokens")))
    seen = fits.select("doc_id", "start", "from", "passage_id", "passage").join(segments.select("doc_id", "start", "words"), ["doc_id", "start"])
    seen = seen.filter(F.array_join(F.slice("words", F.col("from") + 1, PASSAGE), " ") == F.col("passage")).select("doc_id", "passage_id").distinct()
    return seen.join(checked_broadcast(passages.select("passage_id", "item_id", "at", "item_words")), "passage_id").select("doc_id", "item_id", "at", "item_words")


def pairs(found: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of each document and item that share a passage."""
    return found.select("doc_id", "item_id").distinct()


def shared(found: DataFrame) -> DataFrame:
    """``(doc_id, item_id, shared_words, item_words)``: words of the item that stand in the document within shared
    passages; all of its words where the whole item leaked."""
    words = found.select("doc_id", "item_id", "item_words", F.explode(F.sequence(F.col("at"), F.col("at") + PASSAGE - 1)).alias("word")).distinct()
    return words.groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("shared_words"), F.max("item_words").alias("item_words"))


def item_report(found: DataFrame) -> DataFrame:
    """``(item_id, documents, whole_documents, most_shared_words)`` of every item that leaked."""
    per = shared(found)
    return per.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("shared_words") >= F.col("item_words")).alias("whole_documents"), F.max("shared_words").alias("most_shared_words"))
