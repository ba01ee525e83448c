"""Same or near-same strings across splits: a weighted cosine join of character-gram vectors.

Each string is a vector of its padded character grams, weighted by rarity. Vectors of the two sides meet in inverted
lists: a vector is entered only under its rarest terms, up to the point where the terms still to come can't reach the
threshold, by the most they can weigh in a vector of the other side (maximum weight) or by their norm (residual norm).
Candidates get their exact dot product, and the cosine decides. For pairs one edit apart the threshold of a vector is the
least cosine any string one edit away can have, so that no such pair is lost; an edit destroys only grams that overlap its
place, which ends the prefix once two of its grams lie a whole gram apart, and lets the lists be cut by length and offset.

Defined results: null strings take no part; rows without a record id or split are left out; repeated rows of one record
are one; a record never pairs with itself. Empty sides give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.operators.skew import heavy_of, salted
from weirmill.session import checked_broadcast, write_table

GRAM = 6
#: Gram frequencies are counted in this many hashed cells: a bound on what is sent to every task, whatever the data.
CELLS = 1 << 16
SALTS = 64
_PAD = 0x110000  # beyond every code point


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x.astype(np.uint64)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: the text each gram is of, its offset, and its 64-bit hash. A text of n characters has
    n + q - 1 grams, padded at both ends."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    size = lengths + 2 * (q - 1)
    starts = np.cumsum(size) - size
    flat = np.full(int(size.sum()), _PAD, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[starts[owner] + (q - 1) + inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = lengths + q - 1
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(of), np.uint64)
    for k in range(q):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[starts[of] + at + k])
    return of, at, h


def gram_weights(df: DataFrame, text: str, q: int = GRAM) -> np.ndarray:
    """Squared weight of each hashed gram cell: one plus the logarithm of how many times rarer it is than the commonest.
    Counted over all rows; the driver gets one number a cell, at most ``CELLS``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount((grams(b[text].tolist(), q)[2] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"cell": some, "n": total[some]})

    rows = df.select(text).filter(F.col(text).isNotNull()).mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(CELLS, np.float64)
    n[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return 1 + np.log(max(n.max(initial=1.0), 1.0) / np.maximum(n, 1.0))


def most_weights(df: DataFrame, text: str, weights, q: int = GRAM) -> np.ndarray:
    """The greatest normalised weight a gram of each cell has in any vector of ``df``; 0 where no vector has it. The driver
    gets one number a cell."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.full(CELLS, np.inf)
        for b in batches:
            of, _, h = grams(b[text].tolist(), q)
            cell = (h % np.uint64(CELLS)).astype(np.int64)
            norm2 = np.bincount(of, weights.value[cell], len(b))
            np.minimum.at(least, cell, norm2[of])
        some = np.flatnonzero(np.isfinite(least))
        yield pd.DataFrame({"cell": some, "norm2": least[some]})

    rows = df.select(text).filter(F.col(text).isNotNull()).mapInPandas(count, "cell long, norm2 double").groupBy("cell").agg(F.min("norm2").alias("norm2")).toPandas()
    most, cells = np.zeros(CELLS), rows["cell"].to_numpy(np.int64)
    most[cells] = np.sqrt(weights.value[cells] / rows["norm2"].to_numpy(np.float64))
    return most


def _edit_bounds(of: np.ndarray, w2: np.ndarray, n: np.ndarray, q: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors with their grams in order of offset: the weight any string one edit away shares at least, and the cosine
    it has at least. An edit destroys at most the heaviest q neighbouring grams (weight D) and makes at most q new ones, so
    at least S = |x|² - D is shared and the cosine is at least S / (|x| sqrt(S + q max w²))."""
    run = np.concatenate([[0.0], np.cumsum(w2)])
    first = np.cumsum(n) - n
    norm2 = run[first + n] - run[first]
    end = np.minimum(np.arange(len(of)) + q, (first + n)[of])
    lost = np.maximum.reduceat(run[end] - run[:-1], first) if len(n) else np.zeros(0)
    shared = np.maximum(norm2 - lost, 0.0)
    return shared, np.where(norm2 > 0, shared / np.sqrt(np.maximum(norm2 * (shared + q * most), 1e-12)), 0.0)


def _prefixes(texts: list[str], weights: np.ndarray, q: int, threshold: float | None, most: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Text, offset and hash of each gram to be entered in the lists, length and squared norm of its text.

    The terms of a vector stand in the order rarest first, the same for all vectors, so the first term two vectors share
    has all they share behind it on both sides. It is entered if what is behind it can reach the threshold: by its norm,
    and by its weights times the greatest the other side has (``most``). With ``threshold`` None the vector's own bounds
    (:func:`_edit_bounds`) take their place.
    """
    of, at, h = grams(texts, q)
    cell = (h % np.uint64(CELLS)).astype(np.int64)
    w2 = weights[cell]
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    least, bound = _edit_bounds(of, w2, n, q, weights.max()) if threshold is None else (None, np.full(len(texts), threshold))
    order = np.lexsort((h, -w2, of))
    of, at, h, w2, cell = of[order], at[order], h[order], w2[order], cell[order]
    run = np.concatenate([[0.0], np.cumsum(w2)])
    rank = np.arange(len(of)) - first[of]
    norm2 = (run[first + n] - run[first])[of]
    rest2 = run[(first + n)[of]] - run[:-1]  # squared norm of this term and those after it
    slack = 1e-9
    keep = np.sqrt(np.maximum(rest2, 0.0) / norm2) >= bound[of] - slack  # residual norm
    if threshold is None:
        keep &= rest2 >= least[of] - slack  # maximum weight: no term of the other side weighs more
        low, high = at.copy(), at.copy()  # least and greatest offset of the terms before this one
        for lo_hi, f in ((low, np.minimum), (high, np.maximum)):
            step = 1
            while step < int(n.max(initial=0)):
                prior = np.concatenate([lo_hi[:step], lo_hi[:-step]])
                np.copyto(lo_hi, np.where(rank >= step, f(lo_hi, prior), lo_hi))
                step *= 2
        span = np.concatenate([[0], (high - low)[:-1]])
        keep &= (rank == 0) | (span < q)
    else:
        reach = np.concatenate([[0.0], np.cumsum(np.sqrt(w2) * most[cell])])
        keep &= (reach[(first + n)[of]] - reach[:-1]) / np.sqrt(norm2) >= threshold - slack  # maximum weight
    return of[keep], at[keep], h[keep], np.fromiter(map(len, texts), np.int64, len(texts))[of[keep]], norm2[keep]


def _entries(weights, text: str, q: int, several: bool):
    """mapInPandas: ``(key, id)`` of every list a string is entered in; ``several`` enters it for each length and offset
    that a string one edit away can have, the other side for its own only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for b in batches:
            of, at, h, n, _ = _prefixes(b[text].tolist(), w, q, None)
            ids = b["id"].to_numpy()[of]
            keys, out = [], []
            for longer, later in ((0, 0), (-1, 0), (-1, -1), (1, 0), (1, 1)) if several else ((0, 0),):
                keys.append(_mix(h ^ (((n + longer).astype(np.uint64) << np.uint64(32)) + (at + later + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)))
                out.append(ids)
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "id": np.concatenate(out)})

    return run


def _lists(weights, most, text: str, q: int, threshold: float):
    """mapInPandas: ``(key, id, norm2)`` of every list a vector is entered in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of, _, h, _, norm2 = _prefixes(b[text].tolist(), weights.value, q, threshold, most.value)
            yield pd.DataFrame({"key": h.view(np.int64), "id": b["id"].to_numpy()[of], "norm2": norm2})

    return run


def _dots(weights, q: int):
    """mapInPandas: exact dot product and cosine of each pair of strings ``a`` and ``b``, and the least cosine each of them
    has with any string one edit away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for p in batches:
            m = len(p)
            if not m:
                continue
            of, _, h = grams([*p["a"], *p["b"]], q)
            w2 = w[(h % np.uint64(CELLS)).astype(np.int64)]
            norms = np.sqrt(np.bincount(of, w2, 2 * m))
            bound = _edit_bounds(of, w2, np.bincount(of, minlength=2 * m), q, w.max())[1]
            pair, side = of % m, of // m
            order = np.lexsort((side, h, pair))
            pair, h, side, w2 = pair[order], h[order], side[order], w2[order]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (h[1:] != h[:-1])])
            g = np.cumsum(new) - 1
            both = np.minimum(np.bincount(g, side == 0), np.bincount(g, side == 1))
            dot = np.bincount(pair[new], both * w2[new], m)
            yield p.assign(dot=dot, cosine=np.minimum(dot / np.maximum(norms[:m] * norms[m:], 1e-12), 1.0), bound=np.maximum(bound[:m], bound[m:]))

    return run


SCORED = "a string, b string, dot double, cosine double, bound double"


def _sides(left: DataFrame, right: DataFrame, q: int):
    """Both sides with a 64-bit id for each string, and the weights of the grams of both."""
    sides = [d.select(F.col("text"), F.xxhash64("text").alias("id")) for d in (left, right)]
    weights = gram_weights(left.select("text").unionAll(right.select("text")), "text", q)
    return sides, left.sparkSession.sparkContext.broadcast(weights)


def _pairs(sides: list[DataFrame], lists: list[DataFrame], ratio: float | None = None) -> DataFrame:
    """``(a, b)`` of the strings that meet in a list; with ``ratio``, of those whose norms are no
    further apart: the cosine is at most the smaller norm over the greater."""
    met = lists[0].withColumnsRenamed({"id": "ia", "norm2": "na"}).join(lists[1].withColumnsRenamed({"id": "ib", "norm2": "nb"}), "key")
    if ratio is not None:
        met = met.filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(ratio * ratio - 1e-9))
    found = met.select("ia", "ib").distinct()
    strings = [s.select(F.col("id").alias(i), F.col("text").alias(t)) for s, i, t in zip(sides, ("ia", "ib"), "ab")]
    return found.join(strings[0], "ia").join(strings[1], "ib").select("a", "b")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, q: int = GRAM) -> DataFrame:
    """``(a, b, dot, cosine)`` of each string ``a`` of ``left.text`` and ``b`` of ``right.text``, both distinct and not null,
    whose vectors have at least the cosine ``threshold``. A gram a string has twice counts twice. Complete."""
    sides, weights = _sides(left, right, q)
    sent = [left.sparkSession.sparkContext.broadcast(most_weights(s, "text", weights, q)) for s in sides]
    lists = [s.mapInPandas(_lists(weights, most, "text", q, threshold), "key long, id long, norm2 double") for s, most in zip(sides, reversed(sent))]
    scored = _pairs(sides, lists, threshold).mapInPandas(_dots(weights, q), SCORED)
    return scored.filter(F.col("cosine") >= threshold).drop("bound")


def near_strings(left: DataFrame, right: DataFrame, q: int = GRAM) -> DataFrame:
    """``(a, b, dot, cosine)`` of each string ``a`` of ``left.text`` and ``b`` of ``right.text``, both distinct, that
    differ by exactly one character inserted, dropped or replaced: of the pairs whose cosine is at least what such a pair
    has, those an exact check confirms.

    Complete for strings of at least two characters (two single characters share no gram). The larger side should be
    ``left``; it is entered once a term, the other five times.
    """
    sides, weights = _sides(left, right, q)
    lists = [s.mapInPandas(_entries(weights, "text", q, several), "key long, id long") for s, several in zip(sides, (False, True))]
    pairs = _pairs(sides, lists)
    close = pairs.filter((F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") != F.col("b")))
    scored = close.mapInPandas(_dots(weights, q), SCORED)
    return scored.filter((F.col("dot") > 0) & (F.col("cosine") >= F.col("bound") - 1e-9)).filter(F.levenshtein("a", "b", 1) == 1).drop("bound")


def host_pairs(rows: DataFrame, train: str = "train", evals: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """``(host_a, host_b, cosine)`` of train host and evaluation host, equal or one edit apart. ``rows``: host, split."""
    per = rows.filter(F.col("host").isNotNull()).groupBy(F.col("host").alias("text")).agg(F.max(F.col("split") == train).alias("t"), F.max(F.col("split").isin(*evals)).alias("e"))
    per = write_table(per.filter("t or e"), "hosts")
    near = near_strings(per.filter("t").select("text"), per.filter("e").select("text"))
    same = per.filter("t and e").select(F.col("text").alias("host_a"), F.col("text").alias("host_b"), F.lit(1.0).alias("cosine"))
    return write_table(same.unionByName(near.select(F.col("a").alias("host_a"), F.col("b").alias("host_b"), "cosine")), "host_pairs")


def record_pairs(rows: DataFrame, pairs: DataFrame, train: str = "train", evals: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """``(record_id_a, record_id_b)``, smaller first, of train and evaluation records of paired hosts.

    ``rows``: record_id, host, split. Only records of paired hosts are shuffled. Train records meet evaluation records by
    the train host; a train host with very many of them is salted by record, and the evaluation records paired with it are
    copied to every salt.
    """
    rows = rows.filter(F.col("record_id").isNotNull() & F.col("host").isNotNull())
    pairs = pairs.select("host_a", "host_b")
    there = checked_broadcast(pairs.select("host_a").distinct())
    a = rows.filter(F.col("split") == train).join(there, F.col("host") == F.col("host_a"), "left_semi").select(F.col("record_id").alias("ra"), F.col("host").alias("host_a")).distinct()
    a = write_table(a, "train_records")
    b = rows.filter(F.col("split").isin(*evals)).join(checked_broadcast(pairs), F.col("host") == F.col("host_b")).select(F.col("record_id").alias("rb"), "host_a").distinct()
    heavy = heavy_of(a.groupBy("host_a").agg(F.count("*").alias("n")), ["host_a"], "n")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = b.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "host_a", "left").select("rb", "host_a", F.explode(copies).alias("salt"))  # heavy: at most 1,000
    both = salted(a, ["host_a"], F.col("ra"), heavy, SALTS).join(b, ["host_a", "salt"]).filter("ra <> rb")
    return both.select(F.least("ra", "rb").alias("record_id_a"), F.greatest("ra", "rb").alias("record_id_b")).distinct()


def pair_counts(rows: DataFrame, pairs: DataFrame, train: str = "train", evals: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """``(host_a, host_b, near, train_records, eval_records)`` of every pair of hosts: what :func:`record_pairs` spells out,
    one row a pair; the hosts of the records are the membership."""
    known = rows.filter(F.col("host").isNotNull() & F.col("record_id").isNotNull())
    per = known.groupBy("record_id", "host").agg(F.max(F.col("split") == train).alias("t"), F.max(F.col("split").isin(*evals)).alias("e")).groupBy("host").agg(F.count_if("t").alias("train_records"), F.count_if("e").alias("eval_records"))
    a, b = per.select(F.col("host").alias("host_a"), "train_records"), per.select(F.col("host").alias("host_b"), "eval_records")
    return pairs.join(a, "host_a").join(b, "host_b").select("host_a", "host_b", (F.col("host_a") != F.col("host_b")).alias("near"), "train_records", "eval_records")


def report(rows: DataFrame, pairs: DataFrame, evals: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Per split and source: evaluation records, those with an equal and those with an equal or near host in train."""
    rows = rows.filter(F.col("split").isin(*evals) & F.col("record_id").isNotNull())
    kinds = pairs.groupBy(F.col("host_b").alias("h")).agg(F.max(F.col("host_a") == F.col("host_b")).alias("same"))
    got = rows.join(checked_broadcast(kinds), F.col("host") == F.col("h"), "left")
    per = got.groupBy("record_id", "split", "source").agg(F.max(F.coalesce("same", F.lit(False))).alias("same"), F.max(F.col("h").isNotNull()).alias("any"))
    return per.groupBy("split", "source").agg(F.count("*").alias("records"), F.count_if("same").alias("same_records"), F.count_if("any").alias("overlapping_records"))
