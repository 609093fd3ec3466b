"""Language identification with bitmask n-gram filters.

Every learned language is one bit.  A bit-sliced Bloom filter is an array of
``SLOTS`` masks: an n-gram sets its language's bit in ``HASHES`` slots, and
reading those slots and ANDing them gives, at once, all languages that hold
the n-gram.  A document's language is decided by per-language counts of its
n-grams, corrected for the filter's false positives: with a share ``f`` of set
bits per language, ``n`` n-grams and ``c`` hits the estimate is
``(c - n * f**HASHES) / (1 - f**HASHES)``.

Learning counts n-grams of the whole text of every learning document (Spark
aggregates per language and n-gram).  An n-gram belongs to a language when
its relative frequency there is at least ``SHARE`` of its highest relative
frequency over languages, and it is at least ``MIN_SHARE`` of the language's n-grams and
occurs at least ``MIN_COUNT`` times: rows with a wrong label or with
passages in other languages do not put their n-grams into the filter.  N-grams of lengths 2 to 4
stay within words (letters only, word ends count); longer n-grams weigh more
because they meet fewer languages, not through a parameter.

The filter has as many slots as its fullest language needs for a false positive
rate of about a tenth (``slots_for``; at least ``SLOTS``, at most ``MAX_SLOTS`` masks per
64 languages and ``MAX_BYTES`` in all).  ``MIN_SHARE`` is relative, so a language keeps at most
``1 / MIN_SHARE`` n-grams however large the corpus is, and what is sent to the tasks
is bounded.  A filter that would be too full (a rate above ``MAX_MISS``) is an error.

Defined results: ``und`` with score 0 for a null text or one without any
letter, or when nothing was learned; a text none of whose n-grams is known
gets the most frequent learned language with score 0; ties go to the
alphabetically first language; repeated rows each get a result; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refbank.llm import ngrams as G
from refbank.llm.common import store

ORDERS = (2, 3, 4)
SLOTS = 1 << 20
MAX_SLOTS = 1 << 24  # three slots of 24 bits at steps of 20 fill a 64-bit code
MAX_BYTES = 1 << 29
MAX_MISS = 0.5
HASHES = 3
SHARE = 0.2
MIN_COUNT = 3
MIN_SHARE = 2.5e-7
MAX_LANGS = 4096


def codes(symbols: np.ndarray, depth: np.ndarray, order: int) -> np.ndarray:
    """64-bit codes of the n-grams that end at each position and lie inside
    one word with its end marks (so position 0 of a word has one context)."""
    h = symbols.astype(np.uint64) + np.uint64(order << 32)
    s = symbols.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, order):
            lag = np.zeros_like(s)
            lag[k:] = s[:-k] if k < len(s) else 0
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (np.where(depth >= k, lag, 0).astype(np.uint64) + np.uint64(k))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def stream(cps: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(positions mask of letters, [(n-gram codes, mask of those that count)])."""
    s = G.lowered(cps)
    depth = G.in_word(s)
    out = []
    for n in ORDERS:
        # enough context: at least n-1 symbols, the word's start mark among them
        out.append((codes(s, depth, n), G.events(s, depth) & (depth >= n - 2)))
    return s > 0, out


def slots_for(kept: int, slices: int) -> int:
    """Slots for ``kept`` n-grams of the fullest language: 5 each, a power of two."""
    slots = SLOTS
    while slots < 5 * kept and slots < MAX_SLOTS and 16 * slots * slices <= MAX_BYTES:
        slots *= 2
    miss = (1 - np.exp(-HASHES * kept / slots)) ** HASHES
    if miss > MAX_MISS:
        raise ValueError(f"{kept} n-grams of one language and {64 * slices} languages do not fit a filter of {MAX_BYTES} bytes")
    return slots


def slot_columns(code: Column, slots: int = SLOTS) -> list[Column]:
    """Slots of a code: the same arithmetic as :func:`slots_of`."""
    return [F.shiftrightunsigned(code, 20 * i).bitwiseAND(F.lit(slots - 1)) for i in range(HASHES)]


def slots_of(code: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    return [((code >> np.uint64(20 * i)) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # (slices, slots) uint64
    miss: np.ndarray  # false positive rate per language
    common: int  # most frequent language


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of the languages that label ``docs`` (rows without one are left out)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for cps, _, _ in G.batches(part["text"]):
                    for code, on in stream(cps)[1]:
                        u, n = np.unique(code[on], return_counts=True)
                        yield pd.DataFrame({"lang": lang, "code": u.view(np.int64), "n": n})

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"),
                                                              F.col(text_col).alias("text"))
    counts = store(labelled.mapInPandas(count, "lang string, code long, n long")
                   .groupBy("lang", "code").agg(F.sum("n").alias("n")), "lang-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(MAX_LANGS + 1).collect()  # one row per language
    if len(totals) > MAX_LANGS:
        raise ValueError(f"{lang_col} holds more than {MAX_LANGS} values: not a language column")
    seen = {r["lang"]: r["total"] for r in totals}
    langs = sorted(seen)
    if not langs:
        return Filters([], np.zeros((1, SLOTS), np.uint64), np.zeros(0), 0)
    number = docs.sparkSession.createDataFrame([(x, i, float(seen[x])) for i, x in enumerate(langs)],
                                               "lang string, bit int, total double")
    best = Window.partitionBy("code")
    freq = counts.join(F.broadcast(number), "lang").withColumn("p", F.col("n") / F.col("total"))
    own = store(freq.withColumn("top", F.max("p").over(best))
                .where((F.col("n") >= MIN_COUNT) & (F.col("p") >= MIN_SHARE) & (F.col("p") >= SHARE * F.col("top")))
                .select("code", "bit"), "lang-kept")
    slices = -(-len(langs) // 64)
    kept = own.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    slots = slots_for(kept, slices)
    bits = own.select(F.explode(F.array(*slot_columns(F.col("code"), slots))).alias("slot"), "bit").groupBy("slot", (F.col("bit") / 64).cast("int").alias("slice")).agg(
        F.expr("bit_or(shiftleft(1L, bit % 64)) AS mask")).toPandas()  # <= slots rows per slice
    masks = np.zeros((slices, slots), np.uint64)
    masks[bits["slice"], bits["slot"]] = bits["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filters(langs, masks, fill ** HASHES, int(np.argmax([seen[x] for x in langs])))


def scores(texts: list[str | None], f: Filters) -> list[tuple[str, float]]:
    n_docs, n_langs = len(texts), len(f.langs)
    hits, n, letters = np.zeros((n_docs, max(1, n_langs))), np.zeros(n_docs), np.zeros(n_docs, bool)
    for cps, docs, offsets in G.batches(texts):
        is_letter, grams = stream(cps)
        piece = np.repeat(np.arange(len(docs)), np.diff(offsets))
        for code, on in grams:
            at = docs[piece[on]]
            slot = slots_of(code[on], f.masks.shape[1])
            for k in range(len(f.masks)):
                mask = f.masks[k][slot[0]]
                for s in slot[1:]:
                    mask &= f.masks[k][s]
                for bit in range(min(64, n_langs - 64 * k)):
                    hits[:, 64 * k + bit] += np.bincount(at, (mask >> np.uint64(bit)) & np.uint64(1), n_docs)
            n += np.bincount(at, minlength=n_docs)
        letters[docs[np.unique(piece[is_letter])]] = True
    out: list[tuple[str, float]] = []
    if n_langs:
        # hits that few languages share decide; chance hits are taken off
        est = np.maximum(hits - n[:, None] * f.miss, 0) / (1 - f.miss)
    for i in range(n_docs):
        if not letters[i] or not n_langs:
            out.append(("und", 0.0))
            continue
        best = int(np.argmax(est[i]))
        if est[i, best] <= 0:
            out.append((f.langs[f.common], 0.0))
        else:
            out.append((f.langs[best], float(min(1.0, est[i, best] / est[i].sum()))))
    return out


def predict(text: Column, filters: Filters, spark) -> Column:
    """Column of struct(lang, score) of a text column."""
    sent = spark.sparkContext.broadcast(filters)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for s in batches:
            for_all = []
            for at in range(0, len(s), 512):
                for_all += scores(list(s.iloc[at:at + 512]), f)
            yield pd.DataFrame(for_all, columns=["lang", "score"])

    return udf(text)
