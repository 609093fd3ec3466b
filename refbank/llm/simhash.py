"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: bytes A-Z are lower-cased, words are runs of anything but ASCII
white space, shingles are ``shingle`` consecutive words joined by one space
(repeats count; a shorter text is one shingle of all its words; no word gives
fingerprint zero).  A bit is set when it is set in over half of the shingles'
XXH64 hashes (UTF-8, seed 42).

Links: two fingerprints link when at most ``max_bits`` of the 64 bits differ.
Pigeonring: cut the 64 bits into a ring of ``max_bits + 1`` segments.  If two
fingerprints differ in at most ``t`` bits, some segment starts a chain in which
the first l segments together differ in at most ``l * t / (t + 1)`` bits, for
every l.  So segment one of the chain is equal (budget below 1), and the first
two differ in at most one bit (budget below 2).  That two-segment condition is
one equality on (start, segment, next segment with one bit masked): the
candidate join.  The chain budgets of l = 3, 4, ... then prune candidates, and
the full Hamming distance is checked last.  The filter is lossless.

Only distinct fingerprints take part (copies share one).  A bucket of the
candidate join that many close fingerprints share is not expanded into pairs:
see :func:`links`.

Defined results: null text counts as empty (fingerprint zero); rows with the
same id are each returned, with the class of their own fingerprint; empty
tables give empty results; extra columns are ignored by
:func:`fingerprints` / :func:`near_duplicates` and kept by
:func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refbank.llm.common import components, fresh, store

SEED = 42
SLICE = 1 << 16  # shingles hashed at a time: bounds a task's memory for long texts


def fingerprint_of(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    k = min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[: n - k + 1], ends[k - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(lo), SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at:at + SLICE].tolist(), hi[at:at + SLICE].tolist())],
                     np.dtype(">u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(lo))
    return int(bits.view(np.dtype(">i8"))[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """Column of signed 64-bit fingerprints of a text column."""

    @F.pandas_udf(T.LongType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint_of(t, shingle) for t in s], dtype="int64")

    return udf(text.cast("binary"))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(low bit, width) of the ring's segments, widths as even as they go."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _part(fp: str, seg: tuple[int, int]) -> str:
    return f"(shiftrightunsigned({fp}, {seg[0]}) & {(1 << seg[1]) - 1}L)"


def _masks(width: int, n: int) -> list[int]:
    """Every choice of ``n`` of ``width`` bits.  Two parts that differ in at
    most n bits agree outside some mask."""
    return [sum(1 << b for b in c) for c in combinations(range(width), n)]


def _least_mask(diff: str, mask: str, n: int) -> str:
    """SQL: true under exactly one of the masks that cover ``diff``, so that a
    pair is made once: the mask's bits outside ``diff`` are the lowest free."""
    if n == 1:
        return f"(({mask} & ~{diff}) = 0 OR ({diff} = 0 AND {mask} = 1))"
    spare = f"({mask} & ~{diff})"  # its highest bit may have no free bit below it that is not in the mask
    top = f"(CASE WHEN {spare} = 0 THEN 0L ELSE shiftleft(1L, CAST(floor(log2({spare})) AS INT)) END)"
    return f"(({top} = 0) OR ((({top} - 1) & ~{diff} & ~{mask}) = 0))"


def _chain_ok(diffs: list[str], at: int, max_bits: int) -> str:
    """SQL: chain budgets of every length from segment ``at`` round the ring."""
    m = len(diffs)
    order = [f"bit_count({diffs[(at + step) % m]})" for step in range(m)]
    return " AND ".join(f"{' + '.join(order[: n + 1])} <= {(n + 1) * max_bits // m}" for n in range(m))


DENSE = 256  # members from which a bucket is cut finer


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b), a < b: distinct fingerprints (column ``fp``) at most
    ``max_bits`` apart, each pair at least once.

    Buckets of more than DENSE members are cut finer before any pair is made:
    the third chain condition (at most two bits over three segments) joins
    the key with two bits masked.  Both keys are lossless, so the size only
    decides which one a bucket uses.  What remains in a finer bucket agrees in
    about 36 of 64 bits, and pairs beyond the budgets go before they are kept.

    All joins are merges.  A fingerprint has dozens of keys, and Spark takes a
    table for no larger after an explode: it would broadcast them.
    """
    if max_bits < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    segs = segments(max_bits)
    m = len(segs)
    if max(w for _, w in segs) > 14:
        raise ValueError("segments wider than 14 bits do not fit the bucket key: use max_bits >= 4")
    keys = []
    for i in range(m):
        low, width = segs[(i + 1) % m]
        for mask in _masks(width, 1):
            rest = f"(shiftrightunsigned(fp, {low}) & {((1 << width) - 1) & ~mask}L)"
            keys.append(f"shiftleft({_part('fp', segs[i])}, 28) + {(i << 42) + (mask << 14)}L + {rest}")
    at, mask = "shiftrightunsigned(key, 42)", f"(shiftrightunsigned(key, 14) & {(1 << 14) - 1}L)"
    diffs = [f"({_part('fp', s)} ^ {_part('fp2', s)})" for s in segs]

    def pairs(left: DataFrame, on: list[str]) -> DataFrame:
        right = left.select(F.col("fp").alias("fp2"), *on)
        return left.join(right.hint("merge"), on).where("fp < fp2")

    def checked(df: DataFrame) -> DataFrame:
        chain = " ".join(f"WHEN {at} = {i} THEN {_least_mask(diffs[(i + 1) % m], mask, 1)} AND "
                         f"{_chain_ok(diffs, i, max_bits)}" for i in range(m))
        return (df.where(f"CASE {chain} ELSE false END").where(f"bit_count(fp ^ fp2) <= {max_bits}")
                .selectExpr("fp AS a", "fp2 AS b"))

    # a few bytes a row become dozens of rows each: dealt to all tasks first (by a
    # given number, which is not put together again for being small)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.repartition(tasks, "fp").selectExpr("fp", f"explode(array({', '.join(keys)})) AS key")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = store(keyed.join(sizes.hint("merge"), "key"), "simhash-buckets")
    out = checked(pairs(shared.where(F.col("n") <= DENSE).select("fp", "key"), ["key"]))
    dense = shared.where(F.col("n") > DENSE).select("fp", "key")
    if 3 * max_bits // m != 2:
        return out.unionByName(checked(pairs(dense, ["key"])))
    third = [(segs[(i + 2) % m], diffs[(i + 2) % m]) for i in range(m)]
    choice = " ".join(f"WHEN {at} = {i} THEN array({', '.join(f'{x}L' for x in _masks(s[1], 2))})"
                      for i, (s, _) in enumerate(third))
    part3 = " ".join(f"WHEN {at} = {i} THEN {_part('fp', s)}" for i, (s, _) in enumerate(third))
    finer = (dense.selectExpr("fp", "key", f"CASE {part3} END AS part3", f"explode(CASE {choice} END) AS mask3")
             .selectExpr("fp", "key", "mask3", "part3 & ~mask3 AS rest3"))
    diff3 = f"(CASE {' '.join(f'WHEN {at} = {i} THEN {d}' for i, (_, d) in enumerate(third))} END)"
    return out.unionByName(checked(pairs(finer, ["key", "mask3", "rest3"]).where(_least_mask(diff3, "mask3", 2))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, extra: list[Column] | None = None) -> DataFrame:
    """(doc_id, fp, component_id [, extra]): one row per input row."""
    rows = store(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp"),
                             *(extra or [])), "simhash-rows")
    fps = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    comp = components(links(fps.select("fp"), max_bits))
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = store(named.join(least, "component").select("fp", "component", "component_id"), "simhash-classes")
    return rows.join(classes, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         max_bits: int = 4) -> DataFrame:
    """One document of each class stays: the one with the smallest id (ties:
    smallest row hash; of fully equal rows one).  All columns are kept."""
    h, n = fresh(docs.columns, "row_hash"), fresh(docs.columns, "n_same")
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits, [row_hash.alias("h")])
    keep = (found.groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("component").agg(F.min_by(F.struct("doc_id", "h", "n"),
                                               F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k"))
            .select(F.col("k.doc_id").alias("id_"), F.col("k.h").alias(h), F.col("k.n").alias(n)))
    tagged = docs.withColumn(h, row_hash)
    kept = tagged.join(keep.hint("shuffle_hash"), (tagged[h] == keep[h]) & tagged[id_col].eqNullSafe(keep["id_"])).select(
        *[tagged[c] for c in docs.columns], keep[n])
    single = kept.where(F.col(n) == 1).drop(n)
    return single.unionByName(kept.where(F.col(n) > 1).drop(n).dropDuplicates())
