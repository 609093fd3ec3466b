"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased
(kept as its 128-bit XXH3 digest; two different lines would have to collide in
128 bits to be confused).  Keys of at least ``min_chars`` code points that at
least ``min_docs`` documents hold lose all their lines, except in the largest
document id that holds them.

State of a :class:`LineIndex` (tables in the shared folder, one folder per version):

* ``members`` (key, doc_id): which document holds which key;
* ``counts`` (key, n_docs, keeper): exact reference counts and the largest id;
* ``filters`` (shard, slots): cuckoo filters of the keys that have reached
  ``min_docs``.  A key's shard is a hash of the key; every shard has the same
  bucket count and about ``SHARD_KEYS`` keys.

``insert`` and ``delete`` change only the counts of the keys they touch; keys
that cross ``min_docs`` upwards are inserted into their shard's filter, keys
that fall below it are deleted from it, so deleting documents undoes exactly
what inserting them did.  ``dedupe`` asks the filters about every line; only
lines they know go to the exact counts, whose answer decides.  The filters
travel to the tasks in passes of at most ``PASS_BYTES``: more keys mean more
passes, not larger broadcasts.

Defined results: a null or empty text is one empty line; a null id never
keeps a key against an id and counts as one document; rows with one id are one document for the
counts and each is returned; empty tables give empty results; extra columns
stay out of the way (only the two named columns are read).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refbank.llm.common import store

BLANK = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16
WAYS = 4
PASS_BYTES = 32 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


# ---- cuckoo filters --------------------------------------------------------

def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard hash, bucket hash, fingerprint 1..65535) of (n, 16) key bytes."""
    w = keys.view("<u4").reshape(-1, 4)
    return w[:, 0], w[:, 1], (w[:, 2] % 65535 + 1).astype(np.uint16)


def _other(bucket, fp, n_buckets: int):
    return bucket ^ ((np.uint32(0x5BD1E995) * np.asarray(fp, np.uint32)) & np.uint32(n_buckets - 1))


class Cuckoo:
    """One shard: ``n_buckets`` (a power of two) buckets of four 16-bit
    fingerprints.  Equal fingerprints are stored as often as inserted, so a
    delete takes out one copy."""

    def __init__(self, n_buckets: int, slots: bytes | None = None):
        self.n = n_buckets
        self.slots = (np.frombuffer(slots, "<u2").reshape(n_buckets, WAYS).copy() if slots
                      else np.zeros((n_buckets, WAYS), "<u2"))

    def insert(self, bucket: int, fp: int) -> bool:
        b = bucket & (self.n - 1)
        slots = self.slots
        for at in (b, int(_other(b, fp, self.n))):
            free = np.flatnonzero(slots[at] == 0)
            if len(free):
                slots[at, free[0]] = fp
                return True
        for kick in range(500):
            way = (fp + kick) % WAYS
            fp, slots[b, way] = int(slots[b, way]), fp
            b = int(_other(b, fp, self.n))
            free = np.flatnonzero(slots[b] == 0)
            if len(free):
                slots[b, free[0]] = fp
                return True
        return False

    def delete(self, bucket: int, fp: int) -> bool:
        b = bucket & (self.n - 1)
        for at in (b, int(_other(b, fp, self.n))):
            hit = np.flatnonzero(self.slots[at] == fp)
            if len(hit):
                self.slots[at, hit[0]] = 0
                return True
        return False


def contains(slots: np.ndarray, n_buckets: int, row: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Vectorised lookup in stacked shards (``slots`` is (shards * buckets, ways))."""
    b = bucket & np.uint32(n_buckets - 1)
    base = row.astype(np.int64) * n_buckets
    return ((slots[base + b] == fp[:, None]).any(1) | (slots[base + _other(b, fp, n_buckets)] == fp[:, None]).any(1))


# ---- index -----------------------------------------------------------------

#: Ids travel to and from Python as text: a batch with a null id would turn longs into doubles.
KEYED = "key binary, doc_id string"


def _as_long(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


class LineIndex:
    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, members: DataFrame | None = None,
                 counts: DataFrame | None = None, filters: DataFrame | None = None, n_shards: int = 0):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.members, self.counts, self.filters, self.n_shards = members, counts, filters, n_shards
        # twice the room an average shard needs, so that shards of uneven size fit
        self.n_buckets = 1 << max(4, int(np.ceil(np.log2(2 * SHARD_KEYS / WAYS))))

    def _next(self, members, counts, filters, n_shards) -> LineIndex:
        return LineIndex(self.spark, self.min_chars, self.min_docs, members, counts, filters, n_shards)

    def _pairs(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Distinct (key, doc_id) of a batch of documents."""
        min_chars = self.min_chars

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ks, ids = [], []
                for i, text in zip(pdf["doc_id"], pdf["text"]):
                    found = {k for k in (line_key(x, min_chars) for x in (text or b"").split(b"\n")) if k}
                    ks += found
                    ids += [i] * len(found)
                yield pd.DataFrame({"key": ks, "doc_id": pd.Series(ids, dtype=object)})

        return _as_long(_rows(docs, id_col, text_col).mapInPandas(keys, KEYED)).distinct()

    @staticmethod
    def _counted(members: DataFrame) -> DataFrame:
        return members.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with these documents added (a document already held is not counted twice)."""
        new = self._pairs(docs, id_col, text_col)
        if self.members is None:
            members = store(new, "line-members")
            return self._rebuilt(members, store(self._counted(members), "line-counts"))
        old = self.members
        new = store(new.join(old.withColumnRenamed("key", "k").withColumnRenamed("doc_id", "d"),
                             (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti"),
                    "line-members-new")
        return self._changed(old.unionByName(new), new.select("key").distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose ids are the first column of ``ids``."""
        gone_ids = ids.select(F.col(ids.columns[0]).cast("long").alias("d")).distinct()
        gone = store(self.members.join(gone_ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("key").distinct(),
                     "line-keys-gone")
        left = self.members.join(gone_ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
        return self._changed(left, gone)

    def _changed(self, members: DataFrame, touched: DataFrame) -> LineIndex:
        """New version after the members of ``touched`` keys changed."""
        members = store(members, "line-members")
        again = self._counted(members.join(touched, "key", "left_semi"))
        counts = store(self.counts.join(touched, "key", "left_anti").unionByName(again), "line-counts")
        if not self.n_shards:
            return self._rebuilt(members, counts)
        was = self.counts.join(touched, "key", "left_semi").where(F.col("n_docs") >= self.min_docs).select("key")
        now = again.where(F.col("n_docs") >= self.min_docs).select("key")
        moves = (now.join(was, "key", "left_anti").withColumn("up", F.lit(True))
                 .unionByName(was.join(now, "key", "left_anti").withColumn("up", F.lit(False))))
        filters = store(self._applied(self.filters, moves, self.n_shards), "line-filters")
        if filters.where("NOT fits").head(1):
            return self._rebuilt(members, counts)
        return self._next(members, counts, filters, self.n_shards)

    def _rebuilt(self, members: DataFrame, counts: DataFrame) -> LineIndex:
        repeated = counts.where(F.col("n_docs") >= self.min_docs)
        n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
        while True:
            moves = repeated.select("key", F.lit(True).alias("up"))
            none = self.spark.createDataFrame([], "shard int, slots binary, fits boolean")
            filters = store(self._applied(none, moves, n_shards), "line-filters")
            if not filters.where("NOT fits").head(1):
                return self._next(members, counts, filters, n_shards)
            n_shards *= 2

    def _applied(self, filters: DataFrame, moves: DataFrame, n_shards: int) -> DataFrame:
        """Filters after inserting (``up``) and deleting keys; a shard's task
        holds its filter and the keys that crossed the threshold."""
        n_buckets = self.n_buckets

        def change(key, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            f = Cuckoo(n_buckets, bytes(old["slots"].iloc[0]) if len(old) else None)
            fits = True
            if len(keys):
                keys = keys.sort_values("key")
                _, bucket, fp = _split(np.frombuffer(b"".join(keys["key"]), np.uint8))
                for up, b, x in sorted(zip(keys["up"].tolist(), bucket.tolist(), fp.tolist())):
                    fits &= f.insert(b, x) if up else f.delete(b, x)
            return pd.DataFrame({"shard": [int(key[0])], "slots": [f.slots.tobytes()], "fits": [bool(fits)]})

        shard = F.pmod(F.conv(_le32("key"), 16, 10).cast("long"),
                       F.lit(n_shards)).cast("int")
        return (filters.groupBy("shard").cogroup(moves.withColumn("shard", shard).groupBy("shard"))
                .applyInPandas(change, "shard int, slots binary, fits boolean"))

    def drops(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses."""
        per_pass = max(1, PASS_BYTES // (self.n_buckets * WAYS * 2))
        pairs = None
        for first in range(0, self.n_shards, per_pass):
            some = self._known(docs, id_col, text_col, first, min(self.n_shards, first + per_pass))
            pairs = some if pairs is None else pairs.unionByName(some)
        repeated = self.counts.where(F.col("n_docs") >= self.min_docs)
        return (pairs.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
                .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))

    def _known(self, docs: DataFrame, id_col: str, text_col: str, first: int, last: int) -> DataFrame:
        """(key, doc_id) of the lines that the filters of some shards know."""
        rows = self.filters.where(F.col("shard").between(first, last - 1)).select("shard", "slots").collect()
        n_buckets, n_shards, min_chars = self.n_buckets, self.n_shards, self.min_chars
        stacked = np.zeros(((last - first) * n_buckets, WAYS), "<u2")
        for r in rows:
            stacked[(r.shard - first) * n_buckets:(r.shard - first + 1) * n_buckets] = np.frombuffer(r.slots, "<u2").reshape(-1, WAYS)
        sent = self.spark.sparkContext.broadcast(pickle.dumps(stacked))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slots = pickle.loads(sent.value)
            for pdf in batches:
                ks, ids = [], []
                for i, text in zip(pdf["doc_id"], pdf["text"]):
                    found = {k for k in (line_key(x, min_chars) for x in (text or b"").split(b"\n")) if k}
                    ks += found
                    ids += [i] * len(found)
                if not ks:
                    continue
                shard, bucket, fp = _split(np.frombuffer(b"".join(ks), np.uint8))
                row = (shard % np.uint32(n_shards)).astype(np.int64) - first
                here = (row >= 0) & (row < last - first)
                hit = np.flatnonzero(here)[contains(slots, n_buckets, row[here], bucket[here], fp[here])]
                yield pd.DataFrame({"key": [ks[j] for j in hit], "doc_id": pd.Series([ids[j] for j in hit], dtype=object)})

        return _as_long(_rows(docs, id_col, text_col).mapInPandas(ask, KEYED))

    def dedupe(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept): the documents without their lost lines."""
        min_chars = self.min_chars
        lost = self.drops(docs, id_col, text_col).withColumnRenamed("doc_id", "d").hint("shuffle_hash")
        rows = _as_long(_rows(docs, id_col, text_col))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for text, keys in zip(pdf["text"], pdf["keys"]):
                    lines = (text or b"").split(b"\n")
                    drop = set(map(bytes, keys)) if keys is not None else ()
                    kept = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                n, k, t = zip(*out) if out else ((), (), ())
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": n, "n_dropped": k, "kept": t})

        both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("d")), "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "keys")
        return _as_long(both.mapInPandas(cut, "doc_id string, n_lines long, n_dropped long, kept binary"))


def _le32(key: str):
    """Hex of the first four bytes of a binary column, most significant first."""
    return F.concat(*[F.hex(F.substring(key, i, 1)) for i in (4, 3, 2, 1)])

