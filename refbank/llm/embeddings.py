"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half has its
own codebook (k-means on a bounded, hash-chosen sample), and the two nearest
codewords name a cell of the product grid.  Every row is indexed.  A query
walks the cells by multi-sequence traversal: a heap over the two sorted
distance lists yields cells in ascending order of the least squared distance
any vector of the cell can have to the query.  That bound is the distance to
the Voronoi cell's faces: a vector whose nearest codeword is ``a`` lies beyond
the bisector of ``a`` and every other codeword ``j``, so it is at least
``max_j (d_a^2 - d_j^2) / (2 |a - j|)`` away.  Cosine ``t`` means a squared
distance of ``2 - 2t``; the walk ends when the bound passes it, which makes
recall 1 by construction (the tests measure it against brute force).  Cells
visited are then verified in double precision.

Skew: members and queries of a cell are cut into blocks of about ``BLOCK``
rows, and each pair of blocks is one bounded task; link counts add up over
blocks.  A block emits counts and a spanning forest of its links (at most one
edge per vector), never its pairs; components of the union of the forests are
the components of all links.

Defined results: only rows with equal, non-null labels are compared; vectors
that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of another length than the index are compared with those of
their own length, unindexed (one cell, blocked alike); repeated rows (also of
one id) are vectors of their own; a null id is returned, and takes part under
null; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refbank.llm.common import components, hash_sample, store

SAMPLE = 20_000
BLOCK = 2048
MAX_CODES = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """(k', d) codewords, k' <= k; empty ones are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    c = np.unique(c, axis=0)
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, k) least squared distance from each row to each codeword's cell."""
    d = squared(x, c)
    gap = np.sqrt(squared(c, c))
    np.fill_diagonal(gap, np.inf)
    out = np.empty_like(d)
    for a in range(len(c)):
        out[:, a] = np.maximum(((d[:, a:a + 1] - d) / (2 * np.maximum(gap[a], 1e-12))[None]).max(1), 0) ** 2
    return out


def traverse(u: np.ndarray, v: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence traversal: (i, j) in ascending u[i] + v[j] up to ``limit``."""
    ui, vi = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    us, vs = u[ui], v[vi]
    heap, seen = [(us[0] + vs[0], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            return
        yield int(ui[i]), int(vi[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(us) and b < len(vs) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (us[a] + vs[b], a, b))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts of a block's queries and a spanning forest of its links."""
    m, q = rows[~rows["query"]], rows[rows["query"]]
    if not len(m) or not len(q):
        return pd.DataFrame({"row": [], "n": [], "a": [], "b": []})
    linked = _unit(m["vec"]) @ _unit(q["vec"]).T >= threshold
    linked &= m["row"].to_numpy()[:, None] != q["row"].to_numpy()[None]
    counts = linked.sum(0)
    i, j = np.nonzero(linked)
    ids, at = np.unique(np.concatenate([m["row"], q["row"]]), return_inverse=True)
    i, j = at[i], at[len(m) + j]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = [pd.DataFrame({"row": q["row"].to_numpy()[counts > 0], "n": counts[counts > 0]})]
    tied = np.flatnonzero(label != np.arange(len(ids)))
    out.append(pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]}))
    return pd.concat(out).reindex(columns=["row", "n", "a", "b"]).astype("Int64")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    spark = vectors.sparkSession
    v = F.col(vec_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = store(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"),
                                F.col(label_col).alias("label"), v.cast("array<double>").alias("vec"),
                                (fine & F.col(label_col).isNotNull()).alias("fine")), "vec-rows")
    good = rows.where("fine").select("row", "label", "vec", F.size("vec").alias("dim"))
    sizes = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    k = int(min(MAX_CODES, max(4, round(n ** 0.25))))
    half = max(1, dim // 2)
    picked = hash_sample(good.where(F.col("dim") == dim), "row", sample, n).select("vec").toPandas()
    x = _unit(picked["vec"])
    books = spark.sparkContext.broadcast((kmeans(x[:, :half], k), kmeans(x[:, half:], k) if dim > 1 else np.zeros((1, 0))))
    limit = 2 - 2 * threshold + 1e-9

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = books.value
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                main = (part["dim"] == dim).to_numpy()
                place, cell, query = [], [], []
                for p in np.flatnonzero(~main):
                    place, cell, query = place + [p, p], cell + [-1, -1], query + [False, True]
                if main.any():
                    x, index = _unit(part["vec"][main]), np.flatnonzero(main)
                    a, b = squared(x[:, :half], one).argmin(1), squared(x[:, half:], two).argmin(1)
                    u, w = bounds(x[:, :half], one), bounds(x[:, half:], two)
                    for r, p in enumerate(index):
                        place.append(p), cell.append(int(a[r]) * MAX_CODES + int(b[r])), query.append(False)
                        for i, j in traverse(u[r], w[r], limit):
                            place.append(p), cell.append(i * MAX_CODES + j), query.append(True)
                out = part.iloc[place].reset_index(drop=True)
                yield out.assign(cell=cell, query=query)[["label", "dim", "cell", "query", "row", "vec"]]

    kind = dict(good.dtypes)["label"]
    key = ["label", "dim", "cell"]
    postings = store(good.mapInPandas(cells, f"label {kind}, dim int, cell int, query boolean, row long, vec array<double>"),
                     "vec-postings")
    blocks = postings.groupBy(*key).agg(
        F.ceil(F.sum((~F.col("query")).cast("int")) / BLOCK).cast("int").alias("m"),
        F.ceil(F.sum(F.col("query").cast("int")) / BLOCK).cast("int").alias("q")).where("m > 0 AND q > 0")
    own, other = F.when(F.col("query"), F.col("q")).otherwise(F.col("m")), F.when(F.col("query"), F.col("m")).otherwise(F.col("q"))
    cut = (postings.join(blocks, key)
           .withColumn("mine", F.pmod(F.xxhash64("row"), own).cast("int"))
           .withColumn("theirs", F.explode(F.sequence(F.lit(0), other - 1)))
           .select(*key, F.when(F.col("query"), F.col("theirs")).otherwise(F.col("mine")).alias("mb"),
                   F.when(F.col("query"), F.col("mine")).otherwise(F.col("theirs")).alias("qb"), "query", "row", "vec"))
    found = store(cut.groupBy(*key, "mb", "qb").applyInPandas(lambda pdf: _block(pdf, threshold),
                                                             "row long, n long, a long, b long"), "vec-links")
    counts = found.where("n IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n_links"))
    comp = components(found.where("a IS NOT NULL").select("a", "b")).withColumnRenamed("node", "row")
    named = rows.select("row", "vec_id").join(counts, "row", "left").join(comp, "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
