"""Toxicity by class-conditional Kneser-Ney models.

Two character models (order 4 within words, 64 symbols) are learned, one from
toxic and one from ordinary labelled documents, over their whole texts.  The
highest order is each class's own, with absolute discounting; the lower orders
are Kneser-Ney continuation counts of both classes together.  What neither
class has seen backs off to the same shared counts, so a rare expression
weighs only as far as one class has evidence for it.

A document is compared at two lengths: the whole text (log-likelihood ratio
per symbol) and its most toxic word (ratio divided by the word's length plus
the model order, so that short chance words do not win; and undivided).  Few
words make a long document toxic, which the whole-text mean alone would dilute.
A small logistic calibration turns the three into a score.  It is fitted on
features of documents that its model has not counted (a quarter of the
learning rows, at most ``CALIBRATION_ROWS`` of them by hash of the id); the
final model counts all learning rows.  The fit is pulled towards ``PRIOR`` as if
by a few more rows, at every size alike: without any row set aside the weights
are the prior's, and they leave it as rows come in.

Scale: counting is one pass with map-side sums, all of the corpus counts are
aggregated by Spark, and estimation is grouped aggregation over at most
64**4 = 16.8 M codes per class.  That alphabet bounds the model that is sent
to the tasks (only observed codes are sent; a task holds 32 MB).

Defined results: a null or empty text has zero evidence and gets the score of
zero evidence; rows of ``labels`` with a null id or label are left out, and a
document with several labels counts as toxic if one says so; without a toxic
and an ordinary labelled document every score is 0; repeated rows are each
scored (and each counted); extra columns are kept by :func:`drop_toxic`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refbank.llm import ngrams as G
from refbank.llm.common import hash_sample, store

ORDER = 4
DISCOUNT = 0.75
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Calibration before any evidence: bias, mean ratio per symbol, most toxic word per length, most toxic word.
PRIOR = (-6.0, 2.0, 4.0, 0.0)
_LOADED: dict[str, np.ndarray] = {}  # dense table of the model a worker used last


@dataclass
class Model:
    codes: np.ndarray  # observed n-grams
    ratio: np.ndarray  # their log ratio, toxic over ordinary
    contexts: np.ndarray  # observed contexts
    backoff: np.ndarray  # log ratio of an unseen symbol after them
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration: bias, then one per feature
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def dense(self) -> np.ndarray:
        if self.key not in _LOADED:
            _LOADED.clear()
            ctx = np.zeros(G.SYMBOLS ** (ORDER - 1), np.float16)
            ctx[self.contexts] = self.backoff
            table = np.repeat(ctx, G.SYMBOLS)
            table[self.codes] = self.ratio
            _LOADED[self.key] = table
        return _LOADED[self.key]


def features(texts: list[str | None], model: Model) -> np.ndarray:
    """(n, 3): mean ratio per symbol, most toxic word per length, most toxic word."""
    n, table = len(texts), model.dense()
    total, length = np.zeros(n), np.zeros(n)
    word, rate = np.zeros(n), np.zeros(n)
    for cps, docs, offsets in G.batches(texts):
        s = G.symbols(cps)
        depth = G.in_word(s)
        on = G.events(s, depth)
        v = np.where(on, table[G.packed(s, depth, ORDER)], 0).astype(np.float64)
        sums = np.concatenate(([0.0], np.cumsum(v)))
        ends = np.flatnonzero((s == 0) & (depth > 0))
        if not len(ends):
            continue
        size = depth[ends] + 1
        w = sums[ends + 1] - sums[ends + 1 - size]
        piece = np.searchsorted(offsets, ends, side="right") - 1
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        at = docs[piece[first]]
        np.add.at(total, at, np.add.reduceat(w, first))
        np.add.at(length, at, np.add.reduceat(size, first))
        np.maximum.at(word, at, np.maximum.reduceat(w, first))
        np.maximum.at(rate, at, np.maximum.reduceat(w / (size + ORDER), first))
    return np.stack([total / np.maximum(length, 1), rate, word], 1)


def _counts(labelled: DataFrame) -> DataFrame:
    """(aside, toxic, code, n) summed over the texts of (aside, toxic, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (aside, toxic), part in pdf.groupby(["aside", "toxic"]):
                for cps, _, _ in G.batches(part["text"]):
                    s = G.symbols(cps)
                    depth = G.in_word(s)
                    u, n = np.unique(G.packed(s, depth, ORDER)[G.events(s, depth)], return_counts=True)
                    yield pd.DataFrame({"aside": aside, "toxic": toxic, "code": u.astype(np.int32), "n": n})

    return labelled.mapInPandas(count, "aside boolean, toxic int, code int, n long").groupBy(
        "aside", "toxic", "code").agg(F.sum("n").alias("n"))


def _estimate(counts: DataFrame) -> DataFrame:
    """(model, code, ratio, backoff) for model false (without the rows set
    aside) and true (all rows)."""
    both = counts.withColumn("model", F.explode(F.when(F.col("aside"), F.array(F.lit(True)))
                                                .otherwise(F.array(F.lit(False), F.lit(True)))))
    seen = store(both.groupBy("model", "code").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("ct"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("co")), "tox-counts")
    types = seen.select("model", "code")
    shared = None  # (model, code of the order below, p): pooled continuation probability
    orders = []
    for n in range(ORDER - 1, 0, -1):
        types = types.groupBy("model", F.col("code").bitwiseAND(F.lit((1 << (G.BITS * n)) - 1)).alias("code")).agg(
            F.count(F.lit(1)).alias("c"))
        orders.append((n, types))
        types = types.select("model", "code")
    for n, t in reversed(orders):
        ctx = Window.partitionBy("model", F.shiftright("code", G.BITS))
        t = t.withColumn("total", F.sum("c").over(ctx)).withColumn("kinds", F.count(F.lit(1)).over(ctx))
        if shared is None:
            t = t.withColumn("below", F.lit(1.0 / G.SYMBOLS))
        else:
            t = (t.withColumn("low", F.col("code").bitwiseAND(F.lit((1 << (G.BITS * (n - 1))) - 1)))
                 .join(shared.withColumnRenamed("code", "low").withColumnRenamed("p", "below"), ["model", "low"]))
        shared = t.select("model", "code", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0))
                                             + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")).alias("p"))
    ctx = Window.partitionBy("model", F.shiftright("code", G.BITS))
    top = (seen.withColumn("low", F.col("code").bitwiseAND(F.lit((1 << (G.BITS * (ORDER - 1))) - 1)))
           .join(shared.withColumnRenamed("code", "low"), ["model", "low"]))
    for c in ("ct", "co"):
        total, kinds = F.sum(c).over(ctx), F.sum((F.col(c) > 0).cast("long")).over(ctx)
        top = top.withColumn(f"total_{c}", total).withColumn(f"kinds_{c}", kinds)
    for c in ("ct", "co"):
        lam = F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"total_{c}")).otherwise(1.0)
        own = F.when(F.col(f"total_{c}") > 0,
                     F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"total_{c}")).otherwise(0.0)
        top = top.withColumn(f"lam_{c}", lam).withColumn(f"p_{c}", own + F.col(f"lam_{c}") * F.col("p"))
    return top.select("model", "code", F.log(F.col("p_ct") / F.col("p_co")).cast("float").alias("ratio"),
                      F.log(F.col("lam_ct") / F.col("lam_co")).cast("float").alias("backoff"))


def _model(rows: pd.DataFrame) -> Model:
    codes = rows["code"].to_numpy(np.int64)
    ctx, first = np.unique(codes >> G.BITS, return_index=True)
    return Model(codes, rows["ratio"].to_numpy(np.float16), ctx, rows["backoff"].to_numpy(np.float16)[first])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, prior: tuple[float, ...] | None = None) -> np.ndarray:
    """Bias and weights of an L2-penalised logistic regression (Newton steps
    on standardised features, weights given back for raw ones).  With a
    ``prior`` the penalty is on the distance from it, the bias's too."""
    if prior is not None and not len(x):
        return np.array(prior)
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    at = np.zeros(a.shape[1])
    if prior is not None:
        raw = np.array(prior)
        at = np.concatenate(([raw[0] + raw[1:] @ mean], raw[1:] * sd))
    w = at.copy()
    penalty = np.diag([1e-6 if prior is None else ridge] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ (w - at))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / sd
    return np.concatenate(([w[0] - weights @ mean], weights))


def learn(docs: DataFrame, labels: DataFrame, learning: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Model from the labelled documents (those where ``learning`` holds)."""
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    aside = F.pmod(F.xxhash64(F.col(id_col)), F.lit(4)) == 0
    rows = docs if learning is None else docs.where(learning)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), aside.alias("aside"))
    labelled = rows.join(marks.hint("shuffle_hash"), F.col("id") == F.col("label_id")).select("id", "aside", "toxic", "text")
    counts = store(_counts(labelled.select("aside", "toxic", "text")), "tox-ngrams")
    classes = {(r[0], r[1]) for r in counts.select("aside", "toxic").distinct().collect()}
    if {c for _, c in classes} != {0, 1}:
        return None
    table = _estimate(counts).toPandas()  # at most 64**ORDER codes per model
    final = _model(table[table["model"]])
    final.weights = np.array(PRIOR)
    if {c for a, c in classes if not a} == {0, 1}:
        held = _model(table[~table["model"]])
        # the sample is cut by hash before the texts are scored, and only scores reach the driver
        total = marks.where(F.pmod(F.xxhash64("label_id"), F.lit(4)) == 0).count()
        scored = labelled.where("aside").select("id", "toxic", _features(F.col("text"), held, docs).alias("x"))
        sample = hash_sample(scored, "id", CALIBRATION_ROWS, total).select("toxic", "x").toPandas()
        x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(PRIOR) - 1)
        final.weights = fit_logistic(x, sample["toxic"].to_numpy(float), prior=PRIOR)
    return final


def _features(text: Column, model: Model, docs: DataFrame) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(features(list(s), sent.value)))

    return udf(text)


def score(text: Column, model: Model | None, docs: DataFrame) -> Column:
    """Column of scores (0 to 1) of a text column of ``docs``."""
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for s in batches:
            z = m.weights[0] + features(list(s), m) @ m.weights[1:]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return udf(text)


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, all columns kept."""
    return docs.where(score(F.col(text_col), model, docs) < threshold)
