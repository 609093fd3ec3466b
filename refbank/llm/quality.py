"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier over twelve surface
features of its whole text.  Where it was found is a second witness: each host
and each path of a host has a good-document rate, shrunk towards the level
above it.  With ``g`` good of ``n`` labelled documents,

    host = (g + a * global) / (n + a),      path = (g + b * host) / (n + b),

so a site with few labelled documents keeps the prior of its parent.  The
strengths a and b are estimated from the data (analysis-of-variance moment
estimate of the beta-binomial's intra-class correlation) by grouped
aggregation over all labelled documents.  The score's logit is the
classifier's plus the path's logit shift against the global rate.

The text is read once: features (twelve doubles per document) are stored, and
learning and scoring read them.  The classifier is fitted on at most
``FIT_ROWS`` labelled rows, chosen by hash of the id; the counts cover all.

Defined results: null and empty texts have zero features and are scored by
them; a null host or path counts as ``unknown``; an unseen path takes its
host's rate, an unseen host the global one; without a good and a bad labelled
document every score is the global rate (0.5 without labels); a document with
several labels counts as good only if all say so; repeated rows are each scored (and counted by
label once per row); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refbank.llm import ngrams as G
from refbank.llm.common import hash_sample, sized, store
from refbank.llm.toxicity import fit_logistic

FIT_ROWS = 20_000
LETTER, UPPER, DIGIT, BLANK, MARK, LOUD, OTHER = range(7)
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """BMP code point -> kind of character."""
    if not _KINDS:
        t = np.full(65536, OTHER, np.uint8)
        for cp in range(65536):
            ch = chr(cp)
            if 0xD800 <= cp < 0xE000:
                continue
            if ch.isalpha():
                t[cp] = UPPER if ch.isupper() else LETTER
            elif ch.isdigit():
                t[cp] = DIGIT
            elif ch.isspace():
                t[cp] = BLANK
            elif ch in ".,;:'\"()-?":
                t[cp] = MARK
            elif ch == "!":
                t[cp] = LOUD
        _KINDS.append(t)
    return _KINDS[0]


def features(texts: list[str | None]) -> np.ndarray:
    n = len(texts)
    c = np.zeros((n, 7))
    for cps, docs, offsets in G.batches(texts):
        kind = kinds()[np.minimum(cps, 65535)]
        piece = np.repeat(np.arange(len(docs)), np.diff(offsets))
        np.add.at(c, docs, np.bincount(piece * 7 + kind, minlength=len(docs) * 7).reshape(-1, 7))
    size = np.maximum(c.sum(1), 1)
    alpha = c[:, LETTER] + c[:, UPPER]
    w, kinds_of, new_lines, longest = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)
    for i, t in enumerate(texts):
        words, lines = (t or "").split(), (t or "").split("\n")
        w[i] = len(words)
        kinds_of[i] = len(set(words)) / max(1, len(words))
        new_lines[i] = len(set(lines)) / len(lines)
        longest[i] = max(map(len, words), default=0)
    upper = c[:, UPPER] / np.maximum(alpha, 1)
    other, loud = c[:, OTHER] / size, c[:, LOUD] / size
    return np.stack([alpha / size, c[:, DIGIT] / size, upper, c[:, BLANK] / size, c[:, MARK] / size, loud, other,
                     np.log1p(w), kinds_of, new_lines, np.log1p(longest), np.sqrt(other + loud)], 1)


def _features(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(features(list(s))))

    return udf(text)


def _strength(between: Column, groups: Column, parents: Column, rate: Column, n: Column, inner: Column) -> Column:
    """Prior strength (1 - r) / r from the moment estimate r of the
    intra-class correlation; r is kept within [0.0001, 0.9]."""
    v = F.greatest(rate * (1 - rate), F.lit(1e-9))
    df = groups - parents
    r = (between - df * v) / (v * F.greatest(n - inner - df, F.lit(1.0)))
    r = F.least(F.greatest(r, F.lit(1e-4)), F.lit(0.9))
    return (1 - r) / r


def posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(global, hosts, paths) rates from (host, path, good)."""
    paths = store(labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g")), "quality-paths")
    hosts = store(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"), F.count(F.lit(1)).alias("kinds"),
                                            F.sum(F.col("n") * F.col("n")).alias("nn"),
                                            F.sum(F.col("g") * F.col("g") / F.col("n")).alias("gg")), "quality-hosts")
    total = hosts.agg(F.sum("hn").alias("N"), F.sum("hg").alias("G"), F.count(F.lit(1)).alias("H"), F.sum("kinds").alias("P"),
                      F.sum(F.col("hn") * F.col("hn")).alias("HN2"), F.sum(F.col("hg") * F.col("hg") / F.col("hn")).alias("HG2"),
                      F.sum(F.col("nn") / F.col("hn")).alias("inner2"), F.sum("gg").alias("PG2"))
    rate = (F.col("G") + 1) / (F.col("N") + 2)
    top = total.select(
        rate.alias("rate"),
        _strength(F.col("HG2") - F.col("G") * F.col("G") / F.col("N"), F.col("H"), F.lit(1), rate, F.col("N"),
                  F.col("HN2") / F.col("N")).alias("a"),
        _strength(F.col("PG2") - F.col("HG2"), F.col("P"), F.col("H"), rate, F.col("N"), F.col("inner2")).alias("b"))
    r = top.first()  # one row
    if r["rate"] is None:
        r = {"rate": 0.5, "a": 1.0, "b": 1.0}
    top = labelled.sparkSession.createDataFrame([(float(r["rate"]), float(r["a"]), float(r["b"]))], "rate double, a double, b double")
    host = hosts.select("host", ((F.col("hg") + r["a"] * r["rate"]) / (F.col("hn") + r["a"])).alias("host_rate"))
    path = paths.join(host, "host").select("host", "path", ((F.col("g") + r["b"] * F.col("host_rate")) / (F.col("n") + r["b"])).alias("path_rate"))
    return top, host, path


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, learning: Column | None = None, host: Column | None = None,
          path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, learned, score): one row per document."""
    learned = F.lit(True) if learning is None else learning
    unknown = F.lit("unknown")
    feats = store(docs.select(
        F.col(id_col).alias("doc_id"), learned.alias("learned"),
        F.coalesce(host.cast("string"), unknown).alias("host") if host is not None else unknown.alias("host"),
        F.coalesce(path.cast("string"), unknown).alias("path") if path is not None else unknown.alias("path"),
        _features(F.col(text_col)).alias("x")), "quality-features")
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("good")))
    labelled = store(feats.where("learned").join(marks, "doc_id"), "quality-labelled")
    top, hosts, paths = posteriors(labelled.select("host", "path", "good"))
    rate = top.first()["rate"]
    sample = hash_sample(labelled, "doc_id", FIT_ROWS, labelled.count()).select("good", "x").toPandas()
    own = F.lit(float(np.log(rate / (1 - rate))))
    if sample["good"].nunique() == 2:
        w = fit_logistic(np.stack(sample["x"].to_numpy()), sample["good"].to_numpy(float))
        own = F.lit(float(w[0]))
        for i, v in enumerate(w[1:]):
            own = own + F.col("x")[i] * F.lit(float(v))
    both = feats.join(sized(hosts), "host", "left").join(sized(paths), ["host", "path"], "left")
    place = F.coalesce("path_rate", "host_rate", F.lit(rate))
    z = own + _logit(place) - _logit(F.lit(rate))
    return both.select("doc_id", "learned", (1 / (1 + F.exp(-z))).alias("score"))
