import math
from collections import Counter

import numpy as np

from refbank.llm import ngrams as G
from refbank.llm import toxicity as X
from refbank.llm.common import fold, table
from refbank.llm.entries import op2_toxicity

SCHEMA = "doc_id long, text string, toxic int, aside string"
MILD = ["the river runs", "green hills and rain", "bread with butter", "a quiet morning walk"]


def corpus(n=160):
    rows = []
    for i in range(n):
        text = " ".join(MILD[(i * 7 + j) % 4] for j in range(12))
        rows.append((i, text + (" you utter blorkhead" if i % 4 == 0 else ""), int(i % 4 == 0), "x"))
    return rows


def test_estimate_matches_plain_kneser_ney(spark):
    texts = [(1, "blork blork hill"), (1, "the hill"), (0, "the hill hills"), (0, "thé river")]
    df = spark.createDataFrame([(False, y, t) for y, t in texts], "aside boolean, toxic int, text string")
    rows = [r for r in X._estimate(X._counts(df)).collect() if r.model]
    table_ = {chr(c): int(s) for c, s in enumerate(G.symbol_table()) if s}
    grams = {0: Counter(), 1: Counter()}
    for y, t in texts:
        for w in t.split():
            s = [0] * 3 + [table_[c] for c in w] + [0]
            grams[y].update(tuple(s[i:i + 4]) for i in range(len(w) + 1))
    kinds = set(grams[0]) | set(grams[1])
    level = {4: kinds}
    cont = {}
    for n in (3, 2, 1):
        cont[n] = Counter(g[1:] for g in level[n + 1])
        level[n] = set(cont[n])

    def shared(g):
        if not g:
            return 1 / 64
        same = {h: c for h, c in cont[len(g)].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        return (max(cont[len(g)][g] - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / total

    def prob(y, g):
        same = {h: c for h, c in grams[y].items() if h[:-1] == g[:-1]}
        if not same:
            return shared(g[1:])
        return (max(grams[y][g] - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / sum(same.values())

    pack = lambda g: sum(s << (6 * (3 - i)) for i, s in enumerate(g))
    got = {r.code: r.ratio for r in rows}
    assert set(got) == {pack(g) for g in kinds}
    for g in kinds:
        assert math.isclose(got[pack(g)], math.log(prob(1, g) / prob(0, g)), abs_tol=1e-4)


def test_learns_and_drops_toxic_documents(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    model = X.learn(df.select("doc_id", "text", "aside"), df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(1, "rain and a blorkhead", 1, "y"), (2, "green hills", 0, "y"), (3, None, 0, "y"), (4, "", 0, None),
                                 (5, "butter " * 200_000 + "blorkhead", 1, "y"), (5, "bread", 0, "y")], SCHEMA)
    kept = X.drop_toxic(new, model)
    assert kept.columns == new.columns
    assert sorted(r.text or "" for r in kept.collect()) == ["", "", "bread", "green hills"]
    scores = [r.s for r in new.select(X.score(X.F.col("text"), model, new).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_long_texts_are_scored_like_their_pieces(spark, monkeypatch):
    df = spark.createDataFrame(corpus(40), SCHEMA)
    model = X.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    texts = [t for _, t, *_ in corpus(40)] + ["word " * 500 + "blorkhead", "", None]
    whole = X.features(texts, model)
    batches = G.batches
    monkeypatch.setattr(G, "batches", lambda t: batches(t, 64))
    assert np.allclose(X.features(texts, model), whole)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, None, 1, "x"), (None, "b", 0, "x")], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    for docs, labels in ((empty, empty), (df.select("doc_id", "text"), empty.select("doc_id", "toxic")), (df.select("doc_id", "text"), df.select("doc_id", "toxic"))):
        model = X.learn(docs, labels)
        assert model is None
        assert X.drop_toxic(docs, model).count() == docs.count()


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    ranks, toxic = got["score"].rank().to_numpy(), got["toxic"].to_numpy() == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.85
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    assert got["predicted"][~toxic].sum() <= 2


def test_fold_is_crc32_of_the_id(spark):
    import zlib

    got = spark.range(50).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)
