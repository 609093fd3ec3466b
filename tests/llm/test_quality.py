import math

import numpy as np

from refbank.llm import quality as Q
from refbank.llm.common import table
from refbank.llm.entries import op3_quality

SCHEMA = "doc_id long, text string, source string, lang string, good int, host string"


def test_posteriors_by_hand(spark):
    rows = [("a", "x", 1)] * 30 + [("a", "x", 0)] * 2 + [("a", "y", 1)] * 3 + [("b", "x", 0)] * 20 + [("b", "x", 1)] * 4 + [("c", "z", 0)]
    top, hosts, paths = Q.posteriors(spark.createDataFrame(rows, "host string, path string, good int"))
    t = top.first()
    n, g = len(rows), sum(r[2] for r in rows)
    assert math.isclose(t.rate, (g + 1) / (n + 2))

    def strength(between, groups, parents, inner):
        v = t.rate * (1 - t.rate)
        r = (between - (groups - parents) * v) / (v * max(1, n - inner - (groups - parents)))
        r = min(max(r, 1e-4), 0.9)
        return (1 - r) / r

    by = lambda k: {x: ([r[2] for r in rows if r[:k] == x]) for x in {r[:k] for r in rows}}
    h, p = by(1), by(2)
    hg2 = sum(sum(v) ** 2 / len(v) for v in h.values())
    assert math.isclose(t.a, strength(hg2 - g * g / n, 3, 1, sum(len(v) ** 2 for v in h.values()) / n), rel_tol=1e-9)
    pg2 = sum(sum(v) ** 2 / len(v) for v in p.values())
    inner = sum(sum(len(v) ** 2 for k, v in p.items() if k[:1] == x) / len(hv) for x, hv in h.items())
    assert math.isclose(t.b, strength(pg2 - hg2, 4, 3, inner), rel_tol=1e-9)
    host = {r.host: r.host_rate for r in hosts.collect()}
    assert all(math.isclose(host[x], (sum(v) + t.a * t.rate) / (len(v) + t.a)) for (x,), v in h.items())
    got = {(r.host, r.path): r.path_rate for r in paths.collect()}
    assert all(math.isclose(got[k], (sum(v) + t.b * host[k[0]]) / (len(v) + t.b)) for k, v in p.items())
    # a sparse host keeps more of the global rate than dense ones
    moved = {x: (host[x] - t.rate) / (sum(v) / len(v) - t.rate) for (x,), v in h.items()}
    assert 0 < moved["c"] < moved["b"] < moved["a"] < 1


def docs(n=120):
    bad, good = "&&& %%% $$$ *** ### !!!", "A calm sentence with several plain words in it."
    return [(i, (bad if i % 3 == 0 else good) + f" w{i}", f"s{i % 4}", "en", int(i % 3 != 0), "h") for i in range(n)]


def test_scores_documents_and_sites(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    new = spark.createDataFrame([(900, "Another calm sentence of plain words.", "s1", "en", 0, "h"), (901, "%%% &&& *** $$$ ###", None, None, 0, None),
                                 (902, None, "s1", "en", 0, "h"), (903, "", "new", "xx", 0, "h"), (903, "x " * 500_000, "s1", "en", 0, "h")], SCHEMA)
    got = Q.score(df.unionByName(new), df.select("doc_id", Q.F.col("good").alias("quality")), Q.F.col("doc_id") < 900, Q.F.col("source"), Q.F.col("lang"))
    rows = {r.doc_id: r.score for r in got.collect()}
    assert got.count() == 125 and all(0 <= s <= 1 for s in rows.values())
    assert rows[900] > 0.9 > 0.1 > rows[901]
    assert all((rows[i] > 0.5) == bool(good) for i, _, _, _, good, _ in docs())


def test_site_rate_shifts_equal_texts(spark):
    rows = [(i, "same words here", "good" if i < 50 else "bad", "en", int(i % 10 > 0 if i < 50 else i % 10 == 0), "h") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.score for r in Q.score(df, df.select("doc_id", Q.F.col("good").alias("quality")), None, Q.F.col("source"), Q.F.col("lang")).collect()}
    assert got[1] > 0.7 > 0.3 > got[51]


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame(docs(5), SCHEMA)
    none = df.where("false").select("doc_id", Q.F.col("good").alias("quality"))
    assert [r.score for r in Q.score(df, none).collect()] == [0.5] * 5
    assert Q.score(df.where("false"), none).collect() == []


def test_features_do_not_depend_on_batches(monkeypatch):
    texts = [t for _, t, *_ in docs(20)] + ["abc " * 300, "", None]
    whole = Q.features(texts)
    batches = Q.G.batches
    monkeypatch.setattr(Q.G, "batches", lambda t: batches(t, 50))
    # pieces are closed by one line break each, which only the blank share sees
    assert np.allclose(np.delete(Q.features(texts), [0, 1, 3, 4, 5, 6, 11], 1), np.delete(whole, [0, 1, 3, 4, 5, 6, 11], 1))


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out AND quality IS NOT NULL").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
