import random

import brute

from refbank.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string, k1 int"


def corpus():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "bcdfglmnpr" for b in ("ar", "el", "im", "on", "u", "é")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(20, 60))) for i in range(12)] + [(12, "three short words"), (13, ""), (14, None), (15, say(25)), (15, say(25)), (None, say(30))]
    items += [(16, " ".join(["echo echo foxtrot"] * 12)), (17, say(5))]
    docs = []
    for i in range(40):
        w = items[i % 12][1].split()
        kind = i % 5
        if kind == 1:
            w[len(w) - 1] = "changed"
        elif kind == 2:
            w = w[: len(w) * 2 // 3]  # too little of it
        elif kind == 3:
            w.insert(2, "inserted")
        elif kind == 4:
            w = [x.upper() + ("," if j % 7 == 0 else "") for j, x in enumerate(w)]
        docs.append((i, f"{say(rng.randint(0, 80))} {' '.join(w)} {say(rng.randint(0, 80))}", "x", 1))
    docs += [(50, say(300), "x", 1), (51, None, "x", 1), (52, "", None, 1), (53, "one three short words two", "x", 1),
             (54, items[0][1], "x", 1), (54, "same id, clean text", "x", 1), (54, items[0][1], "x", 1), (None, items[1][1], "x", 1),
             (55, "echo echo foxtrot " * 13, "x", 1), (56, say(4000) + " " + items[3][1] + " " + say(4000), "x", 1), (57, items[17][1], "x", 1),
             (58, "three short", "x", 1), (59, " ".join(items[2][1].split()[2:]), "x", 1)]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in D.leaks(df, it).collect()), key=str)
    want = set()
    for n, item in enumerate(items):  # items one by one: ids may repeat
        for d in set(docs):
            hit = brute.leaks([(0, d[1])], [(0, item[1])])
            if hit:
                want.add((d[0], item[0], round(hit[0, 0], 9)))
    assert len(want) > 30 and got == sorted(want, key=str)


def test_drop_keeps_clean_documents(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    kept = D.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    clean = [d for d in docs if not brute.leaks([(0, d[1])], [(i, t) for i, (_, t) in enumerate(items)])]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    docs, items = corpus()
    df, it = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(str, D.leaks(df, it).collect()))
    whole = rows()
    monkeypatch.setattr(D, "BLOCK_HASHES", 200)
    assert rows() == whole


def test_empty_tables(spark):
    docs, items = corpus()
    df, it = spark.createDataFrame(docs[:5], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert D.leaks(df.where("false"), it).collect() == []
    assert D.leaks(df, it.where("false")).collect() == []
    assert D.drop_contaminated(df, it.where("false")).count() == 5
    assert D.drop_contaminated(df.where("false"), it).collect() == []


def test_no_python_on_the_main_path(spark):
    sf = "/root/testdata/sf0.001"
    plan = D.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
