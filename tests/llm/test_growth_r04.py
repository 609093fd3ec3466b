"""What must not be broadcast: tables made larger by an explode."""

from refbank.llm import simhash as S


def test_bucket_keys_are_not_broadcast(spark, monkeypatch):
    plans, store = [], S.store

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(S, "store", seen)
    found = S.links(spark.createDataFrame([(p,) for p in (0, 1, 3, 1 << 40, (1 << 40) + 15, -1, -2)], "fp long"), 4)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert {tuple(r) for r in found.collect()} == {(0, 1), (0, 3), (0, 1 << 40), (1, 3), (1, 1 << 40), (3, 1 << 40),
                                                   (1 << 40, (1 << 40) + 15), (1, (1 << 40) + 15), (3, (1 << 40) + 15), (-2, -1)}
