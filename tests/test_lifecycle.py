"""Lifecycle folds: replay == repeated single outcomes; ids; edges."""

import random

import pytest
from pyspark.sql import functions as F

from refbank.operators import lifecycle as L

RULE_COLS = "template_id string, id string, confidence double, support long, last_used timestamp"


def py_fold(c, s, steps):
    """Reference semantics: apply one outcome at a time, stop when archived."""
    for v in steps:
        if v > 0:
            c, s = min(1.0, round(c + 0.02, 2)), s + 1
        elif v < 0:
            c = max(0.0, round(c - 0.05, 2))
        if c < 0.3:
            return None
    return c, s


@pytest.mark.parametrize("seed", range(6))
def test_replay_matches_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    rows, events, expect = [], [], {}
    for t in range(4):
        tpl = f"t{t}"
        steps = [rnd.choice([1, 1, 1, -1, 0]) for _ in range(rnd.randint(0, 120))]
        for i, v in enumerate(steps):
            # events spread over several hours so several chunks combine
            events.append((tpl, f"2024-01-01 {i // 20:02d}:{i % 60:02d}:00", i, v))
        for k in range(8):
            c = rnd.choice([0.25, 0.3, 0.32, 0.5, 0.74, 0.98, 1.0, 0.61])
            rows.append((tpl, f"R{k}", c, k, None))
            expect[(tpl, f"R{k}")] = py_fold(c, k, steps) if steps else (c, k)
    r = spark.createDataFrame(rows, RULE_COLS)
    o = spark.createDataFrame(events, "template_id string, ts string, event_id long, v int") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(x.template_id, x.id): (None if x.archived else (x.confidence, x.support))
           for x in L.replay_outcomes(r, o).collect()}
    assert got == expect


def test_apply_outcome_archives(spark):
    r = spark.createDataFrame([("t", "R1", 0.8, 5, None), ("t", "R2", 0.32, 0, None)], RULE_COLS)
    out = {x.id: (x.confidence, x.support) for x in L.apply_outcome(r, 0.2).collect()}
    assert out == {"R1": (0.75, 5)}
    out = {x.id: (x.confidence, x.support) for x in L.apply_outcome(r, 1.0).collect()}
    assert out == {"R1": (0.82, 6), "R2": (0.34, 1)}


def test_next_id_never_reuses_referenced(spark):
    r = spark.createDataFrame([("t", "R001", 0.5, 0, None), ("t", "R003", 0.5, 0, None)], RULE_COLS)
    p = spark.createDataFrame([("t", ["R005"])], "template_id string, rules_used array<string>")
    e = spark.createDataFrame([("t", "R002", "A1")], "template_id string, src string, dst string")
    got = L.next_ids(r, p, e).first()
    assert (got.max_id, got.next_id) == (5, "R006")


def test_allocation_is_dense_and_ordered(spark):
    base = spark.createDataFrame([("t", 7)], "template_id string, max_id long")
    req = spark.createDataFrame([("t", "md", f"f{i}", None, 1000 - i) for i in range(5)],
                                "template_id string, input_type string, field string, anchor string, ord long")
    drafted, new_edges = L.draft_rules(req, base, "2024-01-01 00:00:00")
    got = sorted((x.ord, x.id) for x in drafted.collect())
    assert [i for _, i in got] == ["R008", "R009", "R010", "R011", "R012"]
    assert new_edges.count() == 0


def test_append_edges_idempotent(spark):
    e = spark.createDataFrame([("t", "R1", "A1", "uses_anchor", 1.0)],
                              "template_id string, src string, dst string, relation string, weight double")
    new = spark.createDataFrame([("t", "R1", "A1", "uses_anchor", 1.0), ("t", "R2", "A1", "uses_anchor", 1.0)],
                                e.schema)
    once = L.append_edges(e, new)
    twice = L.append_edges(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == 2


def test_touch_only_retrieved(spark):
    r = spark.createDataFrame([("t", "R1", 0.5, 0, None), ("t", "R2", 0.5, 0, None)], RULE_COLS)
    got = spark.createDataFrame([("t", "R2")], "template_id string, id string")
    out = {x.id: x.last_used for x in L.touch_rules(r, got, "2024-05-01 00:00:00").collect()}
    assert out["R1"] is None and out["R2"] is not None


def test_reflect_spares_new_rules(spark):
    r = spark.createDataFrame([("t", "R001", "md", "field_extraction", "a", 0.8, 1, 0)],
                              "template_id string, id string, input_type string, trigger string, field string, "
                              "confidence double, support long, ord long")
    miss = spark.createDataFrame([("t", "md", "Field_B", 1)], "template_id string, input_type string, field string, ord long")
    base = spark.createDataFrame([("t", 1)], "template_id string, max_id long")
    out = {x.id: (x.confidence, x.action) for x in L.reflect_rules(r, miss, base, "2024-01-01").collect()}
    assert out == {"R001": (0.75, None), "R002": (0.6, "retry_extract")}
