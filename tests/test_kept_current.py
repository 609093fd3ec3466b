"""Clusters kept current by days, and extractor answers kept by prompt."""

import datetime as dt
import random

from pyspark.sql import functions as F

from refbank.operators import extract as E
from refbank.operators import memory as M


def test_days_added_one_by_one_equal_the_rebuild(spark, tmp_dir):
    rng = random.Random(3)
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(400):
        ts = start + dt.timedelta(hours=rng.randint(0, 24 * 6))
        rows.append((str(i), ts, rng.choice(["a", "b"]), rng.choice(["e1", "e2", None, ""]), rng.choice([["x"], ["y", "x"], [], None]),
                     rng.choice([None, "", "r1", "r2", "r3"]), ts, i))
    log = M.enrich_events(spark.createDataFrame(rows, "event_id string, ts timestamp, template_signature string, error_type string, "
                                                      "missing_fields array<string>, repair_action string, seq_ts timestamp, seq_id long"))
    days = [M.cluster_votes(log.where(F.to_date("ts") == F.lit((start + dt.timedelta(days=k)).date()))) for k in range(7)]
    order = list(range(7))
    rng.shuffle(order)  # a day may be added late
    votes = days[order[0]]
    for k in order[1:]:
        M.update_votes(votes, days[k]).write.parquet(f"{tmp_dir}/votes-{k}")
        votes = spark.read.parquet(f"{tmp_dir}/votes-{k}")
    text = lambda df: sorted(map(str, df.collect()))
    assert text(votes) == text(M.cluster_votes(log))
    whole = M.failure_clusters(log)
    assert text(M.clusters_of(votes).select(*whole.columns)) == text(whole)
    assert text(M.top_repair_of(votes)) == text(M.top_repair(log))
    at = "2024-04-01 00:00:00"
    rules = M.summary_rules(None, as_of=at, votes=votes)
    assert text(rules) == text(M.summary_rules(log, as_of=at)) and rules.count() > 3


def test_equal_prompts_are_asked_once_and_runs_remember(spark, tmp_dir):
    log = f"{tmp_dir}/calls"

    def fn(content, fields):
        with open(log, "a") as f:
            f.write(f"{content}|{','.join(fields)}\n")
        if content == "bad":
            raise ValueError("cannot read")
        return {"len": len(content or ""), "fields": ",".join(fields)}

    def calls():
        try:
            with open(log) as f:
                return sorted(f.read().splitlines())
        except FileNotFoundError:
            return []

    schema = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "template_id string, field string")
    data = [(1, "t", "one"), (2, "t", "one"), (3, "u", "one"), (4, "t", "bad"), (5, "t", "two"), (6, "t", "bad")]
    inputs = spark.createDataFrame(data, "input_id long, template_id string, content string")
    got = {r.input_id: (r.ok, r.data, r.error) for r in E.cached_extractor(inputs, fn, f"{tmp_dir}/answers", schema).collect()}
    assert got[1] == got[2] == (True, {"len": "3", "fields": "a,b"}, None) and got[3] == (True, {"len": "3", "fields": "a"}, None)
    assert got[4] == got[6] == (False, None, "cannot read") and len(got) == 6
    assert calls() == ["bad|a,b", "one|a", "one|a,b", "two|a,b"]
    # a second run asks only what is new or has failed
    more = inputs.unionByName(spark.createDataFrame([(7, "u", "three")], inputs.schema))
    again = {r.input_id: (r.ok, r.data, r.error) for r in E.cached_extractor(more, fn, f"{tmp_dir}/answers", schema).collect()}
    assert {k: v for k, v in again.items() if k < 7} == got and again[7][0]
    assert calls() == sorted(["bad|a,b", "one|a", "one|a,b", "two|a,b", "bad|a,b", "three|a"])
