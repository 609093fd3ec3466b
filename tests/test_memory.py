"""Failure memory: clustering, votes, summary rules, lookup."""

from pyspark.sql import functions as F

from refbank.operators import memory as M

EV = ("event_id string, ts string, template_signature string, error_type string, missing_fields array<string>, "
      "repair_action string, seq_ts timestamp, seq_id long")


def log(spark, rows):
    df = spark.createDataFrame([(None, f"2024-01-01 00:00:{i:02d}", *r, None, i) for i, r in enumerate(rows)], EV)
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq_ts", F.col("ts"))


def test_three_events_two_actions(spark):
    a = ("sig-template-v1", "row_misalignment", ["Field_A", "Field_B"], "repair_anchor_chain")
    c = ("sig-template-v1", "row_misalignment", ["Field_A", "Field_B"], "manual_repair_check")
    rules = M.summary_rules(M.enrich_events(log(spark, [a, a, c]))).collect()
    assert len(rules) == 1
    r = rules[0]
    assert (r.id, r.template_signature, r.error_type, r.repair_action, r.support) == \
        ("R001", "sig-template-v1", "row_misalignment", "repair_anchor_chain", 3)
    assert abs(r.vote_rate - 2 / 3) < 1e-12


def test_vote_tie_goes_to_first_seen(spark):
    a = ("s", "e", [], "second")
    b = ("s", "e", [], "first")
    top = M.top_repair(M.enrich_events(log(spark, [b, a, a, b]))).first()
    assert (top.top_repair_action, top.top_repair_votes) == ("first", 2)


def test_skips_non_failures_and_orders_rules(spark):
    rows = [("s1", None, [], "x"), ("s1", "", [], "x"),
            ("s2", "e", ["F"], "fix"), ("s2", "e", ["F"], "fix"),
            ("s3", "e", [], "fix3"), ("s3", "e", [], "fix3"), ("s3", "e", [], "fix3"),
            ("s4", "e", [], None), ("s4", "e", [], None)]
    lg = M.enrich_events(log(spark, rows))
    clusters = {r.cluster_key: r.samples for r in M.failure_clusters(lg).collect()}
    assert clusters == {"e|F|s2": 2, "e||s3": 3, "e||s4": 2}
    rules = [(r.id, r.cluster_key) for r in M.summary_rules(lg).orderBy("id").collect()]
    assert rules == [("R001", "e||s3"), ("R002", "e|F|s2")]
    relearn = [r.cluster_key for r in M.relearn_candidates(lg).collect()]
    assert relearn == ["e||s4"]


def test_suggest_repairs(spark):
    base = ("sig-test-v1", "semantic_mismatch", ["Field_C", "Field_D"], "repair_by_reference_chain")
    rules = M.summary_rules(M.enrich_events(log(spark, [base, base])))
    q = spark.createDataFrame([
        ("q1", "sig-test-v1", "semantic_mismatch", ["Field_D", "Field_C"]),
        ("q2", "sig-other", "semantic_mismatch", ["Field_C", "Field_D"]),
        ("q3", "sig-test-v1", "semantic_mismatch", []),
        ("q4", "sig-test-v1", "semantic_mismatch", ["Field_C"])],
        "query_id string, template_signature string, error_type string, missing_fields array<string>")
    got = sorted((r.query_id, r.repair_action) for r in M.suggest_repairs(rules, q).collect())
    assert got == [("q1", "repair_by_reference_chain"), ("q3", "repair_by_reference_chain")]


def test_event_id_stable_and_short(spark):
    lg = M.enrich_events(log(spark, [("s", "e", ["B", "A"], "x")]))
    a = lg.first().event_id
    b = M.enrich_events(log(spark, [("s", "e", ["A", "B"], "x")])).first().event_id
    assert a == b and len(a) == 12
