"""Bank file import/export and streaming equivalence."""

import json
import os

import pytest
from pyspark.sql import functions as F

from refbank.sources import bank_io as IO


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_rules_jsonl_roundtrip(spark, tmp_dir):
    p = f"{tmp_dir}/tplA/reference_bank/rules.jsonl"
    rules = [{"id": "R001", "when": {"input_type": "pdf", "trigger": "field_extraction"},
              "condition": {"field": "vendor"}, "then": {"action": "x"}, "confidence": 0.9, "support": 2,
              "last_used": "2024-01-01T00:00:00"},
             {"id": "R002", "confidence": 0.5, "last_used": "not a date"}]
    write(p, "\n".join(json.dumps(r) for r in rules[:1]) + "\n\n" + json.dumps(rules[1]) + "\n")
    df = IO.read_rules(spark, p)
    got = {r.id: (r.template_id, r.input_type, r.trigger, r.field, r.confidence, r.last_used is None)
           for r in df.collect()}
    assert got == {"R001": ("tplA", "pdf", "field_extraction", "vendor", 0.9, False),
                   "R002": ("tplA", None, None, None, 0.5, True)}
    assert IO.read_rules(spark, f"{tmp_dir}/nope/rules.jsonl").count() == 0


def test_rules_jsonl_malformed_fails(spark, tmp_dir):
    p = f"{tmp_dir}/t/bank/rules.jsonl"
    write(p, '{"id": "R001"}\n{"id": \n')
    with pytest.raises(Exception):
        IO.read_rules(spark, p).collect()


def test_lenient_event_log(spark, tmp_dir):
    p = f"{tmp_dir}/mem/execution_log.jsonl"
    write(p, '{"error_type": "e", "missing_fields": ["A"]}\n\nnot json\n{"error_type": "f"}\n')
    got = sorted(r.error_type for r in IO.read_exec_log(spark, p).collect())
    assert got == ["e", "f"]


def test_anchor_layouts_and_edges(spark, tmp_dir):
    write(f"{tmp_dir}/flat/bank/anchors.json", json.dumps({"vendor_name": {"type": "text_match", "role": "label"}}))
    write(f"{tmp_dir}/wrap/bank/anchors.json",
          json.dumps({"schema_version": "1.0", "anchors": {"total": {"type": "regex", "pattern": "Total:"}}}))
    a = {r.template_id: (r.field, r.type) for r in IO.read_anchors(spark, f"{tmp_dir}/*/bank/anchors.json").collect()}
    assert a == {"flat": ("vendor_name", "text_match"), "wrap": ("total", "regex")}
    write(f"{tmp_dir}/g/bank/knowledge_graph.json",
          json.dumps({"schema_version": "1.0", "edges": [{"from": "R1", "to": "A1", "relation": "uses_anchor"}]}))
    e = IO.read_edges(spark, f"{tmp_dir}/g/bank/knowledge_graph.json").first()
    assert (e.template_id, e.src, e.dst, e.relation, e.weight) == ("g", "R1", "A1", "uses_anchor", 1.0)


def test_snapshots_never_overwrite(spark, tmp_dir):
    df = spark.createDataFrame([("t", "R1")], "template_id string, id string")
    p1 = IO.write_snapshot(df, f"{tmp_dir}/rules", 1)
    p2 = IO.write_snapshot(df.union(df), f"{tmp_dir}/rules", 2)
    assert IO.latest_snapshot(spark, f"{tmp_dir}/rules").endswith("snapshot=000002")
    assert IO.read_snapshot(spark, f"{tmp_dir}/rules").count() == 2
    with pytest.raises(Exception):
        IO.write_snapshot(df, f"{tmp_dir}/rules", 1)
    assert p1 != p2


def test_document_scan(spark, tmp_dir):
    write(f"{tmp_dir}/docs/tplX/a.txt", "hello\nworld")
    got = IO.scan_documents(spark, f"{tmp_dir}/docs/*/*.txt").first()
    assert got.template_id == "tplX" and got.content == "hello\nworld" and got.path.endswith("a.txt")


def test_stream_lifecycle_equals_batch(spark):
    from refbank.plans.catalog import REGISTRY
    d = "/root/testdata/sf0.001"
    a = sorted(map(tuple, REGISTRY["stream_lifecycle"](spark, d).collect()))
    b = sorted(map(tuple, REGISTRY["replay_outcomes"](spark, d).collect()))
    assert a == b


def test_formula_constraints_and_append(spark, tmp_dir):
    docs = spark.createDataFrame([("t", '{"formula_constraints": [{"cell": "C7", "formula": "=MAX(C4:C6)", '
                                        '"depends_on": ["C4", "C6"], "description": "Sum"}]}')],
                                 "tpl string, value string")
    f = IO.formula_constraints_from_json(docs).first()
    assert (f.cell, f.formula, f.depends_on) == ("C7", "=MAX(C4:C6)", ["C4", "C6"])
    ev = spark.createDataFrame([("e1", "2024-01-02 03:04:05", "row_misalignment")], "event_id string, ts string, error_type string")
    IO.append_events(ev, f"{tmp_dir}/log")
    IO.append_events(ev, f"{tmp_dir}/log")
    back = spark.read.json(f"{tmp_dir}/log")
    assert back.count() == 2 and "dt" in back.columns


def test_learn_cycle_commits_and_reflects(spark):
    from refbank.plans import learning as LN
    samples = spark.createDataFrame([("a", 1, "Invoice #1 Vendor: X"), ("b", 2, "nothing here")],
                                    "template_id string, input_id long, content string")
    schema = spark.createDataFrame([("a", "inv", 0), ("b", "inv", 0)], "template_id string, field string, ord long")
    cat = spark.createDataFrame([("inv", 0, "Bill #(\\d+)", "content"), ("inv", 1, "Invoice #(\\d+)", "content")],
                                "field string, cand int, pattern string, source string")
    res = LN.learn_cycle(spark, samples, schema, LN.rule_catalogue_tester(cat), max_retries=3,
                         as_of="2024-01-01 00:00:00")
    got = {r.template_id: (r.status, r.attempts) for r in res.status.collect()}
    assert got == {"a": ("committed", 2), "b": ("reflected", 3)}


def test_rules_export_roundtrip(spark, tmp_dir):
    rules = spark.createDataFrame(
        [("tplZ", "R007", "pdf", "field_extraction", "total", "find_by_regex", None, "Total: (\\\\d+)", 0.7, 3,
          None, "2024-05-06 07:08:09", "Total: 12", "12", 0)],
        "template_id string, id string, input_type string, trigger string, field string, action string, "
        "anchor string, pattern string, confidence double, support long, last_used timestamp, created_at string, "
        "example_input string, example_output string, ord long")
    out = f"{tmp_dir}/tplZ/bank/rules.jsonl"
    IO.write_rules(rules, out)
    back = IO.read_rules(spark, out, template_level=3).first()
    assert (back.template_id, back.id, back.input_type, back.trigger, back.field, back.action,
            back.pattern, back.confidence, back.support) == \
        ("tplZ", "R007", "pdf", "field_extraction", "total", "find_by_regex", "Total: (\\\\d+)", 0.7, 3)
    assert (back.created_at, back.example_input, back.example_output) == ("2024-05-06 07:08:09", "Total: 12", "12")


def test_lenient_log_counts_rejects(spark, tmp_dir):
    p = f"{tmp_dir}/mem2/execution_log.jsonl"
    write(p, '{"error_type": "e"}\nnot json\n{"error_type": "f"}\n{broken\n')
    good, bad = IO.read_exec_log_with_rejects(spark, p)
    assert sorted(r.error_type for r in good.collect()) == ["e", "f"]
    assert bad.count() == 2


def test_stream_ingest_drops_duplicate_events(spark, tmp_dir):
    import pandas as pd

    from refbank.streaming import jobs as ST
    ts = pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:01", "2024-01-01 00:00:03"])
    pdf = pd.DataFrame({"event_id": [1, 2, 1, 3], "ts": ts, "user_id": [4, 5, 4, 6],
                        "event_type": ["error", "error", "error", "click"], "value": [1.0, 2.0, 1.0, 3.0],
                        "props": ['{"k": 1}', '{"k": 2}', '{"k": 1}', '{"k": 3}']})
    os.makedirs(f"{tmp_dir}/src", exist_ok=True)
    pdf.to_parquet(f"{tmp_dir}/src/events.parquet", index=False, coerce_timestamps="us")
    got = sorted((r.event_id, r.error_type) for r in ST.stream_ingest(spark, f"{tmp_dir}/src").collect())
    assert got == [("1", "semantic_mismatch"), ("2", "missing_fields"), ("3", None)]


def test_streams_do_not_depend_on_files_or_arrival_order(spark, tmp_dir):
    from refbank.operators import lifecycle as L
    from refbank.plans import fixtures as X
    from refbank.streaming import jobs as ST

    one = "/root/testdata/sf0.001"
    many = f"{tmp_dir}/many"
    # seven files in shuffled time order, read one per batch
    spark.read.parquet(f"{one}/events.parquet").repartition(7, "event_id").write.parquet(f"{many}/events.parquet")
    stream = ST.event_stream
    rules = X.rules(spark, one)
    rows = lambda df: sorted(map(str, df.collect()))
    whole = [rows(ST.stream_ingest(spark, one)), rows(ST.stream_clusters(spark, one)), rows(ST.stream_lifecycle(spark, one, rules))]
    try:
        ST.event_stream = lambda s, d: stream(s, d, max_files_per_trigger=1)
        parts = [rows(ST.stream_ingest(spark, many)), rows(ST.stream_clusters(spark, many)), rows(ST.stream_lifecycle(spark, many, rules))]
    finally:
        ST.event_stream = stream
    assert parts == whole and all(whole)
    assert whole[2] == rows(L.replay_outcomes(rules, X.outcomes(spark, one)))


def test_late_events_restart_and_bounded_state(spark, tmp_dir):
    import datetime as dt
    import random

    import pandas as pd

    from refbank.operators import lifecycle as L
    from refbank.operators import memory as M
    from refbank.plans import fixtures as X
    from refbank.streaming import jobs as ST

    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=37 * i, microseconds=rng.randint(0, 9)), rng.randint(0, 3),
             rng.choice(["purchase", "error", "click"]), 1.0, '{"k": %d}' % rng.randint(0, 9)) for i in range(900)]
    rows += [(r[0], r[1] + dt.timedelta(days=5), *r[2:]) for r in rows[:5]]  # ids again, long after
    files = [rows[k::3] if k < 2 else rows[k::3][::-1] for k in range(3)]  # every file spans all days: late for the next ones

    def put(n, part):
        os.makedirs(f"{tmp_dir}/s/events.parquet", exist_ok=True)
        pd.DataFrame(part, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(
            f"{tmp_dir}/s/events.parquet/f{n}.parquet", index=False, coerce_timestamps="us")

    rules = X.rules(spark, "/root/testdata/sf0.001")
    jobs = {"ingest": ST.stream_ingest, "clusters": ST.stream_clusters, "lifecycle": lambda s, d, **kw: ST.stream_lifecycle(s, d, rules, **kw)}
    log = lambda: X.table(spark, f"{tmp_dir}/s", "events")
    for n, part in enumerate(files):
        put(n, part)
        got = {}
        for name, job in jobs.items():  # each goes on from its own checkpoint
            df = job(spark, f"{tmp_dir}/s", sink=f"{tmp_dir}/sink-{name}")
            got[name] = sorted(map(str, df.collect()))
        assert got["lifecycle"] == sorted(map(str, L.replay_outcomes(rules, X.outcomes(spark, f"{tmp_dir}/s")).collect()))
        ev = M.enrich_events(M.failures(X.log_events(log())))
        want = ev.groupBy(F.date_trunc("day", "ts").alias("day"), "cluster_key").agg(F.count("*").alias("samples"))
        assert got["clusters"] == sorted(map(str, want.collect()))
        assert len(got["ingest"]) == log().select("event_id").distinct().count()
        # some 23 days were read; what is open is a day or two of at most four templates / sixty clusters
        assert ST.STATE_ROWS["lifecycle"][-1] <= 2 * 4 * 2 and ST.STATE_ROWS["ingest"][-1] <= 100


def test_summaries_merge_in_any_grouping():
    import random

    import numpy as np

    from refbank.streaming import jobs as ST

    rng = random.Random(2)
    for _ in range(200):
        d = np.array([rng.choice([2, -5, 0]) for _ in range(rng.randint(0, 30))])
        cuts = sorted(rng.randint(0, len(d)) for _ in range(4))
        parts = [ST.fold_steps(x) for x in np.split(d, cuts)]
        left = parts[0]
        for p in parts[1:]:
            left = ST.merge_summaries(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = ST.merge_summaries(p, right)
        assert left == right == ST.fold_steps(d)


def test_odd_types_in_log_lines_are_kept(spark, tmp_dir):
    p = f"{tmp_dir}/mem3/execution_log.jsonl"
    write(p, '{"event_id": "e1", "error_type": "x", "confidence": "high"}\n{"event_id": 7, "confidence": "0.5", "missing_fields": "A"}\n'
             '{"event_id": "e3", "human_confirmed": "true", "missing_fields": ["A", 1]}\n\n5\n{oops\n')
    good, bad = IO.read_exec_log_with_rejects(spark, p)
    got = {r.event_id: r for r in good.collect()}
    assert set(got) == {"e1", "7", "e3"}
    assert (got["e1"].confidence, got["7"].confidence, got["e3"].human_confirmed) == (None, 0.5, True)
    assert got["e3"].missing_fields == ["A", "1"] and got["7"].missing_fields is None
    assert bad.count() == 2 and IO.read_exec_log(spark, p).count() == 3


def test_malformed_documents_fail_and_unfinished_snapshots_are_skipped(spark, tmp_dir):
    write(f"{tmp_dir}/bad/bank/anchors.json", "{no json")
    write(f"{tmp_dir}/bad/bank/graph.json", "{no json")
    for reader, name in ((IO.read_anchors, "anchors"), (IO.read_edges, "graph")):
        with pytest.raises(Exception):
            reader(spark, f"{tmp_dir}/bad/bank/{name}.json").collect()
    path = IO.write_snapshot(spark.createDataFrame([("t", 1)], "template_id string, x int"), f"{tmp_dir}/snap", 1)
    os.makedirs(f"{tmp_dir}/snap/snapshot=000002")
    assert IO.latest_snapshot(spark, f"{tmp_dir}/snap").endswith(path.rsplit("/", 1)[1])
