"""What must not grow with the tables: texts in joins, tables sent to the driver."""

import datetime
import hashlib

from refbank.operators import extract as E
from refbank.plans import fixtures as X


def _tables(spark, d):
    spark.createDataFrame([(1, "src0", "one text"), (2, "src1", None), (3, "src0", "")], "doc_id long, source string, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(10, 20), (10, 20), (10, 21), (11, 40)], "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")


def test_patterns_are_made_without_moving_texts(spark, tmp_dir):
    _tables(spark, tmp_dir)
    p = X._build_patterns(spark, tmp_dir)
    top = p._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert "md5" not in top and "input_signature" in top       # hashed below the joins
    got = {r.pattern_id: (r.template_id, r.input_signature, r.rules_used) for r in p.collect()}
    none = hashlib.md5(b"").hexdigest()
    one = hashlib.md5(b"one text").hexdigest()
    assert got["P010"] == ("src0", one, ["R020"]) and got["P011"] == ("src0", one, ["R040"])
    assert set(got) == {"P010", "P011", "P012"} and got["P012"][1] in (None, none)


def test_texts_of_inputs_are_not_broadcast(spark):
    inputs = spark.createDataFrame([(1, "t", "s", "text"), (2, "u", "s", "more")], "input_id long, template_id string, template_signature string, content string")
    rules = spark.createDataFrame([(1, 1, "R001", "direct", 0.9, 3, "f"), (1, 2, "R002", "via_kg", 0.8, 0, "g")],
                                  "input_id long, rank int, id string, source string, confidence double, support long, field string")
    fs = E.few_shot_block(rules, inputs)
    tf = spark.createDataFrame([("t", "{f}", "[]")], "template_id string, fields_txt string, formulas_txt string")
    ta = spark.createDataFrame([("u", "{a}")], "template_id string, anchors_txt string")
    mt = spark.createDataFrame([(1, "[p]")], "input_id long, patterns_txt string")
    prompts = E.build_prompts(inputs, fs, tf, ta, mt)
    for df in (fs, prompts):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.input_id: r.prompt for r in prompts.collect()}
    assert "{f}" in got[1] and "[p]" in got[1] and "R002" in got[1] and "{a}" in got[2] and E.NO_RULES_TEXT in got[2]


def test_every_family_has_its_repairs_in_the_log(spark, tmp_dir):
    """k = 11 is a failure with missing_fields of Field_C, and was repaired."""
    from refbank.plans.catalog import REGISTRY
    t = datetime.datetime(2001, 1, 1)
    rows = [(1, t, 3, "error", '{"k": 11}'), (2, t, 3, "error", '{"k": 11}'), (3, t, 3, "click", '{"k": 11}'), (4, t, 3, "error", '{"k": 4}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{tmp_dir}/events.parquet")
    got = {r.cluster_key: (r.top_repair_action, r.top_repair_votes) for r in REGISTRY["top_repair"](spark, tmp_dir).collect()}
    key = "missing_fields|Field_C|sig3"
    assert sorted(got.values()) == [("repair_4", 1), ("repair_4", 2)] and got[key] == ("repair_4", 2)
    assert [(r.missing_fields, r.support) for r in REGISTRY["summary_rules"](spark, tmp_dir).collect()] == [("Field_C", 2)]
    assert [r.cluster_key for r in REGISTRY["relearn_candidates"](spark, tmp_dir).collect()] == [key]


def test_labels_are_looked_for_in_the_row(spark):
    """No window or join over lines: a text is not moved to find its labels."""
    from refbank.operators import actions as A
    inputs = spark.createDataFrame([(1, "t", "a b c a b\n\nx: 1 a b: 2\nb"), (None, "t", "a b 3"), (2, "u", "a b 3")], "input_id long, template_id string, content string")
    anchors = spark.createDataFrame([("t", "a b"), ("t", "b c"), ("t", "b"), ("t", "x")], "template_id string, anchor string")
    hits = A.anchor_hits(inputs, anchors)
    got = sorted((r.line_no, r.pos, r.n, r.label, r.next_pos, r.below) for r in hits.collect())
    assert got == [(0, 1, 2, "a b", 4, 1), (0, 4, 2, "a b", None, 1), (1, 1, 1, "x", 3, 1), (1, 3, 2, "a b", None, 1), (2, 1, 1, "b", None, None)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString().split("label#")[0]
    assert "Window" not in plan.split("Join")[0]


def test_labels_are_induced_in_the_samples_row(spark, monkeypatch):
    """lines and words are not moved; rows that come twice count as before."""
    from refbank.operators import induce as I
    lines = spark.createDataFrame([(1, "t", 1, [["no", "14"], ["ship"], ["aurora", "ii"]], [("no", ["14"]), ("ship", ["aurora", "ii"])])],
                                  "input_id long, template_id string, n_rows long, ws array<array<string>>, held array<struct<field:string,v:array<string>>>")
    labels = spark.createDataFrame([("t", "no", 1), ("t", "ship", 1)], "template_id string, label string, n int")
    for df in (I.candidates(lines), I.first_followers(lines, labels)):
        top = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert "Window" not in top and "Aggregate" not in top
    assert {(r.field, r.label) for r in I.candidates(lines).collect()} == {("no", "no"), ("ship", "ship")}
    assert {r.label: r.after for r in I.first_followers(lines, labels).collect()} == {"no": ["14"], "ship": ["aurora", "ii"]}
    samples = spark.createDataFrame([(1, "t", "no: 14"), (1, "t", "no: 14"), (2, "t", "no: 9"), (None, "t", "no: 9"), (3, None, "no: 9"), (4, "t", "no: 1")],
                                    "input_id long, template_id string, content string")
    known = spark.createDataFrame([(1, "no", "14"), (1, "no", "14"), (2, "no", "8"), (None, "no", "9"), (3, "no", "9"), (9, "no", "9")], "input_id long, field string, value string")
    got = [tuple(r) for r in I.induce_anchors(samples, known).collect()]
    # two rows, each seen beside either and met by two known values: 2 * 2 * 2, one of input 2, one of input 4
    assert got == [("t", "no", "no", 8, 10, 2, 0.8, 8 * 5 / (10 * 2))]


def test_tables_are_read_in_the_inputs_row(spark):
    """no line or cell is moved; inputs that share an id are still one text."""
    from refbank.operators import actions as A
    texts = ["| Part | Qty |\n| --- | --- |\n| 1 | 2 |\n| 3 |\n\n| PART no | part | x |\n|-|\n| 9 | 8 | 7 | 6 |", "Article 5", None, "", "| Part |", "a | qty \n - | - \n b | c",
             "| Part | Part |\n| 1 | 2 |\n| Part no |\n| |\nqty: 4"]
    inputs = spark.createDataFrame([(k, "t", x) for k, x in enumerate(texts)] + [(7, "u", "| Part |\n| 1 |"), (8, None, "| Part |\n| 1 |"), (9, "v", "Article 6")],
                                   "input_id long, template_id string, content string")
    rules = spark.createDataFrame([("t", "A", "part", A.BY_HEADER, ["Part no", "part"], "Article ([0-9])", 0.8, 1), ("t", "B", "part", A.BY_HEADER, ["PART"], "(5)", 0.9, 2),
                                   ("t", "C", "qty", A.BY_HEADER, ["", "qty"], "qty: ([0-9])", None, 3), ("t", "D", "qty", A.BY_HEADER, ["Qty"], None, None, 3),
                                   ("t", "E", None, A.BY_HEADER, ["x"], None, 0.5, 4), ("u", "F", "part", A.BY_HEADER, ["part"], None, 0.5, 1), ("v", "G", "part", A.BY_HEADER, [], "([0-9])", 0.5, 1)],
                                  "template_id string, rule_id string, field string, action string, headers array<string>, fallback string, confidence double, ord int")
    own, merged = A._own_candidates(inputs, rules), A._merged_candidates(inputs, rules)
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert key(own) == key(merged) == key(A.header_candidates(inputs, rules)) and len(key(own)) > 10
    assert "Window" not in own._jdf.queryExecution().optimizedPlan().toString()
    twice = inputs.unionByName(inputs.where("input_id < 2")).unionByName(inputs.where("input_id = 0").selectExpr("CAST(NULL AS long) AS input_id", "template_id", "content"))
    assert key(A.header_candidates(twice, rules)) == key(A._merged_candidates(twice, rules))


def test_a_round_tests_its_samples_once(spark):
    """what a round's test misses is stored, not found again wherever it is used."""
    from refbank.plans import learning as LN
    seen = spark.sparkContext.accumulator(0)
    samples = spark.createDataFrame([("t", k) for k in range(4)] + [("u", 9)], "template_id string, input_id long")
    schema = spark.createDataFrame([("t", "f", 1), ("u", "g", 1)], "template_id string, field string, ord long")

    def test(s, rules, sch):
        def look(rows):
            for r in rows:
                seen.add(1)
                if r.template_id == "t":
                    yield (r.template_id, r.input_id, "f")
        return spark.createDataFrame(s.rdd.mapPartitions(look), "template_id string, input_id long, field string")

    res = LN.learn_cycle(spark, samples, schema, test, max_retries=3, as_of="2001-12-01 00:00:00")
    assert {tuple(r) for r in res.status.collect()} == {("t", "reflected", 3), ("u", "committed", 1)}
    assert sorted((r.template_id, r.cand) for r in res.rules.collect()) == [("t", 0), ("t", 1), ("t", 2), ("t", 3), ("u", 0)]
    assert seen.value == 5 + 4 + 4


def test_a_value_is_cut_out_once(spark):
    """the words of a line and the runs of a value are not written out where they are used."""
    from refbank.operators import actions as A
    inputs = spark.createDataFrame([(1, "t", "a: 1 b: 2\nc\n 3")], "input_id long, template_id string, content string")
    anchors = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "template_id string, anchor string")
    got = A.after_anchors(inputs, anchors)
    assert {r.label: r.value for r in got.collect()} == {"a": "1", "b": "2", "c": "3"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(A.RUNS) == 2 and plan.split("Join")[0].count("lower(") == 1


def test_lines_are_moved_once_for_the_edges(spark, tmp_dir):
    """No self-join of lines, no names in the distinct; repeats and nulls as before."""
    rows = [(1, 1, 20, 5), (1, 2, 40, 5), (1, 2, 60, 6), (1, 2, 60, 6), (1, 3, 80, None), (1, 5, 20, 5), (1, 4, 21, 5), (2, 1, 20, 5), (2, 2, 20, 5),
            (None, 1, 20, 5), (None, 2, 40, 5), (3, None, 20, 7), (3, None, 40, 7), (4, 1, None, 5), (4, 2, 20, 5), (5, 1, 40, 5), (5, 2, 20, 5)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_dir}/lineitem.parquet")
    df = X._build_edges(spark, tmp_dir)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in df.collect()]
    name = lambda k: f"R{k:03d}" if k is not None else "Rnull"
    tpl = lambda k: f"src{k % 20}" if k is not None else None
    want = {(tpl(p), name(p), f"A{s}" if s is not None else None, "uses_anchor", 1.0) for _, _, p, s in rows}
    want |= {(tpl(p), name(p), name(q), "often_follows", 1.0) for o, n, p, _ in rows for o2, n2, q, _ in rows
             if None not in (o, n, p, o2, n2, q) and o == o2 and n2 == n + 1 and p % 20 == q % 20 and p != q}
    assert len(got) == len(want) and set(got) == want


def test_digests_of_cells_are_sums_of_their_hashes(spark):
    """The same sums as of decimals, made of longs."""
    from refbank.operators import layout as LY
    cells = spark.createDataFrame([(1, "a", r, c, "x") for r in range(3, 40) for c in range(2, 9)] + [(1, "b", 1, 1, " ")], "workbook_id long, sheet string, row long, col long, value string")
    want = sum(int(hashlib.md5(f"{r}:{c}".encode()).hexdigest()[:12], 16) for r in range(37) for c in range(7))
    lay = LY.sheet_layout(cells)
    assert {r.sheet: (r.occupied_digest, r.occupied_count, r.min_row, r.max_col) for r in lay.collect()} == {"a": (str(want), 259, 3, 8), "b": ("0", 0, None, None)}
    assert "decimal(38,0)" not in lay._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_by_anchor_keep_types_in_the_edge(spark):
    """an edge is not written out once per input type, names are not sorted to be counted; repeats and nulls as before."""
    from refbank.operators import retrieval as R
    drows = [("t", "pdf", "R1"), ("t", "md", "R1"), ("t", None, "R1"), ("t", "pdf", "R2"), ("t", "pdf", "R2"), ("t", "md", "R3"), ("u", "pdf", "R1"), ("t", "pdf", None), (None, "pdf", "R1"), ("t", None, "R8")]
    erows = [("t", "R1", "A1"), ("t", "R1", "A1"), ("t", "R2", "A1"), ("t", "R4", "A1"), ("t", None, "A1"), ("t", "R3", "A2"), ("t", None, "A2"), ("t", "R5", "A2"), ("t", "R2", "A3"),
             ("u", "R1", "A1"), ("u", "R6", "A1"), ("t", "R7", None), ("t", "R1", None), (None, "R1", "A1"), (None, "R9", "A1"), ("t", "R8", "A4"), ("t", "R1", "A4"), ("v", "R1", "A1")]
    direct = spark.createDataFrame(drows, "template_id string, input_type string, id string")
    edges = spark.createDataFrame([(*e, r) for e in erows for r in ("uses_anchor", "often_follows") if r == "uses_anchor" or e[1]], "template_id string, src string, dst string, relation string")
    df = R.shared_anchor_neighbors(direct, edges)
    users = {(t, ty, a): {i for t2, ty2, i in drows for t3, s, a2 in erows if (t2, t3, ty2, a2) == (t, t, ty, a) and i is not None and i == s}
             for t, ty, _ in drows for _, _, a in erows if t is not None and a is not None}
    want = {(t, ty, s) for (t, ty, a), use in users.items() for t2, s, a2 in erows if (t2, a2) == (t, a) and (len(use) > 1 or (s is not None and use - {s}))}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) > 8 and set(got) == want
    assert ("t", "pdf", None) in want and ("t", None, "R8") in want and ("t", "md", "R1") not in want
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_edges_take_little_room(spark, tmp_dir):
    """the next line is looked for among three numbers a line; a rule's edges are stored together; names are as by R%03d."""
    import re
    spark.createDataFrame([(1, n % 7, 20 * (n % 9), n % 5) for n in range(90)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_dir}/lineitem.parquet")
    df = X._build_edges(spark, tmp_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, \d+\)", plan)
    for part in df.where("relation = 'uses_anchor'").rdd.glom().collect():
        rules = [int(r.src[1:]) for r in part]
        assert rules == sorted(rules)
    keys = [None, -5, 0, 7, 99, 100, 1234567, 2**62]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(X._rid(X.F.col("k")).alias("r"), X.F.format_string("R%03d", "k").alias("w")).collect()
    assert all(r.r == r.w for r in got)


def test_candidates_are_stored_before_they_meet_the_edges(spark):
    """with a floor few rules may come in; their table's size is known, so the edges are not moved for them."""
    from refbank.operators import retrieval as R
    rules = spark.createDataFrame([("t", f"R{k}", "pdf" if k < 3 else "md", "field_extraction", "f", c, 1, k) for k, c in enumerate([0.5, 0.4, 0.4, 0.9, 0.45, 0.1, 0.95])],
                                  "template_id string, id string, input_type string, trigger string, field string, confidence double, support long, ord long")
    edges = spark.createDataFrame([("t", "R0", "A1", "uses_anchor"), ("t", "R3", "A1", "uses_anchor"), ("t", "R4", "A1", "uses_anchor"), ("t", "R6", "A2", "uses_anchor"), ("t", "R1", "R6", "often_follows")],
                                  "template_id string, src string, dst string, relation string")
    direct = R.direct_rules(spark.createDataFrame([("t", "pdf")], "template_id string, input_type string"), rules)
    floor = spark.createDataFrame([("t", "pdf", 0.5)], "template_id string, input_type string, floor double")
    df = R.kg_expand(direct, edges, rules, floor)
    assert any("/candidates-" in f for f in df.inputFiles())
    assert sorted(r.id for r in df.collect()) == ["R3", "R6"]
    assert sorted(r.id for r in R.kg_expand(direct, edges, rules).collect()) == ["R3", "R4", "R6"]
