"""Retrieval behaviour on small inline banks (reference bank tests)."""

from pyspark.sql import functions as F

from refbank.operators import retrieval as R

RULE_COLS = ("template_id string, id string, input_type string, trigger string, field string, "
             "confidence double, support long, last_used timestamp, ord long")
EDGE_COLS = "template_id string, src string, dst string, relation string, weight double"
PAT_COLS = ("template_id string, pattern_id string, input_signature string, input_type string, "
            "accuracy double, rules_used array<string>, ord long")


def rules(spark, rows):
    return spark.createDataFrame([("t", *r[:4], r[4], 0, None, i) for i, r in enumerate(rows)], RULE_COLS)


def inputs(spark, *paths, content="doc"):
    return spark.createDataFrame([(i, "t", p, content) for i, p in enumerate(paths)],
                                 "input_id long, template_id string, path string, content string")


def edges(spark, rows=()):
    return spark.createDataFrame([("t", *r, 1.0) for r in rows], EDGE_COLS)


def patterns(spark, rows=()):
    return spark.createDataFrame([("t", *r, i) for i, r in enumerate(rows)], PAT_COLS)


def retrieve(spark, r, e=(), p=(), paths=("a.pdf",), content="doc", top_k=10):
    out = R.retrieve_rules(inputs(spark, *paths, content=content), rules(spark, r), edges(spark, e),
                           patterns(spark, p), top_k=top_k)
    return [(x.id, x.source, x.confidence) for x in out.orderBy("input_id", "rank").collect()]


def test_sorted_by_confidence(spark):
    r = [("R001", "pdf", "field_extraction", "a", 0.4), ("R002", "pdf", "field_extraction", "b", 0.9),
         ("R003", "pdf", "field_extraction", "c", 0.6), ("R004", "excel", "field_extraction", "d", 0.99),
         ("R005", "pdf", "field_extraction", "e", 0.2)]
    assert [x[0] for x in retrieve(spark, r)] == ["R002", "R003", "R001"]


def test_duplicate_ids_keep_best(spark):
    r = [("R001", "pdf", "field_extraction", "a", 0.4), ("R001", "pdf", "field_extraction", "a", 0.8)]
    assert retrieve(spark, r) == [("R001", "direct", 0.8)]


def test_missing_type_and_trigger_defaults(spark):
    r = [("R001", None, None, "a", 0.5), ("R002", "auto", "field_extraction", "b", 0.6),
         ("R003", "pdf", "table_extract", "c", 0.9)]
    assert [x[0] for x in retrieve(spark, r, paths=("a.docx",))] == ["R002", "R001"]


def test_kg_one_hop(spark):
    r = [("R001", "pdf", "field_extraction", "a", 0.9), ("R002", "excel", "field_extraction", "b", 0.8),
         ("R003", "excel", "field_extraction", "c", 0.7), ("R004", "excel", "field_extraction", "d", 0.6)]
    e = [("R001", "A1", "uses_anchor"), ("R002", "A1", "uses_anchor"),
         ("R001", "R003", "often_follows"), ("R003", "R004", "often_follows")]
    got = retrieve(spark, r, e)
    assert got == [("R001", "direct", 0.9), ("R002", "via_kg", 0.8), ("R003", "via_kg", 0.7)]


def test_follows_is_directional(spark):
    r = [("R001", "excel", "field_extraction", "a", 0.9), ("R002", "pdf", "field_extraction", "b", 0.8)]
    assert retrieve(spark, r, [("R001", "R002", "often_follows")]) == [("R002", "direct", 0.8)]


def test_signature_upgrades_provenance(spark):
    r = [("R001", "pdf", "field_extraction", "a", 0.9), ("R002", "excel", "field_extraction", "b", 0.8),
         ("R009", "word", "table_extract", "z", 0.5)]
    e = [("R001", "A1", "uses_anchor"), ("R002", "A1", "uses_anchor")]
    from hashlib import md5
    sig = md5(b"doc").hexdigest()
    p = [("P001", sig, "pdf", 0.9, ["R002", "R009"])]
    got = retrieve(spark, r, e, p)
    assert got == [("R001", "direct", 0.9), ("R002", "via_signature", 0.8), ("R009", "via_signature", 0.5)]


def test_top_k_and_gate(spark):
    r = [(f"R{i:03d}", "pdf", "field_extraction", "f", 0.25 + i / 100) for i in range(40)]
    got = retrieve(spark, r, top_k=10)
    assert len(got) == 10
    assert all(c >= 0.3 for _, _, c in got)
    assert got[0][0] == "R039"


def test_match_patterns_exact_and_fallback(spark):
    p = patterns(spark, [("P001", "S1", "pdf", 0.95, []), ("P002", "S2", "pdf", 0.85, []),
                         ("P003", "S3", "pdf", 0.70, []), ("P004", "S1", "pdf", 0.5, [])])
    ctx = spark.createDataFrame([("t", "S1"), ("t", "S9")], "template_id string, signature string")
    got = {(r.signature, r.rank): (r.pattern_id, r.exact) for r in R.match_patterns(ctx, p).collect()}
    assert got == {("S1", 1): ("P001", True), ("S1", 2): ("P004", True),
                   ("S9", 1): ("P001", False), ("S9", 2): ("P002", False)}


def test_new_variant_flag(spark):
    p = patterns(spark, [("P001", "S1", "pdf", 0.95, [])])
    x = spark.createDataFrame([(1, "t", "S1"), (2, "t", "S2"), (3, "u", "S3")],
                              "input_id long, template_id string, signature string")
    got = {r.input_id: r.signature_mismatch for r in R.new_variants(x, p).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_shared_anchor_without_pairs(spark):
    r = rules(spark, [("R001", "pdf", "field_extraction", "a", 0.9), ("R002", "pdf", "field_extraction", "b", 0.8),
                      ("R003", "excel", "field_extraction", "c", 0.7)])
    ctx = spark.createDataFrame([("t", "pdf")], "template_id string, input_type string")
    d = R.direct_rules(ctx, r)
    e = edges(spark, [("R001", "A1", "uses_anchor"), ("R002", "A1", "uses_anchor"), ("R003", "A1", "uses_anchor")])
    got = sorted(x.id for x in R.shared_anchor_neighbors(d, e).collect())
    assert got == ["R001", "R002", "R003"]   # two direct users: every user qualifies
