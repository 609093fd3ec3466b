"""Rule actions: labels, table columns, pattern lists, and rules as files."""

import json

from refbank.operators import actions as A
from refbank.sources import bank_io as B

INPUT = "input_id long, template_id string, content string"
RULE = ("template_id string, rule_id string, field string, action string, anchor string, headers array<string>, patterns array<string>, "
        "pattern string, fallback string, confidence double, ord int")


def rule(rid, field, action=None, anchor=None, headers=None, patterns=None, pattern=None, fallback=None, confidence=0.5, ord=1, template="t"):
    return (template, rid, field, action, anchor, headers, patterns, pattern, fallback, confidence, ord)


def by_field(df):
    return {(r.input_id, r.field): (r.value, r.rule_id) for r in df.collect()}


def test_value_after_a_label(spark):
    inputs = spark.createDataFrame([
        (1, "t", "Berth no: 14   Pilot: Nils Å.\n\nShip name\n\n  Aurora ;\nShip\nDraught = -6.2 m"),
        (2, "t", "pilot|Ove\r\nSHIP NAME: Nova\nship name: Second"),
        (3, "t", "Pilot:\nBerth no\nlast"),
        (4, "u", "Pilot: other template"), (5, "t", None), (6, "t", ""), (7, "t", "Pilots: no such word\nPilot")], INPUT)
    rules = spark.createDataFrame([
        rule("R1", "berth", A.AFTER_ANCHOR, "Berth no."), rule("R2", "pilot", A.AFTER_ANCHOR, "pilot:"),
        rule("R3", "ship", A.AFTER_ANCHOR, "Ship  name", confidence=0.4), rule("R4", "ship", A.AFTER_ANCHOR, "ship", confidence=0.9),
        rule("R5", "draught", A.AFTER_ANCHOR, "Draught"), rule("R6", "none", A.AFTER_ANCHOR, "::"), rule("R7", "none", A.AFTER_ANCHOR)], RULE)
    got = by_field(A.anchor_extract(inputs, rules))
    assert got == {
        (1, "berth"): ("14", "R1"), (1, "pilot"): ("Nils Å.", "R2"), (1, "draught"): ("-6.2 m", "R5"),
        # "Ship name" is one label: the shorter one counts only where it stands alone (and there the next line begins with a label)
        (1, "ship"): ("Aurora", "R3"),
        (2, "pilot"): ("Ove", "R2"), (2, "ship"): ("Nova", "R3"), (3, "berth"): ("last", "R1")}


def test_columns_of_tables(spark):
    text = ("intro | not a table row?\n\n| Part  No | Qty | Qty |\n|---|:-:|---|\n| 7 | 2 | 9 |\n| 8 |\n\n"
            "qty;x\nItem | Qty\n5 | 4 | 6\n")
    inputs = spark.createDataFrame([(1, "t", text), (2, "t", "no table\nweight 12 kg"), (3, "t", None)], INPUT)
    rules = spark.createDataFrame([
        rule("H1", "part", A.BY_HEADER, headers=["Item", "part no"], confidence=0.8), rule("H2", "part", A.BY_HEADER, headers=["Part No"], confidence=0.7),
        rule("H3", "qty", A.BY_HEADER, headers=["QTY"]), rule("H4", "weight", A.BY_HEADER, headers=["w"], fallback="weight ([0-9]+)"),
        rule("H5", "weight", A.BY_HEADER, headers=[], fallback="([a-z]+) table", confidence=0.1)], RULE)
    got = sorted((r.input_id, r.field, r.row, r.value, r.rule_id) for r in A.header_extract(inputs, rules).collect())
    # the first header name that exists wins before the first table; of equal columns the first
    assert got == [(1, "part", 1, "5", "H1"), (1, "qty", 1, "2", "H3"), (1, "weight", 1, "a", "H5"), (2, "weight", 1, "12", "H4")]


def test_all_actions_in_one_pass(spark):
    inputs = spark.createDataFrame([(1, "t", "Code A-17\nPort: Bergen\n| Qty |\n| |\n| 3 |"), (2, "t", "code: b9\nPort:"), (3, "x", "Port: x")], INPUT)
    rules = spark.createDataFrame([
        rule("P1", "code", A.TRY_PATTERNS, patterns=["Code ([A-Z]-[0-9]+)", "code: ([a-z0-9]+)"], confidence=0.6, ord=3),
        rule("P2", "code", "find_by_regex", pattern="([0-9]+)", confidence=0.6, ord=4),
        rule("P3", "port", A.AFTER_ANCHOR, "port", confidence=0.2), rule("P4", "port", None, pattern="Port:(x?)", confidence=0.9),
        rule("P5", "qty", A.BY_HEADER, headers=["qty"])], RULE)
    assert by_field(A.bank_extract(inputs, rules)) == {
        (1, "code"): ("A-17", "P1"), (1, "port"): ("Bergen", "P3"), (1, "qty"): ("3", "P5"), (2, "code"): ("b9", "P1")}
    assert A.bank_extract(inputs.limit(0), rules).collect() == [] and A.bank_extract(inputs, rules.limit(0)).collect() == []


def test_rules_come_back_as_they_were(spark, tmp_dir):
    import os

    lines = [
        {"id": "R001", "when": {"input_type": "pdf", "trigger": "field_extraction"}, "condition": {"field": "berth", "context": "port"},
         "then": {"action": "extract_after_anchor", "anchor": "Berth no.", "method": "semantic_extract", "prompt": "Which berth?"}, "confidence": 0.92, "support": 5},
        {"id": "R002", "when": {"input_type": "excel"}, "condition": {"field": "qty"},
         "then": {"action": "extract_by_header", "method": "find_column_by_header", "headers": ["Qty", "Pieces"], "fallback": "([0-9]+)"}, "confidence": 0.88, "support": 3},
        {"id": "R003", "when": {"error_type": "missing_fields"}, "condition": {"missing": ["berth"]},
         "then": {"action": "try_patterns", "patterns": ["a(.)", "b(.)"]}, "confidence": 0.85, "support": 4, "created_at": "2026-04-01T10:00:00",
         "example": {"input": "x", "output": "y"}}]
    os.makedirs(tmp_dir + "/tpl/bank")
    with open(tmp_dir + "/tpl/bank/rules.jsonl", "w") as f:
        f.write("\n\n".join(map(json.dumps, lines)) + "\n")
    rules = B.read_rules(spark, tmp_dir + "/tpl/bank/rules.jsonl")
    B.write_rules(rules, tmp_dir + "/out/tpl/bank")
    back = [json.loads(r.value) for r in spark.read.text(tmp_dir + "/out/tpl/bank").collect()]
    assert sorted(back, key=lambda r: r["id"]) == lines
    found = {r.id: r for r in B.read_rules(spark, tmp_dir + "/out/tpl/bank").collect()}
    assert found["R002"].headers == ["Qty", "Pieces"] and found["R003"].missing == ["berth"]
