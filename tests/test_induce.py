"""Analysis of samples, the learning loop over all of them, and whole banks."""

import re

import pytest
from pyspark.sql import functions as F

from refbank.operators import induce as I
from refbank.plans import catalog
from refbank.plans import fixtures as X
from refbank.sources import bank_io as B

SMALL = "/root/testdata/sf0.001"


def test_labels_are_what_stands_before_values(spark):
    samples = spark.createDataFrame([
        (1, "t", "Berth no: 14 Pilot Nils\nShip\nAurora II"), (2, "t", "berth no 9   pilot Ove\n\nShip\n Nova"),
        (3, "t", "Berth: none\nBerth no: 7 pilot: Per\nShip\nAda"), (4, "t", "no berth\npilot pilot Åse\nship"), (5, "t", None),
        (6, "u", "Pilot Nils")], "input_id long, template_id string, content string")
    known = spark.createDataFrame([
        (1, "berth", "14"), (2, "berth", "9"), (3, "berth", "7"), (1, "pilot", "Nils"), (2, "pilot", "OVE"), (3, "pilot", "Per"), (4, "pilot", "Åse"),
        (1, "ship", "Aurora II"), (2, "ship", "Nova"), (3, "ship", "Ada"), (4, "ship", "Lost"), (5, "ship", None), (4, "berth", "..."),
        (6, "port", "Bergen")], "input_id long, field string, value string")
    got = {(r.template_id, r.field): tuple(r)[2:] for r in I.induce_anchors(samples, known).collect()}
    # "berth no" stands first before the value in all three; "no" too, but also at the start of sample 4
    assert got == {("t", "berth"): ("berth no", 3, 3, 3, 1.0, 5 / 3),
                   # sample 4 says "pilot" twice: what follows the first is not the value
                   ("t", "pilot"): ("pilot", 3, 4, 4, 0.75, 3 * 5 / 16),
                   ("t", "ship"): ("ship", 3, 4, 4, 0.75, 3 * 5 / 16)}
    ranked = {(r.field, r.cand): r.anchor for r in I.rank_anchors(samples, known).collect()}
    assert ranked["berth", 0] == "berth no" and ranked["berth", 1] == "no" and ("port", 0) not in ranked
    assert I.induce_anchors(samples.limit(0), known).collect() == [] and I.induce_anchors(samples, known.limit(0)).collect() == []


def words(text):
    return re.findall(r"\w+", text.lower())


def test_learning_over_all_forms(spark):
    res = catalog.learn_forms(spark, SMALL)
    status = {r.template_id: (r.status, r.attempts) for r in res.status.collect()}
    ranked = {}
    for r in I.rank_anchors(X.forms(spark, SMALL), X.form_values(spark, SMALL)).orderBy("cand").collect():
        ranked.setdefault((r.template_id, r.field), []).append(r.anchor)
    # by hand: a form is right if every value is what stands after its label
    known = {}
    for r in X.form_values(spark, SMALL).collect():
        known.setdefault(r.input_id, {})[r.field] = words(r.value)
    wrong = set()
    for f in X.forms(spark, SMALL).collect():
        labels = {field: words(ranked[f.template_id, field][0]) for field in known[f.input_id]}
        lines = [x for x in f.content.split("\n") if x.strip()]
        for field, value in known[f.input_id].items():
            found = None
            for k, line in enumerate(lines):
                w = words(line)
                starts = sorted(p for lab in labels.values() for p in range(len(w)) if w[p:p + len(lab)] == lab)
                at = [p for p in range(len(w)) if w[p:p + len(labels[field])] == labels[field]]
                if found is None and at:
                    stop = at[0] + len(labels[field])
                    after = w[stop:min([p for p in starts if p >= stop], default=len(w))]
                    if not after and stop == len(w) and k + 1 < len(lines):
                        n = words(lines[k + 1])
                        after = n[:min([p for lab in labels.values() for p in range(len(n)) if n[p:p + len(lab)] == lab], default=len(n))]
                    found = after or None
            if found != value:
                wrong.add(f.template_id)
    assert wrong and len(wrong) < len(status)
    assert status == {t: ("reflected", 5) if t in wrong else ("committed", 1) for t in status}
    # ids go on after the twelve rules of the bank
    ids = [int(r.id[1:]) for r in res.rules.where("template_id = 'form1'").collect()]
    assert min(ids) == 13 and len(set(ids)) == len(ids)
    assert {r.template_id for r in res.anchors.collect()} == set(status) - wrong
    assert res.edges.join(res.rules, [res.edges.template_id == res.rules.template_id, res.edges.src == res.rules.id], "left_anti").count() == 0


def test_a_bank_is_read_whole_or_not_at_all(spark, tmp_dir):
    rules = spark.createDataFrame([("t", "R001"), ("u", "R001")], "template_id string, id string")
    edges = spark.createDataFrame([("t", "R001", "a")], "template_id string, src string, dst string")
    assert B.read_bank(spark, tmp_dir) == {}
    assert B.commit_bank(spark, tmp_dir, {"rules": rules, "edges": edges}) == 1

    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception):
        B.commit_bank(spark, tmp_dir, {"rules": rules.limit(0), "edges": edges.withColumn("dst", boom("dst"))})
    # the broken round left the old bank readable
    assert B.latest_bank(spark, tmp_dir) == 1 and B.read_bank(spark, tmp_dir)["rules"].count() == 2
    # stores that are not given are taken over; the broken round's number is not used again
    assert B.commit_bank(spark, tmp_dir, {"rules": rules.where("template_id = 'u'")}) == 3
    bank = B.read_bank(spark, tmp_dir)
    assert set(bank) == {"rules", "edges"} and bank["rules"].count() == 1 and bank["edges"].count() == 1
    assert B.read_bank(spark, tmp_dir, 1)["rules"].count() == 2 and B.read_bank(spark, tmp_dir, 2) == {}
    with pytest.raises(ValueError):
        B.commit_bank(spark, tmp_dir, {"other": rules})
