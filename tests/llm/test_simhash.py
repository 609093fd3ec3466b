import itertools
import random

import pytest

from refbank.llm import simhash as S
from refbank.llm.common import components
import brute

SCHEMA = "doc_id long, text string, fp string, h int"


def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "x y"]
    out = []
    for i in range(60):
        out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 300)))))
    for i in range(60, 90):  # near copies of earlier texts
        w = out[rng.randrange(40)][1].split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((i, " ".join(w)))
    out += [(90, out[3][1].upper()), (91, None), (92, ""), (93, " \t\n\x0b"), (94, "one"), (95, "One two\nthree"),
            (96, "a b c d " * 20000), (97, out[7][1])]
    return out


def test_classes_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA)
    got = {r.doc_id: (r.f, r.component_id) for r in
           S.near_duplicates(df).select("doc_id", S.hex16(S.F.col("fp")).alias("f"), "component_id").collect()}
    assert got == brute.simhash_classes(data)


@pytest.mark.parametrize("dense", [256, 2])
def test_links_are_complete_and_exact(spark, monkeypatch, dense):
    monkeypatch.setattr(S, "DENSE", dense)
    rng = random.Random(3)
    points = set()
    for _ in range(12):
        b = rng.getrandbits(64)
        points.add(b)
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = [tuple(r) for r in S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4).collect()]
    assert set(got) == want


def test_drop_keeps_one_document_of_each_class(spark):
    t = "alpha beta gamma delta epsilon zeta"
    data = [(5, t, "a", 1), (2, t, "b", 1), (2, t, "b", 1), (9, "quite another text", None, 2), (None, "quite another text", "c", 3),
            (4, None, "d", 4), (3, "", "e", 5), (None, "alone here", "f", None)]
    df = spark.createDataFrame(data, SCHEMA.replace("h int", "row_hash int"))
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(2, t, "b", 1), (9, "quite another text", None, 2), (3, "", "e", 5), (None, "alone here", "f", None)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(df).collect() == []
    assert S.drop_near_duplicates(df).collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    want = brute.union_find({x for p in chain + hub for x in p}, chain + hub)
    assert got == want
