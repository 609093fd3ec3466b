import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest

from refbank.llm import mixing as M
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, domain string, lang string, source string, total int, level_lang string"


def docs():
    out = []
    for i in range(400):
        d = ["web", "web", "code", None][i % 4]
        s = "hot" if i % 3 == 0 else f"s{i % 7}"
        out.append((i, "w " * (i % 23 + 1), d, ["en", "de", None][i % 5 % 3], s, 1, "x"))
    out += [(500, None, "web", "en", "s1", 1, "x"), (501, "", "void", "en", "e", 1, "x"), (502, "a b", "web", "en", "s1", 1, "x"),
            (502, "a b", "web", "en", "s1", 1, "x"), (None, "a b c", "web", "en", "s1", 1, "x")]
    return out


def brute(rows, weights, share, epochs, seed=17):
    names = ["domain", "lang", "source"]
    leaf = lambda r: tuple(x if x is not None else "unknown" for x in r[2:5])
    tokens = lambda r: len((r[1] or "").split())
    total = defaultdict(int)
    for r in rows:
        total[leaf(r)] += tokens(r)

    def deal(prefix, budget, depth):
        if depth == 3:
            return {prefix: budget}
        kids = sorted({k[:depth + 1] for k in total if k[:depth] == prefix})
        cap = {k: epochs * sum(t for x, t in total.items() if x[:depth + 1] == k) for k in kids}
        w = {k: Fraction(weights.get(names[depth], {}).get(k[-1], 1)) for k in kids}
        got, open_, left = {}, set(kids), Fraction(budget)
        while open_:  # fill the short ones, deal the rest again among their siblings
            level = left / sum(w[k] for k in open_)
            short = {k for k in open_ if cap[k] <= level * w[k]}
            if not short:
                got.update({k: int(level * w[k]) for k in open_})
                break
            got.update({k: cap[k] for k in short})
            left -= sum(cap[k] for k in short)
            open_ -= short
        out = {}
        for k in kids:
            out.update(deal(k, got[k], depth + 1))
        return out

    dealt = deal((), int(sum(total.values()) * share), 0)
    out = []
    for k, budget in dealt.items():
        mine = [r for r in rows if leaf(r) == k]
        whole = budget // total[k] if total[k] else 1
        for e in range(1, whole + 1):
            out += [(r[0], r[1], e) for r in mine]
        if whole < epochs and total[k]:
            name = lambda r: "" if r[0] is None else str(r[0])
            order = defaultdict(list)
            for r in mine:
                order[hashlib.md5(f"{seed}:{whole + 1}:{name(r)}".encode()).hexdigest(), name(r)].append(r)
            used = 0
            for key in sorted(order):
                used += sum(map(tokens, order[key]))
                if used > budget - whole * total[k]:
                    break
                out += [(r[0], r[1], whole + 1) for r in order[key]]
    return sorted(out, key=str)


def levels():
    return {n: F.col(n) for n in ("domain", "lang", "source")}


@pytest.mark.parametrize("share,epochs", [(1.0, 2), (0.3, 1), (1.7, 2), (5.0, 3), (0.0, 2)])
def test_matches_brute_force(spark, share, epochs):
    weights = {"domain": {"web": 3}, "lang": {"en": 5, "de": 2}, "source": {"s1": 4}}
    df = spark.createDataFrame(docs(), SCHEMA).repartition(3)
    got = M.mix(df, levels(), weights, share, epochs, epoch_col="e")
    assert got.columns == [*df.columns, "e"]
    assert sorted(((r.doc_id, r.text, r.e) for r in got.collect()), key=str) == brute(docs(), weights, share, epochs)


def test_many_leaves_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(docs(), SCHEMA)
    monkeypatch.setattr(M, "BROADCAST_LEAVES", 0)
    got = M.mix(df, levels(), {}, 0.5, 2)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((i, t) for i, t, _ in brute(docs(), {}, 0.5, 2)), key=str)


def test_zero_weight_and_empty_table(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    got = M.mix(df, levels(), {"domain": {"web": 0.0}}, 0.5, 1)
    assert got.where("domain = 'web'").count() == 0 and got.count() > 0
    assert M.mix(df.where("false"), levels(), {}).collect() == []


def test_delivered_against_dealt(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    weights = {"domain": {"web": 3}, "lang": {"en": 5, "de": 2}}
    got = {(r.domain, r.lang, r.source): (r.total, r.share, r.delivered) for r in M.delivered(df, levels(), weights, 0.6, 2).collect()}
    mixed = M.mix(df, levels(), weights, 0.6, 2).select(*[F.coalesce(n, F.lit("unknown")).alias(n) for n in ("domain", "lang", "source")],
                                                       M.words(F.col("text")).alias("n"))
    want = {tuple(r)[:3]: r.n for r in mixed.groupBy("domain", "lang", "source").agg(F.sum("n").alias("n")).collect()}
    assert {k: v[2] for k, v in got.items() if v[2]} == {k: n for k, n in want.items() if n}
    longest = df.select(F.max(M.words(F.col("text")))).first()[0]
    assert all(0 <= share - delivered < longest or share >= 2 * total for total, share, delivered in got.values())
