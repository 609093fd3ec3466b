import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import test_entry as base
import test_mixing
import test_tokens

import corpus_pipeline as P
from pyspark.sql import functions as F
from refbank.llm import entries, toxicity
from refbank.llm.common import HELD_OUT_FOLD, fold, store, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and every stage's result, each written and read again."""
    out = [table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        out.append(store(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stage_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity_stage_drops_what_its_scores_reject(spark, stages):
    model = toxicity.learn(stages[0], table(spark, SF, "labels"), fold("doc_id") != HELD_OUT_FOLD)
    texts = [r.text for r in stages[0].collect()]
    z = model.weights[0] + toxicity.features(texts, model) @ model.weights[1:]
    keep = [r for r, s in zip(rows(stages[0]), 1 / (1 + np.exp(-z))) if s < 0.3]
    assert sorted(keep) == sorted(rows(stages[1])) and len(keep) < len(texts)


def test_near_duplicate_stage(stages):
    given = rows(stages[1])
    classes = brute.simhash_classes([(r[0], r[1]) for r in given])
    assert sorted(rows(stages[2])) == sorted(r for r in given if classes[r[0]][1] == r[0])


def test_decontamination_stage(spark, stages):
    given, items = rows(stages[2]), rows(table(spark, SF, "benchmark"))
    bad = {d for d, _ in brute.leaks([(r[0], r[1]) for r in given], items)}
    assert sorted(rows(stages[3])) == sorted(r for r in given if r[0] not in bad)


def test_mixing_stage(stages):
    given = rows(stages[3])
    with_domain = [(r[0], r[1], f"d{int(re.search('[0-9]+$', r[3])[0]) // 5}", r[2], r[3]) for r in given]
    want = test_mixing.brute(with_domain, entries.MIX_WEIGHTS, entries.MIX_BUDGET_SHARE, entries.MIX_EPOCHS, entries.MIX_SEED)
    assert Counter(r[0] for r in rows(stages[4])) == Counter(w[0] for w in want)
    assert set(rows(stages[4])) <= set(given)


def test_token_stage_and_run(spark, stages):
    given = sorted((r[0], r[1]) for r in rows(stages[4]))
    want, at = [], 0
    for (doc_id, _), ids in zip(given, test_tokens.direct([t or "" for _, t in given])):
        want.append((doc_id, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(rows(stages[5])) == sorted(want)
    assert sorted(rows(P.run(spark, SF))) == sorted(want)


def test_every_operator_is_registered():
    names = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in entries.QUERIES)
    assert names == list(range(1, 14))
    import __spark_entry__ as E

    assert set(entries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(entries.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(entries.SQL))
def test_query_matches_duckdb(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in base.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, res = entries.QUERIES[key](spark, SF), con.execute(entries.SQL[key])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert base.digest(df.columns, rows(df)) == base.digest(cols, res.fetchall())


def test_token_query_reads_its_own_files(spark):
    got = sorted(rows(entries.op10_token_output(spark, SF)))
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    assert [r[0] for r in got] == [d for d, _ in docs]
    assert [r[2] - 1 for r in got] == [len(x) for x in test_tokens.direct([t for _, t in docs])]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute.leaks(docs, rows(table(spark, SF, "benchmark")))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in entries.op5_decontamination(spark, SF).collect()} == {
        k: round(v, 9) for k, v in want.items()}


def test_simhash_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in entries.op8_simhash(spark, SF).collect()} == brute.simhash_classes(docs)
