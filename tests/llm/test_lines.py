import hashlib
from collections import defaultdict

from refbank.llm import lines as L

LONG = "this line is well over forty code points long, number "
SCHEMA = "doc_id long, text string, key string, keys int"


def docs():
    out = [(i, f"  {LONG}1 \nunique {i} {'u' * 40}\nshort", "k", 0) for i in range(6)]
    out += [(i, f"{(LONG + '1').upper()}\r\n{LONG}2", None, 0) for i in range(6, 9)]
    out += [(i, f"{LONG}2\n{LONG}2\n\n", "k", 0) for i in range(9, 12)]
    out += [(12, None, "k", 1), (13, "", "k", 1), (14, "é" * 39 + "\n" + "é" * 40, "k", 1)]
    out += [(i, "é" * 39 + "\n" + "é" * 40 + "\t", "k", 1) for i in range(15, 20)]
    out += [(30, "w" * 50 + "\n" + "\n".join(f"{LONG}x{j}" for j in range(3000)), "k", 2)]
    return out


def brute(rows, min_docs=5):
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, ls in split:
        for x in ls:
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    out = []
    for i, ls in split:
        kept = [x for x in ls if len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def result(index, df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in index.dedupe(df).collect())


def test_matches_brute_force(spark):
    df = spark.createDataFrame(docs(), SCHEMA).repartition(4)
    got = result(L.LineIndex(spark).insert(df), df)
    assert got == brute(docs())
    assert sum(r[2] for r in got) > 15


def test_insert_and_delete_are_reversible(spark):
    first, more = docs(), [(40 + i, f"{LONG}2\n{LONG}3\nunique {3} {'u' * 40}", "k", 0) for i in range(6)]
    a, b = spark.createDataFrame(first, SCHEMA), spark.createDataFrame(more, SCHEMA)
    index = L.LineIndex(spark).insert(a)
    both = index.insert(b).insert(b)  # inserting again counts nothing twice
    assert result(both, a.unionByName(b)) == brute(first + more)
    back = both.delete(b.select("doc_id"))
    counts = lambda x: sorted((bytes(r.key), r.n_docs, r.keeper) for r in x.counts.collect())
    keys = lambda x: sorted((r.shard, sorted(L.np.frombuffer(r.slots, "<u2")[L.np.frombuffer(r.slots, "<u2") > 0].tolist())) for r in x.filters.collect())
    assert counts(back) == counts(index) and keys(back) == keys(index)
    assert result(back, a) == brute(first)


def test_many_shards_and_passes_give_the_same_result(spark, monkeypatch):
    df = spark.createDataFrame(docs(), SCHEMA)
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    monkeypatch.setattr(L, "PASS_BYTES", 1)
    index = L.LineIndex(spark).insert(df)
    assert index.n_shards >= 3 and result(index, df) == brute(docs())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, LONG + "1", "k", 0)] * 6 + [(None, LONG + "1", "k", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.n_dropped for r in L.LineIndex(spark).insert(df).dedupe(df).collect()] == [0] * 7
    none = spark.createDataFrame([], SCHEMA)
    assert L.LineIndex(spark).insert(none).dedupe(none).collect() == []
    assert all(r.n_dropped == 0 for r in L.LineIndex(spark).insert(none).dedupe(df).collect())


def test_cuckoo_filter():
    f, rng = L.Cuckoo(64), L.np.random.default_rng(0)
    items = list(zip(rng.integers(0, 2**32, 150, dtype=L.np.uint32).tolist(), rng.integers(1, 65536, 150).tolist()))
    assert all(f.insert(b, x) for b, x in items)
    b, x = (L.np.array(c, t) for c, t in zip(zip(*items), (L.np.uint32, L.np.uint16)))
    assert L.contains(f.slots, 64, L.np.zeros(150, int), b, x).all()
    assert all(f.delete(b, x) for b, x in items) and not f.slots.any()
    full = L.Cuckoo(2)
    assert not all(full.insert(i, i + 1) for i in range(20))


def test_large_ids_beside_null_ids(spark):
    line = "a line that is long enough to be counted as a key"
    ids = [2**60 + 1, 2**60 + 2, None, 2**53 + 1, 5, 2**60 + 3]
    df = spark.createDataFrame([(i, f"{line}\nown {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    from refbank.llm.lines import LineIndex

    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in LineIndex(spark, min_chars=40, min_docs=5).insert(df).dedupe(df).collect()}
    assert got == {i: (2, 0 if i == 2**60 + 3 else 1) for i in ids}
