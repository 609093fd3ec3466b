import hashlib
import random
import zlib

import pytest

from refbank.llm import repair as R
from refbank.llm.entries import OP11_SQL, damaged, op11_conversation_repair

KEPT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {2: "user", 3: "assistant"}


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) by tables of
    the cheapest, then ASCII-least edits of every prefix."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    space = " \t\n\x0b\x0c\r"
    for _, role, text in rows:
        body = text.strip(space)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}
    put = lambda t, q, v: t.__setitem__(q, min(v, t.get(q, v)))
    write = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserts(table):
        for _ in range(4):
            for q, (c, e, out) in list(table.items()):
                put(table, write[q], (c + 3, e + "I", [*out, NAMES[write[q]] + ":"]))
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (c, e, out) in inserts(best).items():
            put(after, q, (c + 4, e + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in KEPT[q]:
                    put(after, KEPT[q][role[:1]], (c + more, e + "K", [*out, f"{role}:{text}"]))
                put(after, write[q], (c + 3 + more, e + "R", [*out, f"{NAMES[write[q]]}:{text}"]))
        best = after
    best = inserts(best)
    cost, audit, out = min(v for q, v in best.items() if q in (0, 3))
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", " ", "", "tool", "Alien"]
    texts = ["Hi.", "Well", " ", "Right! ", "So?\n", "x.y", "", "Hi.", "More.", "Yes.", "No.", "Again."]
    return [(rng.choice([None, *range(8)]) if rng.random() < 0.2 else k, rng.choice(roles[:5] if rng.random() < 0.8 else roles),
             rng.choice(texts) + ("" if rng.random() < 0.4 else f"{k}.")) for k in range(n)]


def test_search_against_tables():
    rng = random.Random(1)
    for _ in range(3000):
        kinds = "".join(rng.choice("DsuaxSUAX" if rng.random() < 0.3 else "uauaUAD") for _ in range(rng.randint(0, 12)))
        copies = [rng.randint(1, 3) if k == "D" else 1 for k in kinds]
        got = R.search(kinds, copies, R.START, R.ENDINGS)
        best = {0: (0, "")}
        put = lambda t, q, v: t.__setitem__(q, min(v, t.get(q, v)))
        for k, n in [*zip(kinds, copies), ("", 0)]:
            for _ in range(3):
                for q, (c, e) in list(best.items()):
                    put(best, R.WRITTEN[q], (c + 3, e + "I"))
            if not k:
                break
            after = {}
            for q, (c, e) in best.items():
                put(after, q, (c + 4 * n, e + "D" * n))
                if k != "D":
                    more = 3 * (k.lower() != k)
                    if k.lower() in KEPT[q]:
                        put(after, KEPT[q][k.lower()], (c + more, e + "K"))
                    put(after, R.WRITTEN[q], (c + 3 + more, e + "R"))
            best = after
        cost, audit = min(v for q, v in best.items() if q in (0, 3))
        assert (got[0], got[2] + "I" * (R.ENDINGS[got[1]] // 3)) == (cost, audit)


def _check(spark, convs):
    data = [(c, *r, 1, "x") for c, rows in convs.items() for r in rows]
    random.Random(0).shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, key int, part string")
    done = R.repair(df)
    got = {r.key: tuple(r)[1:] for r in done.conversations.collect()}
    digests = {r.key: r.sha256 for r in done.digests.collect()}
    name = lambda c: "" if c is None else f"={c}"
    assert {k: (*v, digests[k]) for k, v in got.items()} == {name(c): plain(rows) for c, rows in convs.items() if rows}
    return done


@pytest.mark.parametrize("size", [2, 5, 128])
def test_conversations_cut_into_chunks(spark, monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(R, "CHUNK", size)
    convs = {c: random_rows(rng, rng.randint(1, 14)) for c in range(120)}
    convs |= {None: random_rows(rng, 9), 2**60 + 1: random_rows(rng, 60), 7777: [(1, "user", "Same.")] * 50 + [(2, "user", "Same.")] * 3}
    convs[500] = [(k, "user", "Yes." if k % 3 else f"{k}") for k in range(40)]
    convs[501] = [(None, "user", " ")] * 4
    done = _check(spark, convs)
    messages = [m for r in done.messages.collect() if r.key == "=7777" for m in r.messages]
    assert [(m.role, m.text) for m in messages] == [("user", "Same."), ("assistant", "")]


def test_one_long_conversation(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(R, "CHUNK", 16)
    _check(spark, {1: [(k, *r[1:]) for k, r in enumerate(random_rows(rng, 1500))], 2: random_rows(rng, 3)})


def test_empty_table(spark):
    done = R.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.conversations.collect() == [] and done.digests.collect() == [] and done.messages.collect() == []


def test_query_with_nulls_against_sql_and_tables(spark, tmp_dir):
    import duckdb

    rng = random.Random(4)
    data = []
    for c in [None, *range(150), 2**60 + 1]:
        for t in range(rng.randint(1, 7)):
            row = [c, t if rng.random() < 0.95 else None, "user" if t % 2 == 0 else "assistant",
                   rng.choice(["Fine.", "So. Yes", "One.\nTwo! ", "Naïve? Well.", ""]) + str(rng.randint(0, 3)) + rng.choice([".", "", "!"])]
            for k in (2, 3):
                if rng.random() < 0.04:
                    row[k] = None
            data += [tuple(row)] * (2 if rng.random() < 0.03 else 1)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df.write.parquet(tmp_dir + "/conversations.parquet")
    rows = op11_conversation_repair(spark, tmp_dir)
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in rows.collect()), key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_dir}/conversations.parquet/*.parquet'")
    sql = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({OP11_SQL})").fetchall()
    assert got == sorted(sql, key=key)
    convs = {}
    for c, t, role, text in data:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        convs.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * ((kind != 0) + (kind == 3)))
    want = [(c, *(plain(rows) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))) for c, rows in convs.items()]
    assert got == sorted(want, key=key)
    assert damaged(df).columns == ["conv_id", "turn", "role", "text"]
