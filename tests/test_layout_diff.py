"""Layout signatures / compatibility and the table diff."""

from refbank.operators import diff as D
from refbank.operators import layout as LY

CELLS = "workbook_id long, sheet string, row long, col long, value string"


def test_same_workbook_same_signature(spark):
    c = spark.createDataFrame([(1, "S", 1, 1, "a"), (1, "S", 2, 2, "b"), (2, "S", 1, 1, "a"), (2, "S", 2, 2, "b")], CELLS)
    sig = {r.workbook_id: r.signature for r in LY.template_profile(c).collect()}
    assert sig[1] == sig[2]
    pairs = spark.createDataFrame([(1, 2)], "x long, y long")
    r = LY.layout_compat(c, pairs).first()
    assert (r.compatibility, r.score) == ("exact", 1.0)


def test_similarity_and_missing_sheets(spark):
    c = spark.createDataFrame([
        (1, "S", 1, 1, "a"), (1, "S", 1, 2, "b"), (1, "S", 2, 1, "c"), (1, "T", 1, 1, "t"),
        (2, "S", 3, 3, "x"), (2, "S", 3, 4, "y"), (2, "S", 5, 5, "z"), (2, "U", 1, 1, "u")], CELLS)
    pairs = spark.createDataFrame([(1, 2)], "x long, y long")
    sims = {r.sheet: (r.reason, r.occupancy_jaccard, r.score) for r in LY.layout_similarity(c, pairs).collect()}
    # S: base {(0,0),(0,1),(1,0)} cand {(0,0),(0,1),(2,2)} -> 2/4
    assert sims["S"][0] == "compared" and sims["S"][1] == 0.5
    assert sims["T"] == ("missing_in_candidate", None, 0.0)
    assert sims["U"] == ("missing_in_base", None, 0.0)
    r = LY.layout_compat(c, pairs).first()
    assert r.compatibility == "incompatible" and r.hard_mismatch
    assert LY.layout_routing(LY.layout_compat(c, pairs)).first().route == "learn"


def test_sheets_without_cells(spark):
    c = spark.createDataFrame([(1, "Notes", 1, 1, " "), (1, "S", 1, 1, "a"), (2, "Notes", 4, 2, None), (2, "S", 7, 7, "b"),
                               (3, "S", 1, 1, "a"), (4, "Notes", 2, 2, "")], CELLS)
    lay = {(r.workbook_id, r.sheet): (r.occupied_count, r.min_row) for r in LY.sheet_layout(c).collect()}
    assert lay[1, "Notes"] == (0, None) and lay[2, "S"] == (1, 7) and len(lay) == 6
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "x long, y long")
    sims = {(r.y, r.sheet): (r.reason, r.occupancy_jaccard, r.score) for r in LY.layout_similarity(c, pairs).collect()}
    # empty on both sides is the same layout; a sheet that is not there is none
    assert sims[2, "Notes"] == ("compared", 1.0, 1.0) and sims[3, "Notes"] == ("missing_in_candidate", None, 0.0)
    assert sims[4, "Notes"] == ("compared", 1.0, 1.0) and sims[4, "S"] == ("missing_in_candidate", None, 0.0)
    got = {r.y: (r.compatibility, r.score) for r in LY.layout_compat(c, pairs).collect()}
    assert got == {2: ("compatible", 1.0), 3: ("incompatible", 0.5), 4: ("incompatible", 0.5)}
    prof = {r.workbook_id: (r.n_sheets, r.n_cells, r.n_hashed) for r in LY.template_profile(c).collect()}
    assert prof == {1: (2, 1, 1), 2: (2, 1, 1), 3: (1, 1, 1), 4: (1, 0, 0)}


def test_profile_depends_on_every_cell_but_not_on_rows(spark):
    rows = [(1, "S", r, k, f"{r}-{k}") for r in range(1, 40) for k in range(1, 9)]
    sig = lambda data: LY.template_profile(spark.createDataFrame(data, CELLS).repartition(5)).first().signature
    base = sig(rows)
    assert sig(rows[::-1]) == base
    assert len({base, sig(rows[1:]), sig([(1, "S", 1, 1, "1-2"), *rows[1:]]), sig([(1, "T", *rows[0][2:]), *rows[1:]]),
                sig([(1, "S", 1, 1, "1-2"), (1, "S", 1, 2, "1-1"), *[x for x in rows if x[2:4] not in ((1, 1), (1, 2))]])}) == 5


def test_diff_normalisation(spark):
    gen = spark.createDataFrame([(1, " test ", 1.001), (2, "b", 1.0)], "k long, s string, v double")
    bench = spark.createDataFrame([(1, "test", 1.00), (2, "b", 9.0)], "k long, s string, v double")
    got = [(r.k, r.column, r.generated, r.benchmark) for r in D.data_diff(gen, bench, "k").collect()]
    assert got == [(2, "v", "1.0", "9.0")]
    assert D.tables_equal(gen, bench, "k").first().match is False
    assert D.tables_equal(gen.where("k = 1"), bench.where("k = 1"), "k").first().match is True
    assert D.schema_diff(gen.select("k", "v", "s"), bench)


def test_repeated_and_null_keys_equal_themselves(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (1, "a", 1.0), (None, "c", 3.0), (None, None, None), (2, "d", float("nan"))]
    t = spark.createDataFrame(rows, "k long, s string, v double")
    assert D.data_diff(t, t, "k").collect() == [] and D.tables_equal(t, t, "k").first().match is True
    less = spark.createDataFrame(rows[1:], "k long, s string, v double")
    got = sorted(map(str, D.data_diff(less, t, "k").collect()))
    assert got == sorted(map(str, spark.createDataFrame(
        [(1, "s", "b", "a"), (1, "v", "2.0", "1.0"), (1, "__row__", None, "present")], "k long, column string, generated string, benchmark string").collect()))


def test_positional_diff(spark):
    gen = spark.createDataFrame([(k, f" n{k % 3} ", k / 3) for k in range(200)], "line long, s string, v double").repartition(7)
    same = spark.createDataFrame([(2 * k, f"n{k % 3}", round(k / 3, 2)) for k in range(200)], "line long, s string, v double")
    assert D.tables_equal(gen, same, gen_order=["line"]).first().match is True
    moved = same.where("line <> 20")
    got = {(r.row, r.column): (r.generated, r.benchmark) for r in D.positional_diff(gen, moved, ["line"], ["line"]).collect()}
    assert min(r for r, _ in got) == 10 and got[199, "__row__"] == ("present", None) and got[10, "s"] == ("n1", "n2")
    assert len(got) == 2 * 189 + 1
    # rows without an order of their own are ordered by their values
    t = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "line long, s string")
    assert D.positional_diff(t, t.repartition(3), ["line"], ["line"]).collect() == []
    assert [r.row for r in D.positional_diff(t, t.limit(0), ["line"], ["line"]).orderBy("row").collect()] == [0, 1, 2]


def test_layout_search_against_all_pairs(spark):
    import random

    from refbank.operators import layout_search as LS

    rng = random.Random(6)
    books = {}
    for k in range(60):
        base = books[rng.randrange(k)] if k and rng.random() < 0.8 else {}
        book = {s: set(c) for s, c in base.items()}
        book.setdefault("Cover", {(r, 1) for r in range(1, 6)})  # every workbook has it
        for s in rng.sample(["A", "B", "C"], rng.randint(0, 2)):
            if rng.random() < 0.15:
                book[s] = set()  # a sheet of blank cells
            else:
                cells = book.get(s) or {(rng.randint(1, 6), rng.randint(1, 5)) for _ in range(rng.randint(1, 12))}
                book[s] = (cells - set(rng.sample(sorted(cells), min(1, len(cells) - 1)))) | {(rng.randint(1, 7), rng.randint(1, 6))}
        books[k] = book
    rows = [(k, s, r, c, "v") for k, b in books.items() for s, cells in b.items() for r, c in cells]
    rows += [(k, s, 1, 1, " ") for k, b in books.items() for s, cells in b.items() if not cells]

    def norm(cells):
        r0, c0 = min((r for r, _ in cells), default=0), min((c for _, c in cells), default=0)
        return frozenset((r - r0, c - c0) for r, c in cells)

    forms = {k: {s: norm(c) for s, c in b.items()} for k, b in books.items()}
    first = {}
    for k in sorted(forms):
        first.setdefault(tuple(sorted((s, tuple(sorted(c))) for s, c in forms[k].items())), k)
    cls = {k: first[tuple(sorted((s, tuple(sorted(c))) for s, c in f.items()))] for k, f in forms.items()}

    def size(c, i):
        return max((x[i] for x in c), default=0)

    def score(x, y):
        total = 0.0
        for s in set(x) & set(y):
            jac = len(x[s] & y[s]) / len(x[s] | y[s]) if x[s] | y[s] else 1.0
            gaps = [abs(size(x[s], i) - size(y[s], i)) / (max(size(x[s], i), size(y[s], i)) or 1) for i in (0, 1)]
            total += 0.8 * jac + 0.2 * max(0.0, 1 - sum(gaps) / 2)
        return total / len(set(x) | set(y))

    reps = sorted(set(cls.values()))
    want = {(x, y): round(score(forms[x], forms[y]), 4) for x in reps for y in reps if x < y and score(forms[x], forms[y]) >= 0.78 - 1e-12}
    cells = spark.createDataFrame(rows, CELLS).repartition(4)
    assert {r.workbook_id: r.class_id for r in LS.layout_classes(cells).collect()} == cls
    got = {(r.x, r.y): r.score for r in LS.compatible_layouts(cells).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-3 for p in want) and len(want) > 5
    assert LS.compatible_layouts(cells.limit(0)).collect() == []


def test_profile_is_over_the_ordered_sequence_of_sheets_and_cells(spark):
    import hashlib

    c = spark.createDataFrame([(1, "T", 2, 10, "d"), (1, "T", 2, 9, "c"), (1, "S", 11, 2, "b"), (1, "S", 2, 2, " a ")], CELLS)
    framed = lambda *xs: "".join(f"{len(str(x))}:{x}" for x in xs)
    digest = {r.sheet: r.occupied_digest for r in LY.sheet_layout(c).collect()}
    sheets = ";".join([framed("S", 11, 2, 2, 11, 2, 2, 2, digest["S"]), framed("T", 2, 10, 2, 2, 9, 10, 2, digest["T"])])
    cells = "".join(hashlib.md5(framed(*x).encode()).hexdigest() for x in (("S", "B2", "a"), ("S", "B11", "b"), ("T", "I2", "c"), ("T", "J2", "d")))
    got = LY.template_profile(c.repartition(3)).first()
    assert got.signature == hashlib.sha256(f"{sheets}#{cells}".encode()).hexdigest() and got.n_hashed == 4
