"""Bindings, formula protection, template filling, missing fields."""

from refbank.operators import cells as C
from refbank.sources import bank_io as IO

FIELDS = "tpl string, field string, rel string, r0 long, c0 long, dr long, dc long"


def test_relative_chain(spark):
    f = spark.createDataFrame([("t", "A", None, 2, 2, 0, 0), ("t", "B", "A", None, None, 1, 0),
                               ("t", "C", "B", None, None, 0, 1), ("t", "D", "X", None, None, 0, 1),
                               ("t", "E", "A", None, None, -5, 0), ("t", "G", "E", None, None, 1, 0),
                               ("t", "P", "Q", None, None, 1, 0), ("t", "Q", "P", None, None, 1, 0)], FIELDS)
    got = {r.field: r.cell for r in C.resolve_bindings(f).collect()}
    assert got == {"A": "B2", "B": "B3", "C": "C3"}


def test_chain_of_any_length(spark):
    n = 300
    rows = [("t", "F0", None, 5, 5, 0, 0)] + [("t", f"F{i}", f"F{i - 1}", None, None, 1 if i % 2 else -1, i % 3 - 1) for i in range(1, n)]
    rows += [("t", "U", "F7", None, None, -9, 0), ("t", "V", "U", None, None, 20, 0)]  # U leaves the sheet, V hangs on it
    row = col = 5
    want = {"F0": (5, 5)}
    alive = True
    for i in range(1, n):
        row, col = row + (1 if i % 2 else -1), col + i % 3 - 1
        alive = alive and row > 0 and col > 0
        if alive:
            want[f"F{i}"] = (row, col)
    got = {r.field: (r.row, r.col) for r in C.resolve_bindings(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == want and len(want) == n


def test_schema_json_new_and_legacy(spark):
    docs = spark.createDataFrame([
        ("new", '{"fields": {"A": {"cell": "b2"}, "B": {"relative_to": "A", "row_offset": 1}, '
                '"C": {"address": "C9"}, "bad": "text"}}'),
        ("old", '{"A2": {"name": "Field1"}, "meta": {"x": 1}, "notacell": {"name": "n"}}')],
        "tpl string, value string")
    f = IO.schema_fields_from_json(docs)
    got = {(r.tpl, r.field): (r.rel, r.r0, r.c0, r.name) for r in f.collect()}
    assert got == {("new", "A"): (None, 2, 2, None), ("new", "B"): ("A", None, None, None),
                   ("new", "C"): (None, 9, 3, None), ("old", "A2"): (None, 2, 1, "Field1")}
    cells = {r.field: r.cell for r in C.resolve_bindings(f).collect()}
    assert cells["B"] == "B3" and cells["A2"] == "A2"


def test_formula_conflict_and_fill(spark):
    b = spark.createDataFrame([("t", "Field_A", 2, 1, "A2"), ("t", "Field_B", 7, 3, "C7"),
                               ("t", "Field_C", 6, 4, "D6")],
                              "tpl string, field string, row long, col long, cell string")
    cells = spark.createDataFrame([("t", 7, 3, "=MAX(C4:C6)"), ("t", 1, 1, "Header"), ("t", 8, 3, "=C7*2")],
                                  "tpl string, row long, col long, value string")
    data = spark.createDataFrame([("t", "Field_A", "x"), ("t", "Field_B", "y")], "tpl string, field string, value string")
    conf, cleaned = C.formula_conflicts(b, cells, data)
    assert [(r.field, r.cell) for r in conf.collect()] == [("Field_B", "C7")]
    assert sorted(r.field for r in cleaned.collect()) == ["Field_A"]
    filled = {r.cell: (r.value, r.filled) for r in C.fill_template(cells, C.bind_values(b, cleaned)).collect()}
    assert filled == {"A1": ("Header", False), "A2": ("x", True), "C7": ("=MAX(C4:C6)", False),
                      "C8": ("=C7*2", False)}


def test_legacy_name_binding(spark):
    b = spark.createDataFrame([("t", "A2", 2, 1, "A2")], "tpl string, field string, row long, col long, cell string")
    names = spark.createDataFrame([("t", "A2", "Field1")], "tpl string, field string, name string")
    data = spark.createDataFrame([("t", "Field1", None)], "tpl string, field string, value string")
    got = C.bind_values(b, data, names).collect()
    assert [(r.cell, r.value) for r in got] == [("A2", None)]   # present key with null value still writes


def test_missing_fields_counts_null_as_present(spark):
    schema = spark.createDataFrame([("t", "Field_A"), ("t", "Field_B")], "template_id string, field string")
    ex = spark.createDataFrame([(1, "t", "Field_A", None)], "input_id long, template_id string, field string, value string")
    got = [(r.input_id, r.field) for r in C.missing_fields(schema, ex).collect()]
    assert got == [(1, "Field_B")]


def test_formula_cells_and_neighbors(spark):
    cells = spark.createDataFrame([(1, "S", 1, 1, "a"), (1, "S", 7, 3, "=MAX(C4:C6)*A1"), (1, "S", 2, 2, " ")],
                                  "workbook_id long, sheet string, row long, col long, value string")
    f = C.formula_cells(cells).first()
    assert (f.cell, f.depends_on) == ("C7", ["C4", "C6", "A1"])
    fx = C.formula_cells(cells, expand_ranges=True).first()
    assert fx.depends_on == ["C4", "C5", "C6", "A1"]
    n = {r.cell: (r.up, r.down, r.left, r.right) for r in C.cell_neighbors(cells).collect()}
    assert n == {"A1": (None, "A2", None, "B1"), "C7": ("C6", None, "B7", None)}


def test_check_formulas_range_join(spark):
    from refbank.operators import cells as C2
    from refbank.operators import validate as V
    cells = spark.createDataFrame([(1, "S", 7, 3, "=MAX(C4:C6)+A1"), (1, "S", 9, 1, "=SUM(A1:Z100000)"),
                                   (2, "S", 1, 1, "=B700"), (1, "T", 7, 3, "=MAX(C4:C6)+A1")],
                                  "workbook_id long, sheet string, row long, col long, value string")
    nums = spark.createDataFrame([(1, "S", 4, 3, 1.0), (1, "S", 5, 3, 2.0), (1, "S", 6, 3, 3.0), (1, "S", 1, 1, 10.0), (1, "S", 7, 3, 16.0),
                                  (1, "S", 99999, 26, 5.0), (1, "S", 9, 1, 31.0), (2, "S", 700, 2, 7.0), (2, "S", 1, 1, 7.0),
                                  (1, "T", 4, 3, 8.0), (1, "T", 7, 3, 8.0)],
                                 "workbook_id long, sheet string, row long, col long, num double")
    got = {(r.workbook_id, r.sheet, r.cell): (r.expected, r.target, r.consistent)
           for r in V.check_formulas(C2.formula_cells(cells), nums).collect()}
    assert got[(1, "S", "C7")] == (16.0, 16.0, True)
    # the huge range covers every number of workbook 1, its own cell A9 included
    assert got[(1, "S", "A9")][0] == 1.0 + 2.0 + 3.0 + 10.0 + 16.0 + 5.0 + 31.0
    assert got[(2, "S", "A1")] == (7.0, 7.0, True)
    # the same formula on another sheet sums that sheet
    assert got[(1, "T", "C7")] == (8.0, 8.0, True)


def test_cell_falls_back_to_address_and_strict_conflicts(spark):
    docs = spark.createDataFrame([("t", '{"fields": {"A": {"cell": "", "address": "G3"}, "B": {"cell": "g3"}}}')],
                                 "tpl string, value string")
    f = IO.schema_fields_from_json(docs)
    b = C.resolve_bindings(f)
    got = {r.field: r.cell for r in b.collect()}
    assert got == {"A": "G3", "B": "G3"}
    cells = spark.createDataFrame([("t", 3, 7, "=MIN(G5:G9)")], "tpl string, row long, col long, value string")
    data = spark.createDataFrame([("t", "A", "x"), ("t", "B", "y")], "tpl string, field string, value string")
    conf, _ = C.formula_conflicts(b, cells, data)
    assert sorted(r.field for r in conf.collect()) == ["A", "B"]
    # the original check only saw a raw upper-case `cell`: neither field qualifies
    raw = b.join(spark.createDataFrame([("t", "A", None), ("t", "B", "g3")], "tpl string, field string, raw_cell string"),
                 ["tpl", "field"])
    strict, _ = C.formula_conflicts(raw, cells, data, strict_reference=True)
    assert strict.count() == 0
