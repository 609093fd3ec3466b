"""Worksheet cells, schema bindings and formula protection.

``cells(workbook_id, sheet, row, col, value)`` is the contract for any
spreadsheet; schema fields arrive flat as
``(tpl, field, rel, r0, c0, dr, dc[, name])`` (absolute cell when ``r0`` /
``c0`` are set, otherwise relative to field ``rel``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.session import scratch_path


def collect_cells(cells: DataFrame) -> DataFrame:
    """Non-empty cells (after normalisation) with their A1 reference."""
    v = S.normalize_value(F.col("value"))
    return (cells.withColumn("value", v).where(F.col("value") != "")
            .withColumn("cell", S.a1(F.col("row"), F.col("col"))))


def sheet_extents(cells: DataFrame) -> DataFrame:
    """Used extents per sheet (max row / column of any non-empty cell)."""
    return (collect_cells(cells).groupBy("workbook_id", "sheet")
            .agg(F.max("row").alias("max_row"), F.max("col").alias("max_col")))


def cell_neighbors(cells: DataFrame) -> DataFrame:
    """Up / down / left / right coordinates inside the sheet extents."""
    c = collect_cells(cells).join(sheet_extents(cells), ["workbook_id", "sheet"])
    r, k = F.col("row"), F.col("col")
    return c.select(
        "workbook_id", "sheet", "row", "col", "cell",
        F.when(r > 1, S.a1(r - 1, k)).alias("up"),
        F.when(r < F.col("max_row"), S.a1(r + 1, k)).alias("down"),
        F.when(k > 1, S.a1(r, k - 1)).alias("left"),
        F.when(k < F.col("max_col"), S.a1(r, k + 1)).alias("right"))


def formula_cells(cells: DataFrame, expand_ranges: bool = False) -> DataFrame:
    """Every formula cell with its dependencies.

    Default matches the reference (a range yields its endpoints); with
    ``expand_ranges`` every cell of ``A1:B3`` style ranges is listed (Q6).
    """
    f = cells.where(S.is_formula(F.col("value")))
    f = f.withColumn("cell", S.a1(F.col("row"), F.col("col")))
    f = f.withColumn("depends_on", S.formula_dependencies(F.col("value")))
    if expand_ranges:
        f = f.withColumn("depends_on", expand_formula_ranges(F.col("value")))
    return f.select("workbook_id", "sheet", "row", "col", "cell", F.col("value").alias("formula"),
                    "depends_on")


def expand_formula_ranges(formula) -> F.Column:
    """All cells referenced by a formula with ``X1:Y9`` ranges expanded."""
    body = F.regexp_replace(F.regexp_replace(formula, "^=", ""), "[$]", "")
    ranges = F.regexp_extract_all(body, F.lit("[A-Z]+[0-9]+(?::[A-Z]+[0-9]+)?"), 0)

    def expand(rng):
        a = F.split(rng, ":")
        lo, hi = F.element_at(a, 1), F.coalesce(F.try_element_at(a, F.lit(2)), F.element_at(a, 1))
        r1, r2 = S.cell_row(lo), S.cell_row(hi)
        c1, c2 = S.cell_col(lo), S.cell_col(hi)
        rows = F.sequence(F.least(r1, r2), F.greatest(r1, r2))
        cols = F.sequence(F.least(c1, c2), F.greatest(c1, c2))
        return F.flatten(F.transform(cols, lambda c: F.transform(rows, lambda r: S.a1(r, c))))

    return F.flatten(F.transform(ranges, expand))


def resolve_bindings(fields: DataFrame) -> DataFrame:
    """Field -> cell for absolute fields and chains of relative ones.

    Pointer doubling: every relative field holds a pointer up its chain with
    the offset between both and the smallest row / column offset on the way
    (a chain that leaves the sheet anywhere drops out, with all that hangs on
    it).  Each round joins pointers with pointers, so a chain of n fields is
    resolved in log2(n) rounds, of any length.  A pointer into a cycle never
    reaches an absolute field; after log2(number of relative fields) rounds
    only such pointers are left.  Unknown anchors drop out.  Each round is a
    stored table.  Returns (tpl, field, row, col, depth, cell).
    """
    spark = fields.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "bindings")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    absolute = fields.where(F.col("r0").isNotNull() & F.col("c0").isNotNull())
    done = absolute.select("tpl", "field", F.col("r0").cast("long").alias("row"), F.col("c0").cast("long").alias("col"),
                           F.lit(0).cast("long").alias("depth"))
    dr, dc = F.coalesce(F.col("dr"), F.lit(0)).cast("long"), F.coalesce(F.col("dc"), F.lit(0)).cast("long")
    seeds = done.select("tpl", F.col("field").alias("to"), F.col("row").alias("r"), F.col("col").alias("c"))
    first = (fields.where((F.col("r0").isNull() | F.col("c0").isNull()) & F.col("rel").isNotNull())
             .select("tpl", "field", F.col("rel").alias("to"), dr.alias("dr"), dc.alias("dc"),
                     dr.alias("low_r"), dc.alias("low_c"), F.lit(1).cast("long").alias("steps")))
    ends = seeds.select("tpl", "to").distinct().withColumn("end", F.lit(True))
    chain = stored(first.join(ends, ["tpl", "to"], "left").withColumn("end", F.coalesce("end", F.lit(False))))
    for _ in range(max(1, chain.count()).bit_length() + 1):
        rest = chain.where(~F.col("end"))
        if rest.isEmpty():
            break
        up = chain.select("tpl", F.col("field").alias("to"), F.col("to").alias("up"), F.col("dr").alias("ur"),
                          F.col("dc").alias("uc"), F.col("low_r").alias("ulr"), F.col("low_c").alias("ulc"),
                          F.col("steps").alias("us"), F.col("end").alias("uend"))
        longer = rest.join(up, ["tpl", "to"]).select(
            "tpl", "field", F.col("up").alias("to"), (F.col("ur") + F.col("dr")).alias("dr"), (F.col("uc") + F.col("dc")).alias("dc"),
            F.least("ulr", F.col("ur") + F.col("low_r")).alias("low_r"), F.least("ulc", F.col("uc") + F.col("low_c")).alias("low_c"),
            (F.col("us") + F.col("steps")).alias("steps"), F.col("uend").alias("end"))
        chain = stored(chain.where("end").select(*longer.columns).unionByName(longer))
    hung = (chain.where("end").join(seeds, ["tpl", "to"])
            .where((F.col("r") + F.col("low_r") > 0) & (F.col("c") + F.col("low_c") > 0))
            .select("tpl", "field", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"),
                    F.col("steps").alias("depth")))
    return done.unionByName(hung).withColumn("cell", S.a1(F.col("row"), F.col("col")))


def bind_values(bindings: DataFrame, data: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Value for each binding by field key, else by ``spec.name``.

    ``data(tpl, field, value)``: presence of the key counts, even with a null
    value.  ``names(tpl, field, name)`` optional legacy names."""
    by_key = data.select("tpl", "field", F.col("value").alias("v_key"), F.lit(True).alias("has_key"))
    b = bindings.join(by_key, ["tpl", "field"], "left")
    if names is not None:
        by_name = (data.select("tpl", F.col("field").alias("name"), F.col("value").alias("v_name"),
                               F.lit(True).alias("has_name")))
        b = (b.join(names, ["tpl", "field"], "left").join(by_name, ["tpl", "name"], "left"))
        present = F.coalesce(F.col("has_key"), F.col("has_name"), F.lit(False))
        value = F.when(F.col("has_key"), F.col("v_key")).otherwise(F.col("v_name"))
    else:
        present = F.coalesce(F.col("has_key"), F.lit(False))
        value = F.col("v_key")
    return b.where(present).select("tpl", "field", "cell", "row", "col", value.alias("value"))


def formula_conflicts(bindings: DataFrame, template_cells: DataFrame, data: DataFrame,
                      strict_reference: bool = False) -> tuple[DataFrame, DataFrame]:
    """J9 + U4: fields bound to a formula cell of the template and present in
    the data are reported, and removed from the data.

    ``template_cells(tpl, row, col, value[, sheet])`` is the sheet written to;
    by default the check uses the *resolved* binding (Q5).  With
    ``strict_reference`` only fields whose spec names a raw upper-case
    ``cell`` count (``bindings`` then needs ``raw_cell``), matched against
    formula coordinates of any sheet, as the original check did.
    Returns (conflicts, cleaned).
    """
    formulas = template_cells.where(S.is_formula(F.col("value"))).select("tpl", "row", "col").distinct()
    present = data.select("tpl", "field").distinct()
    if strict_reference:
        bindings = (bindings.where(F.col("raw_cell").isNotNull() & S.is_cell_ref(F.col("raw_cell"))
                                   & (F.col("raw_cell") == F.upper(F.col("raw_cell"))))
                    .withColumn("row", S.cell_row(F.col("raw_cell")))
                    .withColumn("col", S.cell_col(F.col("raw_cell")))
                    .withColumn("cell", F.col("raw_cell")))
    conflicts = (bindings.join(formulas, ["tpl", "row", "col"], "left_semi")
                 .join(present, ["tpl", "field"], "left_semi")
                 .select("tpl", "field", "cell"))
    cleaned = data.join(conflicts.select("tpl", "field"), ["tpl", "field"], "left_anti")
    return conflicts, cleaned


def fill_template(template_cells: DataFrame, assignments: DataFrame) -> DataFrame:
    """Template cells full-outer-joined with assignments; a present
    assignment wins (even a null value), untouched cells survive."""
    t = template_cells.select("tpl", "row", "col", F.col("value").alias("t_value"))
    a = assignments.select("tpl", "row", "col", F.col("value").alias("a_value"), F.lit(True).alias("assigned"))
    return (t.join(a, ["tpl", "row", "col"], "full_outer")
            .select("tpl", "row", "col", S.a1(F.col("row"), F.col("col")).alias("cell"),
                    F.when(F.col("assigned"), F.col("a_value")).otherwise(F.col("t_value")).alias("value"),
                    F.coalesce(F.col("assigned"), F.lit(False)).alias("filled")))


def missing_fields(schema: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per input the schema fields absent as keys from the
    extracted record (a null value counts as present).

    ``schema(template_id, field)``, ``extracted(input_id, template_id, field,
    value)``; inputs come from ``extracted``'s keys plus ``inputs`` if given.
    """
    keys = extracted.select("input_id", "template_id").distinct()
    expected = keys.join(schema, "template_id")
    return (expected.join(extracted.select("input_id", "field").distinct(), ["input_id", "field"], "left_anti")
            .select("input_id", "template_id", "field"))
