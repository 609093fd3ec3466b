"""Checks declared by the reference's specs: value types, formula
consistency, uniqueness, and a template catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refbank.functions import scalars as S

# a decimal number, thousands separated by commas or not at all
NUMBER_PATTERN = ("^[+-]?([0-9]+([.][0-9]*)?|[0-9]{1,3}(,[0-9]{3})+([.][0-9]*)?|[.][0-9]+)"
                  "([eE][+-]?[0-9]+)?$")
DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"   # fixed value: YYYY-MM-DD


def validate_types(values: DataFrame) -> DataFrame:
    """``values(input_id, field, value, type)`` with type in
    {string, number, date}; adds ``valid``."""
    v = F.col("value")
    num = F.when(S.py_strip(v).rlike(NUMBER_PATTERN), F.lit(1))
    date = F.when(v.rlike(DATE_PATTERN), F.expr("try_to_timestamp(value, 'yyyy-MM-dd')"))
    ok = (F.when(F.col("type") == "number", num.isNotNull())
          .when(F.col("type") == "date", date.isNotNull())
          .otherwise(F.coalesce(S.py_strip(v) != "", F.lit(False))))
    return values.withColumn("valid", F.coalesce(ok, F.lit(False)))


def formula_rectangles(formulas: DataFrame) -> DataFrame:
    """Each referenced cell or ``X1:Y9`` range of a formula as a rectangle
    ``(r1, r2, c1, c2)`` (a single reference is 1 x 1)."""
    body = F.regexp_replace(F.regexp_replace(F.col("formula"), "^=", ""), "[$]", "")
    toks = F.regexp_extract_all(body, F.lit("[A-Z]+[0-9]+(?::[A-Z]+[0-9]+)?"), 0)
    t = formulas.select("workbook_id", "sheet", "cell", "row", "col", F.posexplode(toks).alias("k", "tok"))
    parts = F.split(F.col("tok"), ":")
    lo = F.element_at(parts, 1)
    hi = F.coalesce(F.try_element_at(parts, F.lit(2)), lo)
    return t.select("workbook_id", "sheet", "cell", "row", "col", "k",
                    F.least(S.cell_row(lo), S.cell_row(hi)).alias("r1"),
                    F.greatest(S.cell_row(lo), S.cell_row(hi)).alias("r2"),
                    F.least(S.cell_col(lo), S.cell_col(hi)).alias("c1"),
                    F.greatest(S.cell_col(lo), S.cell_col(hi)).alias("c2"))


def check_formulas(formulas: DataFrame, nums: DataFrame, tol: float = 1e-6,
                   block_rows: int = 256) -> DataFrame:
    """For each formula cell, the sum of the numbers inside its referenced
    cells / ranges against the number stored at the formula cell.

    Range join without enumerating empty cells: a rectangle is exploded over
    row *blocks* of ``block_rows`` rows, joined to the numeric cells of the
    same (workbook, sheet, block) and filtered to its exact bounds, so the work
    follows the non-empty cells, not the range area.  A cell named twice is
    counted twice, as the formula would.
    References without a sheet name mean the formula's own sheet.
    ``formulas`` from :func:`formula_cells`; ``nums(workbook_id, sheet, row, col, num)``.
    """
    rect = formula_rectangles(formulas)
    rect = rect.withColumn("blk", F.explode(F.sequence(F.floor(F.col("r1") / block_rows),
                                                       F.floor(F.col("r2") / block_rows))))
    n = nums.select("workbook_id", "sheet", F.floor(F.col("row") / block_rows).alias("blk"),
                    F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("num").alias("v"))
    hits = (rect.join(n, ["workbook_id", "sheet", "blk"])
            .where(F.col("nr").between(F.col("r1"), F.col("r2")) & F.col("nc").between(F.col("c1"), F.col("c2"))))
    expected = (formulas.select("workbook_id", "sheet", "cell", "row", "col")
                .join(hits.groupBy("workbook_id", "sheet", "cell").agg(F.sum("v").alias("s")),
                      ["workbook_id", "sheet", "cell"], "left")
                .withColumn("expected", F.coalesce(F.col("s"), F.lit(0.0))))
    target = nums.select("workbook_id", "sheet", "row", "col", F.col("num").alias("target"))
    out = expected.join(target, ["workbook_id", "sheet", "row", "col"], "left")
    return out.select("workbook_id", "sheet", "cell", "expected", "target",
                      F.coalesce(F.abs(F.col("expected") - F.col("target")) <= tol, F.lit(False)).alias("consistent"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """D3: identifiers that occur on more than one row (partial aggregation)."""
    return df.groupBy(*keys).agg(F.count("*").cast("long").alias("n")).where(F.col("n") > 1)


def list_templates(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per template the rule count, distinct signatures seen (variants)
    and the latest rule use."""
    r = rules.groupBy("template_id").agg(F.count("*").cast("long").alias("n_rules"),
                                         F.max("last_used").alias("last_updated"))
    p = patterns.groupBy("template_id").agg(F.countDistinct("input_signature").cast("long").alias("n_variants"))
    return (r.join(p, "template_id", "full_outer")
            .select("template_id", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
                    F.coalesce("n_variants", F.lit(0)).cast("long").alias("n_variants"),
                    F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated")))
