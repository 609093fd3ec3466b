"""A7 / D6 without given pairs: all compatible layouts of all workbooks.

Workbooks with the same occupied cells on the same sheets are one class and only
its smallest id is compared, so copies of a template cost one row.  Classes are
joined by a weighted prefix filter:

Of a workbook with n sheets every occupied cell of sheet i weighs
``1 / (n * cells of i)``, so a workbook weighs 1.  A pair's score is the mean over
the sheets of either side of ``0.8 * Jaccard + 0.2 * shape``; from a score of t
follows a mean Jaccard of ``s = (t - 0.2) / 0.8`` and, because a sheet's Jaccard
is at most the shared part of its cells, shared cells of weight s on *each* side.
So in one order of all (sheet, row, column), the cells before the first shared one
weigh at most 1 - s, and the first shared one is among each side's *prefix*: the
cells up to the weight that exceeds 1 - s.  The order is rarest first, counted
over classes: what most layouts have, such as a common cover sheet, comes last
and joins nothing.  Every pair that shares a prefix cell, and no other, is then
scored exactly.  Nothing that reaches the threshold is lost.

An empty sheet is a set with one sign of its own: two empty sheets agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.operators import layout as LY
from refbank.session import scratch_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def layout_classes(cells: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """(workbook_id, class_id): class_id is the smallest workbook with the same
    occupied cells on the same sheets."""
    lay = layout if layout is not None else LY.sheet_layout(cells)
    digest = lay.groupBy("workbook_id").agg(LY.set_digest(LY._framed("sheet", "occupied_digest", "occupied_count")).alias("digest"),
                                            F.count(F.lit(1)).alias("n"))
    least = digest.groupBy("digest", "n").agg(F.min("workbook_id").alias("class_id"))
    return digest.join(least, ["digest", "n"]).select("workbook_id", "class_id")


def candidates(occ: DataFrame, sheets: DataFrame, threshold: float) -> DataFrame:
    """(x, y), x < y: workbooks that share a prefix cell.  ``occ(workbook_id,
    sheet, dr, dc)``, ``sheets(workbook_id, sheet, occupied_count)``."""
    share = (threshold - LY.SHAPE_WEIGHT) / LY.JACCARD_WEIGHT
    numbers = sheets.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("n_sheets"))
    empty = sheets.where("occupied_count = 0").select("workbook_id", "sheet", F.lit(-1).cast("long").alias("dr"), F.lit(-1).cast("long").alias("dc"))
    cell = ["sheet", "dr", "dc"]
    every = occ.select("workbook_id", *[F.col(c).cast("long") if c != "sheet" else F.col(c) for c in cell]).unionByName(empty)
    rare = every.groupBy(*cell).agg(F.count(F.lit(1)).alias("held"))
    weight = 1.0 / (F.col("n_sheets") * F.greatest(F.col("occupied_count"), F.lit(1)))
    order = Window.partitionBy("workbook_id").orderBy("held", *cell).rowsBetween(Window.unboundedPreceding, -1)
    prefix = _stored(every.join(rare, cell).join(sheets.select("workbook_id", "sheet", "occupied_count"), ["workbook_id", "sheet"])
                     .join(numbers, "workbook_id").withColumn("before", F.coalesce(F.sum(weight).over(order), F.lit(0.0)))
                     .where(F.col("before") <= 1 - share + 1e-9).where("held > 1").select("workbook_id", "n_sheets", *cell), "layout-prefix")
    other = prefix.select(F.col("workbook_id").alias("y"), F.col("n_sheets").alias("n_y"), *cell)
    # sheets without a partner score nothing: their number is bounded, too
    like = F.least("n_sheets", "n_y") >= share * F.greatest("n_sheets", "n_y") - 1e-9
    return (prefix.withColumnRenamed("workbook_id", "x").join(other, cell).where((F.col("x") < F.col("y")) & like)
            .select("x", "y").distinct())


def compatible_layouts(cells: DataFrame, threshold: float = LY.COMPATIBLE_THRESHOLD, classes: DataFrame | None = None) -> DataFrame:
    """(x, y, score): every two layout classes (x < y) whose score reaches the
    threshold, the score rounded to four places as in :func:`refbank.operators.layout.layout_compat`.
    Workbooks of one class are compatible by being the same (:func:`layout_classes`)."""
    ext = LY.extents(cells)
    occ = _stored(LY.occupied(cells, ext), "layout-cells")
    lay = _stored(LY.sheet_layout(cells, occ, ext), "layout-sheets")
    members = classes if classes is not None else layout_classes(cells, lay)
    first = _stored(members.select(F.col("class_id").alias("workbook_id")).distinct(), "layout-classes")
    occ, lay = occ.join(first, "workbook_id", "left_semi"), lay.join(first, "workbook_id", "left_semi")
    pairs = _stored(candidates(occ, lay, threshold), "layout-candidates")
    sim = LY.layout_similarity(cells, pairs, layout=lay, occ=occ)
    raw = F.col("s") / F.col("n")
    return (sim.groupBy("x", "y").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
            .where(raw >= threshold - 1e-12).select("x", "y", S.round_half_even(raw, 4).alias("score")))
