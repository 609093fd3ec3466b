"""Spreadsheet layout signatures, profiles and pairwise compatibility.

Occupied cells are kept as a long table ``(workbook_id, sheet, dr, dc)``
(coordinates relative to the sheet's top-left used cell).  Jaccard overlap
for a requested pair is an inverted-index join on ``(sheet, dr, dc)``; no
occupied set is ever materialised as one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.operators.cells import collect_cells

COMPATIBLE_THRESHOLD = 0.78     # fixed value: 0.8 * jaccard + 0.2 * shape
JACCARD_WEIGHT = 0.8
SHAPE_WEIGHT = 0.2


def extents(cells: DataFrame) -> DataFrame:
    """Per sheet: used row / column range and occupied count (one aggregation).
    A sheet whose cells are all blank has a count of 0 and no range."""
    full = S.normalize_value(F.col("value")) != ""
    used = cells.select("workbook_id", "sheet", F.when(full, F.struct("row", "col")).alias("at"))  # looked at once per cell
    return (used.groupBy("workbook_id", "sheet").agg(
        F.min("at.row").alias("min_row"), F.max("at.row").alias("max_row"),
        F.min("at.col").alias("min_col"), F.max("at.col").alias("max_col"),
        F.count("at.row").cast("long").alias("occupied_count")))


def occupied(cells: DataFrame, ext: DataFrame | None = None) -> DataFrame:
    """Normalised occupied coordinates per sheet (relative to the sheet's
    top-left used cell), from the per-sheet extents joined back."""
    ext = ext if ext is not None else extents(cells)
    return (collect_cells(cells).join(ext.select("workbook_id", "sheet", "min_row", "min_col"),
                                      ["workbook_id", "sheet"])
            .select("workbook_id", "sheet", (F.col("row") - F.col("min_row")).alias("dr"),
                    (F.col("col") - F.col("min_col")).alias("dc")))


def _cell_hash(dr, dc) -> F.Column:
    """48-bit hash of one normalised coordinate (for order-free set digests)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", dr.cast("string"), dc.cast("string"))), 1, 12),
                  16, 10).cast("long")


def _hash_sum(h) -> F.Column:
    """Aggregate: the sum of 48-bit numbers.  Halves of 24 bits are added as longs,
    which hold 2^39 cells; decimals are made once per sheet, not per cell."""
    half = 1 << 24
    return F.sum(F.shiftright(h, 24)).cast("decimal(20,0)") * half + F.sum(h.bitwiseAND(F.lit(half - 1))).cast("decimal(20,0)")


def sheet_layout(cells: DataFrame, occ: DataFrame | None = None, ext: DataFrame | None = None) -> DataFrame:
    """A5: per sheet extents, occupied count and an order-independent digest
    of the occupied set (sum of per-cell hashes, partial-aggregated)."""
    ext = ext if ext is not None else extents(cells)
    occ = occ if occ is not None else occupied(cells, ext)
    dig = occ.select("workbook_id", "sheet", _cell_hash(F.col("dr"), F.col("dc")).alias("h")).groupBy("workbook_id", "sheet").agg(
        _hash_sum(F.col("h")).cast("string").alias("occupied_digest"))
    return ext.join(dig, ["workbook_id", "sheet"], "left").fillna({"occupied_digest": "0"})


def _framed(*cols) -> F.Column:
    """Values with their lengths before them: no value can imitate a border."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(*[F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in cols])


def set_digest(text: F.Column) -> F.Column:
    """Aggregate: digest of a set of texts, whatever their order.  Four sums of 60
    bits of each text's SHA-256, so tasks add up what they have before the shuffle
    and no list of texts is ever put together."""
    d = F.sha2(text, 256)
    sums = [F.sum(F.conv(F.substring(d, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for k in range(4)]
    return F.concat_ws(",", *sums)


def template_profile(cells: DataFrame, max_cells: int | None = None,
                     layout: DataFrame | None = None) -> DataFrame:
    """A6 + W5: per workbook the SHA-256 over its sheet layouts, by name, and
    its non-empty cells in (sheet, row, col) order.

    Every cell is hashed on its own (sheet, reference and value framed by
    their lengths); the signature is over the ordered sequence of those hashes,
    16 bytes per cell of one workbook.  ``max_cells`` limits the cells to the
    first so many; by default all count.
    """
    lay = layout if layout is not None else sheet_layout(cells)
    sheet_txt = _framed("sheet", "max_row", "max_col", "min_row", "max_row", "min_col", "max_col",
                        "occupied_count", "occupied_digest")
    sheets = lay.groupBy("workbook_id").agg(
        F.count("*").cast("long").alias("n_sheets"),
        F.sum("occupied_count").cast("long").alias("n_cells"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", sheet_txt.alias("t")))), lambda x: x["t"]), ";").alias("sheets_txt"))
    c = collect_cells(cells)
    if max_cells is not None:
        w = Window.partitionBy("workbook_id").orderBy("sheet", "row", "col")
        c = c.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_cells)
    digest = F.unhex(F.md5(_framed("sheet", "cell", "value")))
    graph = c.groupBy("workbook_id").agg(
        F.count("*").cast("long").alias("n_hashed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "row", "col", digest.alias("t")))),
                                 lambda x: F.lower(F.hex(x["t"]))), "").alias("cells_txt"))
    return (sheets.join(graph, "workbook_id", "left")
            .select("workbook_id", "n_sheets", "n_cells", F.coalesce("n_hashed", F.lit(0)).alias("n_hashed"),
                    F.sha2(F.concat_ws("#", "sheets_txt", F.coalesce("cells_txt", F.lit(""))), 256).alias("signature")))


def layout_similarity(cells: DataFrame, pairs: DataFrame, layout: DataFrame | None = None,
                      occ: DataFrame | None = None) -> DataFrame:
    """A7 + P15 + J13: per requested pair (x = base, y = candidate) and sheet
    name of either side: Jaccard of occupied sets, shape score, weighted
    score; a sheet missing on one side scores 0 with a reason."""
    if occ is None:
        ext = extents(cells)
        occ = occupied(cells, ext)
        layout = layout if layout is not None else sheet_layout(cells, occ, ext)
    lay = (layout if layout is not None else sheet_layout(cells, occ)).select(
        "workbook_id", "sheet", "occupied_count",
        F.coalesce(F.col("max_row") - F.col("min_row"), F.lit(0)).alias("h"),
        F.coalesce(F.col("max_col") - F.col("min_col"), F.lit(0)).alias("w"))
    bx = lay.select(F.col("workbook_id").alias("x"), "sheet", F.col("occupied_count").alias("a"),
                    F.col("h").alias("hx"), F.col("w").alias("wx"))
    by = lay.select(F.col("workbook_id").alias("y"), "sheet", F.col("occupied_count").alias("b"),
                    F.col("h").alias("hy"), F.col("w").alias("wy"))
    p = pairs.select("x", "y").distinct()
    sx = p.join(bx, "x")
    sy = p.join(by, "y")
    sheets = sx.join(sy, ["x", "y", "sheet"], "full_outer")
    # candidate cells -> their pair (one base per candidate), then probe the
    # base's cells on the full key; a hot base spreads over its coordinates
    cand = (occ.withColumnRenamed("workbook_id", "y").join(p, "y")
            .select("x", "y", "sheet", "dr", "dc"))
    base = occ.select(F.col("workbook_id").alias("x"), "sheet", "dr", "dc")
    inter = (cand.join(base, ["x", "sheet", "dr", "dc"], "left_semi")
             .groupBy("x", "y", "sheet").agg(F.count("*").cast("long").alias("k")))
    s = sheets.join(inter, ["x", "y", "sheet"], "left").fillna({"k": 0})
    a, b, k = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.col("k")
    jac = (F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0))
           .otherwise(k.cast("double") / (a + b - k)))
    shape = S.shape_score(F.col("hx"), F.col("hy"), F.col("wx"), F.col("wy"))
    reason = (F.when(F.col("a").isNull(), "missing_in_base").when(F.col("b").isNull(), "missing_in_candidate")
              .otherwise("compared"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return s.select("x", "y", "sheet", reason.alias("reason"),
                    F.when(both, jac).alias("occupancy_jaccard"),
                    F.when(both, shape).alias("shape_score"),
                    F.when(both, JACCARD_WEIGHT * jac + SHAPE_WEIGHT * shape).otherwise(0.0).alias("score"))


def layout_compat(cells: DataFrame, pairs: DataFrame, threshold: float = COMPATIBLE_THRESHOLD,
                  profiles: DataFrame | None = None) -> DataFrame:
    """Exact (same signature) -> 1.0; else the mean sheet score over the
    union of sheet names, rounded to 4 places, compatible at >= threshold."""
    ext = extents(cells)
    occ = occupied(cells, ext)
    lay = sheet_layout(cells, occ, ext)
    prof = profiles if profiles is not None else template_profile(cells, layout=lay)
    sig = prof.select("workbook_id", "signature")
    sim = layout_similarity(cells, pairs, layout=lay, occ=occ)
    agg = sim.groupBy("x", "y").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    p = (pairs.select("x", "y").distinct()
         .join(sig.withColumnRenamed("workbook_id", "x").withColumnRenamed("signature", "sx"), "x", "left")
         .join(sig.withColumnRenamed("workbook_id", "y").withColumnRenamed("signature", "sy"), "y", "left")
         .join(agg, ["x", "y"], "left"))
    exact = F.col("sx").isNotNull() & (F.col("sx") == F.col("sy"))
    raw = F.coalesce(F.col("s"), F.lit(0.0)) / F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(1))
    comp = (F.when(exact, "exact").when(raw >= threshold, "compatible").otherwise("incompatible"))
    return p.select("x", "y", comp.alias("compatibility"),
                    F.when(exact, 1.0).otherwise(S.round_half_even(raw, 4)).alias("score"),
                    (~exact & (raw < threshold)).alias("hard_mismatch"))


def layout_routing(compat: DataFrame) -> DataFrame:
    """Incompatible layouts are not written but routed to learning."""
    return compat.withColumn("route", F.when(F.col("hard_mismatch"), "learn").otherwise("write"))
