"""Table diff (generated vs benchmark) with the reference's normalisation:
strings stripped, numbers compared as doubles rounded to 2 places, NaN
equal to NaN.  Rows are matched by position (:func:`positional_diff`, as the
reference does) or by a key (:func:`data_diff`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refbank.functions import scalars as S
from refbank.session import scratch_path

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _norm(df: DataFrame, c: str) -> F.Column:
    dt = df.schema[c].dataType
    if isinstance(dt, _NUMERIC):
        return S.round_half_even(F.col(c).cast("double"), 2)
    if isinstance(dt, T.StringType):
        return S.py_strip(F.col(c))
    return F.col(c)


def schema_diff(gen: DataFrame, bench: DataFrame) -> list[str]:
    """Column names / order / kind differences (metadata only, no job)."""
    issues = []
    if gen.columns != bench.columns:
        issues.append(f"columns differ: {gen.columns} vs {bench.columns}")
    for c in set(gen.columns) & set(bench.columns):
        a, b = gen.schema[c].dataType, bench.schema[c].dataType
        if isinstance(a, _NUMERIC) != isinstance(b, _NUMERIC) or (
                not isinstance(a, _NUMERIC) and type(a) is not type(b)):
            issues.append(f"type of {c} differs: {a.simpleString()} vs {b.simpleString()}")
    return issues


def _compare(g: DataFrame, b: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """One row per (row, column) that differs, and per row of one side only."""
    j = g.join(b, on, "full_outer")
    diffs = []
    for c in cols:
        gv, bv = F.col(f"g_{c}"), F.col(f"b_{c}")
        diffs.append(F.when(~gv.eqNullSafe(bv),
                            F.struct(F.lit(c).alias("column"), gv.cast("string").alias("generated"),
                                     bv.cast("string").alias("benchmark"))))
    one_side = F.when(F.col("_g").isNull() | F.col("_b").isNull(),
                      F.array(F.struct(F.lit("__row__").alias("column"),
                                       F.when(F.col("_g"), F.lit("present")).alias("generated"),
                                       F.when(F.col("_b"), F.lit("present")).alias("benchmark"))))
    arr = F.coalesce(one_side, F.filter(F.array(*diffs), lambda x: x.isNotNull()))
    return j.select(*on, F.explode(arr).alias("d")).select(*on, "d.column", "d.generated", "d.benchmark")


def data_diff(gen: DataFrame, bench: DataFrame, key: str) -> DataFrame:
    """J14 by key: one row per (key, column) whose normalised values differ,
    plus rows present on one side only (column ``__row__``).  Null-safe compare;
    numeric NaN equals NaN.

    Rows with one key are matched in the order of their normalised values, so a
    table with repeated keys equals itself, and a null key is a key.  Only keys
    that occur more than once on a side are put in order."""
    cols = [c for c in bench.columns if c != key and c in gen.columns]

    def side(df: DataFrame, p: str) -> DataFrame:
        x = df.select(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("v")).alias("_k"),
                      *[_norm(df, c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(f"_{p}"))
        many = x.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k")
        values = [F.col(f"{p}_{c}") for c in cols] or [F.lit(0)]
        again = x.join(many, "_k", "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy(*values)))
        return x.join(many, "_k", "left_anti").withColumn("_i", F.lit(1)).unionByName(again)

    return (_compare(side(gen, "g"), side(bench, "b"), ["_k", "_i"], cols)
            .select(F.col("_k.v").alias(key), "column", "generated", "benchmark"))


def with_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Global row numbers (``_pos``, from 0) in the order of ``order``.

    Rows are dealt by ranges and numbered inside them; the sizes of the earlier
    ranges are added (one small row per range).  Rows with equal order columns are
    ordered by all their values, so the numbers are the same at every run.  The
    dealt table is stored once: borders are sampled, and both steps must see the same."""
    spark = df.sparkSession
    keys = [*order, *[c for c in df.columns if c not in order]]
    path = scratch_path(spark, "positions")
    dealt = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    d = spark.read.schema(dealt.schema).parquet(path)
    local = d.withColumn("_pos", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1)
    sizes = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return local.join(before, "_range").withColumn("_pos", F.col("_pos") + F.col("_before")).drop("_range", "_before")


def positional_diff(gen: DataFrame, bench: DataFrame, gen_order: list[str], bench_order: list[str]) -> DataFrame:
    """J14 by position: (row, column, generated, benchmark) for every value that
    differs between the n-th rows of both tables; rows beyond the shorter one
    have the column ``__row__``.  The order columns say what the row order is
    (a file's line number, a sheet's row); they are not compared."""
    cols = [c for c in bench.columns if c not in bench_order and c in gen.columns and c not in gen_order]

    def side(df: DataFrame, order: list[str], p: str) -> DataFrame:
        x = with_positions(df.select(*order, *cols), order)
        return x.select(F.col("_pos").alias("row"), *[_norm(x, c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(f"_{p}"))

    return _compare(side(gen, gen_order, "g"), side(bench, bench_order, "b"), ["row"], cols)


def tables_equal(gen: DataFrame, bench: DataFrame, key: str | None = None, gen_order: list[str] | None = None,
                 bench_order: list[str] | None = None) -> DataFrame:
    """Verdict as a one-row DataFrame: schema equal and no value differences,
    by key or, without one, by position."""
    same_schema = not schema_diff(gen, bench)
    d = data_diff(gen, bench, key) if key else positional_diff(gen, bench, gen_order, bench_order or gen_order)
    n = d.agg(F.count("*").alias("n_diff"))
    return n.select((F.lit(same_schema) & (F.col("n_diff") == 0)).alias("match"), "n_diff")
