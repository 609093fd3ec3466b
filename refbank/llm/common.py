"""Helpers shared by the corpus operators: tables, folds, scratch tables and
connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refbank.session import scratch_path

HELD_OUT_FOLD = 2
N_FOLDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % N_FOLDS).cast("int")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it back: cuts the
    lineage, survives lost executors, and every later reader shares one copy."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], stem: str) -> str:
    """A column name none of ``columns`` uses (names compare without case)."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``df`` to be broadcast when it is counted to be small, else as it is
    (its joins are then ordinary shuffles)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def hash_sample(df: DataFrame, key: str, rows: int, total: int, seed: int = 1) -> DataFrame:
    """At most ``rows`` of ``total`` rows, chosen by hash of ``key``.  The hash
    is cut first, to a little more than is wanted, so that tasks do not each
    bring their own ``rows`` best to the driver."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    share = min(1.0, 1.1 * rows / max(1, total) + 100 / max(1, total))
    cut = df if share >= 1 else df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return cut.orderBy(F.pmod(h, F.lit(1 << 30)), h).limit(rows)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over undirected links.

    ``edges`` has two columns of one ordered type.  Alternating large-star /
    small-star rounds: every round points each node's larger neighbours at the
    smallest node it sees, so a component shrinks to a star in a logarithmic
    number of rounds.  Minima are ordinary aggregates (combined before the
    shuffle) and joins are plain equi-joins that Spark may split when skewed;
    no neighbourhood is gathered in one row.  Each round is a stored table.
    Nodes without any link are not returned.
    """
    a, b = edges.columns
    e = store(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # large star: every neighbour above u goes to the smallest of u's circle
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        large = store(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = store(small, "small-star")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
