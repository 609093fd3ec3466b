"""Mixing sources to target weights by hierarchical budgeting.

The tree's levels are columns, outermost first (domain, language, source).
A node's capacity is the tokens below it times the allowed epochs.  The total
budget is dealt from the root: among siblings in proportion to their weights,
but never beyond a sibling's capacity; what a short sibling leaves goes to the
other siblings by weight, and only what all of them cannot hold never reaches
this parent (its capacity was the sum of theirs), so it went to the parent's
own siblings.  Among siblings this is one water level ``L`` with
``sum(min(capacity, L * weight)) = budget``: in ascending order of
capacity / weight, ``L`` is the largest of
``(budget - capacity of those before) / (weight of the rest)``.
Shares are rounded down to whole tokens.

A leaf takes whole epochs of its documents while its share lasts, then a
prefix of the next epoch, in that epoch's seeded order (md5 of seed, epoch and
id): the documents whose running token sum stays within the rest.  What a leaf
leaves of its share is less than the first document that no longer fits; it is
not dealt again, and :func:`delivered` reports it leaf by leaf.

Only DataFrame operations.  Running sums never put a leaf into one task: the
order key's first three hex digits cut a leaf into 4096 buckets, bucket sums
find the one bucket where the rest runs out, and only that bucket is ordered.
Its last document inside gives the leaf's cut, a single (key, id); whether a
document is taken is then a row-wise comparison, and texts are neither sorted
nor gathered.

Defined results: null level values form a sibling named ``unknown``; a null
text has no tokens; documents without tokens ride along at their place in the
order; a null id sorts as empty text; rows with one id are taken together;
weights must be positive, a missing one is 1, a non-positive one gives no
share; an empty table gives no rows; the input's columns are kept (names that
clash with helper columns are avoided).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refbank.llm.common import fresh, sized, store

BUCKET_DIGITS = 3
BROADCAST_LEAVES = 20_000  # about 2 MB; more leaves are joined by a shuffle


def words(text: Column) -> Column:
    """Tokens of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    given = weights.get(level) or {}
    if not given:
        return F.lit(1.0)
    pairs = [x for k, w in given.items() for x in (F.lit(k), F.lit(float(w)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(1.0))


def shares(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget_share: float,
           max_epochs: int) -> DataFrame:
    """Leaves (levels, total) with their whole-token ``share``."""
    parent = leaves.agg(F.floor(F.coalesce(F.sum("total"), F.lit(0)) * F.lit(float(budget_share))).cast("long").alias("budget"))
    on: list[str] = []
    for depth, level in enumerate(levels):
        key = levels[: depth + 1]
        nodes = (leaves.groupBy(*key).agg((F.sum("total") * max_epochs).alias("cap")).withColumn("w", _weight(level, weights))
                 .where("w > 0"))
        # the root is one row; below it parents meet their children by key
        nodes = nodes.join(parent, on) if on else nodes.join(F.broadcast(parent))
        order = Window.partitionBy(*on).orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("lam", (F.col("budget") - before).cast("double") / rest)
        level_of = F.max("lam").over(Window.partitionBy(*on))
        parent = nodes.withColumn("top", level_of).select(
            *key, F.greatest(F.lit(0), F.least(F.col("cap"), F.floor(F.col("top") * F.col("w")))).cast("long").alias("budget"))
        on = key
    return leaves.join(parent.withColumnRenamed("budget", "share"), levels)


def cuts(slim: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget_share: float,
         max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: whole epochs, and the last (key, id) of the next
    epoch's prefix.  ``slim`` has the levels, ``id`` and ``tokens``."""
    leaves = store(slim.groupBy(*levels).agg(F.sum("tokens").alias("total")), "mix-leaves")
    dealt = shares(leaves, levels, weights, budget_share, max_epochs)
    whole = F.when(F.col("total") > 0, F.floor(F.col("share") / F.col("total"))).otherwise(0).cast("int")
    dealt = store(dealt.withColumn("whole", whole).withColumn("rest", F.col("share") - F.col("whole") * F.col("total")),
                  "mix-shares")
    part = dealt.where((F.col("whole") < max_epochs) & (F.col("total") > 0)).select(*levels, "whole", "rest")
    docs = slim.join(part, levels).select(
        *levels, "rest", "tokens", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        order_key(seed, F.col("whole") + 1, F.col("id")).alias("key"))
    docs = docs.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = docs.groupBy(*levels, "rest", "bucket").agg(F.sum("tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*levels).orderBy("bucket"))
    edge = sums.withColumn("until", run).where("until > rest AND until - n <= rest").select(
        *levels, "bucket", (F.col("rest") - F.col("until") + F.col("n")).alias("left"))
    order = Window.partitionBy(*levels).orderBy("key", "id")
    # in the bucket where the rest runs out: the first document that no longer fits
    over = (docs.join(edge, [*levels, "bucket"]).withColumn("upto", F.sum("tokens").over(order)).where("upto > left")
            .groupBy(*levels).agg(F.min(F.struct("key", "id")).alias("stop")))
    return dealt.join(over, levels, "left").select(*levels, "share", "total", "whole", "stop.key", "stop.id")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], budget_share: float = 1.0,
        max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
        tokens: Column | None = None, epoch_col: str | None = None) -> DataFrame:
    """The mixed documents: a document taken in several epochs is several
    rows.  ``levels`` names the tree's columns, outermost first; ``epoch_col``
    adds the epoch's number."""
    names = list(levels)
    level = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()]
    n_tokens = words(F.col(text_col)) if tokens is None else tokens
    slim = store(docs.select(*level, F.col(id_col).alias("id"), n_tokens.alias("tokens")), "mix-docs")
    cut = store(cuts(slim, names, weights, budget_share, max_epochs, seed), "mix-cuts")
    helper = {n: fresh(docs.columns, f"level_{n}") for n in names}
    ep = fresh([*docs.columns, *helper.values()], "epoch_number")
    small = cut.select(*[F.col(n).alias(helper[n]) for n in names], F.col("whole").alias("_whole"), F.col("total").alias("_total"),
                       F.col("key").alias("_key"), F.col("id").alias("_id"))
    small = small.select(*helper.values(), F.struct("_whole", "_total", "_key", "_id").alias(fresh(docs.columns, "cut")))
    c = small.columns[-1]
    small = sized(small, BROADCAST_LEAVES)
    tagged = docs.withColumns({helper[n]: F.coalesce(levels[n].cast("string"), F.lit("unknown")) for n in names})
    joined = tagged.join(small, list(helper.values()))
    key = order_key(seed, F.col(f"{c}._whole") + 1, F.col(id_col))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    inside = (F.col(f"{c}._whole") < max_epochs) & (
        F.col(f"{c}._key").isNull() | (F.struct(key, ident) < F.struct(F.col(f"{c}._key"), F.col(f"{c}._id"))))
    # a leaf without tokens has nothing to budget: its empty documents are taken once
    n = F.when(F.col(f"{c}._total") == 0, 1).otherwise(F.col(f"{c}._whole") + F.when(inside, 1).otherwise(0))
    out = joined.withColumn(ep, F.explode(F.sequence(F.lit(1), F.lit(max_epochs)))).where(F.col(ep) <= n)
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], *([F.col(ep).alias(epoch_col)] if epoch_col else []))


def delivered(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], budget_share: float = 1.0,
              max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
              tokens: Column | None = None) -> DataFrame:
    """(levels, total, share, delivered) per leaf: the tokens it has, those it was
    dealt and those :func:`mix` gives."""
    names = list(levels)
    n_tokens = words(F.col(text_col)) if tokens is None else tokens
    level = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()]
    leaves = docs.select(*level, n_tokens.alias("tokens")).groupBy(*names).agg(F.sum("tokens").alias("total"))
    dealt = shares(store(leaves, "mix-leaves"), names, weights, budget_share, max_epochs)
    taken = (mix(docs, levels, weights, budget_share, max_epochs, seed, id_col, text_col, tokens)
             .select(*level, n_tokens.alias("tokens")).groupBy(*names).agg(F.sum("tokens").alias("delivered")))
    return dealt.join(taken, names, "left").select(*names, "total", "share", F.coalesce("delivered", F.lit(0)).cast("long").alias("delivered"))
