"""Failure memory: event enrichment, failure clusters, top repair votes,
summary (repair) rules and repair lookup.

All aggregations are two-level (partial aggregation on the map side), and
no cluster's event list is ever collected: membership stays a long table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refbank.functions import scalars as S


def enrich_events(events: DataFrame, as_of=None) -> DataFrame:
    """Default ``ts``, normalised ``missing_fields``, ``event_id`` when
    absent, and the ``cluster_key``."""
    ts = F.coalesce(F.col("ts").cast("timestamp"),
                    F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp"))
    e = events.withColumn("ts", ts).withColumn("missing_fields", S.normalize_fields(F.col("missing_fields")))
    eid = S.event_id(F.col("ts"), F.col("template_signature"), F.col("error_type"),
                     F.col("missing_fields"), F.col("repair_action"))
    e = e.withColumn("event_id", F.coalesce(F.col("event_id").cast("string"), eid)) if "event_id" in e.columns \
        else e.withColumn("event_id", eid)
    key = S.cluster_key(F.col("error_type"), F.col("missing_fields"), F.col("template_signature"))
    if "cluster_key" in e.columns:          # a stored key wins, as in the log
        key = F.coalesce(F.when(F.col("cluster_key") != "", F.col("cluster_key")), key)
    return e.withColumn("cluster_key", key)


def failures(log: DataFrame) -> DataFrame:
    """events with a non-empty error type."""
    return log.where(F.col("error_type").isNotNull() & (F.col("error_type") != ""))


def _seq(log: DataFrame) -> F.Column:
    return F.struct(F.col("seq_ts"), F.col("seq_id"))


def failure_clusters(log: DataFrame) -> DataFrame:
    """A1: one row per cluster key with samples, first / last event, last ts
    (in log order) and the cluster's descriptive fields."""
    f = failures(enrich_events(log) if "cluster_key" not in log.columns else log)
    seq = _seq(f)
    return f.groupBy("cluster_key").agg(
        F.count("*").cast("long").alias("samples"),
        F.min_by("template_signature", seq).alias("signature"),
        F.min_by("error_type", seq).alias("error_type"),
        F.min_by(F.array_join("missing_fields", ","), seq).alias("missing_fields"),
        F.min_by("event_id", seq).alias("first_event"),
        F.max_by("event_id", seq).alias("last_event"),
        F.max_by("ts", seq).alias("last_ts"),
        F.min(seq).alias("first_seq"),
    )


def cluster_events(log: DataFrame) -> DataFrame:
    """Membership of events in clusters as a long table (never collected)."""
    f = failures(enrich_events(log) if "cluster_key" not in log.columns else log)
    return f.select("cluster_key", "event_id", "ts", "seq_ts", "seq_id")


def top_repair(log: DataFrame) -> DataFrame:
    """A2: per cluster the most voted non-empty repair action; ties go to the
    action seen first."""
    f = failures(enrich_events(log) if "cluster_key" not in log.columns else log)
    votes = (f.where(F.col("repair_action").isNotNull() & (F.col("repair_action") != ""))
             .groupBy("cluster_key", "repair_action")
             .agg(F.count("*").cast("long").alias("votes"), F.min(_seq(f)).alias("first")))
    key = F.struct(F.col("votes"),
                   (-F.unix_micros(F.col("first.seq_ts"))).alias("a"),
                   (-F.col("first.seq_id")).alias("b"))
    return votes.groupBy("cluster_key").agg(
        F.max_by("repair_action", key).alias("top_repair_action"),
        F.max("votes").alias("top_repair_votes"))


# ---- clusters kept current ------------------------------------------------------

def cluster_votes(log: DataFrame) -> DataFrame:
    """(cluster_key, action, samples, first, last): what clusters, top repairs and
    summary rules are made of.  Rows of two logs merge by adding the samples and
    taking the earlier first and the later last event."""
    f = failures(enrich_events(log) if "cluster_key" not in log.columns else log)
    first = F.struct("seq_ts", "seq_id", F.col("template_signature").alias("signature"), "error_type",
                     F.array_join("missing_fields", ",").alias("missing_fields"), "event_id")
    return (f.groupBy("cluster_key", F.coalesce("repair_action", F.lit("")).alias("action"))
            .agg(F.count("*").cast("long").alias("samples"), F.min(first).alias("first"),
                 F.max(F.struct("seq_ts", "seq_id", "event_id", "ts")).alias("last")))


def merge_votes(*parts: DataFrame) -> DataFrame:
    """Votes of several logs that share no event; associative and commutative."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("cluster_key", "action").agg(F.sum("samples").alias("samples"), F.min("first").alias("first"), F.max("last").alias("last"))


def update_votes(current: DataFrame, delta: DataFrame) -> DataFrame:
    """``current`` after a day's log (its votes): only clusters of the day change,
    the others are passed through, and no earlier event is read again.  Store
    the result before the next day (``current`` is read twice)."""
    touched = delta.select("cluster_key").distinct()
    return (current.join(touched, "cluster_key", "left_anti")
            .unionByName(merge_votes(current.join(touched, "cluster_key", "left_semi"), delta)))


def clusters_of(votes: DataFrame) -> DataFrame:
    """:func:`failure_clusters` from votes."""
    c = votes.groupBy("cluster_key").agg(F.sum("samples").alias("samples"), F.min("first").alias("f"), F.max("last").alias("l"))
    return c.select("cluster_key", "samples", "f.signature", "f.error_type", "f.missing_fields", F.col("f.event_id").alias("first_event"),
                    F.col("l.event_id").alias("last_event"), F.col("l.ts").alias("last_ts"), F.struct("f.seq_ts", "f.seq_id").alias("first_seq"))


def top_repair_of(votes: DataFrame) -> DataFrame:
    """:func:`top_repair` from votes."""
    key = F.struct(F.col("samples"), (-F.unix_micros(F.col("first.seq_ts"))).alias("a"), (-F.col("first.seq_id")).alias("b"))
    return votes.where("action <> ''").groupBy("cluster_key").agg(
        F.max_by("action", key).alias("top_repair_action"), F.max("samples").alias("top_repair_votes"))


def summary_rules(log: DataFrame | None, min_support: int = 2, as_of=None, votes: DataFrame | None = None) -> DataFrame:
    """A3 + F6 + A11 + W6: reusable repair rules from clusters with at least
    ``min_support`` samples and a repair action, numbered ``R%03d`` by
    samples desc, then first appearance.  From the log, or from its ``votes``
    (:func:`cluster_votes`) where those are kept.

    Numbering is global but never funnels every cluster through one task:
    clusters are ranked within their ``samples`` value (two-level, see
    :func:`sequence_numbers`) and offset by the count of clusters with more
    samples (a table of distinct sample counts).
    """
    if votes is None:
        c = failure_clusters(log).join(top_repair(log), "cluster_key", "left")
    else:
        c = clusters_of(votes).join(top_repair_of(votes), "cluster_key", "left")
    el = c.where((F.col("samples") >= min_support)
                 & F.col("top_repair_action").isNotNull() & (F.col("top_repair_action") != ""))
    # rank inside each samples value by first appearance (ts, event id)
    el = (el.withColumn("_o", F.unix_micros(F.col("first_seq.seq_ts")))
          .withColumn("_o2", F.col("first_seq.seq_id")))
    numbered = _rank_within(el, "samples", ["_o", "_o2"])
    sizes = el.groupBy("samples").agg(F.count("*").alias("_n"))
    off = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy(F.col("samples").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ts = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return (numbered.join(off.select("samples", "_off"), "samples")
            .select(F.format_string("R%03d", F.col("_off") + F.col("_rank")).alias("id"),
                    F.col("signature").alias("template_signature"), "error_type", "missing_fields",
                    F.col("top_repair_action").alias("repair_action"),
                    F.col("samples").alias("support"),
                    (F.col("top_repair_votes") / F.col("samples")).alias("vote_rate"),
                    ts.alias("created_at"), "cluster_key"))


def _rank_within(df: DataFrame, part: str, order: list[str], chunk: int = 3_600_000_000) -> DataFrame:
    """Dense rank inside ``part`` by ``order`` (first column numeric), two-level."""
    b = df.withColumn("_bucket", F.floor(F.col(order[0]) / chunk))
    w = Window.partitionBy(part, "_bucket").orderBy(*order)
    b = b.withColumn("_local", F.row_number().over(w))
    counts = b.groupBy(part, "_bucket").agg(F.count("*").alias("_cnt"))
    wc = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_boff", F.coalesce(F.sum("_cnt").over(wc), F.lit(0))).drop("_cnt")
    return (b.join(offs, [part, "_bucket"])
            .withColumn("_rank", F.col("_boff") + F.col("_local"))
            .drop("_bucket", "_local", "_boff"))


def suggest_repairs(rules: DataFrame, queries: DataFrame) -> DataFrame:
    """Rules with the query's signature and error type whose sorted
    field list equals the query's; an empty query list matches all (Q16).

    ``queries(query_id, template_signature, error_type, missing_fields ARRAY)``.
    """
    q = queries.withColumn("q_fields", F.array_join(S.normalize_fields(F.col("missing_fields")), ","))
    r = rules.select("id", "template_signature", "error_type",
                     F.col("missing_fields").alias("r_fields"), "repair_action", "support", "vote_rate")
    return (q.join(r, ["template_signature", "error_type"])
            .where((F.col("q_fields") == "") | (F.col("q_fields") == F.col("r_fields")))
            .select("query_id", "id", "template_signature", "error_type",
                    F.col("r_fields").alias("missing_fields"), "repair_action", "support", "vote_rate"))


def relearn_candidates(log: DataFrame, min_support: int = 2) -> DataFrame:
    """Failure families seen at least ``min_support`` times that have no
    usable repair rule yet."""
    c = failure_clusters(log).where(F.col("samples") >= min_support)
    rules = summary_rules(log, min_support).select("cluster_key")
    return c.join(rules, "cluster_key", "left_anti").select("cluster_key", "samples", "signature", "error_type")
