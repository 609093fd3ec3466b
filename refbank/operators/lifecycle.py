"""Rule lifecycle: outcome updates, outcome replay, decay, touch, id
allocation, drafting, reflection and pattern recording.

Every step is a projection / join producing a *new* bank snapshot; nothing
is updated in place and reads never write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.session import scratch_path


def _as_of(as_of):
    if as_of is None:
        return F.current_timestamp()
    return as_of if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp")


# --- decay (L3 / P13) -------------------------------------------------------

def decay_all(rules: DataFrame, as_of, days: int = S.DECAY_GRACE_DAYS) -> DataFrame:
    """Every rule with its decayed confidence and an ``archived`` flag."""
    c = S.decayed_confidence(F.col("confidence"), F.col("last_used"), _as_of(as_of), days)
    return (rules.withColumn("confidence", c)
            .withColumn("archived", F.coalesce(F.col("confidence"), F.lit(0.5)) < S.ARCHIVE_THRESHOLD))


def decay_rules(rules: DataFrame, as_of, days: int = S.DECAY_GRACE_DAYS) -> DataFrame:
    """L3: surviving rules after decay as of ``as_of``."""
    return decay_all(rules, as_of, days).where(~F.col("archived")).drop("archived")


# --- one outcome (L1 / P12) ---------------------------------------------------

def apply_outcome_all(rules: DataFrame, outcome) -> DataFrame:
    """P12 over every rule; ``outcome`` is a number or a Column (e.g. joined
    per template).  Adds ``archived``."""
    o = F.lit(float(outcome)) if isinstance(outcome, (int, float)) else outcome
    return (rules.withColumn("_o", o)
            .withColumn("support", S.updated_support(F.col("support"), F.col("_o")))
            .withColumn("confidence", S.updated_confidence(F.col("confidence"), F.col("_o")))
            .withColumn("archived", F.col("confidence") < S.ARCHIVE_THRESHOLD)
            .drop("_o"))


def apply_outcome(rules: DataFrame, outcome) -> DataFrame:
    """L1: new snapshot after one outcome; archived rules removed."""
    return apply_outcome_all(rules, outcome).where(~F.col("archived")).drop("archived")


def apply_template_outcomes(rules: DataFrame, per_template: DataFrame) -> DataFrame:
    """L1 per template: ``per_template(template_id, outcome)``; templates
    without an outcome keep their rules unchanged."""
    r = rules.join(per_template.select("template_id", "outcome"), "template_id", "left")
    upd = apply_outcome_all(r, F.col("outcome"))
    keep = F.col("outcome").isNull() | ~F.col("archived")
    return upd.where(keep).drop("archived", "outcome")


# --- outcome replay (L2) -------------------------------------------------------
#
# On the two-decimal grid an outcome moves confidence by +2 / -5 hundredths
# with a cap at 100 and archival below 30.  With prefix sums S_t of the
# steps, the state after t events is  min(G + S_t, 100 + S_t - max_{u<=t} S_u)
# and a rule is archived iff  G + min_t S_t < 30  or the largest drawdown
# max_{u<=t}(S_u - S_t) exceeds 70.  Those are associative summaries, so the
# log is summarised per (template, minute) in parallel and the chunks
# are combined in order -- no template's log is ever collected in one row.

def _step(v):
    return (F.when(v > 0, F.lit(2)).when(v < 0, F.lit(-5)).otherwise(F.lit(0))).cast("long")


def outcome_summary(outcomes: DataFrame, chunk: str = "minute") -> DataFrame:
    """Per template: n, n_plus, n_moves, first_neutral, total, min_prefix,
    max_prefix, max_drawdown of the time-ordered step sequence.

    ``outcomes(template_id, ts, event_id, v)``; ties on ts are ordered by
    event_id.
    """
    return combine_chunks(outcome_chunks(outcomes, chunk))


def outcome_chunks(outcomes: DataFrame, chunk: str = "minute") -> DataFrame:
    """(template_id, chunk, n, n_plus, n_moves, first_neutral, total, min_p,
    max_p, dd): the summary of every chunk of time by itself."""
    ev = (outcomes.select("template_id", "ts", "event_id", _step(F.col("v")).alias("d"))
          .withColumn("chunk", F.date_trunc(chunk, "ts")))
    w_in = Window.partitionBy("template_id", "chunk").orderBy("ts", "event_id")
    run = Window.partitionBy("template_id", "chunk").orderBy("ts", "event_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("p", F.sum("d").over(run))
    ev = ev.withColumn("runmax", F.max("p").over(run))
    ev = ev.withColumn("rn", F.row_number().over(w_in))
    return ev.groupBy("template_id", "chunk").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("n_plus"),
        F.sum(F.when(F.col("d") != 0, 1).otherwise(0)).alias("n_moves"),
        F.max(F.when(F.col("rn") == 1, F.col("d") == 0)).alias("first_neutral"),
        F.sum("d").alias("total"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.max(F.col("runmax") - F.col("p")).alias("dd"),
    )


def combine_chunks(per_chunk: DataFrame) -> DataFrame:
    """Summaries of disjoint chunks (of any lengths) as one per template, in
    time order: offsets are the sums of earlier chunks."""
    wc = Window.partitionBy("template_id").orderBy("chunk")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    c = (per_chunk.withColumn("off", F.coalesce(F.sum("total").over(before), F.lit(0)))
         .withColumn("abs_min", F.col("off") + F.col("min_p"))
         .withColumn("abs_max", F.col("off") + F.col("max_p"))
         .withColumn("prev_max", F.max("abs_max").over(before))
         .withColumn("cross_dd", F.col("prev_max") - F.col("abs_min"))
         .withColumn("is_first", F.row_number().over(wc) == 1))
    return c.groupBy("template_id").agg(
        F.sum("n").alias("n"),
        F.sum("n_plus").alias("n_plus"),
        F.sum("n_moves").alias("n_moves"),
        F.max(F.when(F.col("is_first"), F.col("first_neutral"))).alias("first_neutral"),
        F.sum("total").alias("total"),
        F.min("abs_min").alias("min_prefix"),
        F.max("abs_max").alias("max_prefix"),
        F.greatest(F.max("dd"), F.coalesce(F.max("cross_dd"), F.lit(0))).alias("max_drawdown"),
    )


def apply_summary(rules: DataFrame, summ: DataFrame) -> DataFrame:
    """Rules after their template's outcome log, given its summary (see
    :func:`outcome_summary`); templates without events keep their rules."""
    x = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
    g0 = F.rint(x * 100.0)   # start on the grid (first move rounds anyway)
    r = rules.join(summ, "template_id", "left")
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    archived = has & (
        (F.col("first_neutral") & (x < S.ARCHIVE_THRESHOLD))
        | (g0 + F.col("min_prefix") < 30)
        | (F.col("max_drawdown") > 70))
    final_grid = F.least(g0 + F.col("total"), 100 + F.col("total") - F.col("max_prefix")) / 100.0
    conf = F.when(~has | (F.col("n_moves") == 0), F.col("confidence")).otherwise(final_grid)
    sup = F.coalesce(F.col("support"), F.lit(0)) + F.coalesce(F.col("n_plus"), F.lit(0))
    # An archived rule leaves the bank; its confidence / support are void.
    arch = F.coalesce(archived, F.lit(False))
    keep = [c for c in rules.columns if c not in ("confidence", "support")]
    return r.select(*keep,
                    F.when(~arch, conf).alias("confidence"),
                    F.when(~arch, sup.cast("long")).alias("support"),
                    arch.alias("archived"))


def replay_outcomes(rules: DataFrame, outcomes: DataFrame, chunk: str = "minute") -> DataFrame:
    """L2: every rule after replaying its template's outcome log in order.

    Output keeps all rule columns with updated ``confidence`` / ``support``
    and an ``archived`` flag.  Equal to applying L1 once per event.
    """
    return apply_summary(rules, outcome_summary(outcomes, chunk))


# --- touch (L4) --------------------------------------------------------------

def touch_rules(rules: DataFrame, retrieved: DataFrame, as_of) -> DataFrame:
    """L4: ``last_used = as_of`` for every rule some input retrieved."""
    hit = retrieved.select("template_id", "id").distinct().withColumn("_hit", F.lit(True))
    return (rules.join(hit, ["template_id", "id"], "left")
            .withColumn("last_used", F.when(F.col("_hit"), _as_of(as_of)).otherwise(F.col("last_used")))
            .drop("_hit"))


# --- ids (A4 / U2 / W4) -----------------------------------------------------------

def _rule_num(c):
    return F.when(c.rlike("^R[0-9]+$"), F.regexp_extract(c, "^R([0-9]+)$", 1).cast("long"))


def known_rule_ids(rules: DataFrame, patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """Every rule id any store names, per template (distinct)."""
    a = rules.select("template_id", "id")
    b = patterns.select("template_id", F.explode("rules_used").alias("id"))
    c = edges.select("template_id", F.col("src").alias("id"))
    d = edges.select("template_id", F.col("dst").alias("id"))
    return a.unionByName(b).unionByName(c).unionByName(d).distinct()


def next_ids(rules: DataFrame, patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """A4: highest numeric ``R<n>`` id in use per template and the next one.

    Aggregates each store separately (partial aggregation, no distinct over
    the union) and takes the max of the three."""
    parts = [
        rules.groupBy("template_id").agg(F.max(_rule_num(F.col("id"))).alias("m")),
        patterns.select("template_id", F.explode("rules_used").alias("id"))
                .groupBy("template_id").agg(F.max(_rule_num(F.col("id"))).alias("m")),
        edges.groupBy("template_id").agg(
            F.greatest(F.max(_rule_num(F.col("src"))), F.max(_rule_num(F.col("dst")))).alias("m")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (u.groupBy("template_id").agg(F.coalesce(F.max("m"), F.lit(0)).alias("max_id"))
            .withColumn("next_id", F.format_string("R%03d", F.col("max_id") + 1)))


def sequence_numbers(df: DataFrame, part_col: str, order_col: str) -> DataFrame:
    """Dense 1-based numbers per ``part_col`` in ``order_col`` order (any
    ordered type).

    Two levels so no single task sorts a whole hot key: rows are dealt by
    ranges of (key, order), numbered inside their range, and the counts of
    earlier ranges of the key are added.  The dealt table is stored once:
    range borders are sampled, and both levels must see the same ones."""
    path = scratch_path(df.sparkSession, "sequence")
    dealt = df.repartitionByRange(part_col, order_col).withColumn("_bucket", F.spark_partition_id())
    dealt.write.parquet(path)
    b = df.sparkSession.read.schema(dealt.schema).parquet(path)
    w = Window.partitionBy(part_col, "_bucket").orderBy(order_col)
    b = b.withColumn("_local", F.row_number().over(w))
    counts = b.groupBy(part_col, "_bucket").agg(F.count("*").alias("_cnt"))
    wc = Window.partitionBy(part_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wc), F.lit(0))).drop("_cnt")
    return (b.join(offs, [part_col, "_bucket"])
            .withColumn("seq", F.col("_off") + F.col("_local"))
            .drop("_bucket", "_local", "_off"))


def allocate_rule_ids(requests: DataFrame, base: DataFrame, order_col: str = "ord") -> DataFrame:
    """``R%03d`` ids after each template's highest id, in request order.

    ``base(template_id, max_id)`` from :func:`next_ids`."""
    seq = sequence_numbers(requests, "template_id", order_col)
    return (seq.join(base.select("template_id", "max_id"), "template_id", "left")
            .withColumn("id", F.format_string("R%03d", F.coalesce(F.col("max_id"), F.lit(0)) + F.col("seq")))
            .drop("seq", "max_id"))


# --- drafting / reflection / patterns (L5-L10, J12, U3) ---------------------------

RULE_COLUMNS = ["template_id", "id", "input_type", "trigger", "field", "action", "anchor",
                "confidence", "support", "created_at", "ord"]


def add_rules(requests: DataFrame, base: DataFrame, action: str | F.Column, confidence: float,
              as_of, order_col: str = "ord") -> DataFrame:
    """L5 over a request table ``(template_id, input_type, field, anchor?, ord)``;
    ``action`` is a name or a column of the requests."""
    req = requests if "anchor" in requests.columns else requests.withColumn("anchor", F.lit(None).cast("string"))
    out = allocate_rule_ids(req, base, order_col)
    return out.select(
        "template_id", "id", "input_type",
        F.lit(S.DEFAULT_TRIGGER).alias("trigger"), "field",
        (F.lit(action) if isinstance(action, str) else action).alias("action"), "anchor",
        F.lit(float(confidence)).alias("confidence"),
        F.lit(0).cast("long").alias("support"),
        _as_of(as_of).alias("created_at"), F.col(order_col).alias("ord"))


def draft_rules(requests: DataFrame, base: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """One ``semantic_extract`` rule at 0.5 per field spec, and a
    ``uses_anchor`` edge (weight 1.0) for every spec naming an anchor."""
    drafted = add_rules(requests, base, "semantic_extract", 0.5, as_of)
    new_edges = (drafted.where(F.col("anchor").isNotNull())
                 .select("template_id", F.col("id").alias("src"), F.col("anchor").alias("dst"),
                         F.lit("uses_anchor").alias("relation"), F.lit(1.0).alias("weight")))
    return drafted, new_edges


def append_edges(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Add proposed edges whose (template, from, to, relation) is new.
    Applying it twice equals applying it once."""
    keys = ["template_id", "src", "dst", "relation"]
    fresh = (proposed.dropDuplicates(keys)
             .join(edges.select(*keys), keys, "left_anti"))
    return edges.unionByName(fresh.select(*edges.columns))


def reflect_rules(rules: DataFrame, missing: DataFrame, base: DataFrame, as_of) -> DataFrame:
    """L10 + U3: FAILURE over the existing rules of every failing template,
    then one ``retry_extract`` rule at 0.6 per missing field (not penalised).

    ``missing(template_id, input_type, field, ord)`` lists the failures."""
    failing = missing.select("template_id").distinct().withColumn("outcome", F.lit(S.OUTCOME_VALUE["FAILURE"]))
    penalised = apply_template_outcomes(rules, failing)
    repairs = add_rules(missing, base, "retry_extract", 0.6, as_of)
    # old rules keep their whole bodies; a repair has what it was given
    old = penalised.select(*rules.columns)
    new = repairs.join(old.select("template_id", "id"), ["template_id", "id"], "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def _pattern_num(c):
    return F.when(c.rlike("^P[0-9]+$"), F.regexp_extract(c, "^P([0-9]+)$", 1).cast("long"))


def record_patterns(patterns: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """L6 + L7: one new success pattern per successful run.

    ``runs(template_id, input_id, signature, input_type, level, rule_ids
    ARRAY, fields ARRAY, ord)``; ``rules_used`` is empty when the run was
    degraded (level > 1).  Pattern ids continue each template's ``P%03d``.
    """
    base = patterns.groupBy("template_id").agg(
        F.coalesce(F.max(_pattern_num(F.col("pattern_id"))), F.lit(0)).alias("max_p"))
    seq = sequence_numbers(runs, "template_id", "ord")
    return (seq.join(base, "template_id", "left")
            .select("template_id", "input_id",
                    F.format_string("P%03d", F.coalesce(F.col("max_p"), F.lit(0)) + F.col("seq")).alias("pattern_id"),
                    F.col("signature").alias("input_signature"), "input_type",
                    F.col("fields").alias("fields_extracted"),
                    F.lit(1.0).alias("accuracy"),
                    F.when(F.col("level") > 1, F.array().cast("array<string>"))
                     .otherwise(F.col("rule_ids")).alias("rules_used"),
                    _as_of(as_of).alias("created_at")))


def archived_counts(rules: DataFrame, per_template_outcome: DataFrame, as_of) -> DataFrame:
    """Per template, rules archived by decay and by the outcome."""
    d = decay_all(rules, as_of).groupBy("template_id").agg(
        F.count("*").alias("n_rules"),
        F.sum(F.col("archived").cast("long")).alias("archived_by_decay"))
    r = rules.join(per_template_outcome.select("template_id", "outcome"), "template_id", "left")
    o = (apply_outcome_all(r, F.col("outcome"))
         .groupBy("template_id").agg(
             F.sum((F.col("outcome").isNotNull() & F.col("archived")).cast("long")).alias("archived_by_outcome")))
    return d.join(o, "template_id")
