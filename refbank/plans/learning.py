"""The learning loop for every unresolved template at once.

analyse -> draft -> up to ``max_retries`` x (test -> commit | reflect).
Each round is one Spark job over *all* templates still unresolved; the
rule bank of a round and what its test misses are stored in the shared folder,
so lineage never grows across rounds and the samples are tested once a round.
The only driver loop is over rounds (<= 5), and the only per-round driver action
is one count of unresolved templates.

Hooks (H2-H5) are DataFrame -> DataFrame functions:
  analyse(samples, schema) -> field specs (template_id, field, anchor)
  draft(specs, base_ids)   -> rules
  test(samples, rules)     -> missing (template_id, input_id, field)
  reflect(rules, missing)  -> repair rules merged by id (U3)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.operators import actions as A
from refbank.operators import extract as E
from refbank.operators import lifecycle as L
from refbank.session import checkpoint_dir, scratch_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class LearnResult:
    status: DataFrame   # (template_id, status, attempts)
    rules: DataFrame    # final rules of every template
    edges: DataFrame    # which rule uses which anchor
    anchors: DataFrame  # (template_id, field, type, role, pattern) of the committed templates' rules


def default_analyse(samples: DataFrame, schema: DataFrame) -> DataFrame:
    """H2 default: every schema field becomes a field spec, no anchor."""
    return schema.select("template_id", "field", F.lit(None).cast("string").alias("anchor"),
                         F.col("ord").cast("long").alias("ord"))


def induced(ranked: DataFrame):
    """H2 by induction: ``ranked`` of :func:`refbank.operators.induce.rank_anchors`;
    every schema field with a candidate gets its best label as anchor."""

    def analyse(samples: DataFrame, schema: DataFrame) -> DataFrame:
        best = ranked.where("cand = 0").select("template_id", "field", "anchor")
        return (schema.select("template_id", "field", F.col("ord").cast("long").alias("ord"))
                .join(best, ["template_id", "field"], "left").select("template_id", "field", "anchor", "ord"))

    return analyse


def anchor_tester(ranked: DataFrame, known: DataFrame):
    """H4 over all samples: extract by each rule's label (the field's candidate
    number ``cand``) and report the values that are not what is known."""

    def test(samples: DataFrame, rules: DataFrame, schema: DataFrame) -> DataFrame:
        r = (rules.drop("anchor").join(ranked.select("template_id", "field", "cand", "anchor"), ["template_id", "field", "cand"])
             .select("template_id", F.col("id").alias("rule_id"), "field", F.lit(A.AFTER_ANCHOR).alias("action"), "anchor", "confidence", "ord"))
        got = A.anchor_extract(samples, r).select("input_id", "field", A._words(F.col("value")).alias("got"))
        need = (known.join(samples.select("input_id", "template_id"), "input_id")
                .join(schema.select("template_id", "field"), ["template_id", "field"], "left_semi"))
        return (need.join(got, ["input_id", "field"], "left").where(~A._words(F.col("value")).eqNullSafe(F.col("got")))
                .select("template_id", "input_id", "field"))

    return test


def rule_catalogue_tester(catalogue: DataFrame):
    """Default H4: extract with each rule's pattern (from a candidate
    catalogue ``(field, cand, pattern, source)``) and report fields the
    sample still misses."""

    def test(samples: DataFrame, rules: DataFrame, schema: DataFrame) -> DataFrame:
        r = (rules.join(catalogue, ["field", "cand"])
             .select("template_id", F.col("id").alias("rule_id"), "field", "pattern", "source", "confidence", "ord"))
        src = [c for c in samples.columns if c not in ("input_id", "template_id")]
        got = E.rule_extract(samples, r, src).select("input_id", "field")
        need = samples.select("template_id", "input_id").join(schema.select("template_id", "field"), "template_id")
        return need.join(got, ["input_id", "field"], "left_anti")

    return test


def learn_cycle(spark: SparkSession, samples: DataFrame, schema: DataFrame, tester,
                analyse=default_analyse, draft=None, reflect=None,
                max_retries: int = 5, as_of=None, base: DataFrame | None = None) -> LearnResult:
    """Learn rules for every template.

    ``samples(template_id, input_id, <source columns>)``, any number per
    template, ``schema(template_id, field, ord)``.  Draft rules carry a
    candidate index ``cand`` = 0; each reflection adds a ``retry_extract``
    rule for every missing field with the next candidate index.  ``base(template_id,
    max_id)`` of :func:`refbank.operators.lifecycle.next_ids` makes the ids go on
    after those the bank has used.
    """
    checkpoint_dir(spark)
    specs = analyse(samples, schema)
    zero = specs.select("template_id").distinct().withColumn("max_id", F.lit(0).cast("long"))
    base = zero if base is None else zero.select("template_id").join(base.select("template_id", "max_id"), "template_id", "left").fillna({"max_id": 0})
    if draft is not None:                       # H3 replaces the default draft
        rules = draft(specs, base)
    else:
        action = F.when(F.col("anchor").isNotNull(), A.AFTER_ANCHOR).otherwise("semantic_extract")
        rules = (L.add_rules(specs.withColumn("input_type", F.lit("md")), base, action, 0.5, as_of)
                 .withColumn("cand", F.lit(0)))
    rules = _stored(rules, "learn-rules")
    status = samples.select("template_id").distinct().withColumn("status", F.lit("reflected")) \
        .withColumn("attempts", F.lit(0))
    open_tpl = samples.select("template_id").distinct()
    done = []
    for attempt in range(1, max_retries + 1):
        todo_rules = rules.join(open_tpl, "template_id", "left_semi")
        missing = tester(samples.join(open_tpl, "template_id", "left_semi"), todo_rules,
                         schema.join(open_tpl, "template_id", "left_semi"))
        # the test reads every open sample: its outcome is stored, and read below.  Only a
        # given H5 asks which samples failed
        if reflect is None:
            missing = missing.select("template_id", "field").distinct()
        missing = _stored(missing, "learn-missing")
        failing = missing.select("template_id").distinct()
        committed = open_tpl.join(failing, "template_id", "left_anti")
        done.append(committed.withColumn("status", F.lit("committed")).withColumn("attempts", F.lit(attempt)))
        # commit: reward the committed templates' rules
        win = committed.withColumn("outcome", F.lit(S.OUTCOME_VALUE["SUCCESS"]))
        lose = failing.withColumn("outcome", F.lit(S.OUTCOME_VALUE["FAILURE"]))
        rules = L.apply_template_outcomes(rules, win.unionByName(lose))
        # reflect: one retry rule per missing field with the next candidate
        miss_f = (missing.select("template_id", "field").distinct()
                  .join(rules.groupBy("template_id", "field").agg(F.max("cand").alias("cand")),
                        ["template_id", "field"], "left")
                  .withColumn("cand", F.coalesce(F.col("cand"), F.lit(-1)) + 1)
                  .withColumn("input_type", F.lit("md"))
                  .withColumn("ord", F.xxhash64("field")))
        ids = rules.groupBy("template_id").agg(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")).alias("max_id"))
        if reflect is not None:
            # H5 sees the already-penalised rules; its repairs are merged by
            # id, existing rules win
            repairs = reflect(rules, missing).join(rules.select("template_id", "id"),
                                                   ["template_id", "id"], "left_anti")
        else:
            repairs = L.add_rules(miss_f, ids, "retry_extract", 0.6, as_of).join(
                miss_f.select("template_id", "field", "cand"), ["template_id", "field"])
        rules = _stored(rules.unionByName(repairs.select(*rules.columns)), "learn-rules")
        open_tpl = _stored(failing, "learn-open")
        if open_tpl.isEmpty():
            break
    finished = done[0]
    for d in done[1:]:
        finished = finished.unionByName(d)
    result = (status.join(finished.withColumnRenamed("status", "s").withColumnRenamed("attempts", "a"),
                          "template_id", "left")
              .select("template_id", F.coalesce("s", "status").alias("status"),
                      F.coalesce("a", F.lit(max_retries)).alias("attempts")))
    named = rules.where(F.col("anchor").isNotNull())
    edges = named.select("template_id", F.col("id").alias("src"), F.col("anchor").alias("dst"),
                         F.lit("uses_anchor").alias("relation"), F.lit(1.0).alias("weight"))
    anchors = (named.join(result.where("status = 'committed'").select("template_id"), "template_id", "left_semi")
               .select("template_id", "field", F.lit("text_match").alias("type"), F.lit("label").alias("role"), F.col("anchor").alias("pattern")).distinct())
    return LearnResult(status=result, rules=rules, edges=edges, anchors=anchors)
