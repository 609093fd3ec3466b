"""Rule retrieval: direct match, one-hop graph expansion, signature
preference, provenance dedupe and top-k — for every input at once.

Plan shape: retrieval depends only on the *context* of an input, i.e.
``(template_id, input_type)`` for direct / graph rules and
``(template_id, signature)`` for pattern matches.  Each part is computed
once per distinct context (a few rows per template), truncated to top-k
as early as the semantics allow, and only then joined back to the inputs.
No step pairs rules with rules: graph expansion goes through
``(context, anchor)`` counts, so hub anchors cost linear work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.operators import lifecycle as L
from refbank.session import scratch_path

# what a rule does and shows: carried along as far as the bank has it
RULE_ACTION = ["action", "anchor", "pattern", "example_input", "example_output"]
RULE_BODY = ["id", "confidence", "support", "field", "ord", *RULE_ACTION]


def with_body(rules: DataFrame) -> DataFrame:
    """Rules with all body columns (null where the bank has no such column)."""
    missing = [c for c in RULE_ACTION if c not in rules.columns]
    return rules.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else rules


def prepare_inputs(inputs: DataFrame) -> DataFrame:
    """Add ``signature`` (MD5 of content) and ``input_type`` (from path)."""
    return inputs.withColumn("signature", S.signature("content")) \
                 .withColumn("input_type", S.input_type("path"))


def slim_inputs(inputs: DataFrame) -> DataFrame:
    """(input_id, template_id, input_type, signature), stored once: documents
    are read and hashed in one pass, and every later step reads this table."""
    if "content" not in inputs.columns:
        return inputs
    x = inputs if "signature" in inputs.columns else prepare_inputs(inputs)
    x = x.select("input_id", "template_id", "input_type", "signature")
    return _stored(x, "inputs")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quality_gate(rules: DataFrame) -> DataFrame:
    """F2: ``confidence >= 0.3`` with missing confidence counting as 0.0."""
    return rules.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= S.ARCHIVE_THRESHOLD)


def _dedupe_by_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, id): the best-confidence copy, file order on ties."""
    w = Window.partitionBy(*keys, "id").orderBy(
        F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), F.col("ord").asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def direct_rules(contexts: DataFrame, rules: DataFrame,
                 trigger: str = S.DEFAULT_TRIGGER) -> DataFrame:
    """F1 + F2 per ``(template_id, input_type)`` context.

    Rule trigger defaults to ``field_extraction``; rule input type defaults
    to the wildcard ``auto`` which matches every input type.
    """
    r = quality_gate(with_body(rules)).where(
        F.coalesce(F.col("trigger"), F.lit(S.DEFAULT_TRIGGER)) == F.lit(trigger))
    r = r.select("template_id",
                 F.coalesce(F.col("input_type"), F.lit(S.WILDCARD_INPUT_TYPE)).alias("rule_type"),
                 *RULE_BODY)
    c = contexts.select("template_id", "input_type").distinct()
    return (c.join(r, "template_id")
            .where((F.col("rule_type") == F.col("input_type"))
                   | (F.col("rule_type") == F.lit(S.WILDCARD_INPUT_TYPE)))
            .drop("rule_type"))


def _edges(edges: DataFrame, relation: str) -> DataFrame:
    """Edges of one relation.  Repeated ones do no harm: they are only met by
    semi-joins or counted distinctly."""
    return edges.where(F.col("relation") == relation).select("template_id", "src", "dst")


def _types_of_rules(direct: DataFrame) -> DataFrame:
    """(template_id, id, types): the input types each rule is direct for, one
    row per rule.  Types are structs: a null one counts as a type."""
    return (direct.where("id IS NOT NULL AND template_id IS NOT NULL").groupBy("id", "template_id")
            .agg(F.array_sort(F.collect_set(F.struct("input_type"))).alias("types")))


def _anchors_in_use(types: DataFrame, uses: DataFrame) -> DataFrame:
    """(template_id, dst, lone, many): per anchor the input types with one direct
    rule using it, and those with more.  Rules are counted by their list of
    types, so a rule that is direct for all types is one row."""
    used = (uses.join(types.withColumnRenamed("id", "src").hint("shuffle_hash"), ["src", "template_id"])
            .select("src", "template_id", "dst", "types").distinct())
    each = (used.groupBy("dst", "template_id", "types").agg(F.count(F.lit(1)).alias("n"))
            .select("dst", "template_id", F.explode("types").alias("t"), "n")
            .groupBy("dst", "template_id", "t").agg(F.sum("n").alias("n")))
    return (each.groupBy("dst", "template_id")
            .agg(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("t")))).alias("lone"),
                 F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("t")))).alias("many")))


def shared_anchor_neighbors(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules sharing an anchor with some *other* direct rule.

    A rule using an anchor qualifies for every type in which at least two direct
    rules use it, and for those with one if that is not the rule itself.  Types
    stay in one row per edge and are written out per rule at the end: an edge is
    moved once by rule and once by anchor, whatever the number of types.  Output
    is distinct (template_id, input_type, id)."""
    types = _types_of_rules(direct)
    uses = _edges(edges, "uses_anchor")
    seen = (uses.join(_anchors_in_use(types, uses).hint("shuffle_hash"), ["dst", "template_id"])
            .select("src", "template_id", "lone", "many").distinct()
            .groupBy("src", "template_id")
            .agg(F.array_distinct(F.flatten(F.collect_set("lone"))).alias("lone"), F.array_distinct(F.flatten(F.collect_set("many"))).alias("many")))
    none = F.array().cast("array<struct<input_type:string>>")
    others = F.when(F.col("src").isNotNull(), F.array_except("lone", F.coalesce("types", none))).otherwise(none)
    return (seen.join(types.withColumnRenamed("id", "src"), ["src", "template_id"], "left")
            .select("template_id", "src", F.explode(F.array_union("many", others)).alias("t"))
            .select("template_id", "t.input_type", F.col("src").alias("id")))


def follows_neighbors(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets of ``often_follows`` edges leaving a direct rule."""
    fol = _edges(edges, "often_follows")
    d_ids = direct.select("template_id", "input_type", F.col("id").alias("src")).distinct()
    return (d_ids.join(fol, ["template_id", "src"])
            .select("template_id", "input_type", F.col("dst").alias("id"))
            .distinct())


def kg_expand(direct: DataFrame, edges: DataFrame, rules: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """J4 + J5: one-hop neighbours minus the direct set, as rule rows (F2).

    It starts from the rules that may come in: per context those of its template
    that pass the gate and are not direct.  ``above(template_id, input_type,
    floor)`` leaves out, before any edge is read, those whose confidence does not
    exceed the context's floor (null: no floor).  A rule that is not direct shares an anchor with *another* rule
    as soon as a direct rule uses it, so its edges are probed against the
    contexts' distinct anchors; a hub anchor is one row there, and no rule is
    paired with a rule."""
    keys = ["template_id", "input_type"]
    contexts = direct.select(*keys).distinct()
    cand = contexts.join(quality_gate(with_body(rules)).select("template_id", *RULE_BODY), "template_id")
    if above is not None:
        cand = (cand.join(above, keys, "left").where(F.col("floor").isNull() | (F.coalesce("confidence", F.lit(0.0)) > F.col("floor")))
                .drop("floor"))
    cand = cand.join(direct.select(*keys, "id"), [*keys, "id"], "left_anti")
    if above is not None:
        # read twice below; few pass the floor, and a stored table's size is known: the edges need not be moved to meet them
        cand = _stored(cand, "candidates")
    uses = _edges(edges, "uses_anchor")
    anchors = direct.select(*keys, "id").join(uses.withColumnRenamed("src", "id"), ["template_id", "id"]).select(*keys, "dst").distinct()
    sharing = (cand.select(*keys, "id").join(uses.withColumnRenamed("src", "id"), ["template_id", "id"])
               .join(anchors, [*keys, "dst"], "left_semi").select(*keys, "id"))
    return cand.join(sharing.unionByName(follows_neighbors(direct, edges)), [*keys, "id"], "left_semi")


def match_patterns(sig_contexts: DataFrame, patterns: DataFrame,
                   top_k: int = 3, threshold: float = 0.8) -> DataFrame:
    """J1 / F3 / W3 per (template_id, signature).

    Exact signature matches ranked by accuracy (stable on file order); when a
    context has none, the template's accurate patterns (>= threshold).  Both
    lists are cut to ``top_k`` on the pattern side before joining, so the
    join carries at most ``top_k`` rows per context.
    """
    p = patterns.select("template_id", "pattern_id", "input_signature",
                        F.coalesce(F.col("accuracy"), F.lit(0.0)).alias("acc"),
                        "accuracy", "rules_used", "ord")
    by_sig = Window.partitionBy("template_id", "input_signature").orderBy(F.col("acc").desc(), "ord")
    exact = (p.withColumn("rank", F.row_number().over(by_sig)).where(F.col("rank") <= top_k)
             .withColumnRenamed("input_signature", "signature"))
    by_tpl = Window.partitionBy("template_id").orderBy(F.col("acc").desc(), "ord")
    fallback = (p.where(F.col("acc") >= threshold)
                .withColumn("rank", F.row_number().over(by_tpl)).where(F.col("rank") <= top_k)
                .drop("input_signature"))
    ctx = sig_contexts.select("template_id", "signature").distinct()
    hit = ctx.join(exact, ["template_id", "signature"]).withColumn("exact", F.lit(True))
    miss = (ctx.join(p.select("template_id", F.col("input_signature").alias("signature")).distinct(),
                     ["template_id", "signature"], "left_anti")
            .join(fallback, "template_id").withColumn("exact", F.lit(False)))
    cols = ["template_id", "signature", "rank", "pattern_id", "accuracy", "rules_used", "exact"]
    return hit.select(*cols).unionByName(miss.select(*cols))


def via_signature(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules named in the matched patterns' ``rules_used`` (F2, any type)."""
    pref = (matched.select("template_id", "signature", F.explode("rules_used").alias("id"))
            .distinct())
    body = quality_gate(with_body(rules)).select("template_id", *RULE_BODY)
    return pref.join(body, ["template_id", "id"])


def new_variants(inputs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``signature_mismatch`` = the template has patterns, none with this
    signature."""
    has = patterns.select("template_id").distinct().withColumn("has_patterns", F.lit(True))
    sigs = (patterns.select("template_id", F.col("input_signature").alias("signature")).distinct()
            .withColumn("matched", F.lit(True)))
    return (inputs.join(has, "template_id", "left").join(sigs, ["template_id", "signature"], "left")
            .withColumn("signature_mismatch",
                        F.coalesce(F.col("has_patterns"), F.lit(False)) & F.col("matched").isNull())
            .drop("has_patterns", "matched"))


def retrieve_rules(inputs: DataFrame, rules: DataFrame, edges: DataFrame, patterns: DataFrame,
                   as_of=None, trigger: str = S.DEFAULT_TRIGGER, top_k: int = 10,
                   use_signature: bool = True, matched: DataFrame | None = None) -> DataFrame:
    """X1 for every input: (input_id, template_id, rank, id, source, confidence,
    support, field) and the rule's action, anchor, pattern and example.

    Decay (L3) runs first when ``as_of`` is given.  Provenance: a rule keeps
    the strongest source (via_signature > direct > via_kg) but the position
    of its best copy (confidence desc, then direct, via_kg, via_signature
    list order, then file order).
    """
    x = slim_inputs(inputs)
    bank = L.decay_rules(rules, as_of) if as_of is not None else rules
    # One distinct pass over the slim inputs; the smaller contexts derive from it.
    full_ctx = x.select("template_id", "input_type", "signature").distinct()
    type_ctx = full_ctx.select("template_id", "input_type").distinct()
    # read five times below; a few rows per context
    direct = _stored(direct_rules(type_ctx, bank, trigger), "direct")
    # list rank: 0 = direct, 1 = via_kg, 2 = via_signature (reference list order)
    tkeys = ["template_id", "input_type"]

    def best(rows: DataFrame) -> DataFrame:
        # A candidate outside its type context's top-k can never reach the final
        # top-k (signature copies only rank later), so cut here.
        return (rows.withColumn("_r", F.row_number().over(Window.partitionBy(*tkeys).orderBy("pos")))
                .where(F.col("_r") <= top_k).drop("_r"))

    ours = best(_fold_copies(direct.withColumn("list_rank", F.lit(0)).withColumn("prec", F.lit(2)), tkeys))
    # a neighbour reaches the top-k only above the k-th direct rule (on equal confidence it ranks later)
    floor = (ours.groupBy(*tkeys).agg(F.count(F.lit(1)).alias("n"), F.max("pos.nc").alias("nc")).where(F.col("n") >= top_k)
             .select(*tkeys, (-F.col("nc")).alias("floor")))
    theirs = _fold_copies(kg_expand(direct, edges, bank, floor).withColumn("list_rank", F.lit(1)).withColumn("prec", F.lit(1)), tkeys)
    typed = best(ours.unionByName(theirs))
    cand = full_ctx.join(typed, tkeys)
    if use_signature:
        sig_ctx = full_ctx.select("template_id", "signature").distinct()
        m = matched if matched is not None else match_patterns(sig_ctx, patterns)
        via_sig = (via_signature(m, bank)
                   .withColumn("list_rank", F.lit(2)).withColumn("prec", F.lit(3)))
        cand = cand.unionByName(full_ctx.join(_copy_keys(via_sig), ["template_id", "signature"])
                                .select(*cand.columns))
    keys = ["template_id", "input_type", "signature"]
    # min(pos) / max(best) are associative, so folding per type context
    # first and per full context afterwards gives the one-pass result.
    # A full context holds at most top_k + |signature rules| candidates, so
    # one shuffle on the context serves both the fold and the ranking window.
    per_rule = (cand.repartition(*keys)
                .groupBy(*keys, "id").agg(F.min("pos").alias("pos"), F.max("best").alias("best")))
    wr = Window.partitionBy(*keys).orderBy("pos")
    ranked = (per_rule.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= top_k)
              .select(*keys, "rank",
                      F.col("best.body.id").alias("id"),
                      F.when(F.col("best.prec") == 3, "via_signature")
                       .when(F.col("best.prec") == 2, "direct").otherwise("via_kg").alias("source"),
                      F.col("best.body.confidence").alias("confidence"),
                      F.col("best.body.support").alias("support"),
                      *[F.col(f"best.body.{c}").alias(c) for c in ["field", *RULE_ACTION]]))
    return (x.select("input_id", *keys).join(ranked, keys)
            .select("input_id", "template_id", "rank", "id", "source", "confidence", "support", "field",
                    *RULE_ACTION))


def _copy_keys(df: DataFrame) -> DataFrame:
    """Position key and body key of each rule copy (see :func:`_fold_copies`)."""
    conf0 = F.coalesce(F.col("confidence"), F.lit(0.0))
    return df.select(
        *[c for c in df.columns if c not in RULE_BODY + ["list_rank", "prec"]], "id",
        F.struct((-conf0).alias("nc"), "list_rank", "ord").alias("pos"),
        F.struct("prec", conf0.alias("c"), (-F.col("list_rank")).alias("nl"), (-F.col("ord")).alias("no"),
                 F.struct(*RULE_BODY).alias("body")).alias("best"))


def _fold_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, id): the position of the best copy (confidence desc, list
    order, file order) and the body of the strongest-source copy (Q10)."""
    k = _copy_keys(df)
    return k.groupBy(*keys, "id").agg(F.min("pos").alias("pos"), F.max("best").alias("best"))


def retrieval_context(inputs: DataFrame, rules: DataFrame, edges: DataFrame,
                      patterns: DataFrame, anchors: DataFrame, as_of=None,
                      top_k: int = 10) -> DataFrame:
    """Per input signature, type, retrieved rule ids, matched patterns,
    anchor count and the new-variant flag."""
    x = slim_inputs(inputs)
    matched = match_patterns(x.select("template_id", "signature").distinct(), patterns)
    got = retrieve_rules(x, rules, edges, patterns, as_of=as_of, top_k=top_k, matched=matched)
    rule_list = (got.groupBy("input_id")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))),
                                               lambda s: s["id"]), ",").alias("rule_ids"),
                      F.count("*").alias("n_rules")))
    mlist = (matched.groupBy("template_id", "signature")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pattern_id"))),
                                           lambda s: s["pattern_id"]), ",").alias("matched_patterns")))
    n_anchor = anchors.groupBy("template_id").agg(F.count("*").alias("n_anchors"))
    nv = new_variants(x, patterns)
    return (nv.join(rule_list, "input_id", "left")
            .join(mlist, ["template_id", "signature"], "left")
            .join(n_anchor, "template_id", "left")
            .select("input_id", "template_id", "signature", "input_type",
                    F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
                    F.coalesce("rule_ids", F.lit("")).alias("rule_ids"),
                    F.coalesce("matched_patterns", F.lit("")).alias("matched_patterns"),
                    F.coalesce("n_anchors", F.lit(0)).cast("long").alias("n_anchors"),
                    "signature_mismatch"))


def query_anchors(anchors: DataFrame, field: str | None = None) -> DataFrame:
    """every anchor, or only the anchor of ``field``."""
    return anchors if field is None else anchors.where(F.col("field") == field)
