"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables through :mod:`refbank.plans.fixtures`
and runs an operator over the whole tables.  Array results are flattened
with ``array_join`` and counts cast to ``long`` so both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refbank.functions import scalars as S
from refbank.operators import lifecycle as L
from refbank.operators import retrieval as R
from refbank.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register ``fn``; the bank's instants are UTC wall-clock times, so the
    session time zone is pinned to UTC before the plan is built."""
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str, *a, **kw) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir, *a, **kw)

    REGISTRY[fn.__name__.removeprefix("q_")] = run
    return run


def _ids(arr) -> F.Column:
    return F.array_join(arr, ",")


# --- phase 1: slice ---------------------------------------------------------

@query
def q_scan_inputs(spark, d):
    return X.inputs(spark, d)


@query
def q_input_signature(spark, d):
    return X.inputs(spark, d).select("input_id", S.signature("content").alias("signature"))


@query
def q_input_type(spark, d):
    return X.inputs(spark, d).select("input_id", "path", S.input_type("path").alias("input_type"))


@query
def q_retrieve_direct(spark, d, top_k: int = 10):
    x = R.prepare_inputs(X.inputs(spark, d))
    ctx = x.select("template_id", "input_type").distinct()
    direct = R._dedupe_by_id(R.direct_rules(ctx, X.rules(spark, d)), ["template_id", "input_type"])
    w = Window.partitionBy("template_id", "input_type").orderBy(F.col("confidence").desc(), "ord")
    top = direct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return (x.select("input_id", "template_id", "input_type").join(top, ["template_id", "input_type"])
            .select("input_id", F.col("rank").cast("long").alias("rank"), "id", "confidence"))


# --- phase 2: retrieval -------------------------------------------------------

@query
def q_match_patterns(spark, d):
    x = R.prepare_inputs(X.inputs(spark, d))
    m = R.match_patterns(x.select("template_id", "signature"), X.patterns(spark, d))
    return (x.select("input_id", "template_id", "signature").join(m, ["template_id", "signature"])
            .select("input_id", F.col("rank").cast("long").alias("rank"), "pattern_id", "accuracy", "exact"))


def _type_direct(spark, d):
    x = R.prepare_inputs(X.inputs(spark, d))
    ctx = x.select("template_id", "input_type").distinct()
    return R.direct_rules(ctx, X.rules(spark, d))


@query
def q_kg_shared_anchor(spark, d):
    return R.shared_anchor_neighbors(_type_direct(spark, d), X.edges(spark, d))


@query
def q_kg_often_follows(spark, d):
    return R.follows_neighbors(_type_direct(spark, d), X.edges(spark, d))


@query
def q_kg_expand(spark, d):
    out = R.kg_expand(_type_direct(spark, d), X.edges(spark, d), X.rules(spark, d))
    return out.select("template_id", "input_type", "id", "confidence")


@query
def q_via_signature(spark, d):
    x = R.prepare_inputs(X.inputs(spark, d))
    m = R.match_patterns(x.select("template_id", "signature"), X.patterns(spark, d))
    v = R.via_signature(m, X.rules(spark, d)).select("template_id", "signature", "id", "confidence").distinct()
    return (x.select("input_id", "template_id", "signature").join(v, ["template_id", "signature"])
            .select("input_id", "id", "confidence"))


@query
def q_new_variants(spark, d):
    x = R.prepare_inputs(X.inputs(spark, d))
    return R.new_variants(x, X.patterns(spark, d)).select("input_id", "signature_mismatch")


@query
def q_query_anchors(spark, d):
    return R.query_anchors(X.anchors(spark, d), "f_1")


def _retrieved(spark, d):
    return R.retrieve_rules(X.inputs(spark, d), X.rules(spark, d), X.edges(spark, d),
                            X.patterns(spark, d), as_of=X.as_of())


@query
def q_retrieve_rules(spark, d):
    return _retrieved(spark, d).select("input_id", F.col("rank").cast("long").alias("rank"),
                                       "id", "source", "confidence")


@query
def q_retrieval_context(spark, d):
    return R.retrieval_context(X.inputs(spark, d), X.rules(spark, d), X.edges(spark, d),
                               X.patterns(spark, d), X.anchors(spark, d), as_of=X.as_of())


# --- phase 3: lifecycle -------------------------------------------------------

def _latest_outcome(spark, d):
    o = X.outcomes(spark, d)
    return (o.groupBy("template_id")
            .agg(F.max_by("v", F.struct("ts", "event_id")).alias("v"))
            .select("template_id",
                    F.when(F.col("v") > 0, S.OUTCOME_VALUE["SUCCESS"])
                     .when(F.col("v") < 0, S.OUTCOME_VALUE["FAILURE"])
                     .otherwise(S.OUTCOME_VALUE["PARTIAL"]).alias("outcome")))


@query
def q_apply_outcome(spark, d):
    out = L.apply_template_outcomes(X.rules(spark, d), _latest_outcome(spark, d))
    return out.select("template_id", "id", "confidence", "support")


@query
def q_replay_outcomes(spark, d):
    out = L.replay_outcomes(X.rules(spark, d), X.outcomes(spark, d))
    return out.select("template_id", "id", "confidence", "support", "archived")


@query
def q_decay_rules(spark, d):
    return L.decay_rules(X.rules(spark, d), X.as_of()).select("template_id", "id", "confidence")


@query
def q_touch_rules(spark, d):
    out = L.touch_rules(X.rules(spark, d), X.retrieved(spark, d), X.as_of())
    return out.select("template_id", "id",
                      F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query
def q_archived_counts(spark, d):
    return L.archived_counts(X.rules(spark, d), _latest_outcome(spark, d), X.as_of())


def _base_ids(spark, d):
    return L.next_ids(X.rules(spark, d), X.patterns(spark, d), X.edges(spark, d))


@query
def q_next_ids(spark, d):
    return _base_ids(spark, d)


def draft_requests(spark, d):
    """Field specs to draft: one per part, anchored on even sizes."""
    p = X.table(spark, d, "part").select("p_partkey", "p_size")
    return p.select(
        F.concat(F.lit("src"), (F.col("p_partkey") % X.N_TEMPLATES).cast("string")).alias("template_id"),
        F.lit("md").alias("input_type"),
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("field"),
        F.when(F.col("p_size") % 2 == 0,
               F.concat(F.lit("A"), (F.col("p_partkey") % 100).cast("string"))).alias("anchor"),
        F.col("p_partkey").alias("ord"))


@query
def q_draft_rules(spark, d):
    drafted, _ = L.draft_rules(draft_requests(spark, d), _base_ids(spark, d), X.as_of())
    return drafted.select("template_id", "id", "field", "action", "anchor", "confidence", "support")


@query
def q_append_edges(spark, d):
    e = X.edges(spark, d)
    _, new_edges = L.draft_rules(draft_requests(spark, d), _base_ids(spark, d), X.as_of())
    proposed = new_edges.unionByName(e.where(F.col("relation") == "uses_anchor"))
    return L.append_edges(e, proposed).select("template_id", "src", "dst", "relation")


@query
def q_reflect_rules(spark, d):
    missing = draft_requests(spark, d).where(F.col("anchor").isNull()).drop("anchor")
    out = L.reflect_rules(X.rules(spark, d), missing, _base_ids(spark, d), X.as_of())
    return out.select("template_id", "id", "field", "action", "confidence", "support")


@query
def q_record_patterns(spark, d):
    x = R.prepare_inputs(X.inputs(spark, d))
    got = X.retrieved(spark, d)
    per = got.groupBy("input_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("rule_ids"),
        F.array_sort(F.collect_set("field")).alias("fields"))
    runs = (x.select("input_id", "template_id", "signature", "input_type").join(per.hint("merge"), "input_id", "left")
            .select("template_id", "input_id", "signature", "input_type",
                    F.when(F.col("rule_ids").isNull(), 2).otherwise(1).alias("level"),
                    F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"),
                    F.coalesce("fields", F.array().cast("array<string>")).alias("fields"),
                    F.col("input_id").alias("ord")))
    out = L.record_patterns(X.patterns(spark, d), runs, X.as_of())
    return out.select("template_id", "input_id", "pattern_id", "input_signature", "input_type",
                      "accuracy", _ids(F.col("rules_used")).alias("rules_used"),
                      _ids(F.col("fields_extracted")).alias("fields_extracted"))


# --- phase 4: failure memory ---------------------------------------------------

from refbank.operators import memory as M  # noqa: E402


def _log(spark, d):
    return M.enrich_events(X.exec_log(spark, d))


@query
def q_read_exec_log(spark, d):
    return _log(spark, d).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        "template_signature", "error_type",
        _ids(F.col("missing_fields")).alias("missing_fields"), "repair_action")


@query
def q_cluster_key(spark, d):
    return _log(spark, d).select("event_id", "cluster_key")


@query
def q_event_id(spark, d):
    e = X.exec_log(spark, d)
    return e.select("event_id", S.event_id(F.col("ts"), F.col("template_signature"), F.col("error_type"),
                                           S.normalize_fields(F.col("missing_fields")),
                                           F.col("repair_action")).alias("eid"))


@query
def q_failure_clusters(spark, d):
    return M.failure_clusters(_log(spark, d)).select(
        "cluster_key", "samples", "signature", "error_type", "missing_fields", "first_event", "last_event",
        F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


@query
def q_top_repair(spark, d):
    return M.top_repair(_log(spark, d))


@query
def q_summary_rules(spark, d):
    return M.summary_rules(_log(spark, d)).select(
        "id", "template_signature", "error_type", "missing_fields", "repair_action", "support", "vote_rate")


@query
def q_cluster_events(spark, d):
    return M.cluster_events(_log(spark, d)).select("cluster_key", "event_id")


@query
def q_cluster_update(spark, d):
    """Summary rules after the last day of the log was added to the rest."""
    log = _log(spark, d).withColumn("day", F.to_date("ts"))
    last = log.agg(F.max("day")).first()[0]
    votes = M.update_votes(M.cluster_votes(log.where(F.col("day") < F.lit(last))), M.cluster_votes(log.where(F.col("day") == F.lit(last))))
    return M.summary_rules(None, votes=votes).select(
        "id", "template_signature", "error_type", "missing_fields", "repair_action", "support", "vote_rate")


def repair_queries(spark, d):
    """Lookup requests: every distinct failure shape of the log, as raised."""
    e = X.exec_log(spark, d).where(F.col("error_type").isNotNull())
    return (e.select("template_signature", "error_type", "missing_fields").distinct()
            .withColumn("query_id", F.concat_ws("|", "template_signature", "error_type",
                                                F.array_join("missing_fields", ","))))


@query
def q_suggest_repairs(spark, d):
    rules = M.summary_rules(_log(spark, d))
    return M.suggest_repairs(rules, repair_queries(spark, d)).select("query_id", "id")


@query
def q_relearn_candidates(spark, d):
    return M.relearn_candidates(M.enrich_events(X.open_log(spark, d)))


# --- phase 5: cells, bindings, formulas ----------------------------------------------

from refbank.operators import cells as C  # noqa: E402


@query
def q_schema_fields(spark, d):
    return X.schema_fields(spark, d).drop("ord")


@query
def q_resolve_bindings(spark, d):
    return C.resolve_bindings(X.schema_fields(spark, d)).select("tpl", "field", "cell", "row", "col")


@query
def q_collect_cells(spark, d):
    return C.collect_cells(X.cells(spark, d)).select("workbook_id", "sheet", "row", "col", "cell", "value")


@query
def q_normalize_values(spark, d):
    gen, _ = X.diff_tables(spark, d)
    return gen.select("c_custkey", F.col("c_name").alias("raw"), S.normalize_value("c_name").alias("normalized"))


@query
def q_formula_dependencies(spark, d):
    f = C.formula_cells(X.cells(spark, d))
    return f.select("workbook_id", "sheet", "cell", _ids(F.col("depends_on")).alias("depends_on"))


@query
def q_formula_cells(spark, d):
    f = C.formula_cells(X.cells(spark, d))
    return f.select("workbook_id", "sheet", "row", "col", "cell", "formula",
                    _ids(F.col("depends_on")).alias("depends_on"))


@query
def q_shift_cells(spark, d):
    c = X.cells(spark, d)
    ref = S.a1(F.col("row"), F.col("col"))
    ref = F.when(F.col("row") % 2 == 0, F.lower(ref)).otherwise(ref)
    dr = (F.col("row") % 4 - 2)
    dc = (F.col("col") % 5 - 2) * 30
    return c.select("workbook_id", "sheet", "row", "col", ref.alias("ref"),
                    dr.cast("long").alias("dr"), dc.cast("long").alias("dc"),
                    S.shift_cell(ref, dr, dc).alias("shifted"))


@query
def q_cell_neighbors(spark, d):
    return C.cell_neighbors(X.cells(spark, d)).drop("row", "col")


def template_sheet(spark, d):
    """Each schema template writes into sheet R of the workbook with its number."""
    tpls = X.schema_fields(spark, d).select("tpl").distinct()
    cells = X.cells(spark, d).where(F.col("sheet") == "R").select(
        F.concat(F.lit("tpl"), F.col("workbook_id").cast("string")).alias("tpl"), "row", "col", "value")
    return cells.join(tpls, "tpl", "left_semi")


def template_data(spark, d):
    """Extracted values per template field."""
    p = X.table(spark, d, "part").select("p_partkey", "p_name")
    return (p.select(F.concat(F.lit("tpl"), F.floor(F.col("p_partkey") / 100).cast("string")).alias("tpl"),
                    F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("field"),
                    F.col("p_name").alias("value")))


def _conflicts(spark, d):
    b = C.resolve_bindings(X.schema_fields(spark, d))
    return b, C.formula_conflicts(b, template_sheet(spark, d), template_data(spark, d))


@query
def q_formula_conflicts(spark, d):
    _, (conf, _) = _conflicts(spark, d)
    return conf


@query
def q_fill_template(spark, d):
    b, (_, cleaned) = _conflicts(spark, d)
    assigned = C.bind_values(b, cleaned)
    return C.fill_template(template_sheet(spark, d), assigned).select("tpl", "cell", "value", "filled")


# --- phase 6: layout ----------------------------------------------------------------

from refbank.operators import layout as LY  # noqa: E402


@query
def q_sheet_layout(spark, d):
    return LY.sheet_layout(X.cells(spark, d))


@query
def q_template_profile(spark, d):
    return LY.template_profile(X.cells(spark, d))


@query
def q_layout_similarity(spark, d):
    return LY.layout_similarity(X.cells(spark, d), X.layout_pairs(spark, d))


@query
def q_layout_compat(spark, d):
    return LY.layout_compat(X.cells(spark, d), X.layout_pairs(spark, d))


from refbank.operators import layout_search as LS  # noqa: E402


@query
def q_layout_classes(spark, d):
    return LS.layout_classes(X.form_cells(spark, d))


@query
def q_layout_search(spark, d):
    return LS.compatible_layouts(X.form_cells(spark, d))


@query
def q_layout_routing(spark, d):
    c = LY.layout_compat(X.cells(spark, d), X.layout_pairs(spark, d))
    return LY.layout_routing(c).select("x", "y", "compatibility", "route")


# --- phase 7: extraction --------------------------------------------------------------

from refbank.operators import diff as D  # noqa: E402
from refbank.operators import extract as E  # noqa: E402

LEVEL_ERRORS = ["invalid JSON response", "no anchors-only extractor configured", "no rule matched"]


@query
def q_parse_responses(spark, d):
    p = E.parse_responses(X.responses(spark, d))
    return p.select("input_id", "ok", F.explode_outer("data").alias("key", "value"))


@query
def q_rule_extract(spark, d):
    return E.rule_extract(X.page_inputs(spark, d).drop("content"), X.web_rules(spark)).drop("template_id")


def _levels(spark, d):
    p = E.parse_responses(X.responses(spark, d)).withColumn(
        "error", F.when(~F.col("ok"), F.lit(LEVEL_ERRORS[0])))
    pages = X.page_inputs(spark, d)
    lvl2 = pages.select("input_id", F.lit(False).alias("ok"), F.lit(None).cast("map<string,string>").alias("data"),
                        F.lit(LEVEL_ERRORS[1]).alias("error"))
    rx = E.rule_extract(pages.drop("content"), X.web_rules(spark))
    got = rx.groupBy("input_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("data"))
    lvl3 = (pages.select("input_id").join(got, "input_id", "left")
            .select("input_id", F.col("data").isNotNull().alias("ok"), "data",
                    F.when(F.col("data").isNull(), F.lit(LEVEL_ERRORS[2])).alias("error")))
    return E.extract_cascade([p, lvl2, lvl3])


@query
def q_extract_cascade(spark, d):
    c = _levels(spark, d)
    return c.select("input_id", "level", _ids(F.array_sort(F.map_keys("data"))).alias("fields"), "error")


def _page_missing(spark, d, extracted):
    schema = spark.createDataFrame([(X.WEB_TEMPLATE, f) for f in X.PAGE_SCHEMA_FIELDS], "template_id string, field string")
    return C.missing_fields(schema, extracted)


@query
def q_missing_fields(spark, d):
    ex = X.extracted(spark, d).withColumn("template_id", F.lit(X.WEB_TEMPLATE))
    miss = _page_missing(spark, d, ex)
    per = miss.groupBy("input_id").agg(_ids(F.array_sort(F.collect_list("field"))).alias("missing"),
                                       F.count("*").alias("n_missing"))
    pages = X.page_inputs(spark, d).select("input_id")
    return (pages.join(per, "input_id", "left")
            .select("input_id", F.coalesce("missing", F.lit("")).alias("missing"),
                    F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing")))


@query
def q_run_status(spark, d):
    c = _levels(spark, d)
    ex = (c.select("input_id", F.explode("data").alias("field", "value"))
          .withColumn("template_id", F.lit(X.WEB_TEMPLATE)))
    keys = c.select("input_id").withColumn("template_id", F.lit(X.WEB_TEMPLATE))
    schema = spark.createDataFrame([(X.WEB_TEMPLATE, f) for f in X.PAGE_SCHEMA_FIELDS], "template_id string, field string")
    miss = (keys.join(schema, "template_id")
            .join(ex.select("input_id", "field"), ["input_id", "field"], "left_anti"))
    return E.run_status(c, miss).select("input_id", "status", "stage", "level", "missing_fields", "message")


@query
def q_few_shot_text(spark, d):
    return E.few_shot_block(X.retrieved(spark, d), X.inputs(spark, d))


@query
def q_build_prompts(spark, d):
    x = R.slim_inputs(X.inputs(spark, d))
    m = R.match_patterns(x.select("template_id", "signature").distinct(), X.patterns(spark, d))
    got = X.retrieved(spark, d)
    fs = E.few_shot_block(got, x)
    # template srcN writes into sheet R of workbook N, whose formulas it must leave alone
    sheet = X.cells(spark, d).where((F.col("workbook_id") < X.N_TEMPLATES) & (F.col("sheet") == "R"))
    formulas = C.formula_cells(sheet).select(F.concat(F.lit("src"), F.col("workbook_id").cast("string")).alias("template_id"),
                                             "row", "col", "cell", "formula", "depends_on")
    tf, ta = E.template_sections(X.anchors(spark, d), formulas)
    mt = E.pattern_section(x.select("input_id", "template_id", "signature").join(m, ["template_id", "signature"]))
    # the text is read once more, for the prompt itself
    inp = X.inputs(spark, d).withColumn("template_signature", F.md5("template_id"))
    p = E.build_prompts(inp, fs, tf, ta, mt)
    return p.select("input_id", F.length("prompt").cast("long").alias("prompt_chars"),
                    F.md5("prompt").alias("prompt_md5"))


@query
def q_data_diff(spark, d):
    gen, bench = X.diff_tables(spark, d)
    return D.data_diff(gen, bench, "c_custkey").withColumnRenamed("column", "col_name")


@query
def q_positional_diff(spark, d):
    gen, bench = X.diff_tables(spark, d)
    # the generated table lost its first segment's smallest customer: every later row moves up by one
    gen = gen.where(F.col("c_custkey") != 3)
    return D.positional_diff(gen, bench, ["c_mktsegment", "c_custkey"], ["c_mktsegment", "c_custkey"]).withColumnRenamed("column", "col_name")


# --- phase 10: declared checks ---------------------------------------------------------

from refbank.operators import validate as V  # noqa: E402


@query
def q_validate_types(spark, d):
    pg = X.table(spark, d, "pages").select("page_id", "url", "html")
    parts = [pg.select(F.col("page_id").alias("input_id"), F.lit(f).alias("field"),
                       F.regexp_extract(F.col(src), rx, 1).alias("value"), F.lit(t).alias("type"))
             for f, rx, src, t in X.TYPED_PAGE_FIELDS]
    vals = parts[0]
    for p in parts[1:]:
        vals = vals.unionByName(p)
    return V.validate_types(vals.where(F.col("value") != ""))


@query
def q_check_formulas(spark, d):
    li = X.table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber", "l_shipdate", "l_quantity")
    nums = (li.groupBy(F.col("l_partkey").alias("workbook_id"), F.col("l_returnflag").alias("sheet"), F.col("l_linenumber").cast("long").alias("row"),
                       F.month("l_shipdate").cast("long").alias("col"))
            .agg(F.sum("l_quantity").alias("num")))
    return V.check_formulas(C.formula_cells(X.cells(spark, d)), nums)


@query
def q_check_unique(spark, d):
    x = R.prepare_inputs(X.inputs(spark, d))
    return V.check_unique(x, ["template_id", "signature"])


@query
def q_list_templates(spark, d):
    return V.list_templates(X.rules(spark, d), X.patterns(spark, d))


# --- rule actions ---------------------------------------------------------------------

from refbank.operators import actions as A  # noqa: E402


@query
def q_anchor_extract(spark, d):
    return A.anchor_extract(X.forms(spark, d), X.form_rules(spark))


@query
def q_header_extract(spark, d):
    return A.header_extract(X.forms(spark, d), X.form_rules(spark))


@query
def q_bank_extract(spark, d):
    return A.bank_extract(X.forms(spark, d), X.form_rules(spark))


from refbank.operators import induce as I  # noqa: E402


@query
def q_induce_anchors(spark, d):
    return I.induce_anchors(X.forms(spark, d), X.form_values(spark, d))


# --- phase 9: streaming ------------------------------------------------------------

from refbank.streaming import jobs as ST  # noqa: E402


@query
def q_stream_ingest(spark, d):
    return ST.stream_ingest(spark, d).select("event_id", "cluster_key")


@query
def q_stream_clusters(spark, d):
    return ST.stream_clusters(spark, d).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "cluster_key", "samples")


@query
def q_stream_lifecycle(spark, d):
    return ST.stream_lifecycle(spark, d).select("template_id", "id", "confidence", "support", "archived")


# --- phase 7/8: batch run and learning loop (rows-only) ---------------------------------

from refbank.plans import batch as B  # noqa: E402
from refbank.plans import learning as LN  # noqa: E402


def _web_schema(spark, templates: DataFrame | None = None):
    """Required fields of the web template(s): the fixed page field list."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).cast("long").alias("ord"))
                       for i, f in enumerate(X.PAGE_SCHEMA_FIELDS)])
    t = templates if templates is not None else spark.range(1).select(F.lit(X.WEB_TEMPLATE).alias("template_id"))
    return t.select("template_id", F.explode(fields).alias("f")).select("template_id", "f.field", "f.ord")


@query
def q_run_batch(spark, d):
    pages = X.page_inputs(spark, d).withColumn("path", F.col("url"))
    res = B.run_batch(spark, pages, B.web_bank(spark), _web_schema(spark).select("template_id", "field"),
                      as_of=X.AS_OF)
    return res.status.select("input_id", "status", "level", "missing_fields")


def learn_forms(spark, d):
    """The learning loop over every form: labels are induced from all forms with
    their known values, tested on all of them, and ids go on after the bank's."""
    forms, known = X.forms(spark, d), X.form_values(spark, d)
    ranked = LN._stored(I.rank_anchors(forms, known), "learn-ranked")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).cast("long").alias("ord")) for k, f in enumerate(X.FORM_LABELS)])
    schema = forms.select("template_id").distinct().select("template_id", F.inline(fields))
    base = X.form_rules(spark).groupBy("template_id").agg(F.count(F.lit(1)).alias("max_id"))
    return LN.learn_cycle(spark, forms, schema, LN.anchor_tester(ranked, known), analyse=LN.induced(ranked), as_of=X.AS_OF, base=base)


@query
def q_batch_filled(spark, d):
    """The sheets of a batch run over all forms."""
    return B.run_forms(spark, d).filled.select("input_id", "cell", "value", "filled")


@query
def q_batch_events(spark, d):
    """What that run logs, one event per form."""
    return B.run_forms(spark, d).events.select("input_id", "template_id", "template_signature", "error_type",
                                               _ids(F.col("missing_fields")).alias("missing_fields"), "status", "message")


@query
def q_learn_cycle(spark, d):
    return learn_forms(spark, d).status
