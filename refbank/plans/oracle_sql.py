"""DuckDB oracle SQL, one string per registered query.

Written straight from the reference semantics (pairwise joins, recursive
folds), independently of the Spark plan shapes, so a match is evidence.
"""

from __future__ import annotations

from refbank.plans.oracle_views import AS_OF, with_views as W

ORACLE: dict[str, str] = {}

# --- shared CTE bodies -------------------------------------------------------------

DECAYED = f"""
  SELECT * REPLACE (CASE WHEN d > 30
                 THEN round_even(coalesce(confidence, 0.5) * pow(0.99::DOUBLE, d - 30) * 10000, 0) / 10000.0
                 ELSE confidence END AS confidence)
  FROM (SELECT *, floor((epoch_us({AS_OF}) - epoch_us(last_used)) / 86400000000.0) AS d FROM rules)"""

BANK = "SELECT * EXCLUDE (d) FROM decayed WHERE coalesce(confidence, 0.5) >= 0.3"

DIRECT = """
  SELECT i.input_id, i.template_id, r.id, r.confidence, r.support, r.field, r.ord
  FROM input_types i JOIN {bank} r ON r.template_id = i.template_id
  WHERE coalesce(r."trigger", 'field_extraction') = 'field_extraction'
    AND coalesce(r.input_type, 'auto') IN (i.input_type, 'auto')
    AND coalesce(r.confidence, 0.0) >= 0.3"""

MATCHED = """
  SELECT * FROM (
    SELECT i.input_id, i.template_id, p.pattern_id, p.accuracy, p.rules_used, true AS exact,
           row_number() OVER (PARTITION BY i.input_id ORDER BY coalesce(p.accuracy, 0.0) DESC, p.ord) AS rank
    FROM input_types i JOIN patterns p ON p.template_id = i.template_id AND p.input_signature = i.signature
    UNION ALL
    SELECT i.input_id, i.template_id, p.pattern_id, p.accuracy, p.rules_used, false,
           row_number() OVER (PARTITION BY i.input_id ORDER BY coalesce(p.accuracy, 0.0) DESC, p.ord)
    FROM input_types i JOIN patterns p ON p.template_id = i.template_id
    WHERE coalesce(p.accuracy, 0.0) >= 0.8
      AND NOT EXISTS (SELECT 1 FROM patterns q
                      WHERE q.template_id = i.template_id AND q.input_signature = i.signature))
  WHERE rank <= 3"""

NBR_ANCHOR = """
  SELECT DISTINCT d.input_id, d.template_id, e2.src AS id
  FROM {direct} d
  JOIN edges e1 ON e1.relation = 'uses_anchor' AND e1.template_id = d.template_id AND e1.src = d.id
  JOIN edges e2 ON e2.relation = 'uses_anchor' AND e2.template_id = d.template_id AND e2.dst = e1.dst
  WHERE e2.src <> d.id"""

NBR_FOLLOW = """
  SELECT DISTINCT d.input_id, d.template_id, e.dst AS id
  FROM {direct} d JOIN edges e
    ON e.relation = 'often_follows' AND e.template_id = d.template_id AND e.src = d.id"""

VIA_KG = """
  SELECT n.input_id, n.template_id, r.id, r.confidence, r.support, r.field, r.ord
  FROM (SELECT * FROM {na} UNION SELECT * FROM {nf}) n
  JOIN {bank} r ON r.template_id = n.template_id AND r.id = n.id
  WHERE coalesce(r.confidence, 0.0) >= 0.3
    AND NOT EXISTS (SELECT 1 FROM {direct} x WHERE x.input_id = n.input_id AND x.id = n.id)"""

VIA_SIG = """
  SELECT DISTINCT m.input_id, m.template_id, r.id, r.confidence, r.support, r.field, r.ord
  FROM (SELECT input_id, template_id, unnest(rules_used) AS id FROM matched) m
  JOIN {bank} r ON r.template_id = m.template_id AND r.id = m.id
  WHERE coalesce(r.confidence, 0.0) >= 0.3"""


def _retrieval_ctes(bank: str = "bank") -> list[tuple[str, str]]:
    ctes = []
    if bank == "bank":
        ctes += [("decayed", DECAYED), ("bank", BANK)]
    ctes += [
        ("direct", DIRECT.format(bank=bank)),
        ("matched", MATCHED),
        ("nbr_anchor", NBR_ANCHOR.format(direct="direct")),
        ("nbr_follow", NBR_FOLLOW.format(direct="direct")),
        ("via_kg", VIA_KG.format(na="nbr_anchor", nf="nbr_follow", bank=bank, direct="direct")),
        ("via_sig", VIA_SIG.format(bank=bank)),
        ("combined", """
          SELECT *, 0 AS lr, 2 AS prec FROM direct
          UNION ALL SELECT *, 1, 1 FROM via_kg
          UNION ALL SELECT *, 2, 3 FROM via_sig"""),
        ("positioned", """
          SELECT *,
            first_value(coalesce(confidence, 0.0)) OVER w_pos AS p_conf,
            first_value(lr) OVER w_pos AS p_lr, first_value(ord) OVER w_pos AS p_ord,
            row_number() OVER (PARTITION BY input_id, id
                               ORDER BY prec DESC, coalesce(confidence, 0.0) DESC, lr, ord) AS body_rn
          FROM combined
          WINDOW w_pos AS (PARTITION BY input_id, id ORDER BY coalesce(confidence, 0.0) DESC, lr, ord)"""),
        ("retrieved", """
          SELECT * FROM (
            SELECT input_id, template_id, id, confidence, support, field,
                   CASE prec WHEN 3 THEN 'via_signature' WHEN 2 THEN 'direct' ELSE 'via_kg' END AS source,
                   row_number() OVER (PARTITION BY input_id ORDER BY p_conf DESC, p_lr, p_ord) AS rank
            FROM positioned WHERE body_rn = 1)
          WHERE rank <= 10"""),
    ]
    return ctes


RETRIEVAL_VIEWS = ("input_types", "rules", "edges", "patterns")

# --- phase 1 ---------------------------------------------------------------------

ORACLE["scan_inputs"] = W("inputs") + "SELECT input_id, template_id, path, content FROM inputs"
ORACLE["input_signature"] = W("inputs") + "SELECT input_id, md5(content) AS signature FROM inputs"
ORACLE["input_type"] = W("input_types") + "SELECT input_id, path, input_type FROM input_types"
ORACLE["retrieve_direct"] = W("input_types", "rules", extra=[("direct", DIRECT.format(bank="rules"))]) + """
SELECT input_id, rank, id, confidence FROM (
  SELECT input_id, id, confidence,
         row_number() OVER (PARTITION BY input_id ORDER BY confidence DESC, ord) AS rank
  FROM (SELECT * FROM direct QUALIFY row_number() OVER (PARTITION BY input_id, id ORDER BY confidence DESC, ord) = 1))
WHERE rank <= 10"""

# --- phase 2 ---------------------------------------------------------------------

ORACLE["match_patterns"] = W("input_types", "patterns", extra=[("matched", MATCHED)]) + \
    "SELECT input_id, rank, pattern_id, accuracy, exact FROM matched"

_TYPE_DIRECT = [("direct", DIRECT.format(bank="rules"))]
ORACLE["kg_shared_anchor"] = W("input_types", "rules", "edges", extra=_TYPE_DIRECT + [
    ("na", NBR_ANCHOR.format(direct="direct"))]) + """
SELECT DISTINCT i.template_id, i.input_type, na.id FROM na JOIN input_types i USING (input_id)"""
ORACLE["kg_often_follows"] = W("input_types", "rules", "edges", extra=_TYPE_DIRECT + [
    ("nf", NBR_FOLLOW.format(direct="direct"))]) + """
SELECT DISTINCT i.template_id, i.input_type, nf.id FROM nf JOIN input_types i USING (input_id)"""
ORACLE["kg_expand"] = W("input_types", "rules", "edges", extra=_TYPE_DIRECT + [
    ("na", NBR_ANCHOR.format(direct="direct")), ("nf", NBR_FOLLOW.format(direct="direct")),
    ("vk", VIA_KG.format(na="na", nf="nf", bank="rules", direct="direct"))]) + """
SELECT DISTINCT i.template_id, i.input_type, vk.id, vk.confidence FROM vk JOIN input_types i USING (input_id)"""
ORACLE["via_signature"] = W("input_types", "rules", "patterns", extra=[
    ("matched", MATCHED), ("vs", VIA_SIG.format(bank="rules"))]) + """
SELECT DISTINCT input_id, id, confidence FROM vs"""
ORACLE["new_variants"] = W("input_types", "patterns") + """
SELECT i.input_id,
       (EXISTS (SELECT 1 FROM patterns p WHERE p.template_id = i.template_id)
        AND NOT EXISTS (SELECT 1 FROM patterns p WHERE p.template_id = i.template_id
                                                  AND p.input_signature = i.signature)) AS signature_mismatch
FROM input_types i"""
ORACLE["query_anchors"] = W("anchors") + "SELECT template_id, anchor_id, field, type, role, pattern FROM anchors WHERE field = 'f_1'"
ORACLE["retrieve_rules"] = W(*RETRIEVAL_VIEWS, extra=_retrieval_ctes()) + \
    "SELECT input_id, rank, id, source, confidence FROM retrieved"
ORACLE["retrieval_context"] = W(*RETRIEVAL_VIEWS, "anchors", extra=_retrieval_ctes()) + """
SELECT i.input_id, i.template_id, i.signature, i.input_type,
       coalesce(r.n_rules, 0)::BIGINT AS n_rules, coalesce(r.rule_ids, '') AS rule_ids,
       coalesce(m.ids, '') AS matched_patterns, coalesce(a.n, 0)::BIGINT AS n_anchors,
       (EXISTS (SELECT 1 FROM patterns p WHERE p.template_id = i.template_id)
        AND NOT EXISTS (SELECT 1 FROM patterns p WHERE p.template_id = i.template_id
                                                  AND p.input_signature = i.signature)) AS signature_mismatch
FROM input_types i
LEFT JOIN (SELECT input_id, count(*) AS n_rules, string_agg(id, ',' ORDER BY rank) AS rule_ids
           FROM retrieved GROUP BY input_id) r USING (input_id)
LEFT JOIN (SELECT input_id, string_agg(pattern_id, ',' ORDER BY rank) AS ids FROM matched GROUP BY input_id) m
  USING (input_id)
LEFT JOIN (SELECT template_id, count(*) AS n FROM anchors GROUP BY template_id) a USING (template_id)"""

# --- phase 3 ---------------------------------------------------------------------

LATEST_OUTCOME = """
  SELECT template_id, CASE WHEN v > 0 THEN 1.0 WHEN v < 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS outcome
  FROM (SELECT template_id, arg_max(v, (ts, event_id)) AS v FROM outcomes GROUP BY template_id)"""

UPDATED = """
  SELECT r.*, o.outcome,
    CASE WHEN o.outcome >= 0.8 THEN least(1.0, round_even((coalesce(r.confidence, 0.5) + 0.02) * 100, 0) / 100.0)
         WHEN o.outcome <= 0.3 THEN greatest(0.0, round_even((coalesce(r.confidence, 0.5) - 0.05) * 100, 0) / 100.0)
         ELSE coalesce(r.confidence, 0.5) END AS new_conf,
    coalesce(r.support, 0) + CASE WHEN o.outcome >= 0.8 THEN 1 ELSE 0 END AS new_support
  FROM rules r LEFT JOIN latest o USING (template_id)"""

ORACLE["apply_outcome"] = W("rules", "outcomes", extra=[("latest", LATEST_OUTCOME), ("upd", UPDATED)]) + """
SELECT template_id, id,
       CASE WHEN outcome IS NULL THEN confidence ELSE new_conf END AS confidence,
       CASE WHEN outcome IS NULL THEN support ELSE new_support END::BIGINT AS support
FROM upd WHERE outcome IS NULL OR new_conf >= 0.3"""

ORACLE["replay_outcomes"] = W("rules", "outcomes", extra=[
    ("ev", """SELECT template_id, v,
                     row_number() OVER (PARTITION BY template_id ORDER BY ts, event_id) AS t
              FROM outcomes"""),
]) + """, fold AS (
  WITH RECURSIVE f(template_id, id, t, c, s, archived) AS (
    SELECT template_id, id, 0::BIGINT, confidence, support, false FROM rules
    UNION ALL
    SELECT f.template_id, f.id, f.t + 1, n.c2, f.s + CASE WHEN e.v > 0 THEN 1 ELSE 0 END, n.c2 < 0.3
    FROM f JOIN ev e ON e.template_id = f.template_id AND e.t = f.t + 1,
    LATERAL (SELECT CASE WHEN e.v > 0 THEN least(1.0, round_even((coalesce(f.c, 0.5) + 0.02) * 100, 0) / 100.0)
                         WHEN e.v < 0 THEN greatest(0.0, round_even((coalesce(f.c, 0.5) - 0.05) * 100, 0) / 100.0)
                         ELSE f.c END AS c2) n
    WHERE NOT f.archived)
  SELECT * FROM f)
SELECT template_id, id, CASE WHEN NOT archived THEN c END AS confidence,
       CASE WHEN NOT archived THEN s END::BIGINT AS support, archived
FROM fold QUALIFY row_number() OVER (PARTITION BY template_id, id ORDER BY t DESC) = 1"""

ORACLE["decay_rules"] = W("rules", extra=[("decayed", DECAYED), ("bank", BANK)]) + \
    "SELECT template_id, id, confidence FROM bank"

ORACLE["touch_rules"] = W(*RETRIEVAL_VIEWS, extra=_retrieval_ctes()) + f"""
SELECT r.template_id, r.id,
       strftime(CASE WHEN h.id IS NOT NULL THEN {AS_OF} ELSE r.last_used END, '%Y-%m-%d %H:%M:%S') AS last_used
FROM rules r LEFT JOIN (SELECT DISTINCT template_id, id FROM retrieved) h USING (template_id, id)"""

ORACLE["archived_counts"] = W("rules", "outcomes", extra=[
    ("decayed", DECAYED), ("latest", LATEST_OUTCOME), ("upd", UPDATED)]) + """
SELECT d.template_id, d.n_rules, d.archived_by_decay, o.archived_by_outcome FROM
  (SELECT template_id, count(*)::BIGINT AS n_rules,
          sum(CASE WHEN coalesce(confidence, 0.5) < 0.3 THEN 1 ELSE 0 END)::BIGINT AS archived_by_decay
   FROM decayed GROUP BY template_id) d
JOIN (SELECT template_id,
             sum(CASE WHEN outcome IS NOT NULL AND new_conf < 0.3 THEN 1 ELSE 0 END)::BIGINT AS archived_by_outcome
      FROM upd GROUP BY template_id) o USING (template_id)"""

NEXT_IDS = """
  SELECT template_id, coalesce(max(n), 0)::BIGINT AS max_id, printf('R%03d', coalesce(max(n), 0) + 1) AS next_id
  FROM (
    SELECT template_id, id FROM rules
    UNION ALL SELECT template_id, unnest(rules_used) FROM patterns
    UNION ALL SELECT template_id, src FROM edges
    UNION ALL SELECT template_id, dst FROM edges)
  , LATERAL (SELECT CASE WHEN regexp_full_match(id, 'R[0-9]+') THEN CAST(substring(id, 2) AS BIGINT) END AS n)
  GROUP BY template_id"""

DRAFT_REQ = """
  SELECT 'src' || (p_partkey % 20) AS template_id, 'md' AS input_type, 'F' || p_partkey AS field,
         CASE WHEN p_size % 2 = 0 THEN 'A' || (p_partkey % 100) END AS anchor, p_partkey AS ord
  FROM part"""

DRAFTED = """
  SELECT q.template_id, printf('R%03d', coalesce(b.max_id, 0)
                          + row_number() OVER (PARTITION BY q.template_id ORDER BY q.ord)) AS id,
         q.input_type, q.field, q.anchor, q.ord
  FROM req q LEFT JOIN base b USING (template_id)"""

ORACLE["next_ids"] = W("rules", "patterns", "edges", extra=[("base", NEXT_IDS)]) + \
    "SELECT template_id, max_id, next_id FROM base"

ORACLE["draft_rules"] = W("rules", "patterns", "edges", extra=[
    ("base", NEXT_IDS), ("req", DRAFT_REQ), ("drafted", DRAFTED)]) + """
SELECT template_id, id, field, 'semantic_extract' AS action, anchor, 0.5::DOUBLE AS confidence, 0::BIGINT AS support
FROM drafted"""

ORACLE["append_edges"] = W("rules", "patterns", "edges", extra=[
    ("base", NEXT_IDS), ("req", DRAFT_REQ), ("drafted", DRAFTED)]) + """
SELECT template_id, src, dst, relation FROM edges
UNION
SELECT template_id, id, anchor, 'uses_anchor' FROM drafted WHERE anchor IS NOT NULL"""

ORACLE["reflect_rules"] = W("rules", "patterns", "edges", "outcomes", extra=[
    ("base", NEXT_IDS),
    ("req", "SELECT * FROM (" + DRAFT_REQ + ") WHERE anchor IS NULL"),
    ("drafted", DRAFTED)]) + """
SELECT template_id, id, field, action, confidence, support FROM (
  SELECT r.template_id, r.id, r.field, r.action, f.template_id IS NOT NULL AS failing,
         CASE WHEN f.template_id IS NULL THEN r.confidence
              ELSE greatest(0.0, round_even((coalesce(r.confidence, 0.5) - 0.05) * 100, 0) / 100.0) END AS confidence,
         r.support
  FROM rules r LEFT JOIN (SELECT DISTINCT template_id FROM req) f USING (template_id))
WHERE NOT failing OR confidence >= 0.3
UNION ALL
SELECT template_id, id, field, 'retry_extract', 0.6::DOUBLE, 0::BIGINT FROM drafted"""

ORACLE["record_patterns"] = W(*RETRIEVAL_VIEWS, extra=_retrieval_ctes() + [
    ("per", """SELECT input_id, string_agg(id, ',' ORDER BY rank) AS rule_ids,
                      array_to_string(list_sort(list(DISTINCT field)), ',') AS fields
               FROM retrieved GROUP BY input_id"""),
    ("pbase", """SELECT template_id, max(CAST(substring(pattern_id, 2) AS BIGINT)) AS max_p
                 FROM patterns GROUP BY template_id""")]) + """
SELECT i.template_id, i.input_id,
       printf('P%03d', coalesce(b.max_p, 0) + row_number() OVER (PARTITION BY i.template_id ORDER BY i.input_id)) AS pattern_id,
       i.signature AS input_signature, i.input_type, 1.0::DOUBLE AS accuracy,
       CASE WHEN p.rule_ids IS NULL THEN '' ELSE p.rule_ids END AS rules_used,
       coalesce(p.fields, '') AS fields_extracted
FROM input_types i LEFT JOIN per p USING (input_id) LEFT JOIN pbase b USING (template_id)"""

# --- phase 4: failure memory ------------------------------------------------------

_WS = "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_STRIP = f"regexp_replace(regexp_replace(coalesce(x, 'None'), '^{_WS}+', ''), '{_WS}+$', '')"
NORM_FIELDS = ("list_sort(list_filter(list_transform(coalesce(missing_fields, []::VARCHAR[]), lambda x: "
               + _STRIP + "), lambda y: y <> ''))")

LOG = f"""
  SELECT event_id, ts, template_signature, error_type, repair_action, seq_ts, seq_id, nf AS missing_fields,
         coalesce(error_type, 'unknown') || '|' || array_to_string(nf, ',') || '|' || coalesce(template_signature, '') AS cluster_key
  FROM (SELECT *, {NORM_FIELDS} AS nf FROM exec_log)"""

CLUSTERS = """
  SELECT cluster_key, count(*)::BIGINT AS samples,
         arg_min(template_signature, (seq_ts, seq_id)) AS signature,
         arg_min(error_type, (seq_ts, seq_id)) AS error_type,
         arg_min(array_to_string(missing_fields, ','), (seq_ts, seq_id)) AS missing_fields,
         arg_min(event_id, (seq_ts, seq_id)) AS first_event,
         arg_max(event_id, (seq_ts, seq_id)) AS last_event,
         arg_max(ts, (seq_ts, seq_id)) AS last_ts,
         min(seq_ts) AS first_ts, arg_min(seq_id, (seq_ts, seq_id)) AS first_id
  FROM log WHERE error_type IS NOT NULL AND error_type <> '' GROUP BY cluster_key"""

TOP = """
  SELECT cluster_key, repair_action AS top_repair_action, votes AS top_repair_votes FROM (
    SELECT cluster_key, repair_action, count(*)::BIGINT AS votes, min((seq_ts, seq_id)) AS first
    FROM log WHERE error_type IS NOT NULL AND error_type <> ''
      AND repair_action IS NOT NULL AND repair_action <> ''
    GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY votes DESC, first) = 1"""

SUMMARY = """
  SELECT printf('R%03d', row_number() OVER (ORDER BY c.samples DESC, c.first_ts, c.first_id)) AS id,
         c.signature AS template_signature, c.error_type, c.missing_fields,
         t.top_repair_action AS repair_action, c.samples AS support,
         t.top_repair_votes / c.samples AS vote_rate, c.cluster_key
  FROM clusters c JOIN top t USING (cluster_key)
  WHERE c.samples >= 2"""

_MEM = [("log", LOG), ("clusters", CLUSTERS), ("top", TOP), ("summary", SUMMARY)]

ORACLE["read_exec_log"] = W("exec_log", extra=[("log", LOG)]) + """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, template_signature, error_type,
       array_to_string(missing_fields, ',') AS missing_fields, repair_action FROM log"""
ORACLE["cluster_key"] = W("exec_log", extra=[("log", LOG)]) + "SELECT event_id, cluster_key FROM log"
ORACLE["event_id"] = W("exec_log", extra=[("log", LOG)]) + """
SELECT event_id, substr(sha1(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || coalesce(template_signature, '')
       || '|' || coalesce(error_type, '') || '|' || array_to_string(missing_fields, ',') || '|'
       || coalesce(repair_action, '')), 1, 12) AS eid FROM log"""
ORACLE["failure_clusters"] = W("exec_log", extra=_MEM[:2]) + """
SELECT cluster_key, samples, signature, error_type, missing_fields, first_event, last_event,
       strftime(last_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM clusters"""
ORACLE["top_repair"] = W("exec_log", extra=[_MEM[0], _MEM[2]]) + \
    "SELECT cluster_key, top_repair_action, top_repair_votes FROM top"
ORACLE["summary_rules"] = W("exec_log", extra=_MEM) + """
SELECT id, template_signature, error_type, missing_fields, repair_action, support, vote_rate FROM summary"""
ORACLE["suggest_repairs"] = W("exec_log", extra=_MEM + [("q", f"""
    SELECT DISTINCT template_signature, error_type, missing_fields,
           template_signature || '|' || error_type || '|' || array_to_string(missing_fields, ',') AS query_id,
           array_to_string({NORM_FIELDS}, ',') AS q_fields
    FROM exec_log WHERE error_type IS NOT NULL""")]) + """
SELECT q.query_id, s.id FROM q JOIN summary s USING (template_signature, error_type)
WHERE q.q_fields = '' OR q.q_fields = s.missing_fields"""
ORACLE["relearn_candidates"] = W("open_log", extra=[("log", LOG.replace("exec_log", "open_log")), *_MEM[1:]]) + """
SELECT cluster_key, samples, signature, error_type FROM clusters
WHERE samples >= 2 AND cluster_key NOT IN (SELECT cluster_key FROM summary)"""

# --- phase 5: cells, bindings, formulas ---------------------------------------------------


def col_letters(n: str) -> str:
    d1 = f"chr(CAST(65 + (({n}) - 1) % 26 AS INTEGER))"
    q1 = f"((({n}) - 1) // 26)"
    d2 = f"chr(CAST(65 + ({q1} - 1) % 26 AS INTEGER))"
    q2 = f"(({q1} - 1) // 26)"
    d3 = f"chr(CAST(65 + ({q2} - 1) % 26 AS INTEGER))"
    return (f"CASE WHEN ({n}) <= 0 THEN NULL WHEN ({n}) <= 26 THEN {d1} "
            f"WHEN ({n}) <= 702 THEN {d2} || {d1} ELSE {d3} || {d2} || {d1} END")


def a1(r: str, c: str) -> str:
    return f"({col_letters(c)} || CAST({r} AS VARCHAR))"


def letters_to_num(s: str) -> str:
    return f"list_reduce(list_transform(string_split(upper({s}), ''), lambda ch: ascii(ch) - 64), lambda acc, x: acc * 26 + x, 0)"


RESOLVED = """
  WITH RECURSIVE res(tpl, field, "row", col) AS (
    SELECT tpl, field, r0, c0 FROM schema_fields WHERE r0 IS NOT NULL AND c0 IS NOT NULL
    UNION ALL
    SELECT s.tpl, s.field, r."row" + coalesce(s.dr, 0), r.col + coalesce(s.dc, 0)
    FROM res r JOIN schema_fields s ON s.tpl = r.tpl AND s.rel = r.field AND (s.r0 IS NULL OR s.c0 IS NULL)
    WHERE r."row" + coalesce(s.dr, 0) > 0 AND r.col + coalesce(s.dc, 0) > 0)
  SELECT tpl, field, "row", col, """ + a1('"row"', "col") + """ AS cell FROM res"""

TPL_SHEET = """
  SELECT 'tpl' || workbook_id AS tpl, "row", col, value FROM cells
  WHERE sheet = 'R' AND 'tpl' || workbook_id IN (SELECT tpl FROM schema_fields)"""
TPL_DATA = """
  SELECT 'tpl' || (p_partkey // 100) AS tpl, 'F' || p_partkey AS field, p_name AS value
  FROM part"""
CONFLICTS = """
  SELECT b.tpl, b.field, b.cell FROM bindings b
  WHERE EXISTS (SELECT 1 FROM tsheet t WHERE t.tpl = b.tpl AND t."row" = b."row" AND t.col = b.col AND t.value LIKE '=%')
    AND EXISTS (SELECT 1 FROM tdata x WHERE x.tpl = b.tpl AND x.field = b.field)"""

ORACLE["schema_fields"] = W("schema_fields") + "SELECT tpl, field, rel, r0, c0, dr, dc FROM schema_fields"
ORACLE["resolve_bindings"] = W("schema_fields", extra=[("bindings", RESOLVED)]) + \
    'SELECT tpl, field, cell, "row", col FROM bindings'
ORACLE["collect_cells"] = W("cells") + f"""
SELECT workbook_id, sheet, "row", col, {a1('"row"', 'col')} AS cell, v AS value
FROM (SELECT *, coalesce(regexp_replace(regexp_replace(value, '^{_WS}+', ''), '{_WS}+$', ''), '') AS v FROM cells)
WHERE v <> ''"""
ORACLE["normalize_values"] = W("diff_gen") + f"""
SELECT c_custkey, c_name AS raw,
       coalesce(regexp_replace(regexp_replace(c_name, '^{_WS}+', ''), '{_WS}+$', ''), '') AS normalized
FROM diff_gen"""
_DEPS = ("array_to_string(list_transform(regexp_extract_all(regexp_replace(value, '^=', ''), "
         "'\\$?[A-Z]+\\$?\\d+'), lambda r: replace(r, '$', '')), ',')")
ORACLE["formula_dependencies"] = W("cells") + f"""
SELECT workbook_id, sheet, {a1('"row"', 'col')} AS cell, {_DEPS} AS depends_on
FROM cells WHERE value LIKE '=%'"""
ORACLE["formula_cells"] = W("cells") + f"""
SELECT workbook_id, sheet, "row", col, {a1('"row"', 'col')} AS cell, value AS formula, {_DEPS} AS depends_on
FROM cells WHERE value LIKE '=%'"""
ORACLE["shift_cells"] = W("cells") + f"""
SELECT workbook_id, sheet, "row", col, ref, dr, dc,
       CASE WHEN NOT regexp_full_match(ref, '[A-Za-z]+[0-9]+') THEN NULL
            WHEN dr = 0 AND dc = 0 THEN upper(ref)
            WHEN nr <= 0 OR nc <= 0 THEN NULL
            ELSE {a1('nr', 'nc')} END AS shifted
FROM (SELECT *, "row" + dr AS nr, col + dc AS nc FROM (
  SELECT workbook_id, sheet, "row", col,
         CASE WHEN "row" % 2 = 0 THEN lower({a1('"row"', 'col')}) ELSE {a1('"row"', 'col')} END AS ref,
         ("row" % 4 - 2)::BIGINT AS dr, ((col % 5 - 2) * 30)::BIGINT AS dc
  FROM cells))"""
ORACLE["cell_neighbors"] = W("cells") + f"""
SELECT c.workbook_id, c.sheet, {a1('c."row"', 'c.col')} AS cell,
       CASE WHEN c."row" > 1 THEN {a1('c."row" - 1', 'c.col')} END AS up,
       CASE WHEN c."row" < e.mr THEN {a1('c."row" + 1', 'c.col')} END AS down,
       CASE WHEN c.col > 1 THEN {a1('c."row"', 'c.col - 1')} END AS "left",
       CASE WHEN c.col < e.mc THEN {a1('c."row"', 'c.col + 1')} END AS "right"
FROM cells c JOIN (SELECT workbook_id, sheet, max("row") AS mr, max(col) AS mc FROM cells GROUP BY ALL) e
  USING (workbook_id, sheet)"""
ORACLE["formula_conflicts"] = W("schema_fields", "cells", extra=[
    ("bindings", RESOLVED), ("tsheet", TPL_SHEET), ("tdata", TPL_DATA), ("conf", CONFLICTS)]) + \
    "SELECT tpl, field, cell FROM conf"
ORACLE["fill_template"] = W("schema_fields", "cells", extra=[
    ("bindings", RESOLVED), ("tsheet", TPL_SHEET), ("tdata", TPL_DATA), ("conf", CONFLICTS),
    ("assigned", """SELECT b.tpl, b."row", b.col, x.value FROM bindings b
                    JOIN tdata x ON x.tpl = b.tpl AND x.field = b.field
                    WHERE (b.tpl, b.field) NOT IN (SELECT (tpl, field) FROM conf)""")]) + f"""
SELECT coalesce(t.tpl, a.tpl) AS tpl, {a1('coalesce(t."row", a."row")', 'coalesce(t.col, a.col)')} AS cell,
       CASE WHEN a.tpl IS NOT NULL THEN a.value ELSE t.value END AS value, a.tpl IS NOT NULL AS filled
FROM tsheet t FULL OUTER JOIN assigned a ON a.tpl = t.tpl AND a."row" = t."row" AND a.col = t.col"""

# --- phase 6: layout -------------------------------------------------------------

NONEMPTY = f"""
  SELECT workbook_id, sheet, "row", col, {a1('"row"', 'col')} AS cell, v AS value FROM (
    SELECT *, coalesce(regexp_replace(regexp_replace(value, '^{_WS}+', ''), '{_WS}+$', ''), '') AS v FROM cells)
  WHERE v <> ''"""
OCC = """
  SELECT c.workbook_id, c.sheet, c."row" - m.r0 AS dr, c.col - m.c0 AS dc
  FROM ne c JOIN (SELECT workbook_id, sheet, min("row") AS r0, min(col) AS c0 FROM ne GROUP BY ALL) m
    USING (workbook_id, sheet)"""
LAYOUT = """
  SELECT e.*, o.occupied_digest FROM
    (SELECT workbook_id, sheet, min("row") AS min_row, max("row") AS max_row, min(col) AS min_col,
            max(col) AS max_col, count(*)::BIGINT AS occupied_count FROM ne GROUP BY ALL) e
  JOIN (SELECT workbook_id, sheet,
               CAST(sum(('0x' || substr(md5(dr || ':' || dc), 1, 12))::BIGINT) AS VARCHAR) AS occupied_digest
        FROM occ GROUP BY ALL) o USING (workbook_id, sheet)"""


def framed(*cols: str) -> str:
    """Values with their lengths before them."""
    return " || ".join(f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in cols)


def set_digest(text: str) -> str:
    """Sums of pieces of the texts' hashes."""
    return "concat_ws(',', " + ", ".join(f"sum(('0x' || substr(sha256({text}), {15 * k + 1}, 15))::BIGINT)::VARCHAR" for k in range(4)) + ")"


PROFILE = """
  SELECT s.workbook_id, s.n_sheets, s.n_cells, g.n_hashed,
         sha256(concat_ws('#', s.t, g.t)) AS signature
  FROM (SELECT workbook_id, count(*)::BIGINT AS n_sheets, sum(occupied_count)::BIGINT AS n_cells,
               """ + set_digest(framed("sheet", "max_row", "max_col", "min_row", "max_row", "min_col", "max_col",
                                       "occupied_count", "occupied_digest")) + """ AS t
        FROM layout GROUP BY workbook_id) s
  JOIN (SELECT workbook_id, count(*)::BIGINT AS n_hashed, """ + set_digest(framed("sheet", "cell", "value")) + """ AS t
        FROM ne GROUP BY workbook_id) g USING (workbook_id)"""
# the profile itself is over the ordered sequence of sheets and cells; compatibility asks only whether two are equal
ORDERED_PROFILE = """
  SELECT s.workbook_id, s.n_sheets, s.n_cells, g.n_hashed,
         sha256(concat_ws('#', s.t, g.t)) AS signature
  FROM (SELECT workbook_id, count(*)::BIGINT AS n_sheets, sum(occupied_count)::BIGINT AS n_cells,
               string_agg(""" + framed("sheet", "max_row", "max_col", "min_row", "max_row", "min_col", "max_col",
                                       "occupied_count", "occupied_digest") + """, ';' ORDER BY sheet) AS t
        FROM layout GROUP BY workbook_id) s
  JOIN (SELECT workbook_id, count(*)::BIGINT AS n_hashed,
               string_agg(md5(""" + framed("sheet", "cell", "value") + """), '' ORDER BY sheet, "row", col) AS t
        FROM ne GROUP BY workbook_id) g USING (workbook_id)"""
SIMILARITY = """
  SELECT coalesce(bx.x, cy.x) AS x, coalesce(bx.y, cy.y) AS y, coalesce(bx.sheet, cy.sheet) AS sheet,
         CASE WHEN bx.sheet IS NULL THEN 'missing_in_base' WHEN cy.sheet IS NULL THEN 'missing_in_candidate'
              ELSE 'compared' END AS reason,
         CASE WHEN bx.sheet IS NOT NULL AND cy.sheet IS NOT NULL THEN jac END AS occupancy_jaccard,
         CASE WHEN bx.sheet IS NOT NULL AND cy.sheet IS NOT NULL THEN shape END AS shape_score,
         CASE WHEN bx.sheet IS NOT NULL AND cy.sheet IS NOT NULL THEN 0.8 * jac + 0.2 * shape ELSE 0.0 END AS score
  FROM (SELECT p.x, p.y, l.sheet, l.occupied_count AS a, l.max_row - l.min_row AS h, l.max_col - l.min_col AS w
        FROM layout_pairs p JOIN layout l ON l.workbook_id = p.x) bx
  FULL OUTER JOIN
       (SELECT p.x, p.y, l.sheet, l.occupied_count AS b, l.max_row - l.min_row AS h, l.max_col - l.min_col AS w
        FROM layout_pairs p JOIN layout l ON l.workbook_id = p.y) cy
    ON bx.x = cy.x AND bx.y = cy.y AND bx.sheet = cy.sheet
  LEFT JOIN (SELECT p.x, p.y, o1.sheet, count(*) AS k FROM layout_pairs p
             JOIN occ o1 ON o1.workbook_id = p.x JOIN occ o2 ON o2.workbook_id = p.y
               AND o2.sheet = o1.sheet AND o2.dr = o1.dr AND o2.dc = o1.dc
             GROUP BY ALL) i ON i.x = bx.x AND i.y = bx.y AND i.sheet = bx.sheet,
  LATERAL (SELECT CASE WHEN bx.a = 0 AND cy.b = 0 THEN 1.0 WHEN bx.a = 0 OR cy.b = 0 THEN 0.0
                       ELSE coalesce(i.k, 0)::DOUBLE / (bx.a + cy.b - coalesce(i.k, 0)) END AS jac,
                  greatest(0.0, 1.0 - (abs(bx.h - cy.h)::DOUBLE / CASE WHEN greatest(bx.h, cy.h) = 0 THEN 1 ELSE greatest(bx.h, cy.h) END
                                     + abs(bx.w - cy.w)::DOUBLE / CASE WHEN greatest(bx.w, cy.w) = 0 THEN 1 ELSE greatest(bx.w, cy.w) END) / 2.0) AS shape)"""
COMPAT = """
  SELECT p.x, p.y,
         CASE WHEN px.signature = py.signature THEN 'exact' WHEN raw >= 0.78 THEN 'compatible' ELSE 'incompatible' END AS compatibility,
         CASE WHEN px.signature = py.signature THEN 1.0 ELSE round_even(raw * 10000, 0) / 10000.0 END AS score,
         (coalesce(px.signature = py.signature, false) = false AND raw < 0.78) AS hard_mismatch
  FROM (SELECT DISTINCT x, y FROM layout_pairs) p
  LEFT JOIN profile px ON px.workbook_id = p.x LEFT JOIN profile py ON py.workbook_id = p.y
  LEFT JOIN (SELECT x, y, sum(score) / greatest(count(*), 1) AS raw FROM sim GROUP BY ALL) s USING (x, y)"""
_LAY = [("ne", NONEMPTY), ("occ", OCC), ("layout", LAYOUT)]

ORACLE["sheet_layout"] = W("cells", extra=_LAY) + "SELECT * FROM layout"
ORACLE["template_profile"] = W("cells", extra=_LAY + [("profile", ORDERED_PROFILE)]) + "SELECT * FROM profile"
ORACLE["layout_similarity"] = W("cells", "layout_pairs", extra=_LAY + [("sim", SIMILARITY)]) + "SELECT * FROM sim"
ORACLE["layout_compat"] = W("cells", "layout_pairs", extra=_LAY + [
    ("profile", PROFILE), ("sim", SIMILARITY), ("compat", COMPAT)]) + "SELECT * FROM compat"
ORACLE["layout_routing"] = W("cells", "layout_pairs", extra=_LAY + [
    ("profile", PROFILE), ("sim", SIMILARITY), ("compat", COMPAT)]) + """
SELECT x, y, compatibility, CASE WHEN hard_mismatch THEN 'learn' ELSE 'write' END AS route FROM compat"""

# --- phase 7: extraction ---------------------------------------------------------

from refbank.plans.fixtures import PAGE_SCHEMA_FIELDS, TYPED_PAGE_FIELDS, WEB_RULES  # noqa: E402


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RESPONSES = """
  SELECT input_id,
         CASE input_id % 3 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```'
                           WHEN 1 THEN j ELSE left(j, length(j) - 1) END AS response
  FROM (SELECT input_id, CAST(to_json(map_from_entries(list(struct_pack(k := field, v := value) ORDER BY field))) AS VARCHAR) AS j
        FROM extracted GROUP BY input_id)"""
PARSED = """
  SELECT input_id, CASE WHEN json_valid(c) THEN CASE WHEN json_type(c) = 'OBJECT'
                        THEN CAST(c::JSON AS MAP(VARCHAR, VARCHAR)) END END AS m
  FROM (SELECT input_id, regexp_replace(regexp_replace(response, '^```json\\s*', ''), '\\s*```$', '') AS c
        FROM responses)"""
RULE_HITS = "\n  UNION ALL\n".join(
    f"""  SELECT page_id AS input_id, {_sq(f)} AS field, {_sq(rid)} AS rule_id, {c}::DOUBLE AS confidence, {i + 1} AS ord,
         regexp_extract({src}, {_sq(p)}, 1) AS value FROM pages"""
    for i, (rid, f, p, src, c) in enumerate(WEB_RULES))
RULE_BEST = """
  SELECT input_id, field, value, rule_id FROM hits WHERE value <> ''
  QUALIFY row_number() OVER (PARTITION BY input_id, field ORDER BY confidence DESC, ord) = 1"""
CASCADE = """
  SELECT p.page_id AS input_id,
         CASE WHEN r.m IS NOT NULL THEN 1 WHEN b.n > 0 THEN 3 ELSE 4 END AS level,
         CASE WHEN r.m IS NOT NULL THEN array_to_string(list_sort(map_keys(r.m)), ',')
              WHEN b.n > 0 THEN b.fields END AS fields,
         CASE WHEN r.m IS NULL AND coalesce(b.n, 0) = 0 THEN
           'All extraction levels failed. Level 1: invalid JSON response, Level 2: no anchors-only extractor configured, Level 3: no rule matched'
         END AS error
  FROM pages p LEFT JOIN parsed r ON r.input_id = p.page_id
  LEFT JOIN (SELECT input_id, count(*) AS n, string_agg(field, ',' ORDER BY field) AS fields FROM best GROUP BY input_id) b
    ON b.input_id = p.page_id"""
_SCHEMA = "(VALUES " + ", ".join(f"({_sq(f)})" for f in PAGE_SCHEMA_FIELDS) + ") s(field)"
_EXTRACT = [("responses", RESPONSES), ("parsed", PARSED), ("hits", RULE_HITS), ("best", RULE_BEST),
            ("cascade", CASCADE)]

ORACLE["parse_responses"] = W("extracted", extra=[("responses", RESPONSES), ("parsed", PARSED)]) + """
SELECT input_id, true AS ok, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM parsed WHERE m IS NOT NULL
UNION ALL SELECT input_id, false, NULL, NULL FROM parsed WHERE m IS NULL"""
ORACLE["rule_extract"] = W(extra=[("hits", RULE_HITS), ("best", RULE_BEST)]) + "SELECT * FROM best"
ORACLE["extract_cascade"] = W("extracted", extra=_EXTRACT) + "SELECT * FROM cascade"
ORACLE["missing_fields"] = W("extracted") + f"""
SELECT p.page_id AS input_id, coalesce(m.missing, '') AS missing, coalesce(m.n, 0)::BIGINT AS n_missing
FROM pages p LEFT JOIN (
  SELECT q.page_id, string_agg(s.field, ',' ORDER BY s.field) AS missing, count(*) AS n
  FROM pages q CROSS JOIN {_SCHEMA}
  WHERE NOT EXISTS (SELECT 1 FROM extracted e WHERE e.input_id = q.page_id AND e.field = s.field)
  GROUP BY q.page_id) m ON m.page_id = p.page_id"""
ORACLE["run_status"] = W("extracted", extra=_EXTRACT + [("keys", """
    SELECT c.input_id, c.level, c.error, s.field
    FROM cascade c CROSS JOIN """ + _SCHEMA + """
    WHERE s.field NOT IN (SELECT unnest(string_split(coalesce(c.fields, ''), ',')))""")]) + """
SELECT c.input_id,
       CASE WHEN c.level >= 4 OR k.missing IS NOT NULL THEN 'failed' WHEN c.level > 1 THEN 'degraded' ELSE 'success' END AS status,
       CASE WHEN c.level >= 4 THEN 'exhausted_degradation' WHEN k.missing IS NOT NULL THEN 'validation' END AS stage,
       c.level, coalesce(k.missing, '') AS missing_fields,
       CASE WHEN c.level >= 4 THEN c.error WHEN k.missing IS NOT NULL THEN 'Extracted data missing required fields.'
            WHEN c.level > 1 THEN 'Extraction succeeded at degradation level ' || c.level END AS message
FROM cascade c LEFT JOIN (SELECT input_id, string_agg(field, ',' ORDER BY field) AS missing FROM keys GROUP BY input_id) k
  USING (input_id)"""

FEW_SHOT = """
  SELECT i.input_id,
         CASE WHEN f.body IS NULL THEN '暂无规则' ELSE '## 提取规则（按置信度排序）' || chr(10) || f.body END AS few_shot
  FROM input_types i LEFT JOIN (
    SELECT input_id, string_agg(
      chr(10) || '规则 ' || id || ' [置信度: ' || CAST(confidence AS VARCHAR) || ', 成功次数: ' || CAST(support AS VARCHAR)
      || CASE source WHEN 'via_kg' THEN ', 来源: 知识图谱关联' WHEN 'via_signature' THEN ', 来源: 签名匹配' ELSE '' END
      || ']:' || chr(10) || '- 触发条件: 提取 ' || coalesce(field, '未知字段') || ' 字段时' || chr(10) || '- 操作: ' || coalesce(action, '未定义操作')
      || CASE WHEN anchor <> '' THEN ' (锚点: ' || anchor || ')' ELSE '' END
      || CASE WHEN pattern <> '' THEN ' (模式: ' || pattern || ')' ELSE '' END
      || CASE WHEN example_input IS NOT NULL OR example_output IS NOT NULL
              THEN chr(10) || '- 示例: "' || coalesce(example_input, '') || '" → "' || coalesce(example_output, '') || '"' ELSE '' END,
      chr(10) ORDER BY confidence DESC, rank) AS body
    FROM (SELECT t.input_id, t.rank, t.id, t.source, t.confidence, t.support, t.field,
                 b.action, b.anchor, b.pattern, b.example_input, b.example_output
          FROM retrieved t JOIN input_types y USING (input_id)
          JOIN rules b ON b.template_id = y.template_id AND b.id = t.id) GROUP BY input_id) f USING (input_id)"""
ORACLE["few_shot_text"] = W(*RETRIEVAL_VIEWS, extra=_retrieval_ctes() + [("fs", FEW_SHOT)]) + \
    "SELECT input_id, few_shot FROM fs"
NL = "chr(10)"
_j = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
ORACLE["build_prompts"] = W(*RETRIEVAL_VIEWS, "anchors", "cells", extra=_retrieval_ctes() + [("fs", FEW_SHOT), ("nonempty", NONEMPTY), ("prompts", f"""
  SELECT i.input_id,
         '## 目标模板签名' || {NL} || md5(i.template_id) || {NL} || {NL}
         || '## 字段定义' || {NL} || coalesce(tf.fields_txt, '{{}}') || {NL} || {NL}
         || '## 公式约束' || {NL} || coalesce(ff.formulas_txt, '[]') || {NL} || '说明：以上单元格包含公式，请勿填充，但可用于验证。' || {NL} || {NL}
         || '## 锚点参考' || {NL} || coalesce(tf.anchors_txt, '{{}}') || {NL} || {NL}
         || fs.few_shot || {NL} || {NL}
         || '## 成功案例参考' || {NL} || coalesce(mt.patterns_txt, '[]') || {NL} || {NL}
         || '## 输入文档' || {NL} || i.content || {NL} AS prompt
  FROM input_types i JOIN fs USING (input_id)
  LEFT JOIN (SELECT template_id,
        '{{' || {NL} || string_agg('  ' || {_j('field')} || ': {{' || {NL} || '    "anchor": ' || {_j('anchor_id')} || {NL} || '  }}', ',' || {NL} ORDER BY field) || {NL} || '}}' AS fields_txt,
        '{{' || {NL} || string_agg('  ' || {_j('field')} || ': {{' || {NL} || '    "type": ' || {_j('type')} || ',' || {NL} || '    "role": ' || {_j('role')} || ',' || {NL}
               || '    "pattern": ' || {_j('pattern')} || {NL} || '  }}', ',' || {NL} ORDER BY field, type, role, pattern) || {NL} || '}}' AS anchors_txt
        FROM anchors GROUP BY template_id) tf USING (template_id)
  LEFT JOIN (SELECT 'src' || workbook_id AS template_id, '[' || {NL} || string_agg('  {{' || {NL} || '    "cell": ' || {_j('cell')} || ',' || {NL}
               || '    "formula": ' || {_j('value')} || ',' || {NL} || '    "depends_on": [' || {NL}
               || array_to_string(list_transform(regexp_extract_all(value, '[A-Z]+[0-9]+'), lambda c: '      ' || {_j('c')}), ',' || {NL}) || {NL} || '    ]' || {NL} || '  }}',
               ',' || {NL} ORDER BY "row", col) || {NL} || ']' AS formulas_txt
        FROM nonempty WHERE workbook_id < 20 AND sheet = 'R' AND value LIKE '=%' GROUP BY workbook_id) ff USING (template_id)
  LEFT JOIN (SELECT input_id, '[' || {NL} || string_agg('  {{' || {NL} || '    "pattern_id": ' || {_j('pattern_id')} || ',' || {NL} || '    "accuracy": '
               || CAST(accuracy AS VARCHAR) || {NL} || '  }}', ',' || {NL} ORDER BY rank) || {NL} || ']' AS patterns_txt
        FROM matched GROUP BY input_id) mt USING (input_id)""")]) + """
SELECT input_id, length(prompt)::BIGINT AS prompt_chars, md5(prompt) AS prompt_md5 FROM prompts"""

_NUM = "CAST(round_even(CAST({c} AS DOUBLE) * 100, 0) / 100.0 AS VARCHAR)"
_STR = f"regexp_replace(regexp_replace({{c}}, '^{_WS}+', ''), '{_WS}+$', '')"
_DIFF_COLS = [("c_name", _STR), ("c_nationkey", _NUM), ("c_acctbal", _NUM), ("c_mktsegment", _STR)]
ORACLE["data_diff"] = W("diff_gen", "diff_bench") + "\nUNION ALL\n".join(
    f"""SELECT c_custkey, '{c}' AS col_name, g AS generated, b AS benchmark FROM (
  SELECT coalesce(x.c_custkey, y.c_custkey) AS c_custkey, {f.replace('{c}', 'x.' + c)} AS g, {f.replace('{c}', 'y.' + c)} AS b
  FROM diff_gen x FULL OUTER JOIN diff_bench y USING (c_custkey)) WHERE g IS DISTINCT FROM b"""
    for c, f in _DIFF_COLS)

# --- phase 10: declared checks ---------------------------------------------------------

_TYPED = "\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT page_id AS input_id, {_sq(f)} AS field, regexp_extract({src}, {_sq(p)}, 1) AS value,
       {_sq(t)} AS type FROM pages) WHERE value <> ''""" for f, p, src, t in TYPED_PAGE_FIELDS)
ORACLE["validate_types"] = f"""
SELECT *, CASE WHEN type = 'number' THEN regexp_full_match(value, '\\s*[+-]?([0-9]+([.][0-9]*)?|[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')
               ELSE regexp_replace(regexp_replace(value, '^{_WS}+', ''), '{_WS}+$', '') <> '' END AS valid
FROM ({_TYPED})"""

ORACLE["check_formulas"] = W("cells", extra=[
    ("nums", """SELECT l_partkey AS workbook_id, l_returnflag AS sheet, l_linenumber::BIGINT AS "row", month(l_shipdate)::BIGINT AS col,
                       sum(l_quantity) AS num FROM lineitem GROUP BY ALL"""),
    ("f", f"""SELECT workbook_id, sheet, "row", col, {a1('"row"', 'col')} AS cell,
                     {letters_to_num("regexp_extract(value, '([A-Z]+)[0-9]+:', 1)")} AS c1,
                     CAST(regexp_extract(value, '[A-Z]+([0-9]+):', 1) AS BIGINT) AS r1,
                     {letters_to_num("regexp_extract(value, ':([A-Z]+)', 1)")} AS c2,
                     CAST(regexp_extract(value, ':[A-Z]+([0-9]+)', 1) AS BIGINT) AS r2
              FROM cells WHERE value LIKE '=%'""")]) + """
SELECT f.workbook_id, f.sheet, f.cell, coalesce(sum(n.num), 0.0) AS expected, any_value(t.num) AS target,
       coalesce(abs(coalesce(sum(n.num), 0.0) - any_value(t.num)) <= 1e-6, false) AS consistent
FROM f LEFT JOIN nums n ON n.workbook_id = f.workbook_id AND n.sheet = f.sheet AND n.col BETWEEN f.c1 AND f.c2 AND n."row" BETWEEN f.r1 AND f.r2
LEFT JOIN nums t ON t.workbook_id = f.workbook_id AND t.sheet = f.sheet AND t."row" = f."row" AND t.col = f.col
GROUP BY f.workbook_id, f.sheet, f.cell"""

ORACLE["check_unique"] = W("input_types") + """
SELECT template_id, signature, count(*)::BIGINT AS n FROM input_types GROUP BY ALL HAVING count(*) > 1"""
ORACLE["list_templates"] = W("rules", "input_types", "patterns") + """
SELECT coalesce(r.template_id, p.template_id) AS template_id, coalesce(r.n_rules, 0)::BIGINT AS n_rules,
       coalesce(p.n_variants, 0)::BIGINT AS n_variants, strftime(r.last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated
FROM (SELECT template_id, count(*) AS n_rules, max(last_used) AS last_updated FROM rules GROUP BY ALL) r
FULL OUTER JOIN (SELECT template_id, count(DISTINCT input_signature) AS n_variants FROM patterns GROUP BY ALL) p
  USING (template_id)"""

# --- phase 9: streaming (same results as the batch forms) ------------------------------

ORACLE["stream_ingest"] = ORACLE["cluster_key"]
ORACLE["stream_clusters"] = W("exec_log", extra=[("log", LOG)]) + """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, cluster_key, count(*)::BIGINT AS samples
FROM log WHERE error_type IS NOT NULL GROUP BY ALL"""
ORACLE["stream_lifecycle"] = ORACLE["replay_outcomes"]

# --- rule actions: labels, tables, pattern lists ------------------------------------

_WORD = "[\\p{L}\\p{N}_]+"
_EDGES = "^[ \\t\\r:=：|]+|[ \\t\\r|;,]+$"
_ws = lambda x: f"regexp_extract_all(lower({x}), '{_WORD}')"
_trim = lambda x: f"regexp_replace({x}, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')"
_ANCHORS = [
    ("alines", """SELECT input_id, template_id, line_no, ls[line_no] AS line, ls[line_no + 1] AS next_line FROM (
        SELECT *, unnest(range(1, len(ls) + 1)) AS line_no FROM (
          SELECT input_id, template_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]')) AS ls FROM forms))"""),
    ("labels", f"""SELECT template_id, rule_id, field, confidence, ord, array_to_string({_ws('anchor')}, ' ') AS label, len({_ws('anchor')}) AS n
        FROM form_rules WHERE action = 'extract_after_anchor'"""),
    ("amet", f"""SELECT DISTINCT l.input_id, l.template_id, line_no, line, next_line, pos, n, label
        FROM (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT *, {_ws('line')} AS w FROM alines)) l
        JOIN labels a ON a.template_id = l.template_id AND array_to_string(w[pos:pos + n - 1], ' ') = label AND pos + n - 1 <= len(w)"""),
    ("ahits", """SELECT *, lead(pos) OVER (PARTITION BY input_id, line_no ORDER BY pos, n DESC) AS next_pos FROM (
        SELECT *, max(pos + n) OVER (PARTITION BY input_id, line_no ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM amet)
        WHERE reach IS NULL OR pos >= reach"""),
    ("aruns", f"""SELECT h.*, f.below, regexp_extract_all(line, '{_WORD}|[^\\p{{L}}\\p{{N}}_]+') AS r, regexp_extract_all(next_line, '{_WORD}|[^\\p{{L}}\\p{{N}}_]+') AS r2,
               CASE WHEN regexp_matches(line, '^{_WORD}') THEN 0 ELSE 1 END AS o, CASE WHEN regexp_matches(next_line, '^{_WORD}') THEN 0 ELSE 1 END AS o2
        FROM ahits h LEFT JOIN (SELECT input_id, line_no - 1 AS line_no, min(pos) AS below FROM ahits GROUP BY ALL) f USING (input_id, line_no)"""),
    ("aval", f"""SELECT input_id, template_id, label, line_no, pos,
               regexp_replace(array_to_string(r[2 * (pos + n - 1) + o:coalesce(2 * next_pos - 2 + o, len(r))], ''), '{_EDGES}', '', 'g') AS here,
               CASE WHEN next_pos IS NULL AND next_line IS NOT NULL
                    THEN regexp_replace(array_to_string(r2[1:coalesce(2 * below - 2 + o2, len(r2))], ''), '{_EDGES}', '', 'g') ELSE '' END AS under FROM aruns"""),
    ("afirst", """SELECT input_id, template_id, label, arg_min(CASE WHEN here <> '' THEN here ELSE under END, (line_no, pos)) AS value
        FROM aval WHERE here <> '' OR under <> '' GROUP BY ALL"""),
    ("acand", "SELECT input_id, template_id, field, value, rule_id, confidence, ord FROM afirst JOIN labels USING (template_id, label)"),
]
_TABLES = [
    ("trows", f"""SELECT *, line_no - row_number() OVER (PARTITION BY input_id ORDER BY line_no) AS table_no FROM (
        SELECT input_id, template_id, line_no, line, list_transform(string_split(regexp_replace({_trim('line')}, '^\\||\\|$', '', 'g'), '|'), lambda x: {_trim('x')}) AS cells
        FROM (SELECT input_id, template_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM forms)
        WHERE contains(line, '|'))"""),
    ("tbody", """SELECT *, row_number() OVER (PARTITION BY input_id, table_no ORDER BY line_no) AS row FROM (
        SELECT *, first_value(cells) OVER t AS names, row_number() OVER t AS nth FROM trows WINDOW t AS (PARTITION BY input_id, table_no ORDER BY line_no))
        WHERE nth > 1 AND NOT regexp_matches(line, '^[ \\t\\r|:-]*-[ \\t\\r|:-]*$')"""),
    ("tcells", f"""SELECT input_id, template_id, table_no, row, col, cells[col] AS value, regexp_replace({_trim('lower(names[col])')}, '[ \\t\\r]+', ' ', 'g') AS header
        FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS col FROM tbody) WHERE names[col] IS NOT NULL"""),
    ("hnames", f"""SELECT template_id, rule_id, field, confidence, ord, alias, regexp_replace({_trim('lower(headers[alias])')}, '[ \\t\\r]+', ' ', 'g') AS header
        FROM (SELECT *, unnest(range(1, len(headers) + 1)) AS alias FROM form_rules WHERE action = 'extract_by_header')"""),
    ("hfound", """SELECT input_id, template_id, field, row, value, rule_id, confidence, ord FROM (
        SELECT *, rank() OVER (PARTITION BY input_id, field ORDER BY confidence DESC, ord, alias, table_no, col) AS k
        FROM tcells JOIN hnames USING (template_id, header) WHERE header <> '') WHERE k = 1"""),
    ("hspare", """SELECT input_id, template_id, field, 1 AS row, value, rule_id, confidence, ord FROM (
        SELECT *, row_number() OVER (PARTITION BY input_id, field ORDER BY confidence DESC, ord) AS k FROM (
          SELECT f.input_id, f.template_id, r.field, r.rule_id, r.confidence, r.ord, regexp_extract(f.content, r.fallback, 1) AS value
          FROM forms f JOIN form_rules r USING (template_id) WHERE r.action = 'extract_by_header' AND r.fallback IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM hfound h WHERE h.input_id = f.input_id AND h.field = r.field)) WHERE value <> '') WHERE k = 1"""),
    ("hcand", "SELECT * FROM hfound UNION ALL SELECT * FROM hspare"),
]
_PATTERNS = [
    ("pcand", """SELECT input_id, template_id, field, value, rule_id, confidence, ord FROM (
        SELECT *, row_number() OVER (PARTITION BY input_id, rule_id ORDER BY k) AS first FROM (
          SELECT f.input_id, f.template_id, r.field, r.rule_id, r.confidence, r.ord, k, regexp_extract(f.content, p, 1) AS value
          FROM forms f JOIN (SELECT *, unnest(patterns) AS p, generate_subscripts(patterns, 1) AS k FROM form_rules WHERE action = 'try_patterns'
                             UNION ALL SELECT *, pattern, 1 FROM form_rules WHERE pattern IS NOT NULL) r USING (template_id)) WHERE value <> '')
        WHERE first = 1"""),
]
_one = lambda name: f"""SELECT input_id, template_id, field, value, rule_id FROM (
  SELECT *, row_number() OVER (PARTITION BY input_id, field ORDER BY confidence DESC, ord) AS k FROM {name}) WHERE k = 1"""  # noqa: E731
ORACLE["anchor_extract"] = W("forms", "form_rules", extra=_ANCHORS) + _one("acand")
ORACLE["header_extract"] = W("forms", "form_rules", extra=_TABLES) + "SELECT input_id, template_id, field, CAST(row AS INTEGER) AS row, value, rule_id FROM hcand"
ORACLE["bank_extract"] = W("forms", "form_rules", extra=[*_ANCHORS, *_TABLES, *_PATTERNS, ("every", """
    SELECT * FROM acand UNION ALL SELECT * FROM pcand UNION ALL
    SELECT input_id, template_id, field, arg_min(value, row), rule_id, confidence, ord FROM hcand WHERE value <> ''
    GROUP BY input_id, template_id, field, rule_id, confidence, ord""")]) + _one("every")

# --- analysis of samples -------------------------------------------------------------

ORACLE["induce_anchors"] = W("forms", "form_values", extra=[
    _ANCHORS[0],
    ("lw", f"SELECT *, {_ws('line')} AS w, coalesce({_ws('next_line')}, []) AS nw FROM alines"),
    ("kv", f"SELECT input_id, template_id, field, {_ws('value')} AS v FROM form_values JOIN forms USING (input_id) WHERE len({_ws('value')}) > 0"),
    ("vp", """SELECT l.input_id, l.template_id, k.field, l.line_no, l.w,
        list_filter(range(1, len(l.w) - len(v) + 2), lambda p: l.w[p:p + len(v) - 1] = v)[1] AS p FROM lw l JOIN kv k USING (input_id)"""),
    ("bf", """SELECT x.input_id, x.template_id, x.field, CASE WHEN p > 1 THEN x.w[1:p - 1] ELSE coalesce(a.w, []) END AS b
        FROM vp x LEFT JOIN lw a ON a.input_id = x.input_id AND a.line_no = x.line_no - 1 WHERE p IS NOT NULL"""),
    ("cd", """SELECT DISTINCT input_id, template_id, field, n, array_to_string(b[len(b) - n + 1:len(b)], ' ') AS label
        FROM (SELECT *, unnest(range(1, least(len(b), 3) + 1)) AS n FROM bf)"""),
    ("nk", "SELECT template_id, field, count(DISTINCT input_id) AS n_known FROM kv GROUP BY ALL"),
    ("ok", """SELECT template_id, field, label, n, n_known FROM (SELECT template_id, field, label, n, count(*) AS seen FROM cd GROUP BY ALL)
        JOIN nk USING (template_id, field) WHERE seen >= n_known * 0.5::DOUBLE"""),
    ("gr", """SELECT l.input_id, l.template_id, o.label, arg_min({'a': CASE WHEN pos + n <= len(w) THEN w[pos + n:len(w)] ELSE nw END}, (line_no, pos)) AS f
        FROM (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM lw) l JOIN (SELECT DISTINCT template_id, label, n FROM ok) o
          ON o.template_id = l.template_id AND pos + n - 1 <= len(w) AND array_to_string(w[pos:pos + n - 1], ' ') = o.label GROUP BY ALL"""),
    ("pe", """SELECT o.template_id, o.field, o.label, o.n, o.n_known, count(*) AS n_label,
        count(*) FILTER (k.v IS NOT NULL AND g.f.a[1:len(k.v)] = k.v) AS support
        FROM gr g JOIN ok o USING (template_id, label) LEFT JOIN kv k ON k.input_id = g.input_id AND k.field = o.field GROUP BY ALL"""),
    ("rk", """SELECT *, support::DOUBLE / n_label AS precision, support::DOUBLE * n_samples / (n_label * n_known) AS lift,
        row_number() OVER (PARTITION BY template_id, field ORDER BY support::DOUBLE / n_label DESC, support DESC, n DESC, label) AS k
        FROM pe JOIN (SELECT template_id, count(*) AS n_samples FROM forms GROUP BY ALL) USING (template_id) WHERE support >= n_known * 0.5::DOUBLE"""),
]) + "SELECT template_id, field, label AS anchor, support, n_label, n_known, precision, lift FROM rk WHERE k = 1"

# --- positional diff -----------------------------------------------------------------

_pside = lambda v, where: f"""SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS row, trim(c_name) AS c_name,
    round_even(c_nationkey::DOUBLE * 100, 0) / 100 AS c_nationkey, round_even(c_acctbal * 100, 0) / 100 AS c_acctbal FROM {v} {where}"""  # noqa: E731
ORACLE["positional_diff"] = W("diff_gen", "diff_bench", extra=[
    ("pg", _pside("diff_gen", "WHERE c_custkey <> 3")), ("pb", _pside("diff_bench", ""))]) + " UNION ALL ".join(
    f"""SELECT row, '{c}' AS col_name, CAST(g.{c} AS VARCHAR) AS generated, CAST(b.{c} AS VARCHAR) AS benchmark
FROM pg g JOIN pb b USING (row) WHERE g.{c} IS DISTINCT FROM b.{c}""" for c in ("c_name", "c_nationkey", "c_acctbal")) + """
UNION ALL SELECT row, '__row__', NULL, 'present' FROM pb WHERE row NOT IN (SELECT row FROM pg)"""

# --- clusters: membership, and kept current by days ------------------------------------

ORACLE["cluster_events"] = W("exec_log", extra=_MEM[:1]) + """
SELECT cluster_key, event_id FROM log WHERE error_type IS NOT NULL AND error_type <> ''"""
ORACLE["cluster_update"] = ORACLE["summary_rules"]

# --- layout search without given pairs ---------------------------------------------------

_CLASSES = [*_LAY, ("classes", """
  SELECT workbook_id, min(workbook_id) OVER (PARTITION BY t) AS class_id FROM (
    SELECT workbook_id, string_agg(sheet || ':' || dr || ':' || dc, ';' ORDER BY sheet, dr, dc) AS t FROM occ GROUP BY workbook_id)""")]
ORACLE["layout_classes"] = W("form_cells", extra=[("cells", "SELECT * FROM form_cells"), *_CLASSES]) + "SELECT workbook_id, class_id FROM classes"
ORACLE["layout_search"] = W("form_cells", extra=[
    ("cells", "SELECT * FROM form_cells"), *_CLASSES,
    ("o", "SELECT * FROM occ WHERE workbook_id IN (SELECT class_id FROM classes)"),
    ("l", "SELECT workbook_id, sheet, occupied_count AS a, max_row - min_row AS h, max_col - min_col AS w FROM layout WHERE workbook_id IN (SELECT class_id FROM classes)"),
    ("k", """SELECT a.workbook_id AS x, b.workbook_id AS y, a.sheet, count(*) AS k FROM o a JOIN o b
        ON a.sheet = b.sheet AND a.dr = b.dr AND a.dc = b.dc AND a.workbook_id < b.workbook_id GROUP BY ALL"""),
    # every pair that shares a cell, and all sheets both have
    ("s", """SELECT p.x, p.y, coalesce(k.k, 0) / (lx.a + ly.a - coalesce(k.k, 0)) AS jac,
        greatest(0.0, 1.0 - (abs(lx.h - ly.h)::DOUBLE / greatest(lx.h, ly.h, 1) + abs(lx.w - ly.w)::DOUBLE / greatest(lx.w, ly.w, 1)) / 2.0) AS shape
        FROM (SELECT DISTINCT x, y FROM k) p JOIN l lx ON lx.workbook_id = p.x JOIN l ly ON ly.workbook_id = p.y AND ly.sheet = lx.sheet
        LEFT JOIN k ON k.x = p.x AND k.y = p.y AND k.sheet = lx.sheet"""),
    ("n", "SELECT workbook_id, count(*) AS n FROM l GROUP BY ALL"),
    ("r", """SELECT s.x, s.y, sum(0.8::DOUBLE * jac + 0.2::DOUBLE * shape) / any_value(nx.n + ny.n - c.c) AS raw
        FROM s JOIN n nx ON nx.workbook_id = s.x JOIN n ny ON ny.workbook_id = s.y
        JOIN (SELECT x, y, count(*) AS c FROM s GROUP BY ALL) c ON c.x = s.x AND c.y = s.y GROUP BY s.x, s.y"""),
]) + "SELECT x, y, round_even(raw * 10000, 0) / 10000 AS score FROM r WHERE raw >= 0.78::DOUBLE - 1e-12"

# --- batch run over all forms --------------------------------------------------------------

from refbank.plans.fixtures import FORM_REQUIRED, FORM_SHEET, N_TEMPLATES  # noqa: E402

_RUN = [*_ANCHORS, *_TABLES, *_PATTERNS, ("every", """
    SELECT * FROM acand UNION ALL SELECT * FROM pcand UNION ALL
    SELECT input_id, template_id, field, arg_min(value, row), rule_id, confidence, ord FROM hcand WHERE value <> ''
    GROUP BY input_id, template_id, field, rule_id, confidence, ord"""),
    ("vals", _one("every")),
    ("sheet", "SELECT * FROM (VALUES " + ", ".join(f"({r}, {_sq(f)})" for r, f in enumerate(FORM_SHEET, 1)) + ") s(r, field)"),
    ("tpls", f"SELECT 'form' || range AS tpl, range % 5 = 0 AS locked FROM range({N_TEMPLATES})"),
    ("tcell", """SELECT tpl, r AS row, 1 AS col, field AS value FROM tpls, sheet UNION ALL SELECT tpl, 20, 3, 'end' FROM tpls
        UNION ALL SELECT tpl, r, 2, '=SUM(C1:C9)' FROM tpls, sheet WHERE locked AND field = 'total'"""),
    ("miss", f"""SELECT f.input_id, string_agg(s.field, ',' ORDER BY s.field) AS missing FROM forms f, sheet s
        WHERE s.field IN ({', '.join(_sq(f) for f in FORM_REQUIRED)}) AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.input_id = f.input_id AND v.field = s.field)
        GROUP BY f.input_id"""),
    ("found", "SELECT DISTINCT input_id FROM vals"),
    ("stat", """SELECT f.input_id, f.template_id, md5(f.content) AS sig, m.missing, v.input_id IS NULL AS none_found,
        CASE WHEN v.input_id IS NULL OR m.missing IS NOT NULL THEN 'failed' ELSE 'degraded' END AS status
        FROM forms f LEFT JOIN miss m USING (input_id) LEFT JOIN found v USING (input_id)"""),
    ("bnd", """SELECT v.input_id, s.r AS row, v.value, t.locked AND v.field = 'total' AS clash FROM vals v JOIN stat x USING (input_id)
        JOIN sheet s ON s.field = v.field JOIN tpls t ON t.tpl = v.template_id WHERE x.status <> 'failed'"""),
]
ORACLE["batch_filled"] = W("forms", "form_rules", extra=_RUN) + """
SELECT coalesce(a.input_id, b.input_id) AS input_id, chr(64 + coalesce(a.col, 2)) || coalesce(a.row, b.row) AS cell,
       CASE WHEN b.input_id IS NOT NULL THEN b.value ELSE a.value END AS value, b.input_id IS NOT NULL AS filled
FROM (SELECT x.input_id, c.row, c.col, c.value FROM stat x JOIN tcell c ON c.tpl = x.template_id WHERE x.status <> 'failed') a
FULL OUTER JOIN (SELECT * FROM bnd WHERE NOT clash) b ON b.input_id = a.input_id AND b.row = a.row AND a.col = 2"""
ORACLE["batch_events"] = W("forms", "form_rules", extra=_RUN) + """
SELECT x.input_id, x.template_id, sig AS template_signature,
       CASE WHEN none_found THEN 'exhausted_degradation' WHEN missing IS NOT NULL THEN 'validation' END AS error_type, missing AS missing_fields, status,
       CASE WHEN none_found THEN NULL WHEN missing IS NOT NULL THEN 'Extracted data missing required fields.'
            ELSE 'Extraction succeeded at degradation level 3' END AS message FROM stat x"""
