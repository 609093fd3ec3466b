"""DuckDB SQL for the derived views of :mod:`refbank.plans.fixtures`.

The driver pre-registers the parquet tables as views; every oracle query is
``WITH <needed views> SELECT ...``.  Keep these definitions in step with the
Spark builders.
"""

from __future__ import annotations

from refbank.plans import fixtures as X

AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"

# view name -> (dependencies, body)
_quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
_list = lambda x: "NULL::VARCHAR[]" if x is None else "[" + ", ".join(_quote(v) for v in x) + "]::VARCHAR[]"


def _form_label(field: str) -> str:
    return f"{(X.FORM_LABELS | X.FORM_COLUMNS)[field]}[o_custkey % 4 + 1]"


FORMS = f"""
    SELECT o_orderkey AS input_id, 'form' || (o_custkey % 20) AS template_id,
           concat_ws(chr(10), {_form_label("order")} || ': ' || o_orderkey || '   ' || {_form_label("date")} || ': ' || strftime(o_orderdate, '%Y-%m-%d'),
             {_form_label("buyer")}, '', coalesce(c_name, '-'),
             {_form_label("total")} || ' = ' || CAST(round_even(o_totalprice * 100, 0) AS BIGINT), {_form_label("priority")} || ': ' || o_orderpriority, '',
             '| ' || {_form_label("part")} || ' | ' || {_form_label("quantity")} || ' | ' || {_form_label("tax")} || ' |', '| --- | ---: | --- |', r.rows) AS content
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, string_agg(row, chr(10) ORDER BY l_linenumber, row) AS rows
               FROM (SELECT l_orderkey, l_linenumber, '| ' || l_partkey || ' | ' || CAST(round_even(l_quantity, 0) AS BIGINT) || ' | '
                            || CAST(round_even(l_tax * 100, 0) AS BIGINT) || ' |' AS row FROM lineitem) GROUP BY l_orderkey) r ON r.l_orderkey = o_orderkey"""
FORM_RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"({_quote(t)}, {_quote(i)}, {_quote(f)}, {_quote(a)}, {_quote(an)}, {_list(h)}, {_list(ps)}, {_quote(p)}, {_quote(fb)}, {c}::DOUBLE, {o})"
    for t, i, f, a, an, h, ps, p, fb, c, o in X.form_rules_rows()
) + ") r(template_id, rule_id, field, action, anchor, headers, patterns, pattern, fallback, confidence, ord)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "inputs": ((), """
        SELECT doc_id AS input_id, source AS template_id,
               'in_' || doc_id || '.' || ['pdf','xlsx','docx','md','TXT','xlsm','dat'][doc_id % 7 + 1] AS path,
               text AS content
        FROM documents"""),
    "input_types": (("inputs",), """
        SELECT input_id, template_id, path, content, md5(content) AS signature,
               CASE lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '^.+[.]([^.]+)$', 1))
                 WHEN 'pdf' THEN 'pdf'
                 WHEN 'xls' THEN 'excel' WHEN 'xlsx' THEN 'excel' WHEN 'xlsm' THEN 'excel'
                 WHEN 'xlsb' THEN 'excel' WHEN 'xltx' THEN 'excel' WHEN 'xltm' THEN 'excel'
                 WHEN 'doc' THEN 'word' WHEN 'docx' THEN 'word'
                 WHEN 'md' THEN 'md' WHEN 'txt' THEN 'md' ELSE 'md' END AS input_type
        FROM inputs"""),
    "rules": ((), """
        SELECT 'src' || (p_partkey % 20) AS template_id,
               printf('R%03d', p_partkey) AS id,
               CASE p_type WHEN 'STANDARD' THEN 'pdf' WHEN 'PROMO' THEN 'excel'
                           WHEN 'ECONOMY' THEN 'word' WHEN 'MEDIUM' THEN 'md'
                           WHEN 'SMALL' THEN 'auto' END AS input_type,
               CASE WHEN p_brand = 'Brand#25' THEN 'table_extract'
                    WHEN p_brand = 'Brand#24' THEN NULL ELSE 'field_extraction' END AS "trigger",
               p_name AS field,
               round_even(p_size * 2.0::DOUBLE, 0) / 100.0::DOUBLE AS confidence,
               (p_partkey % 10)::BIGINT AS support,
               lu.last_used::TIMESTAMP AS last_used,
               CASE p_partkey % 4 WHEN 0 THEN 'extract_after_anchor' WHEN 1 THEN 'find_by_regex'
                                  WHEN 2 THEN 'semantic_extract' END AS action,
               CASE WHEN p_partkey % 4 = 0 THEN p_brand || ':' END AS anchor,
               CASE WHEN p_partkey % 4 = 1 THEN '(' || p_type || '[0-9]*)' END AS pattern,
               CASE WHEN p_size % 10 = 0 THEN p_brand || ': ' || p_name END AS example_input,
               CASE WHEN p_size % 10 = 0 THEN p_name END AS example_output,
               p_partkey AS ord
        FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_used
                             FROM lineitem GROUP BY l_partkey) lu ON lu.l_partkey = p_partkey"""),
    "edges": ((), """
        SELECT *, 1.0::DOUBLE AS weight FROM (
          SELECT DISTINCT 'src' || (l_partkey % 20) AS template_id, printf('R%03d', l_partkey) AS src,
                 'A' || l_suppkey AS dst, 'uses_anchor' AS relation
          FROM lineitem
          UNION ALL
          SELECT DISTINCT 'src' || (a.l_partkey % 20), printf('R%03d', a.l_partkey),
                 printf('R%03d', b.l_partkey), 'often_follows'
          FROM lineitem a JOIN lineitem b
            ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
          WHERE a.l_partkey % 20 = b.l_partkey % 20 AND a.l_partkey <> b.l_partkey)"""),
    "anchors": (("edges",), """
        SELECT e.template_id, e.dst AS anchor_id, 'f_' || s_suppkey AS field,
               ['text_match','regex','spatial','visual'][s_suppkey % 4 + 1] AS type,
               ['label','value_matcher','section_start','section_end','table_start','visual_locator'][s_nationkey % 6 + 1] AS role,
               s_name || ':' AS pattern
        FROM (SELECT DISTINCT template_id, dst FROM edges WHERE relation = 'uses_anchor') e
        JOIN supplier ON s_suppkey = CAST(substring(e.dst, 2) AS BIGINT)"""),
    "patterns": (("input_types",), """
        SELECT i.template_id, printf('P%03d', o.o_orderkey) AS pattern_id,
               i.signature AS input_signature, i.input_type,
               (o.o_orderkey % 41 + 60)::DOUBLE / 100.0::DOUBLE AS accuracy,
               coalesce(u.rules_used, []::VARCHAR[]) AS rules_used, o.o_orderkey AS ord
        FROM orders o JOIN input_types i ON i.input_id = o.o_custkey
        LEFT JOIN (
          SELECT o2.o_orderkey, list_sort(list(DISTINCT printf('R%03d', l.l_partkey))) AS rules_used
          FROM orders o2 JOIN input_types i2 ON i2.input_id = o2.o_custkey
          JOIN lineitem l ON l.l_orderkey = o2.o_orderkey
          WHERE 'src' || (l.l_partkey % 20) = i2.template_id
          GROUP BY o2.o_orderkey) u ON u.o_orderkey = o.o_orderkey"""),
    "exec_log": ((), """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts::TIMESTAMP AS ts,
               'sig' || (user_id % 10) AS template_signature,
               CASE WHEN failed THEN ['row_misalignment','semantic_mismatch','missing_fields'][k % 3 + 1] END AS error_type,
               CASE WHEN failed THEN CASE k % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Field_A']
                          WHEN 2 THEN ['Field_B','Field_A'] ELSE ['Field_C'] END END AS missing_fields,
               CASE WHEN failed AND k % 5 <> 0 THEN 'repair_' || (k % 7) END AS repair_action,
               ts::TIMESTAMP AS seq_ts, event_id AS seq_id
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS failed
              FROM events)"""),
    "open_log": (("exec_log",), """
        SELECT * REPLACE (CASE WHEN NOT coalesce(error_type = 'missing_fields' AND missing_fields[1] = 'Field_C', false)
                               THEN repair_action END AS repair_action) FROM exec_log"""),
    "outcomes": ((), """
        SELECT 'src' || (user_id % 20) AS template_id, ts::TIMESTAMP AS ts, event_id,
               CASE WHEN event_type IN ('purchase','signup') THEN 1
                    WHEN event_type = 'error' THEN -1 ELSE 0 END AS v
        FROM events"""),
    "schema_fields": ((), """
        SELECT 'tpl' || (p_partkey // 100) AS tpl, 'F' || p_partkey AS field,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'F' || (p_partkey - 1) END AS rel,
               CASE WHEN p_partkey % 10 = 0 THEN 1 + p_partkey % 50 END::BIGINT AS r0,
               CASE WHEN p_partkey % 10 = 0 THEN 1 + p_size % 5 END::BIGINT AS c0,
               CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size % 5 - 1 END::BIGINT AS dr,
               CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size % 3 - 1 END::BIGINT AS dc,
               p_partkey AS ord
        FROM part"""),
    "cells": ((), """
        SELECT workbook_id, sheet, "row", col,
               CASE WHEN sheet = 'R' THEN '=SUM(' || chr(64 + col::INT) || '2:' || chr(64 + col::INT) || '4)'
                    ELSE status END AS value
        FROM (SELECT l_partkey AS workbook_id, l_returnflag AS sheet, l_linenumber::BIGINT AS "row",
                     month(l_shipdate)::BIGINT AS col, min(l_linestatus) AS status
              FROM lineitem GROUP BY ALL)"""),
    "layout_pairs": ((), """
        SELECT b.x, p.p_partkey AS y
        FROM part p JOIN (SELECT p_brand, p_size, min(p_partkey) AS x FROM part GROUP BY ALL) b
          USING (p_brand, p_size)
        WHERE p.p_partkey <> b.x"""),
    "extracted": ((), """
        SELECT * FROM (
          SELECT page_id AS input_id, 'title' AS field, regexp_extract(html, '<title>(.*?)</title>', 1) AS value FROM pages
          UNION ALL SELECT page_id, 'h1', regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1) FROM pages
          UNION ALL SELECT page_id, 'lang', regexp_extract(html, '<html lang="([^"]*)"', 1) FROM pages
          UNION ALL SELECT page_id, 'utm_source', regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) FROM pages)
        WHERE value <> ''"""),
    "forms": ((), FORMS),
    "form_rules": ((), FORM_RULES),
    "form_cells": ((), """
        SELECT o_orderkey AS workbook_id, 'Form' AS sheet, r.range AS "row", c.range AS col, 'x' AS value FROM orders, range(1, 5) r, range(1, 3) c
        UNION ALL SELECT o_orderkey, 'Lines', 1, c.range, 'h' FROM orders, range(1, 4) c
        UNION ALL SELECT l_orderkey, 'Lines', l_linenumber + 1, c.range, CASE WHEN c.range < 3 THEN 'v' WHEN tax > 0 THEN 't' ELSE ' ' END
        FROM (SELECT l_orderkey, l_linenumber, max(l_tax) AS tax FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL), range(1, 4) c"""),
    "form_values": ((), """
        SELECT o_orderkey AS input_id, f.field, f.value FROM (
          SELECT o_orderkey, unnest([{'field': 'order', 'value': CAST(o_orderkey AS VARCHAR)}, {'field': 'date', 'value': strftime(o_orderdate, '%Y-%m-%d')},
            {'field': 'buyer', 'value': c_name}, {'field': 'total', 'value': CAST(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR)},
            {'field': 'priority', 'value': o_orderpriority}]) AS f
          FROM orders LEFT JOIN customer ON c_custkey = o_custkey) WHERE f.value IS NOT NULL"""),
    "diff_gen": ((), """
        SELECT c_custkey, '  ' || c_name || ' ' AS c_name, c_nationkey,
               c_acctbal + 0.001::DOUBLE + CASE WHEN c_custkey % 97 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS c_acctbal,
               c_mktsegment
        FROM customer"""),
    "diff_bench": ((), """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"""),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named views (plus extra CTEs, in order)."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _order(list(names))]
    for n, body in extra or []:
        parts.append(f"{n} AS ({body})")
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""
