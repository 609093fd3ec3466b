"""The corpus queries (``op<N>_<name>``, ``pipeline``) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refbank.llm.common import fold, table, HELD_OUT_FOLD


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import decontaminate as D

    return D.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8).drop("k1", "k2")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import licenses as L

    return L.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def _op6_sql() -> str:
    from refbank.llm import licenses as L

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {v}, {b}, {quote(g)}, {t})" for n, v, b, g, t in L.template_bigrams(L.TEMPLATES))
    return f"""
WITH tpl(licence, variant, b, bigram, times) AS (VALUES {rows}),
d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, md5(text) AS h, 'line' AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position,
         unnest(string_split(text, chr(10))) AS body FROM d
  UNION ALL
  SELECT * FROM (SELECT doc_id, md5(text), 'paragraph',
         generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) - 1,
         unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS body FROM d) WHERE contains(body, chr(10))
  UNION ALL
  SELECT doc_id, md5(text), 'text', 0, text FROM d WHERE contains(text, chr(10))),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM u),
g AS (SELECT doc_id, h, unit, position, len(ws) - 1 AS a,
             unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bigram
      FROM w WHERE len(ws) >= 2),
c AS (SELECT doc_id, h, unit, position, a, bigram, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, h, unit, position, licence, 2.0::DOUBLE * sum(least(n, times)) / (a + b) AS dice
      FROM c JOIN tpl USING (bigram) GROUP BY doc_id, h, unit, position, a, licence, variant, b),
one AS (SELECT doc_id, h, unit, position, min((-dice, licence)) AS m FROM s WHERE dice >= 0.8 GROUP BY ALL),
p AS (SELECT doc_id, h, m[2] AS licence, min((m[1], unit, position)) AS k, count(*) AS n_units FROM one GROUP BY ALL)
SELECT doc_id, licence, -k[1] AS dice, k[2] AS unit, CAST(k[3] AS INTEGER) AS position, n_units FROM p
"""


OP6_SQL = _op6_sql()


#: The mixing tree over ``documents``: five sources make a domain.
MIX_WEIGHTS = {"domain": {"d0": 2.0}, "lang": {"en": 3.0}, "source": {}}
MIX_BUDGET_SHARE = 1.0
MIX_EPOCHS = 2
MIX_SEED = 17


def mix_levels() -> dict:
    number = F.regexp_extract("source", r"([0-9]{1,9})$", 1)
    return {"domain": F.when(number != "", F.concat(F.lit("d"), F.floor(number.cast("long") / 5))).otherwise("other"),
            "lang": F.col("lang"), "source": F.col("source")}


def mixed(docs: DataFrame, epoch_col: str | None = None) -> DataFrame:
    from refbank.llm import mixing as M

    return M.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_BUDGET_SHARE, MIX_EPOCHS, MIX_SEED, epoch_col=epoch_col)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "epoch").select(
        "doc_id", "lang", "source", "epoch")


def _deal(key: list[str], on: list[str], weight: str, parent: str) -> str:
    """SQL of one level of the tree: parent budgets to child budgets."""
    k, o = ", ".join(key), ", ".join(on)
    part = f"PARTITION BY {o}" if on else ""
    join = f"JOIN {parent} USING ({o})" if on else f"CROSS JOIN {parent}"
    return f"""SELECT {k}, greatest(0, least(cap, CAST(floor(top * w) AS BIGINT))) AS budget FROM (
  SELECT *, max(lam) OVER ({part}) AS top FROM (
    SELECT *, CAST(budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {key[-1]}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / sum(w) OVER ({part} ORDER BY cap / w, {key[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
    FROM (SELECT {k}, CAST(sum(total) * {MIX_EPOCHS} AS BIGINT) AS cap, CAST({weight} AS DOUBLE) AS w FROM leaves GROUP BY {k}) n
    {join}))"""


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> ''
              THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) // 5 AS VARCHAR) ELSE 'other' END AS domain,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY ALL),
root AS (SELECT CAST(floor(sum(total) * {MIX_BUDGET_SHARE}) AS BIGINT) AS budget FROM leaves),
l1 AS ({_deal(["domain"], [], "CASE domain WHEN 'd0' THEN 2 ELSE 1 END", "root")}),
l2 AS ({_deal(["domain", "lang"], ["domain"], "CASE lang WHEN 'en' THEN 3 ELSE 1 END", "l1")}),
l3 AS ({_deal(["domain", "lang", "source"], ["domain", "lang"], "1", "l2")}),
s AS (SELECT domain, lang, source, total, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS whole,
             budget - CASE WHEN total > 0 THEN budget // total ELSE 0 END * total AS rest
      FROM leaves JOIN l3 USING (domain, lang, source)),
o AS (SELECT d.*, total, whole, rest,
             sum(tokens) OVER (PARTITION BY domain, lang, source
               ORDER BY md5('{MIX_SEED}:' || CAST(whole + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS upto
      FROM d JOIN s USING (domain, lang, source)),
n AS (SELECT *, CASE WHEN total = 0 THEN 1
                     ELSE whole + CASE WHEN whole < {MIX_EPOCHS} AND upto <= rest THEN 1 ELSE 0 END END AS n FROM o)
SELECT doc_id, lang0 AS lang, source0 AS source, CAST(e.epoch AS INTEGER) AS epoch
FROM n JOIN (SELECT unnest(range(1, {MIX_EPOCHS} + 1)) AS epoch) e ON e.epoch <= n.n
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import simhash as S

    found = S.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", S.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import embeddings as V

    return V.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE fine),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, v.vec_id) AS component_id,
       v.vec_id = coalesce(c.m, v.vec_id) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import toxicity as X

    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id") == HELD_OUT_FOLD
    model = X.learn(docs, table(spark, sf_dir, "labels"), ~held)
    scored = docs.select("doc_id", held.alias("held_out"), X.score(F.col("text"), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= X.THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no URLs: a source is a host, its languages are its paths."""
    from refbank.llm import quality as Q

    held = fold("doc_id") == HELD_OUT_FOLD
    scored = Q.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held, F.col("source"), F.col("lang"))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm.lines import LineIndex

    docs = table(spark, sf_dir, "documents")
    kept = LineIndex(spark, min_chars=40, min_docs=5).insert(docs).dedupe(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line,
             translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL OR k.doc_id = f.keeper), ''))
           AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
"""

def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import langid as L

    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id") == HELD_OUT_FOLD
    filters = L.learn(docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), L.predict(F.col("text"), filters, spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import tokens as T

    return T.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of ``conv_id:turn``; nulls count as one blank."""
    blank = F.lit(" ")
    kind = (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), blank))) % 20).cast("int")
    text = F.coalesce("text", blank)
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refbank.llm import repair as R

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = R.repair(damaged(rows))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (rows.select("conv_id").distinct().withColumn("key", R.key(F.col("conv_id")))
            .join(done.conversations, "key", "left").join(done.digests, "key", "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


OP11_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
-- crc32, a table of bytes
crc0(b, v, n) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, n + 1 FROM crc0 WHERE n < 8),
crct AS (SELECT b, v FROM crc0 WHERE n = 8),
crc(k, v, n) AS (SELECT DISTINCT k, 4294967295::BIGINT, 0 FROM c UNION ALL
  SELECT crc.k, xor(crc.v // 256, crct.v), n + 1 FROM crc JOIN crct ON crct.b = xor(crc.v, ascii(substr(crc.k, n + 1, 1))) & 255
  WHERE n < length(crc.k)),
h AS (SELECT k, xor(v, 4294967295::BIGINT) % 20 AS kind FROM crc WHERE n = length(k)),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM c JOIN h USING (k) JOIN range(2) r ON r.range < CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
f AS (SELECT *, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS x0,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM o),
-- role states: 0 start, 1 s, 2 u, 3 a; inserts before a row
pre(q, ins, cost, texts, p) AS (VALUES (0, '', 0, [], 0), (0, 'I', 3, ['user:'], 2), (0, 'II', 6, ['user:', 'assistant:'], 3),
  (1, '', 0, [], 1), (1, 'I', 3, ['user:'], 2), (1, 'II', 6, ['user:', 'assistant:'], 3),
  (2, '', 0, [], 2), (2, 'I', 3, ['assistant:'], 3), (3, '', 0, [], 3), (3, 'I', 3, ['user:'], 2)),
act(p, e, x, cost, t) AS (VALUES (0, 'D', NULL, 4, 0), (1, 'D', NULL, 4, 1), (2, 'D', NULL, 4, 2), (3, 'D', NULL, 4, 3),
  (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2),
  (0, 'R', NULL, 3, 2), (1, 'R', NULL, 3, 2), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 3, 2)),
w(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'texts': []::VARCHAR[]} FROM f
  UNION ALL
  SELECT f.conv_id, f.i, act.t, min({
      'cost': best.cost + pre.cost + act.cost + CASE WHEN act.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END,
      'audit': best.audit || pre.ins || act.e,
      'texts': list_concat(best.texts, list_concat(pre.texts, CASE act.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
               ELSE [CASE act.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END))})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN pre ON pre.q = w.q JOIN act ON act.p = pre.p
  WHERE (act.x IS NULL OR act.x = f.x) AND (act.e = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY f.conv_id, f.i, act.t),
z AS (SELECT w.conv_id, min({'cost': best.cost + pre.cost, 'audit': best.audit || pre.ins, 'texts': list_concat(best.texts, pre.texts)}) AS best
      FROM w JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.i
      JOIN pre ON pre.q = w.q WHERE pre.p IN (0, 3) GROUP BY w.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (x0 IS NOT NULL AND x0 || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.texts, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from refbank.llm import align as A

    return A.align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from refbank.llm import bpe

    files = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    found = bpe.round_trip(table(spark, sf_dir, "documents"), *files)
    return found.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_token_output": op10_token_output,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_license_scan": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op11_conversation_repair": OP11_SQL,
}
