"""Licence scan: Dice coefficient over word bigrams.

Units of a document are its lines, its paragraphs of several lines (between
blank lines) and, if it has several lines, the whole text.  Normalised words are
lower-cased runs of letters and digits.  A unit with ``a`` bigrams and a
template with ``b`` share ``c`` (with repeats) and score ``2c / (a + b)``.
Since c is at most the smaller of both, a score of t needs
``a`` within ``b * t / (2 - t)`` and ``b * (2 - t) / t``: units outside the bounds of all
templates are dropped by their word count, the rest join only templates whose
bounds hold them.

A notice inside a longer line, paragraph or comment block is found by windows
over the words of the whole text.  A window has as many bigrams as the template
(fewer at the end of the text), starts where a shared bigram of the
template's signature puts its start, and scores like a unit; ``position`` is its first
word.  Templates of 128 bigrams and more are tried at the best supported start
of every 64th of their length.  A place belongs to the unit or window that shares most
bigrams there (then the better score, the first template, the first start), and a
window counts when all its shared places are its own.  So a notice that is
a line of its own is that line, and a GPL window inside an LGPL notice is nothing.

Only documents that hold ``need`` bigrams of a template's signature are looked at
further, which every match does (:func:`signatures`).

Only DataFrame and SQL functions.  The templates are a parameter; at most
``MAX_TEMPLATE_WORDS`` words in all, so their bigram table may be broadcast.  Those
of the query are in ``license_templates.py``.

Defined results: null and empty texts match nothing, and neither does a unit
or template with fewer than two words; ties between templates go to the
alphabetically first, between units to the first; equal rows of one id are one result, different
texts of one id each have theirs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refbank.llm.common import sized, store
from refbank.llm.license_templates import templates

MAX_TEMPLATE_WORDS = 200_000
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000  # some 40 bytes each, counted before; larger tables are joined by a shuffle
WORDS = r"filter(split(lower({}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"

TEMPLATES: dict[str, list[str]] = templates()


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, int, int, str, int]]:
    """(licence, variant, bigrams in all, bigram, times) of every template with two words."""
    rows = []
    for name, variants in sorted(templates.items()):
        for v, text in enumerate(variants):
            w = re.findall(r"[^\W_]+", text.lower())
            pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
            rows += [(name, v, len(pairs), p, n) for p, n in sorted(Counter(pairs).items())]
    if sum(r[4] for r in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    return rows


def signatures(templates: dict[str, list[str]], threshold: float) -> list[tuple]:
    """(tid, licence, variant, b, need, bigram, offsets): each template's
    signature, its rarest bigrams (those in the fewest templates).  A unit or
    window that scores ``threshold`` shares at least ``least`` bigrams, so at most
    ``b - least`` of the template's are missing: of a signature that has ``need``
    more than that, ``need`` are in the unit.  Nothing that matches is lost."""
    rows = template_bigrams(templates)
    held = Counter(r[3] for r in rows)
    by_template: dict[tuple[str, int], list[tuple]] = {}
    for r in rows:
        by_template.setdefault(r[:2], []).append(r)
    out = []
    for tid, ((name, v), own) in enumerate(sorted(by_template.items())):
        w = re.findall(r"[^\W_]+", templates[name][v].lower())
        places: dict[str, list[int]] = {}
        for i, (x, y) in enumerate(zip(w, w[1:])):
            places.setdefault(f"{x} {y}", []).append(i)
        b = own[0][2]
        least = max(1, math.ceil(threshold * b / (2 - threshold) - 1e-9))
        want, size, chosen = min(b, b - least + max(1, math.ceil(b / 5))), 0, []
        for r in sorted(own, key=lambda r: (held[r[3]], r[4], r[3])):
            if size >= want:
                break
            chosen.append(r[3])
            size += r[4]
        out += [(tid, name, v, b, size - (b - least), g, places[g]) for g in chosen]
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, dice, unit, position, n_units): the licences of each
    document with their best unit and how many units match."""
    rows = template_bigrams(TEMPLATES if templates is None else templates)
    spark = docs.sparkSession
    if not rows:
        return spark.createDataFrame([], docs.select(F.col(id_col).alias("doc_id")).schema.add("licence", "string").add(
            "dice", "double").add("unit", "string").add("position", "integer").add("n_units", "long"))
    ids, texts, signature = _candidates(docs, TEMPLATES if templates is None else templates, threshold, id_col, text_col)
    known = spark.createDataFrame(rows, "licence string, variant int, b int, bigram string, times int")
    sizes = [r[2] for r in rows]
    low, high = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    t = "text"
    lines = f"transform(split({t}, '\\n'), (x, i) -> struct('line' AS unit, i AS position, x AS body))"
    paras = (f"filter(transform(split({t}, '\\n[ \\t\\r]*\\n'), (x, i) -> struct('paragraph' AS unit, i AS position, x AS body)), "
             "p -> instr(p.body, '\\n') > 0)")
    whole = f"CASE WHEN instr({t}, '\\n') > 0 THEN array(struct('text' AS unit, 0 AS position, {t} AS body)) ELSE array() END"
    units = (texts.selectExpr("k1", "k2", f"inline(concat({lines}, {paras}, {whole}))")
             .selectExpr("k1", "k2", "unit", "position",
                         r"filter(split(lower(body), '[^\\p{L}\\p{N}]+'), w -> w <> '') AS w")
             .where(f"size(w) >= 2 AND size(w) - 1 BETWEEN {low - 1e-9} AND {high + 1e-9}"))
    unit = ["k1", "k2", "unit", "position", "a"]
    grams = units.selectExpr("k1", "k2", "unit", "position", "size(w) - 1 AS a",
                             "explode(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))) AS bigram")
    # dealt by text once: both groupings below stay where their text is
    found = (grams.join(F.broadcast(known.select("bigram").distinct()), "bigram", "left_semi").repartition("k1", "k2")
             .groupBy(*unit, "bigram").agg(F.count(F.lit(1)).alias("n"))
             .join(F.broadcast(known), "bigram")
             .where((F.col("a") >= F.col("b") * threshold / (2 - threshold) - 1e-9)
                    & (F.col("a") <= F.col("b") * (2 - threshold) / threshold + 1e-9)))
    scored = (found.groupBy(*unit, "licence", "variant", "b").agg(F.sum(F.least("n", "times")).alias("c"))
              .withColumn("dice", 2.0 * F.col("c") / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold))
    # one licence per unit (the best), then one row per text and licence
    best = store(scored.groupBy(*unit).agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "licence", "c")).alias("m")).select(
        *unit, "m.licence", (-F.col("m.d")).alias("dice"), "m.c"), "licence-units")
    best, embedded = _windows(texts, signature, known, best, threshold)
    both = best.select("k1", "k2", "unit", "position", "licence", "dice").unionByName(embedded)
    per_text = both.groupBy("k1", "k2", "licence").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "unit", "position")).alias("m"), F.count(F.lit(1)).alias("n_units"))
    return ids.join(sized(store(per_text, "licence-results"), BROADCAST_ROWS), ["k1", "k2"]).select(
        "doc_id", "licence", (-F.col("m.d")).alias("dice"), "m.unit", "m.position", "n_units")


def _candidates(docs: DataFrame, templates: dict[str, list[str]], threshold: float, id_col: str, text_col: str
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents that share enough of some template's signature: (doc_id, k1,
    k2) of each, (k1, k2, text, tids of those templates) of each different text,
    both stored once for all later steps, and the signatures."""
    signature = docs.sparkSession.createDataFrame(
        signatures(templates, threshold),
        "tid int, licence string, variant int, b int, need int, bigram string, offsets array<int>")
    rows = docs.where(F.col(text_col).isNotNull()).selectExpr(
        f"`{id_col}` AS doc_id", f"xxhash64(`{text_col}`) AS k1", f"xxhash64(`{text_col}`, 'unit') AS k2", f"`{text_col}` AS text")
    words = rows.selectExpr("doc_id", "k1", "k2", f"{WORDS.format('text')} AS w").where("size(w) >= 2")
    grams = words.selectExpr("doc_id", "k1", "k2", "explode(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))) AS bigram")
    # by document: copies of a text do not add up
    found = (grams.join(F.broadcast(signature.select("bigram", "tid", "need")), "bigram")
             .groupBy("doc_id", "k1", "k2", "tid", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need"))
    found = found.groupBy("k1", "k2").agg(F.collect_set("tid").alias("tids"), F.min("doc_id").alias("one"))  # at most one entry per template
    per_text = store(found, "licence-candidates")
    few = sized(per_text.select("k1", "k2", "one"), BROADCAST_ROWS)
    ids = rows.select("doc_id", "k1", "k2").join(few, ["k1", "k2"]).select("doc_id", "k1", "k2").distinct()
    texts = (rows.join(few, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("one"))).select("k1", "k2", "text")
             .dropDuplicates(["k1", "k2"]).join(sized(per_text.select("k1", "k2", "tids"), BROADCAST_ROWS // 5), ["k1", "k2"]))
    return ids, store(texts, "licence-texts"), signature


def _alternatives(windows: DataFrame) -> DataFrame:
    """Windows that no better one overlaps by half of the larger of both.  Windows
    meet in cells of their size, so only near ones of like size are compared."""
    size = "CAST(floor(log2(a)) AS INT)"
    cells = ", ".join(f"struct({size} + {k} AS cls, start div shiftleft(1, {size} + {k}) + {j} AS cell)" for k in (0, 1) for j in (0, 1))
    keyed = windows.selectExpr("k1", "k2", "tid", "start", "a", "c", "dice", f"inline(array({cells}))")
    other = sized(windows, BROADCAST_ROWS // 5).selectExpr("k1", "k2", "tid", "start", "a", "c", "dice", f"inline(array({cells}))").select("k1", "k2", "cls", "cell", *[F.col(x).alias(f"{x}2") for x in ("tid", "start", "a", "c", "dice")])
    beaten = (keyed.join(other, ["k1", "k2", "cls", "cell"])
              .where("2 * (least(start + a, start2 + a2) - greatest(start, start2)) >= greatest(a, a2) AND "
                     "struct(dice2, c2, -tid2, -start2) > struct(dice, c, -tid, -start)")
              .select("k1", "k2", "tid", "start").distinct())
    return windows.join(beaten, ["k1", "k2", "tid", "start"], "left_anti")


def _windows(texts: DataFrame, signature: DataFrame, known: DataFrame, best: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The units that no window beats, and (k1, k2, unit, position, licence, dice)
    of the windows of each different text."""
    names = signature.select("tid", "licence", "variant").distinct()
    table = known.join(F.broadcast(names), ["licence", "variant"]).join(
        F.broadcast(signature.select("tid", "bigram", "offsets")), ["tid", "bigram"], "left")
    words = (texts.selectExpr(
        "k1", "k2", "tids",
        f"flatten(transform(split(text, '\\n'), (x, i) -> transform({WORDS.format('x')}, w -> struct(i AS line, w AS word)))) AS w",
        f"flatten(transform(split(text, '\\n[ \\t\\r]*\\n'), (x, i) -> transform({WORDS.format('x')}, w -> i))) AS para")
        .where("size(w) >= 2"))
    grams = words.selectExpr("k1", "k2", "tids", "size(w) - 1 AS size", "posexplode(transform(sequence(0, size(w) - 2), "
                             "i -> struct(concat(w[i].word, ' ', w[i + 1].word) AS bigram, w[i].line AS line, para[i] AS para))) "
                             "AS (place, g)").select("k1", "k2", "tids", "size", "place", "g.*")
    hits = store(grams.join(F.broadcast(table), "bigram").where("array_contains(tids, tid)").drop("tids")
                 .withColumn("bucket", F.expr("place div b")), "licence-hits")
    window = ["k1", "k2", "tid", "start"]
    # where the signature's bigrams place the template; long ones at the best supported of every 64th
    starts = store(hits.where("offsets IS NOT NULL")
              .select("k1", "k2", "tid", "b", "size", F.explode("offsets").alias("o"), "place")
              .withColumn("start", F.greatest(F.lit(0), F.col("place") - F.col("o")))
              .groupBy(*window, "b", "size").agg(F.count(F.lit(1)).alias("votes"))
              .groupBy("k1", "k2", "tid", "b", "size", F.expr("start div greatest(1, b div 64)").alias("cell"))
              .agg(F.max(F.struct("votes", (-F.col("start")).alias("m"))).alias("top"))
              .select("k1", "k2", "tid", (-F.col("top.m")).alias("start"), F.expr("least(b, size + top.m)").alias("a"),
                      F.expr("-top.m div b").alias("bucket")), "licence-starts")

    # a window begins in one bucket and ends in the same or the next: hits look there
    seen = hits.withColumn("bucket", F.explode(F.expr("array(bucket, bucket - 1)")))

    def inside(w: DataFrame) -> DataFrame:
        return sized(w, BROADCAST_ROWS).join(seen, ["k1", "k2", "tid", "bucket"]).where("place >= start AND place < start + a")

    scored = store(
        inside(starts).select(*window, "a", "b", "bigram", "times").repartition("k1", "k2", "tid")
        .groupBy(*window, "a", "b", "bigram", "times").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*window, "a", "b").agg(F.sum(F.least("n", F.col("times").cast("long"))).alias("c"))
        .withColumn("dice", 2.0 * F.col("c") / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold)
        .select(*window, "a", "b", "c", "dice"), "licence-windows")
    scored = store(_alternatives(scored), "licence-alternatives")
    spread = inside(scored.withColumn("bucket", F.expr("start div b")).drop("b"))
    places = store(spread.join(F.broadcast(names.select("tid", F.col("licence").alias("named"))), "tid")
                   .select(*window, "a", "c", "dice", "named", "place", "line", "para"), "licence-places")

    def of(units: DataFrame, unit: str, at: str, value: str) -> DataFrame:
        return sized(units.where(F.col("unit") == unit), BROADCAST_ROWS).select("k1", "k2", F.col("position").alias(at), *[F.col(v) for v in value.split()])

    # a unit and a window inside it, alike in size: the better score stays where they name different licences
    unit_of = best.select("k1", "k2", "unit", "position", F.col("licence").alias("unit_licence"), F.col("dice").alias("unit_dice"), F.col("a").alias("unit_a"))
    whole = sized(store(places.groupBy(*window, "a", "dice", "named").agg(F.count(F.lit(1)).alias("n")), "licence-whole"), BROADCAST_ROWS)
    values = "unit unit_licence unit_dice unit_a"
    met = [places.join(of(unit_of, u, at, values), ["k1", "k2", at]).withColumn("position", F.col(at))
           .groupBy(*window, "unit", "position", "unit_licence", "unit_dice", "unit_a").agg(F.count(F.lit(1)).alias("inside"))
           for u, at in (("line", "line"), ("paragraph", "para"))]
    all_of = whole.join(of(unit_of, "text", "position", values), ["k1", "k2"]).select(
        *window, "unit", "position", "unit_licence", "unit_dice", "unit_a", F.col("n").alias("inside"))
    rivals = (met[0].unionByName(met[1]).unionByName(all_of).join(whole, window)
              .where("inside = n AND 2 * least(a, unit_a) >= greatest(a, unit_a) AND named <> unit_licence"))
    rivals = store(rivals.select(*window, "unit", "position", (F.col("dice") > F.col("unit_dice")).alias("better")), "licence-rivals")
    best = best.join(rivals.where("better").select("k1", "k2", "unit", "position").distinct(), ["k1", "k2", "unit", "position"], "left_anti")
    places = places.join(sized(rivals.where("NOT better").select(*window).distinct(), BROADCAST_ROWS), window, "left_anti")

    # a place belongs to the window or unit that shares most there
    most = store(best.groupBy("k1", "k2", "unit", "position").agg(F.max("c").alias("unit_c")), "licence-owners")

    def taken(unit: str, at: str) -> DataFrame:
        return sized(most.where(F.col("unit") == unit), BROADCAST_ROWS).select("k1", "k2", F.col("position").alias(at), F.col("unit_c").alias(f"c_{unit}"))

    places = (places.join(taken("line", "line"), ["k1", "k2", "line"], "left").join(taken("paragraph", "para"), ["k1", "k2", "para"], "left")
              .join(taken("text", "zero").drop("zero"), ["k1", "k2"], "left")
              .withColumn("taken", F.coalesce(F.greatest("c_line", "c_paragraph", "c_text"), F.lit(0))))
    key = F.struct("c", "dice", (-F.col("tid")).alias("t"), (-F.col("start")).alias("s"))
    top = F.max(key).over(Window.partitionBy("k1", "k2", "place"))  # as many rows as windows lie over one place
    kept = (places.select(*window, "c", "dice", "place", "taken").repartition("k1", "k2").withColumn("top", top)
            .withColumn("own", (F.col("top.t") == -F.col("tid")) & (F.col("top.s") == -F.col("start"))
                        & (F.col("taken") < F.col("c")))
            .groupBy(*window, "dice").agg(F.min("own").alias("own")).where("own"))
    return best, kept.join(F.broadcast(names), "tid").select("k1", "k2", F.lit("window").alias("unit"),
                                                             F.col("start").alias("position"), "licence", "dice")
