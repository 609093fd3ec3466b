"""Scalar column expressions (all JVM-side, inside whole-stage codegen).

Every function maps Columns to a Column; none of them collects or calls
Python per row.  They are the building blocks of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference behaviour ------------------
# File extension -> input type tag; anything else (or no extension) is "md".
INPUT_TYPE_BY_EXTENSION = {
    "pdf": "pdf",
    "xls": "excel", "xlsx": "excel", "xlsm": "excel", "xlsb": "excel",
    "xltx": "excel", "xltm": "excel",
    "doc": "word", "docx": "word",
    "md": "md", "txt": "md",
}
DEFAULT_INPUT_TYPE = "md"
DEFAULT_TRIGGER = "field_extraction"
WILDCARD_INPUT_TYPE = "auto"
ARCHIVE_THRESHOLD = 0.3          # rules below this confidence are archived
REWARD_STEP = 0.02               # success: +0.02, support + 1
PENALTY_STEP = 0.05              # failure: -0.05
SUCCESS_CUTOFF = 0.8             # outcome >= 0.8 rewards
FAILURE_CUTOFF = 0.3             # outcome <= 0.3 penalises
DECAY_RATE = 0.99                # per idle day beyond the grace period
DECAY_GRACE_DAYS = 30
OUTCOME_VALUE = {"SUCCESS": 1.0, "FAILURE": 0.2, "PARTIAL": 0.5}
# Provenance precedence when one rule is reachable several ways.
SOURCE_PRECEDENCE = {"via_signature": 3, "direct": 2, "via_kg": 1}
# Characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CELL_REF_PATTERN = "^[A-Za-z]+[0-9]+$"
FORMULA_REF_PATTERN = "\\$?[A-Z]+\\$?\\d+"
# --------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signature(content) -> Column:
    """MD5 hex of the UTF-8 content (input signature)."""
    return F.md5(_col(content))


def input_type(path) -> Column:
    """Tag from the last suffix of the file name, case-folded; unknown -> md."""
    base = F.regexp_extract(_col(path), "([^/\\\\]*)$", 1)
    ext = F.lower(F.regexp_extract(base, "^.+[.]([^.]+)$", 1))
    mapping = F.create_map(*[x for kv in INPUT_TYPE_BY_EXTENSION.items() for x in map(F.lit, kv)])
    return F.coalesce(F.element_at(mapping, ext), F.lit(DEFAULT_INPUT_TYPE))


def py_strip(c) -> Column:
    """Python ``str.strip()``: ``btrim`` over Python's whitespace set (no
    regex; Spark ``trim`` alone only removes spaces)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def normalize_value(c) -> Column:
    """Cell text as compared by layouts: null -> '', else stripped text."""
    return F.coalesce(py_strip(_col(c).cast("string")), F.lit(""))


def normalize_fields(arr) -> Column:
    """Stringify, strip, drop blanks, sort (duplicates kept); null -> []."""
    cleaned = F.transform(F.coalesce(_col(arr), F.array().cast("array<string>")),
                          lambda x: py_strip(F.coalesce(x, F.lit("None"))))
    return F.array_sort(F.filter(cleaned, lambda x: x != F.lit("")))


def cluster_key(error_type, fields_norm, template_signature) -> Column:
    """``error_type|f1,f2|signature`` with defaults ``unknown`` / ''."""
    return F.concat_ws(
        "|",
        F.coalesce(_col(error_type), F.lit("unknown")),
        F.array_join(_col(fields_norm), ","),
        F.coalesce(_col(template_signature), F.lit("")),
    )


def iso_micros(ts) -> Column:
    """Timestamp as ``yyyy-MM-ddTHH:mm:ss.ffffff`` (UTC session)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def event_id(ts, template_signature, error_type, fields_norm, repair_action) -> Column:
    """First 12 hex of SHA-1 over a canonical pipe-joined event string.

    The canonical form is ours (documented, stable, engine independent):
    ``ts|template_signature|error_type|f1,f2|repair_action`` with '' for
    missing parts.
    """
    canon = F.concat_ws(
        "|",
        F.coalesce(iso_micros(ts), F.lit("")),
        F.coalesce(_col(template_signature), F.lit("")),
        F.coalesce(_col(error_type), F.lit("")),
        F.array_join(_col(fields_norm), ","),
        F.coalesce(_col(repair_action), F.lit("")),
    )
    return F.substring(F.sha1(canon), 1, 12)


# --- cell references ------------------------------------------------------

def col_letters_to_number(letters) -> Column:
    """Base-26 decode of column letters (A=1 ... Z=26, AA=27)."""
    chars = F.split(F.upper(_col(letters)), "")
    return F.aggregate(chars, F.lit(0).cast("long"),
                       lambda acc, ch: acc * 26 + (F.ascii(ch) - 64))


def number_to_col_letters(n) -> Column:
    """Base-26 encode (1 -> A, 27 -> AA, 16384 -> XFD, 18279 -> AAAA);
    null at or below zero."""
    n = _col(n).cast("long")
    d1 = F.pmod(n - 1, 26)
    q1 = F.floor((n - 1) / 26)
    d2 = F.pmod(q1 - 1, 26)
    q2 = F.floor((q1 - 1) / 26)
    d3 = F.pmod(q2 - 1, 26)

    def ch(d):
        return F.char(d + 65)

    def longer():
        # one letter per step, the last one first; a long has at most 14
        def step(acc, _):
            return F.when(acc["n"] > 0, F.struct(
                F.call_function("div", acc["n"] - 1, F.lit(26).cast("long")).alias("n"),
                F.concat(ch(F.pmod(acc["n"] - 1, F.lit(26))), acc["s"]).alias("s"))).otherwise(acc)

        start = F.struct(n.alias("n"), F.lit("").alias("s"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["s"])

    return (F.when(n <= 0, F.lit(None).cast("string"))
            .when(n <= 26, ch(d1))
            .when(n <= 702, F.concat(ch(d2), ch(d1)))
            .when(n <= 18278, F.concat(ch(d3), ch(d2), ch(d1)))
            .otherwise(longer()))


def cell_row(ref) -> Column:
    return F.regexp_extract(_col(ref), "([0-9]+)$", 1).cast("long")


def cell_col(ref) -> Column:
    return col_letters_to_number(F.regexp_extract(_col(ref), "^([A-Za-z]+)", 1))


def a1(row, col) -> Column:
    return F.concat(number_to_col_letters(col), _col(row).cast("string"))


def is_cell_ref(ref) -> Column:
    return F.coalesce(_col(ref).rlike(CELL_REF_PATTERN), F.lit(False))


def shift_cell(ref, row_offset, col_offset) -> Column:
    """Offset an A1 reference; zero offset only upper-cases; <=0 -> null."""
    ref = _col(ref)
    dr = F.coalesce(_col(row_offset).cast("long"), F.lit(0))
    dc = F.coalesce(_col(col_offset).cast("long"), F.lit(0))
    new_row = cell_row(ref) + dr
    new_col = cell_col(ref) + dc
    return (F.when(~is_cell_ref(ref), F.lit(None).cast("string"))
            .when((dr == 0) & (dc == 0), F.upper(ref))
            .when((new_row <= 0) | (new_col <= 0), F.lit(None).cast("string"))
            .otherwise(a1(new_row, new_col)))


def is_formula(value) -> Column:
    return F.coalesce(_col(value).startswith("="), F.lit(False))


def formula_dependencies(formula) -> Column:
    """Cell references in a formula, ``$`` removed, in order of appearance."""
    body = F.regexp_replace(_col(formula), "^=", "")
    refs = F.regexp_extract_all(body, F.lit(FORMULA_REF_PATTERN), 0)
    return F.transform(refs, lambda r: F.regexp_replace(r, "[$]", ""))


# --- confidence arithmetic ------------------------------------------------

def round_half_even(x, places: int) -> Column:
    """Python ``round(x, n)`` on doubles: scale, round half to even, unscale."""
    scale = float(10 ** places)
    return F.rint(_col(x) * scale) / scale


def updated_confidence(confidence, outcome) -> Column:
    """Confidence after one outcome (missing confidence counts as 0.5)."""
    c = F.coalesce(_col(confidence).cast("double"), F.lit(0.5))
    o = _col(outcome).cast("double")
    return (F.when(o >= SUCCESS_CUTOFF, F.least(F.lit(1.0), round_half_even(c + REWARD_STEP, 2)))
            .when(o <= FAILURE_CUTOFF, F.greatest(F.lit(0.0), round_half_even(c - PENALTY_STEP, 2)))
            .otherwise(c))


def updated_support(support, outcome) -> Column:
    s = F.coalesce(_col(support).cast("long"), F.lit(0))
    return F.when(_col(outcome).cast("double") >= SUCCESS_CUTOFF, s + 1).otherwise(s)


def idle_days(last_used, as_of) -> Column:
    """Whole days elapsed (floor, like ``timedelta.days``)."""
    lu = F.unix_micros(_col(last_used).cast("timestamp"))
    now = F.unix_micros(_col(as_of).cast("timestamp"))
    return F.floor((now - lu) / F.lit(86400 * 1_000_000))


def decayed_confidence(confidence, last_used, as_of, days: int = DECAY_GRACE_DAYS) -> Column:
    """``round(c * 0.99 ** (idle - days), 4)`` once idle for more than ``days``."""
    d = idle_days(last_used, as_of)
    c = _col(confidence).cast("double")
    return F.when(d > days, round_half_even(
        F.coalesce(c, F.lit(0.5)) * F.pow(F.lit(DECAY_RATE), d - days), 4)).otherwise(c)


def shape_score(h1, h2, w1, w2) -> Column:
    """``max(0, 1 - (dh/max h + dw/max w)/2)``, zero-safe."""
    h1, h2, w1, w2 = (_col(x).cast("double") for x in (h1, h2, w1, w2))
    mh = F.greatest(h1, h2)
    mw = F.greatest(w1, w2)
    rd = F.abs(h1 - h2) / F.when(mh == 0, F.lit(1.0)).otherwise(mh)
    cd = F.abs(w1 - w2) / F.when(mw == 0, F.lit(1.0)).otherwise(mw)
    return F.greatest(F.lit(0.0), F.lit(1.0) - (rd + cd) / 2.0)
