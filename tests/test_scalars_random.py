"""Randomised checks of scalar functions against plain-Python models of the
reference behaviour (one DataFrame per check, many cases each)."""

import random
import re

from pyspark.sql import functions as F

from refbank.functions import scalars as S


def letters(n):
    s = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def model_shift(ref, dr, dc):
    if not re.fullmatch(r"[A-Za-z]+[0-9]+", ref or ""):
        return None
    if dr == 0 and dc == 0:
        return ref.upper()
    m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", ref)
    col = 0
    for ch in m.group(1).upper():
        col = col * 26 + ord(ch) - 64
    r, c = int(m.group(2)) + dr, col + dc
    return None if r <= 0 or c <= 0 else f"{letters(c)}{r}"


def test_shift_cell_random(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(3000):
        c = rnd.choice([rnd.randint(1, 30), rnd.randint(1, 800), rnd.randint(1, 18000)])
        ref = letters(c) + str(rnd.randint(0, 2000))
        if rnd.random() < 0.3:
            ref = ref.lower()
        if rnd.random() < 0.05:
            ref = rnd.choice(["", "1A", "A", "A1B", "$A$1"])
        rows.append((ref, rnd.randint(-40, 40), rnd.choice([0, rnd.randint(-700, 700)])))
    df = spark.createDataFrame(rows, "ref string, dr long, dc long")
    got = [r.v for r in df.select(S.shift_cell("ref", "dr", "dc").alias("v")).collect()]
    want = [model_shift(*r) for r in rows]
    assert got == want


def test_strip_random(spark):
    rnd = random.Random(11)
    alphabet = list("ab xé\t\n\r") + ["　", "\xa0", " ", "\x1c", "​", "﻿"]
    rows = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(2000)]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = [r.v for r in df.select(S.py_strip("v").alias("v")).collect()]
    assert got == [r.strip() for r in rows]


def test_formula_refs_random(spark):
    rnd = random.Random(3)
    forms = []
    for _ in range(1000):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            ref = ("$" if rnd.random() < .3 else "") + letters(rnd.randint(1, 800)) + \
                  ("$" if rnd.random() < .3 else "") + str(rnd.randint(1, 999))
            parts.append(rnd.choice([ref, f"SUM({ref}:{ref})", f"{ref}*2", "LOG10(5)"]))
        forms.append(("=" if rnd.random() < .9 else "") + "+".join(parts))
    df = spark.createDataFrame([(f,) for f in forms], "f string")
    got = [r.v for r in df.select(S.formula_dependencies("f").alias("v")).collect()]
    want = [[x.replace("$", "") for x in re.findall(r"\$?[A-Z]+\$?\d+", f[1:] if f.startswith("=") else f)]
            for f in forms]
    assert got == want


def test_round_half_even_matches_python_on_grid(spark):
    vals = [i / 100 for i in range(0, 101)] + [i / 10000 for i in range(2900, 3100)]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    up = [r.v for r in df.select(S.updated_confidence("c", F.lit(1.0)).alias("v")).collect()]
    down = [r.v for r in df.select(S.updated_confidence("c", F.lit(0.2)).alias("v")).collect()]
    assert up[:101] == [min(1.0, round(v + 0.02, 2)) for v in vals[:101]]
    assert down[:101] == [max(0.0, round(v - 0.05, 2)) for v in vals[:101]]
