"""Pure column functions against the reference's golden literals."""

import pytest
from pyspark.sql import functions as F

from refbank.functions import scalars as S


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


def test_signature_md5(spark):
    assert one(spark, S.signature(F.lit("test content"))) == "9473fdd0d880a43c21b7778d34872157"


@pytest.mark.parametrize("path,expected", [
    ("invoice.pdf", "pdf"), ("/abs/path/REPORT.PDF", "pdf"),
    ("data.xlsx", "excel"), ("data.xls", "excel"), ("data.xlsm", "excel"), ("data.xlsb", "excel"),
    ("data.xltx", "excel"), ("data.xltm", "excel"),
    ("doc.doc", "word"), ("doc.docx", "word"),
    ("notes.md", "md"), ("notes.txt", "md"), ("no_extension", "md"), ("weird.xyz", "md"),
    (".pdf", "md"), ("dir.pdf/notes", "md"), ("a.tar.PDF", "pdf"),
])
def test_input_type(spark, path, expected):
    assert one(spark, S.input_type(F.lit(path))) == expected


def test_confidence_update(spark):
    df = spark.createDataFrame([(0.80, 5, 1.0), (0.80, 5, 0.2), (0.32, 1, 0.2), (0.80, 5, 0.5), (0.99, 1, 1.0)],
                               "c double, s long, o double")
    got = df.select(S.updated_confidence("c", "o").alias("c"), S.updated_support("s", "o").alias("s")).collect()
    assert [(r.c, r.s) for r in got] == [(0.82, 6), (0.75, 5), (0.27, 1), (0.80, 5), (1.0, 2)]


def test_decay(spark):
    df = spark.createDataFrame([(0.8, "2024-01-01 00:00:00"), (0.31, "2023-12-23 00:00:00"),
                                (0.9, "2024-02-20 00:00:00"), (0.5, None)], "c double, lu string")
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp")
    got = [r.v for r in df.select(S.decayed_confidence(F.col("c"), F.col("lu").cast("timestamp"), as_of).alias("v")).collect()]
    assert got[0] == round(0.8 * 0.99 ** 30, 4)
    assert got[1] < 0.3                   # 0.31 idle ~69 days -> archived
    assert got[2] == 0.9                  # idle 10 days: untouched
    assert got[3] == 0.5                  # never used: untouched


def test_formula_dependencies(spark):
    got = one(spark, S.formula_dependencies(F.lit("=MAX(C4:C6)*A1")))
    assert got == ["C4", "C6", "A1"]
    assert one(spark, S.formula_dependencies(F.lit("=$B$2*C3"))) == ["B2", "C3"]
    assert one(spark, S.is_formula(F.lit("=A1"))) is True
    assert one(spark, S.is_formula(F.lit("A1"))) is False


@pytest.mark.parametrize("n,letters", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"),
                                       (703, "AAA"), (16384, "XFD"), (0, None), (18278, "ZZZ"), (18279, "AAAA"),
                                       (475254, "ZZZZ"), (475255, "AAAAA"), (9223372036854775807, "CRPXNLSKVLJFHG")])
def test_column_letters(spark, n, letters):
    assert one(spark, S.number_to_col_letters(F.lit(n))) == letters
    if letters:
        assert one(spark, S.col_letters_to_number(F.lit(letters))) == n


@pytest.mark.parametrize("ref,dr,dc,out", [
    ("B2", 1, 0, "B3"), ("b2", 0, 0, "B2"), ("A1", -1, 0, None), ("A1", 0, -1, None),
    ("Z9", 0, 1, "AA9"), ("C3", 2, 2, "E5"), ("nope", 1, 1, None), ("A1", 0, 0, "A1"),
])
def test_shift_cell(spark, ref, dr, dc, out):
    assert one(spark, S.shift_cell(F.lit(ref), F.lit(dr), F.lit(dc))) == out


def test_normalize(spark):
    df = spark.createDataFrame([(None,), ("  x \t",), ("　y ",)], "v string")
    assert [r.v for r in df.select(S.normalize_value("v").alias("v")).collect()] == ["", "x", "y"]
    arr = F.array(F.lit(" Field_B "), F.lit(""), F.lit("Field_A"), F.lit("Field_A"))
    assert one(spark, S.normalize_fields(arr)) == ["Field_A", "Field_A", "Field_B"]
    assert one(spark, S.normalize_fields(F.lit(None).cast("array<string>"))) == []


def test_cluster_key(spark):
    key = S.cluster_key(F.lit("row_misalignment"), F.array(F.lit("Field_A"), F.lit("Field_B")), F.lit("sig"))
    assert one(spark, key) == "row_misalignment|Field_A,Field_B|sig"
    assert one(spark, S.cluster_key(F.lit(None), F.array().cast("array<string>"), F.lit(None))) == "unknown||"


def test_shape_score(spark):
    assert one(spark, S.shape_score(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 1.0
    assert one(spark, S.shape_score(F.lit(2), F.lit(4), F.lit(3), F.lit(3))) == 0.75
