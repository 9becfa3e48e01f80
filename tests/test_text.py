"""Cleaning rules by hand-checked cases, each with its quirk."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text


def one(spark, expr, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("1 ，234", "1,234"), ("3 ． 5", "3.5"), ("1o5", "1.05"), ("1 2 3", "12 3"), ("2023\n5", "20235"), ("PLAN 5", "PLAN5"), ("2020 - 2021", "2020 -2021"), ("5 ％", "5%"), ("＄ 7", "$7"), ("NT$ 12", "NT$12"),
        ("12　3", "123"), ("", ""), (None, None),
    ],
)
def test_numbers(spark, raw, clean):
    assert one(spark, text.clean_numbers, raw) == clean


@pytest.mark.parametrize(("raw", "clean"), [("exam-\nple", "example"), ("exé- \n mple", "exémple"), ("a    b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("a- b", "a- b")])
def test_spacing(spark, raw, clean):
    assert one(spark, text.clean_spacing, raw) == clean


def test_symbols_and_all(spark):
    assert one(spark, text.clean_symbols, "＄％（x）") == "$%(x)"
    assert one(spark, text.clean_text, "NT＄ 1 ，234 （x）") == "NT$1,234 (x)"


def test_paths(spark):
    assert one(spark, text.basename, "a/b/C.PDF") == "C.PDF"
    assert one(spark, text.stem, "a/b/C.x.PDF") == "C.x"
    assert one(spark, text.suffix, "a/b/C.PDF") == ".pdf"
    assert one(spark, text.suffix, "a/b.c/none") == ""


def test_sheet_name(spark):
    assert one(spark, text.sheet_name, "Sheet: A Sheet: B\n1") == "A  B"
    assert one(spark, text.sheet_name, "x\nSheet: Q\n1") == "Q"
    assert one(spark, text.sheet_name, "x") == "Unknown Sheet"


def test_page_marks(spark):
    assert one(spark, text.without_page_marks, "a\n--- PAGE 12 ---\nb") == "a\nb"
    assert one(spark, text.without_page_marks, "--- PAGE 12 ---\nb") == "--- PAGE 12 ---\nb"


def test_strip_and_filled(spark):
    assert one(spark, text.strip, "　 a b\t\n") == "a b"
    assert [one(spark, text.filled, x) for x in (" 　\n", "", None, "x")] == [False, False, False, True]


def test_page_numbers(spark):
    rows = spark.createDataFrame([("2,3", True, 2), ("3, 2", True, 2), ("2,3", False, 2), (None, True, 4), ("x", True, 5), ("2,3", None, 2)], "r string, s boolean, p int")
    got = [r[0] for r in rows.select(text.page_numbers(F.col("r"), F.col("s"), F.col("p"))).collect()]
    assert got == [[2, 3], [2, 3], [2], [4], [5], [2]]


def test_format_table(spark):
    df = spark.createDataFrame([([[" a ", None], [], ["b"]],)], "t array<array<string>>")
    assert df.select(text.format_table(F.col("t"))).first()[0] == "a | \nb"


def test_truncated_and_tokens(spark):
    df = spark.createDataFrame([("abcdef",)], "t string")
    assert df.select(text.truncated(F.col("t"), F.lit(4))).first()[0] == "abcd..."
    assert df.select(text.truncated(F.col("t"), F.lit(6))).first()[0] == "abcdef"
    assert one(spark, text.token_count, "收入 grew 12%") == 5
    assert one(spark, text.token_count, None) == 0
