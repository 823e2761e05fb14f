"""Column functions on values that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from complyspark.functions import numbers as N
from complyspark.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("ký ngày 31/02/2025 rồi 01-03-2025", "2025-03-01"),
        ("ngày 5 tháng 4 năm 2024", "2024-04-05"),
        ("tháng 07/2025", "2025-07-01"),
        ("8 giờ/ngày, 40 giờ/tuần", None),
        (None, None),
    ],
)
def test_dates(spark, value, want):
    assert one(spark, value, N.parse_date_any) == want


@pytest.mark.parametrize(("value", "want"), [("1.000", 1000), ("2.5", None), ("3,0", 3), ("0", 0), ("12 345", 12345), ("1.234,567", None), ("", None)])
def test_to_int(spark, value, want):
    assert one(spark, value, N.to_int) == want


def test_money(spark):
    m = one(spark, "lương 1.200.000 VNĐ/tháng (50 USD)", N.parse_money)
    assert (m.amount, m.currency, m.period, m.note) == (1200000, "VND", "tháng", "50 USD")
    assert one(spark, "so 999", N.parse_money) is None
    assert one(spark, "0 đồng", N.parse_money).amount == 0
    assert one(spark, "1.5 USD", N.parse_money).amount == 15


def test_text(spark):
    assert one(spark, "Hợp đồng ĐẶC biệt", X.fold_diacritics) == "Hop dong DAC biet"
    assert one(spark, " , nội   dung;", X.clean_value) == "nội dung"
    assert one(spark, "Ghi theo thực tế", X.clean_value) is None
    assert one(spark, "Ghi chú", X.clean_value) == "Ghi chú"
    assert one(spark, "日本語の行 a", X.is_foreign_script_line) is True
    assert one(spark, "200.000円/月 x", X.strip_foreign_chars) == "200.000 / x"
    assert one(spark, "theo quy định của pháp luật", X.is_boilerplate_clause) is True
    assert one(spark, "căn cứ (Luật::43::f6d218196160) này", X.strip_chunk_ids) == "căn cứ này"
    long = "Câu một dài. Lương 5 triệu. " * 3 + "Hết."
    assert "Lương" in one(spark, long, lambda c: X.condense_clause(c, ["luong"], 40))
    assert one(spark, "one two three|one too three".replace("|", " "), lambda c: X.take_short_quote(c, 2)) == "one two"


def test_word_distance(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), ("mot hai", "mot hai")], "a string, b string")
    assert [r.r for r in df.select(X.word_edit_distance(F.col("a"), F.col("b")).alias("r")).collect()] == [2, 1, 0]


def test_numbers(spark):
    df = spark.createDataFrame([("1.234,5", "1,234.5"), ("12", "12.0"), ("", None), ("a b", "x a b c"), ("1", "2")], "a string, b string")
    assert [r.r for r in df.select(N.values_match(F.col("a"), F.col("b")).alias("r")).collect()] == [True, True, True, True, False]
