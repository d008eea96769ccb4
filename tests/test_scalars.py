"""Scalar functions on single values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def one(spark, f, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string' if v is None or isinstance(v, str) else 'int'}" for i, v in enumerate(values)))
    out = row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]
    return tuple(out) if hasattr(out, "asDict") else out


@pytest.mark.parametrize(
    "raw, want",
    [
        ("01/09/2026", "01-09-2026"), ("14-07-2026", "14-07-2026"), ("5.3.2028", "05-03-2028"), ("12/2027", "01-12-2027"), ("03-28", "01-03-2028"), ("MAR-2028", "01-03-2028"),
        ("Apr/2026", "01-04-2026"), ("01-MAR-2028", "01-03-2028"), ("14 Jul 2026", "14-07-2026"), ("August 14, 2026", "14-08-2026"), ("Q3 2026", "Q3 2026"), (None, None), ("", ""),
        ("31-02-2026", "31-02-2026"), ("13/2027", "13/2027"), ("1/1/202", "01-01-0202"), ("Foo-2026", "Foo-2026"), ("45/10/2026", "45/10/2026"),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, S.normalize_date, raw) == want


@pytest.mark.parametrize("raw, want", [("Rs. 45", 0.45), ("1.2.3", None), ("(12)", 12.0), ("-1,200.50", -1200.5), (" -3", -3.0), ("", None), (None, None), ("12 %", 12.0), (".", None)])
def test_amounts(spark, raw, want):
    assert one(spark, S.parse_amount, raw) == want


@pytest.mark.parametrize(
    "f, raw, want",
    [
        (S.split_pack_hyphen, "Nefro Tablets -15s", ("Nefro Tablets", "15s")), (S.split_pack_hyphen, "Multi - Vitamin Syrup - 200ml", ("Multi - Vitamin Syrup", "200ml")),
        (S.split_pack_hyphen, "Anti-Inflammatory Tablets", ("Anti-Inflammatory Tablets", None)), (S.split_pack_label, "NAME Pack Size: 1*10 CAPSULE", ("NAME", "1*10 CAPSULE")),
        (S.split_pack_number, "X 0.5% 5 ML", ("X 0.5%", "5 ML")), (S.split_pack_number, "SOLN 5ML SALE 1100 L", ("SOLN 5ML SALE", "1100 L")), (S.split_pack_number, "no digits", ("no digits", None)), (S.split_pack_number, "5 ML", ("", "5 ML")),
    ],
)
def test_packs(spark, f, raw, want):
    assert one(spark, f, raw) == want


def test_pack_order(spark):
    assert one(spark, S.resolve_pack, "A - 5s", "10S") == ("A - 5s", "10S")
    assert one(spark, S.resolve_pack, "A - 5s pack size: 3", None) == ("A - 5s", "3")


@pytest.mark.parametrize("q, t, d, want", [(320.0, 20044.8, 69.6, (288.0, 32.0)), (320.0, 2400.0, 69.6, (34.0, 286.0)), (100.0, 5000.0, 50.0, (100.0, 0.0)), (5.0, 2.5, 1.0, (2.0, 3.0)), (5.0, 3.5, 1.0, (4.0, 1.0)), (1.0, 5.0, 0.0, (None, None))])
def test_derived(spark, q, t, d, want):
    assert one(spark, S.derived_quantities, q, t, d) == want


def test_divisor_and_quantity(spark):
    assert one(spark, S.effective_divisor, 69.6, 999.0) == 69.6
    assert one(spark, S.effective_divisor, 0.0, 50.0) == 50.0


@pytest.mark.parametrize("raw, want", [("INV/2026/001", "INV-2026-001"), ('A:B*C?D"E<F>G|H\\I', "A-B-C-D-E-F-G-H-I"), ("", "x_7"), (None, "x_7"), ("  'a b'  ", "a_b"), ("x" * 200, "x" * 150)])
def test_names(spark, raw, want):
    assert one(spark, lambda c: S.sanitize_filename(c, F.lit(7), "x"), raw) == want


@pytest.mark.parametrize("v", [850.0, 0.5, 12345678.0, 1234567.25, 20000000.5, -99999999.0, 1e15])
def test_float_text(spark, v):
    assert one(spark, S.float_text, v) == repr(v)


def test_labels(spark):
    assert [one(spark, S.column_label, x) for x in ("hsn_sac", "some_thing")] == ["HSN/SAC", "Some Thing"]


@pytest.mark.parametrize("raw, want", [("Grand Total", True), ("sub-total", True), ("Total for X", True), ("Totally", False), ("A total", False), (None, False)])
def test_subtotals(spark, raw, want):
    assert one(spark, S.is_subtotal, raw) is want
