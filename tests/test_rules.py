from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billsift.operators import blend, quality, rules

AS_OF = "2024-06-01"
HEAD = (
    "invoice_id long, vendor_id long, invoice_number string, invoice_date date, subtotal decimal(14,2), "
    "tax_amount decimal(14,2), total_amount decimal(14,2)"
)
LINE = "invoice_id long, product_name string, quantity decimal(12,3), unit_price decimal(14,2), tax_percent decimal(5,2)"


def d(x):
    return None if x is None else Decimal(x)


def heads(spark, rows):
    return spark.createDataFrame([(i, v, n, day, d(s), d(t), d(a)) for i, v, n, day, s, t, a in rows], HEAD)


def lines(spark, rows):
    return spark.createDataFrame([(i, n, d(q), d(p), d(g)) for i, n, q, p, g in rows], LINE)


@pytest.fixture(scope="module")
def vendors(spark):
    return spark.createDataFrame([(1, "Acme"), (2, " \t")], "vendor_id long, vendor_name string")


def test_every_rule_at_its_boundary(spark, vendors):
    day = date(2024, 6, 1)
    invoices = heads(spark, [
        (1, 1, "A-1", day, "100", "18", "118"),
        (2, 1, " \t ", day, "100", "18", "118.01"),
        (3, 2, "A-3", None, "100", "18", "118.02"),
        (4, None, "A-4", date(2024, 6, 2), "-1", "-2", "-3"),
        (5, 1, "A-5", day, None, "18", "118"),
    ])
    items = lines(spark, [
        (1, "pen", "1", "1", "0"), (1, "pen", "1", "1", "100"),
        (2, "pen", "0", "0", "100.01"), (2, None, None, "-1.50", "-0.01"),
        (9, "lost", "0", "0", "0"),
    ])
    got = {}
    for r in rules.findings(invoices, items, vendors, AS_OF).collect():
        got.setdefault(r["invoice_id"], []).append((r["rule_no"], r["severity"], r["message"]))
    assert 1 not in got and 9 not in got
    assert sorted(n for n, _, _ in got[2]) == [1, 6, 6, 7, 7, 8, 8, 10]
    assert sorted(n for n, _, _ in got[3]) == [2, 3, 9]
    assert sorted(n for n, _, _ in got[4]) == [2, 4, 5, 5, 5]
    assert [m for _, _, m in got[5]] == [
        "Cannot verify total: subtotal, tax_amount or total_amount is missing "
        "(subtotal=None, tax_amount=18.0, total_amount=118.0)."]
    texts = {m for group in got.values() for _, _, m in group}
    assert "Total mismatch: expected 118.0, got 118.02 (tolerance 0.01)." in texts
    assert "Line-item quantity must be greater than zero: 'General' (quantity=None)." in texts
    assert "Line-item unit price must be greater than zero: 'General' (unit_price=-1.5)." in texts
    assert "Invoice dated in the future: 2024-06-02." in texts

    assessed = {r["invoice_id"]: r for r in rules.assess(invoices, items, vendors, AS_OF).collect()}
    assert assessed[1]["assessed_status"] == "Valid" and assessed[1]["issue_count"] == 0
    assert float(assessed[2]["assessed_score"]) == 100.0 and assessed[2]["issue_count"] == 8
    assert [assessed[i]["has_critical"] for i in (1, 2, 3, 4, 5)] == [False, True, True, True, True]


def test_status_bounds(spark):
    scores = [-1, 0, 0.5, 29, 29.5, 30, 59, 59.5, 60, 100]
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    got = [r[0] for r in df.select(rules.status_for_score(F.col("s"))).collect()]
    assert got == ["Valid", "Valid", "Needs Review", "Needs Review", "High Risk", "High Risk", "High Risk",
                   "Critical", "Critical", "Critical"]


def test_blend_report_goldens(spark):
    """Two rows of the sample whose outcome does not depend on a fitted forest."""
    rows = [
        ("INV-101", "ABC Traders", date(2026, 1, 5), "5", "200", "18", "1180"),
        ("INV-102", "XYZ Supplies", date(2026, 1, 6), "10", "150", "18", "1200"),
        ("INV-101", "ABC Traders", date(2026, 1, 5), "5", "200", "18", "1180"),
        ("INV-107", "Metro Electronics", date(2026, 1, 10), None, "5000", "18", "5900"),
        ("INV-110", "Prime Stationery", date(2027, 3, 1), "10", "80", "18", "944"),
        ("INV-105", "XYZ Supplies", date(2026, 1, 8), "7", "300", "18", "2478"),
    ]
    df = spark.createDataFrame(
        [(i, v, day, d(q), d(p), d(g), d(t)) for i, v, day, q, p, g, t in rows],
        "invoice_id string, vendor_name string, invoice_date date, quantity decimal(12,3), "
        "unit_price decimal(14,2), gst_percent decimal(5,2), total_amount decimal(14,2)",
    )
    scored = blend.score_rows(blend.with_codes(df, "2026-08-01"))
    got = {r["invoice_id"]: (r["status"], float(r["risk_score"])) for r in scored.collect()}
    assert got == {
        "INV-101": ("Duplicate", 100.0), "INV-102": ("High Risk", 60.0), "INV-107": ("Needs Review", 30.0),
        "INV-110": ("Needs Review", 10.0), "INV-105": ("Valid", 0.0)}
    expected = {r["invoice_id"]: r["expected_total"] for r in blend.results(scored).collect()}
    assert float(expected["INV-102"]) == 1770.0 and expected["INV-107"] is None
    total = blend.summary(scored).first()
    assert (total["total_invoices"], total["duplicate_count"], float(total["total_flagged_amount"])) == (6, 2, 10404.0)


def test_quality_checks(spark):
    companies = spark.createDataFrame(
        [(1, "27AACCA9603R1ZM", "a@x.in"), (2, "36GLOB1122K1Z7", "a@x.in")],
        "company_id long, gst_number string, email string")
    vendors = spark.createDataFrame(
        [(1, 1, None, None, "Active"), (2, 1, "29XYZAB5678G1Z2", "no-at", "Odd"), (3, 9, "29XYZAB5678G1Z2", "a@b.c", "Active")],
        "vendor_id long, company_id long, gst_number string, email string, status string")
    assert [r["record_id"] for r in quality.gstin_format(companies, vendors).collect()] == [2]
    assert [r["record_id"] for r in quality.email_format(vendors).collect()] == [2]
    assert sorted(r["record_id"] for r in quality.uniques(companies, vendors).collect()) == [1, 2]
