"""Rule and anomaly blend over flat invoice rows.

A flat row carries invoice_id, vendor_name, invoice_date, quantity, unit_price,
gst_percent and total_amount. ``codes`` is its small array of distinct rule codes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.functions import money, text

PRICE_OUTLIER_THRESHOLD = Decimal("3000.0")


def is_price_outlier(unit_price: Column, threshold: Decimal = PRICE_OUTLIER_THRESHOLD) -> Column:
    return F.coalesce(unit_price > F.lit(threshold), F.lit(False))


def with_codes(rows: DataFrame, as_of: str) -> DataFrame:
    """Rule codes of each row, in a fixed order, each code once."""
    repeats = (
        rows.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("invoice_id", F.lit(True).alias("repeated"))
    )
    date = F.col("invoice_date")
    mismatch = money.total_mismatches(
        F.col("quantity"), F.col("unit_price"), F.col("gst_percent"), F.col("total_amount")
    )
    missing = (
        text.is_blank(F.col("invoice_id"))
        | text.is_blank(F.col("vendor_name"))
        | F.col("quantity").isNull()
        | F.col("unit_price").isNull()
        | F.col("total_amount").isNull()
    )
    conditions = [
        ("DUPLICATE_INVOICE", F.coalesce(F.col("repeated"), F.lit(False))),
        ("TOTAL_MISMATCH", mismatch),
        ("MISSING_FIELD", missing),
        ("PRICE_OUTLIER", is_price_outlier(F.col("unit_price"))),
        ("FUTURE_DATE", F.coalesce(date > F.lit(as_of).cast("date"), F.lit(False))),
        ("INVALID_DATE", date.isNull()),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in conditions]))
    return rows.join(repeats, "invoice_id", "left").withColumn("codes", codes).drop("repeated")


def rule_component(codes: Column) -> Column:
    """Points of a set of codes: each code counts once, the two date codes share theirs."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    def has(code: str) -> Column:
        return F.array_contains(codes, code)

    return (
        points(has("TOTAL_MISMATCH"), 40)
        + points(has("MISSING_FIELD"), 15)
        + points(has("PRICE_OUTLIER"), 15)
        + points(has("FUTURE_DATE") | has("INVALID_DATE"), 10)
    )


def blend(rows: DataFrame) -> DataFrame:
    """Status and score from codes, rule_score, ml_risk_score and ml_flag."""
    codes = F.col("codes")
    rule = F.col("rule_score").cast("decimal(9,4)")
    anomaly = F.col("ml_risk_score").cast("decimal(9,4)")
    mixed = anomaly * F.lit(Decimal("0.6")) + rule * F.lit(Decimal("0.4"))
    combined = F.round(F.least(F.lit(Decimal("100.0")), F.greatest(rule, mixed)), 1)
    high = F.array_contains(codes, "TOTAL_MISMATCH") | (F.col("combined") >= 50) | F.col("ml_flag")
    duplicate = F.array_contains(codes, "DUPLICATE_INVOICE")
    return (
        rows.withColumn("combined", combined)
        .withColumn(
            "status",
            F.when(duplicate, "Duplicate")
            .when(high, "High Risk")
            .when(F.size(codes) > 0, "Needs Review")
            .otherwise("Valid"),
        )
        .withColumn(
            "risk_score",
            F.when(duplicate, F.lit(Decimal("100.0")))
            .when(high, F.greatest(F.col("combined"), F.lit(Decimal("60.0"))))
            .otherwise(F.col("combined"))
            .cast("decimal(5,1)"),
        )
        .drop("combined")
    )


def score_rows(rows: DataFrame, ml_scores: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """Rule component, blend, status. Without anomaly scores they count as 0 and unflagged."""
    scored = rows.withColumn("rule_score", rule_component(F.col("codes")))
    if ml_scores is None:
        scored = scored.withColumns({"ml_risk_score": F.lit(0.0), "ml_flag": F.lit(False)})
    else:
        scored = scored.join(ml_scores.select(key, "ml_risk_score", "ml_flag"), key, "left")
    return blend(scored)


def results(scored: DataFrame) -> DataFrame:
    """Row-level report with the expected total beside the reported one."""
    return scored.select(
        F.col("invoice_id").cast("string").alias("invoice_id"),
        "vendor_name",
        "total_amount",
        money.expected_total(F.col("quantity"), F.col("unit_price"), F.col("gst_percent"))
        .alias("expected_total"),
        "status",
        "risk_score",
        "codes",
    )


def summary(scored: DataFrame) -> DataFrame:
    flagged = F.when(F.col("status") != "Valid", F.coalesce(F.col("total_amount"), F.lit(0)))
    return scored.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("status") == "Valid").alias("valid_count"),
        F.count_if(F.col("status") == "High Risk").alias("high_risk_count"),
        F.count_if(F.col("status") == "Duplicate").alias("duplicate_count"),
        F.coalesce(F.sum(flagged), F.lit(0)).alias("total_flagged_amount"),
    )


def export_rows(scored: DataFrame) -> DataFrame:
    """Flat export: five columns and the codes joined into one text."""
    return scored.select(
        "invoice_id", "vendor_name", "total_amount", "status", "risk_score",
        F.array_join("codes", "; ").alias("issues_summary"),
    )
