"""Report statements over invoices, vendors, items and findings.

Vendor reports add up per vendor id before they join the vendor table, so a vendor
with very many invoices costs one row per map task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.functions import money, text

TOTAL = "total_amount"


def _mean(col: str) -> Column:
    return F.round(F.avg(col), 2)


def duplicate_numbers(invoices: DataFrame) -> DataFrame:
    """Invoice numbers submitted more than once: count and exposure."""
    return (
        invoices.groupBy("invoice_number")
        .agg(F.count(F.lit(1)).alias("submissions"), F.sum(TOTAL).alias("exposure"))
        .filter(F.col("submissions") > 1)
    )


def duplicate_number_members(invoices: DataFrame) -> DataFrame:
    """The report with its id and status lists as rows, so a list has no size limit."""
    groups = duplicate_numbers(invoices).withColumnRenamed("invoice_number", "number")
    return (
        invoices.join(groups, F.col("invoice_number").eqNullSafe(F.col("number")))
        .select("invoice_number", "submissions", "exposure", "invoice_id", "status")
        .orderBy(F.desc("exposure"), "invoice_number", "invoice_id")
    )


def _per_vendor(invoices: DataFrame, vendors: DataFrame, *aggregates: Column, how: str = "inner") -> DataFrame:
    """Aggregates per vendor id, then the vendor's own columns."""
    sums = invoices.filter(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(*aggregates)
    return vendors.select("vendor_id", "vendor_name", F.col("status").alias("vendor_status")).join(
        sums, "vendor_id", how
    )


def vendor_spend(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    grand = invoices.agg(F.coalesce(F.sum(TOTAL), F.lit(0)).alias("s")).scalar()
    rows = _per_vendor(
        invoices, vendors, F.count(F.lit(1)).alias("invoice_count"), F.sum(TOTAL).alias("total_spend")
    )
    return rows.select(
        "vendor_name", "invoice_count", "total_spend",
        money.share_percent(F.col("total_spend"), grand).alias("spend_pct"),
    ).orderBy(F.desc("total_spend"), "vendor_name")


def monthly_trend(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy(text.month_key(F.col("invoice_date")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("invoice_count"),
            F.sum(TOTAL).alias("invoiced_amount"),
            _mean(TOTAL).alias("avg_amount"),
        )
        .orderBy("month")
    )


def _with_vendor(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    return invoices.join(vendors.select("vendor_id", "vendor_name"), "vendor_id")


def risky_invoices(invoices: DataFrame, vendors: DataFrame, length: int = 25) -> DataFrame:
    """The riskiest invoices that need attention; the length is the feature."""
    flagged = invoices.filter(F.col("status").isin("High Risk", "Needs Review", "Duplicate"))
    return (
        _with_vendor(flagged, vendors)
        .select("invoice_id", "invoice_number", "vendor_name", "invoice_date", TOTAL, "risk_score", "status")
        .orderBy(F.desc("risk_score"), "invoice_id")
        .limit(length)
    )


def top_products(items: DataFrame, length: int = 10) -> DataFrame:
    gross = F.round(F.sum(F.col("quantity") * F.col("unit_price")), 2)
    return (
        items.groupBy("product_name")
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            gross.alias("gross_value"),
            _mean("unit_price").alias("avg_unit_price"),
            F.max("unit_price").alias("max_unit_price"),
        )
        .orderBy(F.desc("gross_value"), "product_name")
        .limit(length)
    )


def tax_summary(items: DataFrame) -> DataFrame:
    base = F.col("quantity") * F.col("unit_price")
    return (
        items.groupBy(F.col("tax_percent").alias("gst_rate"))
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.round(F.sum(base), 2).alias("taxable_base"),
            F.round(F.sum(money.percent_of(base, F.col("tax_percent"))), 2).alias("tax_amount"),
            F.sum("line_total").alias("billed_amount"),
        )
        .orderBy("gst_rate")
    )


def pending_invoices(invoices: DataFrame, vendors: DataFrame, as_of: str) -> DataFrame:
    return (
        _with_vendor(invoices.filter(F.col("status") == "Pending"), vendors)
        .select(
            "invoice_number", "vendor_name", "invoice_date", TOTAL, "status",
            text.days_pending(as_of, F.col("invoice_date")).alias("days_pending"),
        )
        .orderBy("invoice_date", "invoice_number")
    )


def invoices_per_vendor(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every vendor, also those without invoices."""
    rows = _per_vendor(invoices, vendors, F.count(F.lit(1)).alias("n"), how="left")
    return rows.select(
        "vendor_name", F.col("vendor_status").alias("status"),
        F.coalesce(F.col("n"), F.lit(0)).alias("invoice_count"),
    ).orderBy(F.desc("invoice_count"), "vendor_name")


def invoice_value_range(invoices: DataFrame) -> DataFrame:
    return invoices.agg(
        _mean(TOTAL).alias("avg_invoice_value"),
        F.min(TOTAL).alias("min_invoice_value"),
        F.max(TOTAL).alias("max_invoice_value"),
    )


def vendor_average(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    rows = _per_vendor(
        invoices, vendors, F.count(F.lit(1)).alias("invoice_count"), _mean(TOTAL).alias("avg_invoice_value")
    )
    return rows.select("vendor_name", "invoice_count", "avg_invoice_value").orderBy(
        F.desc("avg_invoice_value"), "vendor_name"
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("validation_type", "severity")
        .agg(F.count(F.lit(1)).alias("issue_count"))
        .orderBy(text.severity_rank(F.col("severity")), F.desc("issue_count"), "validation_type")
    )


def potential_loss(invoices: DataFrame) -> DataFrame:
    return invoices.filter(F.col("status").isin("High Risk", "Duplicate")).agg(
        F.sum(TOTAL).alias("potential_loss")
    )


def paid_with_mismatch(findings: DataFrame, invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    wanted = findings.filter(F.col("validation_type").isin("TOTAL_MISMATCH", "GST_MISMATCH"))
    paid = _with_vendor(invoices.filter(F.col("status") == "Paid"), vendors).select(
        "invoice_id", "invoice_number", "vendor_name", TOTAL, "status"
    )
    return (
        wanted.select("invoice_id", "validation_type", "severity", "message", "created_at")
        .join(paid, "invoice_id")
        .orderBy("created_at", "invoice_id")
        .drop("invoice_id")
    )


def repeated_ids(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("submissions"))
        .filter(F.col("submissions") > 1)
    )


def high_risk(invoices: DataFrame) -> DataFrame:
    return (
        invoices.filter(F.col("status") == "High Risk")
        .select("invoice_id", "vendor_id", TOTAL, "risk_score", "status")
        .orderBy(F.desc("risk_score"), "invoice_id")
    )


def monthly_anomalies(invoices: DataFrame) -> DataFrame:
    status = F.col("status")
    return (
        invoices.groupBy(text.month_key(F.col("invoice_date")).alias("month"))
        .agg(
            F.count_if(status == "High Risk").alias("high_risk_count"),
            F.count_if(status == "Duplicate").alias("duplicate_count"),
            F.count(F.lit(1)).alias("total_invoices"),
        )
        .orderBy("month")
    )


def vendor_names(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Average and count per vendor name: vendors of one name merge.

    Sums and counts per id add up exactly, which averages would not.
    """
    per_id = _per_vendor(invoices, vendors, F.count(F.lit(1)).alias("n"), F.sum(TOTAL).alias("s"))
    mean = F.sum("s") / F.sum("n")
    return (
        per_id.groupBy("vendor_name")
        .agg(F.round(mean.cast("decimal(24,6)"), 2).alias("avg_invoice_amount"),
             F.sum("n").alias("invoice_count"))
        .orderBy(F.desc("avg_invoice_amount"), "vendor_name")
    )
