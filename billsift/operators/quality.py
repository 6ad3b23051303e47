"""Data-quality checks of the stored tables: one row per violating record.

Every check returns (check_name, table_name, record_id).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.schemas import (
    BATCH_STATUSES,
    INVOICE_STATUSES,
    SEVERITIES,
    VALIDATION_TYPES,
    VENDOR_STATUSES,
)

# Formats of a tax registration number and of an e-mail address.
GSTIN_PATTERN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"


def _violations(df: DataFrame, check: str, table: str, key: str, broken: Column) -> DataFrame:
    return df.filter(broken).select(
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.col(key).cast("bigint").alias("record_id"),
    )


def gstin_format(companies: DataFrame, vendors: DataFrame) -> DataFrame:
    """Companies must have a well-formed number, vendors may have none."""
    ok = F.col("gst_number").rlike(GSTIN_PATTERN)
    return _violations(
        companies, "gstin_format", "companies", "company_id", F.col("gst_number").isNull() | ~ok
    ).unionByName(_violations(vendors, "gstin_format", "vendors", "vendor_id", ~ok))


def email_format(vendors: DataFrame) -> DataFrame:
    return _violations(
        vendors, "email_format", "vendors", "vendor_id", ~F.col("email").rlike(EMAIL_PATTERN)
    )


def batch_counters(batches: DataFrame) -> DataFrame:
    lowest = F.least("total_invoices", "processed_invoices", "failed_invoices")
    return _violations(batches, "batch_counters", "upload_batches", "batch_id", lowest < 0)


def invoice_money(invoices: DataFrame) -> DataFrame:
    negative = F.least("subtotal", "tax_amount", "total_amount") < 0
    gap = F.abs(F.col("subtotal") + F.col("tax_amount") - F.col("total_amount"))
    return _violations(
        invoices, "invoice_money", "invoices", "invoice_id", negative | (gap > F.lit(Decimal("0.01")))
    )


def risk_range(invoices: DataFrame) -> DataFrame:
    return _violations(
        invoices, "risk_range", "invoices", "invoice_id", ~F.col("risk_score").between(0, 100)
    )


def item_ranges(items: DataFrame) -> DataFrame:
    broken = (F.least("quantity", "unit_price", "line_total") < 0) | ~F.col("tax_percent").between(0, 100)
    return _violations(items, "item_ranges", "invoice_items", "invoice_id", broken)


def _repeated(df: DataFrame, check: str, table: str, key: str, columns: list[str]) -> DataFrame:
    """Records that share a non-null key with another record."""
    known = df.dropna(subset=columns)
    groups = known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _violations(known.join(groups, columns), check, table, key, F.col("n") > 1)


def uniques(companies: DataFrame, vendors: DataFrame) -> DataFrame:
    return (
        _repeated(companies, "unique_gst", "companies", "company_id", ["gst_number"])
        .unionByName(_repeated(companies, "unique_email", "companies", "company_id", ["email"]))
        .unionByName(_repeated(vendors, "unique_gst", "vendors", "vendor_id", ["company_id", "gst_number"]))
    )


def _orphans(child: DataFrame, check: str, table: str, key: str, column: str, parent: DataFrame,
             parent_key: str) -> DataFrame:
    parents = parent.select(F.col(parent_key).alias(column)).distinct()
    lost = child.filter(F.col(column).isNotNull()).join(parents, column, "left_anti")
    return _violations(lost, check, table, key, F.lit(True))


def foreign_keys(companies: DataFrame, vendors: DataFrame, batches: DataFrame, invoices: DataFrame,
                 items: DataFrame, findings: DataFrame) -> DataFrame:
    checks = [
        _orphans(vendors, "vendor_company", "vendors", "vendor_id", "company_id", companies, "company_id"),
        _orphans(invoices, "invoice_company", "invoices", "invoice_id", "company_id", companies, "company_id"),
        _orphans(invoices, "invoice_vendor", "invoices", "invoice_id", "vendor_id", vendors, "vendor_id"),
        _orphans(invoices, "invoice_batch", "invoices", "invoice_id", "batch_id", batches, "batch_id"),
        _orphans(items, "item_invoice", "invoice_items", "invoice_id", "invoice_id", invoices, "invoice_id"),
        _orphans(findings, "finding_invoice", "validation_results", "invoice_id", "invoice_id", invoices,
                 "invoice_id"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def domains(vendors: DataFrame, batches: DataFrame, invoices: DataFrame, findings: DataFrame) -> DataFrame:
    def outside(column: str, allowed: tuple[str, ...]) -> Column:
        return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))

    return (
        _violations(vendors, "vendor_status", "vendors", "vendor_id", outside("status", VENDOR_STATUSES))
        .unionByName(
            _violations(batches, "batch_status", "upload_batches", "batch_id", outside("status", BATCH_STATUSES)))
        .unionByName(
            _violations(invoices, "invoice_status", "invoices", "invoice_id", outside("status", INVOICE_STATUSES)))
        .unionByName(
            _violations(findings, "finding_severity", "validation_results", "invoice_id",
                        outside("severity", SEVERITIES)))
        .unionByName(
            _violations(findings, "finding_type", "validation_results", "invoice_id",
                        outside("validation_type", VALIDATION_TYPES)))
    )


def gst_mismatch(invoices: DataFrame, items: DataFrame, tolerance: Decimal = Decimal("0.01")) -> DataFrame:
    """Invoices whose header tax differs from the tax recomputed from their lines."""
    recomputed = items.groupBy("invoice_id").agg(F.sum("line_tax").alias("item_tax"))
    # An invoice without lines has no item tax, not an unknown one.
    joined = invoices.join(recomputed, "invoice_id", "left").withColumn(
        "item_tax", F.coalesce("item_tax", F.lit(Decimal("0.00")))
    )
    gap = F.abs(F.col("item_tax") - F.col("tax_amount"))
    return joined.filter(gap > F.lit(tolerance)).select(
        "invoice_id", "tax_amount", "item_tax", F.lit("GST_MISMATCH").alias("validation_type")
    )
