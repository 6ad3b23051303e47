"""Read shapes over the stored tables.

Nested one-to-many shapes are returned flat, one row per child: a batch or an invoice
may have any number of children, and no task has to hold them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY_LENGTH = 50


def batch_invoices(invoices: DataFrame, items: DataFrame, vendors: DataFrame, batch_id: int) -> DataFrame:
    """Invoices of one batch with vendor and lines, by invoice id."""
    chosen = invoices.filter(F.col("batch_id") == batch_id)
    names = vendors.select("vendor_id", "vendor_name")
    lines = items.select("invoice_id", "product_name", "quantity", "unit_price", "tax_percent", "line_total")
    return (
        chosen.join(names, "vendor_id", "left").join(lines, "invoice_id", "left").orderBy("invoice_id")
    )


def company_invoices(invoices: DataFrame, batch_id: int) -> DataFrame:
    """All invoices of the companies a batch touches; all invoices if it names no company."""
    companies = (
        invoices.filter((F.col("batch_id") == batch_id) & F.col("company_id").isNotNull())
        .select("company_id").distinct()
    )
    named = companies.agg(F.count(F.lit(1)).alias("n")).scalar()
    marked = invoices.join(companies.withColumn("wanted", F.lit(True)), "company_id", "left")
    return marked.filter(F.col("wanted").isNotNull() | (named == 0)).drop("wanted")


def upload_history(batches: DataFrame, length: int = HISTORY_LENGTH) -> DataFrame:
    """Newest batches first; the length of the page is the feature."""
    return batches.orderBy(F.desc("batch_id")).limit(length)


def batch_detail(batches: DataFrame, invoices: DataFrame, vendors: DataFrame, batch_id: int) -> DataFrame:
    """Batch columns beside each of its invoices; one row without invoice when it has none."""
    chosen = batches.filter(F.col("batch_id") == batch_id)
    lines = (
        invoices.filter(F.col("batch_id") == batch_id)
        .join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left")
        .select(
            "batch_id", "invoice_id", "invoice_number", "invoice_date", "vendor_name", "subtotal",
            "tax_amount", "total_amount", F.col("status").alias("invoice_status"),
        )
    )
    return chosen.join(lines, "batch_id", "left").orderBy("invoice_id")


def invoice_list(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Invoices with vendor name, newest date first."""
    return invoice_rows(invoices, vendors).orderBy(F.desc_nulls_last("invoice_date"), "invoice_id")


def invoice_rows(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    return invoices.join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left").select(
        "invoice_id", "invoice_date", "total_amount", "risk_score", "status", "vendor_name"
    )


def invoice_detail(invoices: DataFrame, items: DataFrame, vendors: DataFrame,
                   invoice_id: int | None = None) -> DataFrame:
    """Header and vendor beside each line of one invoice, or of every invoice."""
    heads, lines = invoices, items
    if invoice_id is not None:
        heads = heads.filter(F.col("invoice_id") == invoice_id)
        lines = lines.filter(F.col("invoice_id") == invoice_id)
    return (
        heads.select("invoice_id", "vendor_id", "invoice_date", "total_amount", "risk_score", "status")
        .join(vendors.select("vendor_id", "vendor_name", "gst_number"), "vendor_id", "left")
        .join(lines.select("invoice_id", "product_name", "quantity", "unit_price"), "invoice_id", "left")
        .select(
            "invoice_id", "invoice_date", "total_amount", "risk_score", "status",
            "vendor_id", "vendor_name", "gst_number", "product_name", "quantity", "unit_price",
            (F.col("quantity") * F.col("unit_price")).alias("amount"),
        )
    )
