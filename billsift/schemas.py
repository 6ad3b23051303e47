"""Column types of the six stored tables and of the transport rows."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of the stored tables.
MONEY = T.DecimalType(14, 2)
QUANTITY = T.DecimalType(12, 3)
PERCENT = T.DecimalType(5, 2)

COMPANIES = T.StructType(
    [
        T.StructField("company_id", T.LongType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("gst_number", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)

VENDORS = T.StructType(
    [
        T.StructField("vendor_id", T.LongType()),
        T.StructField("company_id", T.LongType()),
        T.StructField("vendor_name", T.StringType()),
        T.StructField("gst_number", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

UPLOAD_BATCHES = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("uploaded_by", T.StringType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("total_invoices", T.LongType()),
        T.StructField("processed_invoices", T.LongType()),
        T.StructField("failed_invoices", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

INVOICES = T.StructType(
    [
        T.StructField("invoice_id", T.LongType()),
        T.StructField("company_id", T.LongType()),
        T.StructField("vendor_id", T.LongType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("subtotal", MONEY),
        T.StructField("tax_amount", MONEY),
        T.StructField("total_amount", MONEY),
        T.StructField("status", T.StringType()),
        T.StructField("risk_score", PERCENT),
    ]
)

INVOICE_ITEMS = T.StructType(
    [
        T.StructField("invoice_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("quantity", QUANTITY),
        T.StructField("unit_price", MONEY),
        T.StructField("tax_percent", PERCENT),
        T.StructField("line_total", MONEY),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("invoice_id", T.LongType()),
        T.StructField("validation_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("confidence_score", PERCENT),
    ]
)

# Column contract of an uploaded line file and accepted header variants.
REQUIRED_COLUMNS = (
    "invoice_number",
    "vendor_name",
    "invoice_date",
    "product_name",
    "quantity",
    "unit_price",
    "gst_percent",
)
HEADER_ALIASES = {
    "gst": "gst_percent",
    "gst_rate": "gst_percent",
    "gst_percentage": "gst_percent",
    "sales_tax": "gst_percent",
}

# Enumerated domains of the stored tables.
VENDOR_STATUSES = ("Active", "Inactive", "Blacklisted")
BATCH_STATUSES = ("Processing", "Completed", "Failed")
INVOICE_STATUSES = (
    "Pending",
    "Valid",
    "Needs Review",
    "High Risk",
    "Critical",
    "Duplicate",
    "Paid",
)
SEVERITIES = ("CRITICAL", "ERROR", "WARNING", "INFO")
VALIDATION_TYPES = (
    "DUPLICATE",
    "TOTAL_MISMATCH",
    "GST_MISMATCH",
    "MISSING_FIELD",
    "PRICE_OUTLIER",
    "FUTURE_DATE",
    "INVALID_DATE",
    "RISK_ANOMALY",
    "RECONCILIATION",
    "NEGATIVE_AMOUNT",
    "QUANTITY_INVALID",
    "UNIT_PRICE_INVALID",
    "GST_OUT_OF_RANGE",
    "EMPTY_PRODUCT_NAME",
    "DUPLICATE_EXACT",
    "DUPLICATE_VENDOR",
    "DUPLICATE_NEAR",
    "DUPLICATE_DATE",
    "DUPLICATE_ITEM",
)
