"""Row-level validation rules, risk score and status.

A rule is a declaration: code, severity, condition column, message column. Header
rules look at one invoice row, item rules at one line. Nothing gathers the lines of
an invoice: item findings are rows, and the score is a sum that combines before
the shuffle, so an invoice may have any number of lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.functions import money, text

# Points by severity, and the upper end of each status.
SEVERITY_POINTS = {"CRITICAL": 40, "ERROR": 20, "WARNING": 10, "INFO": 2}
MAX_SCORE = 100
TOTAL_TOLERANCE = Decimal("0.01")


@dataclass(frozen=True)
class Rule:
    number: int
    code: str
    severity: str
    condition: Column
    message: Column


def _shown(col: Column) -> Column:
    return F.coalesce(text.float_text(col), F.lit("None"))


def _item_label() -> Column:
    return text.product_or_default(F.col("product_name"))


# The message texts of the rules below are fixed values.


def header_rules(as_of: str, tolerance: Decimal = TOTAL_TOLERANCE) -> list[Rule]:
    date = F.col("invoice_date")
    rules = [
        Rule(1, "MISSING_FIELD", "CRITICAL", text.is_blank(F.col("invoice_number")),
             F.lit("Missing required field: invoice_number.")),
        Rule(2, "MISSING_FIELD", "CRITICAL", text.is_blank(F.col("vendor_name")),
             F.lit("Missing required field: vendor_name.")),
        Rule(3, "INVALID_DATE", "ERROR", date.isNull(),
             F.lit("Invoice date is empty or in an invalid format.")),
        Rule(4, "FUTURE_DATE", "WARNING", date > F.lit(as_of).cast("date"),
             F.concat(F.lit("Invoice dated in the future: "), date.cast("string"), F.lit("."))),
    ]
    for label in ("subtotal", "tax_amount", "total_amount"):
        value = F.col(label)
        rules.append(
            Rule(5, "NEGATIVE_AMOUNT", "CRITICAL", value < 0,
                 F.concat(F.lit(f"Negative amount detected: {label}="), _shown(value), F.lit(".")))
        )
    parts = [F.col(c) for c in ("subtotal", "tax_amount", "total_amount")]
    subtotal, tax, total = parts
    missing = subtotal.isNull() | tax.isNull() | total.isNull()
    expected = money.round_money(subtotal + tax)
    rules.append(
        Rule(9, "TOTAL_MISMATCH", "CRITICAL", missing,
             F.concat(
                 F.lit("Cannot verify total: subtotal, tax_amount or total_amount is missing (subtotal="),
                 _shown(subtotal), F.lit(", tax_amount="), _shown(tax),
                 F.lit(", total_amount="), _shown(total), F.lit(").")))
    )
    rules.append(
        Rule(9, "TOTAL_MISMATCH", "CRITICAL", F.abs(expected - total) > F.lit(tolerance),
             F.concat(
                 F.lit("Total mismatch: expected "), _shown(expected), F.lit(", got "), _shown(total),
                 F.lit(f" (tolerance {tolerance}).")))
    )
    return rules


def item_rules() -> list[Rule]:
    quantity, price, rate = F.col("quantity"), F.col("unit_price"), F.col("tax_percent")
    return [
        Rule(6, "QUANTITY_INVALID", "ERROR", quantity.isNull() | (quantity <= 0),
             F.concat(F.lit("Line-item quantity must be greater than zero: '"), _item_label(),
                      F.lit("' (quantity="), _shown(quantity), F.lit(")."))),
        Rule(7, "UNIT_PRICE_INVALID", "ERROR", price.isNull() | (price <= 0),
             F.concat(F.lit("Line-item unit price must be greater than zero: '"), _item_label(),
                      F.lit("' (unit_price="), _shown(price), F.lit(")."))),
        Rule(8, "GST_OUT_OF_RANGE", "ERROR", rate.isNull() | ~rate.between(0, 100),
             F.concat(F.lit("GST rate out of allowed range 0-100: '"), _item_label(),
                      F.lit("' (gst_percent="), _shown(rate), F.lit(")."))),
        Rule(10, "EMPTY_PRODUCT_NAME", "WARNING", text.is_blank(F.col("product_name")),
             F.lit("Line item has an empty product name; supplier data is incomplete for reporting.")),
    ]


def _holds(rule: Rule) -> Column:
    return F.coalesce(rule.condition, F.lit(False))


def _fired(rules: list[Rule]) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(
                    _holds(r),
                    F.struct(
                        F.lit(r.number).alias("rule_no"),
                        F.lit(r.code).alias("validation_type"),
                        F.lit(r.severity).alias("severity"),
                        r.message.alias("message"),
                    ),
                )
                for r in rules
            ]
        )
    )


def _points(rules: list[Rule]) -> Column:
    total = F.lit(0)
    for r in rules:
        total = total + F.when(_holds(r), SEVERITY_POINTS.get(r.severity, 0)).otherwise(0)
    return total


def _count(rules: list[Rule]) -> Column:
    total = F.lit(0)
    for r in rules:
        total = total + _holds(r).cast("int")
    return total


def _any_critical(rules: list[Rule]) -> Column:
    found = F.lit(False)
    for r in rules:
        if r.severity == "CRITICAL":
            found = found | _holds(r)
    return found


def with_vendor_name(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    return invoices.join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left")


def header_findings(invoices: DataFrame, vendors: DataFrame, as_of: str,
                    tolerance: Decimal = TOTAL_TOLERANCE) -> DataFrame:
    named = with_vendor_name(invoices, vendors)
    return named.select("invoice_id", F.inline(_fired(header_rules(as_of, tolerance))))


def item_findings(items: DataFrame) -> DataFrame:
    return items.select("invoice_id", F.inline(_fired(item_rules())))


def findings(invoices: DataFrame, items: DataFrame, vendors: DataFrame, as_of: str,
             tolerance: Decimal = TOTAL_TOLERANCE) -> DataFrame:
    """One row per finding: every header rule once, every item rule per offending line."""
    of_items = item_findings(items).join(invoices.select("invoice_id"), "invoice_id", "left_semi")
    return header_findings(invoices, vendors, as_of, tolerance).unionByName(of_items)


def score_from_points(points: Column) -> Column:
    return F.least(points, F.lit(MAX_SCORE)).cast("decimal(5,2)")


def status_for_score(score: Column) -> Column:
    return (
        F.when(score <= 0, "Valid")
        .when(score <= 29, "Needs Review")
        .when(score <= 59, "High Risk")
        .otherwise("Critical")
    )


def assess(invoices: DataFrame, items: DataFrame, vendors: DataFrame, as_of: str,
           tolerance: Decimal = TOTAL_TOLERANCE) -> DataFrame:
    """Invoices with issue_count, has_critical, assessed_score and assessed_status."""
    per_line = item_rules()
    per_header = header_rules(as_of, tolerance)
    line_sums = (
        items.select("invoice_id", _points(per_line).alias("p"), _count(per_line).alias("n"))
        .filter(F.col("n") > 0)
        .groupBy("invoice_id")
        .agg(F.sum("p").alias("line_points"), F.sum("n").alias("line_issues"))
    )
    points = _points(per_header) + F.coalesce(F.col("line_points"), F.lit(0))
    rows = with_vendor_name(invoices, vendors).join(line_sums, "invoice_id", "left")
    return rows.select(
        *[F.col(c) for c in invoices.columns],
        (_count(per_header) + F.coalesce(F.col("line_issues"), F.lit(0))).cast("bigint").alias("issue_count"),
        _any_critical(per_header).alias("has_critical"),
        score_from_points(points).alias("assessed_score"),
        status_for_score(score_from_points(points)).alias("assessed_status"),
    )


def batch_summary(assessed: DataFrame) -> DataFrame:
    """Invoice counts by status for every batch."""
    status = F.col("assessed_status")
    return assessed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(status == "Valid").alias("valid"),
        F.count_if(status == "Needs Review").alias("needs_review"),
        F.count_if(status == "High Risk").alias("high_risk"),
        F.count_if(status == "Critical").alias("critical"),
    )
