"""Dashboard aggregates.

``invoices`` here are rows of ``reads.invoice_rows``, ``batches`` the upload history,
``pairs`` the rows of ``duplicates.pair_listing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.functions import money, text
from billsift.functions.frames import beside

AT_RISK = ("High Risk", "Critical")
# Bounds of the risk buckets, and the order of duplicate levels.
RISK_BOUNDS = (0, 25, 50, 75, 101)
LEVEL_ORDER = (
    "DUPLICATE_EXACT",
    "DUPLICATE_VENDOR",
    "DUPLICATE_NEAR",
    "DUPLICATE_DATE",
    "DUPLICATE_ITEM",
)


def _zero() -> Column:
    return F.lit(0).cast("decimal(14,2)")


def _amount() -> Column:
    return F.coalesce(F.col("total_amount"), _zero())


def _sum(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0).cast("decimal(24,2)"))


def monthly_series(invoices: DataFrame, last: int | None = None) -> DataFrame:
    """Invoices per month, optionally the latest months only."""
    counts = (
        invoices.filter(F.col("invoice_date").isNotNull())
        .groupBy(text.month_key(F.col("invoice_date")).alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    if last is not None:
        counts = counts.orderBy(F.desc("label")).limit(last)
    return counts.orderBy("label")


def amount_series(invoices: DataFrame) -> DataFrame:
    return (
        invoices.filter(F.col("invoice_date").isNotNull())
        .groupBy(text.month_key(F.col("invoice_date")).alias("label"))
        .agg(money.half_up_int(F.sum(_amount())).alias("value"))
        .orderBy("label")
    )


def status_distribution(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy(F.coalesce(F.col("status"), F.lit("Pending")).alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("value"), "label")
    )


def vendor_profile(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy(F.coalesce(F.col("vendor_name"), F.lit("Unknown Vendor")).alias("name"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            _sum(_amount()).alias("amount"),
            F.count_if(F.col("status").isin(*AT_RISK)).alias("high_risk"),
            F.count_if(F.col("risk_score") >= 40).alias("risky"),
        )
    )


def ranked_vendors(profile: DataFrame) -> DataFrame:
    return profile.orderBy(F.desc("amount"), "name")


def risk_buckets(invoices: DataFrame, bounds: tuple[int, ...] = RISK_BOUNDS) -> DataFrame:
    """Count per bucket, empty buckets included; scores outside all buckets are left out."""
    score = F.coalesce(F.col("risk_score"), F.lit(0))
    spans = list(zip(bounds, bounds[1:]))
    counts = invoices.agg(
        *[F.count_if((score >= low) & (score < high)).alias(f"b{i}") for i, (low, high) in enumerate(spans)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f"{low}–{100 if high == 101 else high}").alias("label"),
                F.col(f"b{i}").alias("value"),
            )
            for i, (low, high) in enumerate(spans)
        ]
    )
    return counts.select(F.inline(rows)).orderBy("position")


def duplicate_levels(pairs: DataFrame) -> DataFrame:
    """Per level: pairs, amount of the lower-id side, first severity, highest confidence."""
    kind = F.coalesce(F.col("validation_type"), F.lit("DUPLICATE_ITEM"))
    severity = F.coalesce(F.col("severity"), F.lit("WARNING"))
    position = F.array_position(F.array(*[F.lit(c) for c in LEVEL_ORDER]), F.col("type"))
    return (
        pairs.groupBy(kind.alias("type"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            _sum(F.abs(F.coalesce(F.col("amount_a"), _zero()))).alias("amount"),
            F.min_by(severity, F.struct(text.severity_rank(F.col("severity")), F.col("invoice_a_id")))
            .alias("severity"),
            F.max(F.coalesce(F.col("confidence_score"), F.lit(0))).alias("confidence"),
        )
        .filter(position > 0)
        .orderBy(position)
    )


def measured_levels(measures: DataFrame) -> DataFrame:
    """``duplicate_levels`` of a scan from ``duplicates.pair_measures``, which lists no pairs."""
    position = F.array_position(F.array(*[F.lit(c) for c in LEVEL_ORDER]), F.col("validation_type"))
    return measures.orderBy(position).select(
        F.col("validation_type").alias("type"), F.col("pairs").alias("count"), "amount", "severity",
        F.col("confidence").cast("decimal(5,2)").alias("confidence"),
    )


def _invoice_kpis(invoices: DataFrame) -> DataFrame:
    status = F.col("status")
    losing = status.isin(*AT_RISK, "Duplicate")
    return invoices.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(status == "Valid").alias("valid"),
        F.count_if(status.isin(*AT_RISK)).alias("high_risk"),
        F.count_if(status == "Duplicate").alias("duplicate_status"),
        _sum(F.when(losing, _amount())).alias("potential_loss"),
        _sum(_amount()).alias("total_value"),
    )


def executive_kpis(invoices: DataFrame, batches: DataFrame, pair_totals: DataFrame) -> DataFrame:
    """Counts over all invoices and batches, and the pairs of a scan by its exact counters."""
    of_batches = batches.agg(
        F.count(F.lit(1)).alias("total_uploads"),
        F.coalesce(F.sum("processed_invoices"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("failed_invoices"), F.lit(0)).alias("failed"),
    )
    of_pairs = pair_totals.select(sum(F.col(c) for c in pair_totals.columns).alias("pairs"))
    return beside(beside(_invoice_kpis(invoices), of_batches), of_pairs).select(
        "total_uploads", "total_invoices", "processed", "failed", "valid", "high_risk",
        (F.col("duplicate_status") + F.col("pairs")).alias("duplicate"),
        "potential_loss", "total_value",
    )


def executive_shares(invoices: DataFrame) -> DataFrame:
    return _invoice_kpis(invoices).select(
        money.half_up_percent(F.col("valid"), F.col("total_invoices")).alias("valid_share"),
        money.half_up_percent(F.col("high_risk"), F.col("total_invoices")).alias("risk_share"),
        "total_value",
    )


def vendor_kpis(profile: DataFrame) -> DataFrame:
    mean = money.half_up_quotient((F.col("spend") * 100).cast("decimal(38,0)"), F.col("vendors") * 100)
    return profile.agg(
        F.count(F.lit(1)).alias("vendors"),
        _sum(F.col("amount")).alias("spend"),
        F.coalesce(F.sum("high_risk"), F.lit(0)).alias("high_risk_invoices"),
        F.count_if(F.col("high_risk") > 0).alias("risky_vendors"),
    ).withColumn("avg_per_vendor", mean)


def spend_share(profile: DataFrame, top: int = 7) -> DataFrame:
    """Share of all spend, in whole percent, of the vendors with the most spend."""
    total = profile.agg(_sum(F.col("amount")).alias("t")).scalar()
    whole = F.when(total == 0, F.lit(1)).otherwise(total)
    share = money.half_up_quotient(
        (F.col("amount") * 10000).cast("decimal(38,0)"), (whole * 100).cast("decimal(38,0)")
    )
    return ranked_vendors(profile).limit(top).select("name", share.alias("value"))


def vendor_heat(profile: DataFrame, top: int = 8) -> DataFrame:
    """Invoices, high-risk invoices and spend of the top vendors, scaled to the column maximum."""
    peaks = profile.agg(
        F.greatest(F.max("count"), F.lit(1)).alias("max_count"),
        F.greatest(F.max("high_risk"), F.lit(1)).alias("max_high_risk"),
        F.greatest(F.max("amount"), F.lit(1)).alias("max_amount"),
    )
    heads = ranked_vendors(profile).limit(top)

    def heat(value: Column, peak: Column) -> Column:
        return money.half_up_quotient((value * 10000).cast("decimal(38,0)"), (peak * 100).cast("decimal(38,0)"))

    return beside(heads, peaks).select(
        "name",
        heat(F.col("count"), F.col("max_count")).alias("invoices"),
        heat(F.col("high_risk"), F.col("max_high_risk")).alias("high_risk"),
        heat(F.col("amount"), F.col("max_amount")).alias("spend"),
    )


def vendor_ranking(profile: DataFrame, top: int = 10) -> DataFrame:
    return ranked_vendors(profile).limit(top).select("name", "count", "high_risk", "amount")


def validation_kpis(invoices: DataFrame) -> DataFrame:
    status = F.coalesce(F.col("status"), F.lit("Pending"))
    flagged = ~status.isin("Valid", "Pending")
    return invoices.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "Valid").alias("valid"),
        F.count_if(status == "Needs Review").alias("needs_review"),
        F.count_if(status.isin(*AT_RISK)).alias("at_risk"),
        _sum(F.when(flagged, _amount())).alias("flagged_value"),
    ).select(
        money.half_up_percent(F.col("valid"), F.col("total")).alias("pass_rate"),
        "needs_review", "at_risk", "flagged_value",
        money.half_up_percent(F.col("at_risk"), F.col("total")).alias("flagged_rate"),
    )


def duplicate_kpis(levels: DataFrame) -> DataFrame:
    return levels.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("severity") == "CRITICAL", F.col("count"))), F.lit(0))
        .alias("critical_pairs"),
        _sum(F.col("amount")).alias("exposure"),
        F.max("confidence").alias("max_confidence"),
    )


def audit_kpis(history: DataFrame) -> DataFrame:
    status = F.col("status")
    return history.agg(
        F.count(F.lit(1)).alias("batches"),
        F.count_if(status == "Completed").alias("completed"),
        F.count_if(status == "Failed").alias("failed"),
        F.count_if(status == "Processing").alias("processing"),
        F.coalesce(F.sum("processed_invoices"), F.lit(0)).alias("processed_invoices"),
        F.coalesce(F.sum("failed_invoices"), F.lit(0)).alias("failed_invoices"),
        F.coalesce(F.max_by("uploaded_by", "batch_id"), F.lit("admin")).alias("latest_uploader"),
    )


def landing_kpis(invoices: DataFrame) -> DataFrame:
    status = F.col("status")
    flagged = F.coalesce(status != "Valid", F.lit(True))
    return invoices.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(status == "High Risk").alias("high_risk"),
        F.count_if(status == "Duplicate").alias("duplicates"),
        _sum(F.when(flagged, _amount())).alias("flagged_amount"),
    )


def flagged_invoices(invoices: DataFrame) -> DataFrame:
    return invoices.filter(F.coalesce(F.col("status") != "Valid", F.lit(True)))


def status_share(invoices: DataFrame) -> DataFrame:
    """Percentage of all invoices per status."""
    counts = status_distribution(invoices)
    total = invoices.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("label", "value", (F.col("value") * 100.0 / total).alias("share"))
