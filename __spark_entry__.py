"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from billsift.functions import money, similarity, text  # noqa: E402
from billsift.operators import (  # noqa: E402
    anomaly,
    blend,
    duplicates,
    load,
    quality,
    reads,
    rules,
    runs,
    sinks,
)
from billsift.plans import dashboard, reports  # noqa: E402
from billsift.session import configure, cut_lineage, discard, ensure_checkpoint_dir, remove  # noqa: E402
from billsift.sources import lines  # noqa: E402
from billsift.sources.orderbook import AS_OF, OrderBook  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
SCANNED_BATCH = 3

Query = Callable[[SparkSession, str], DataFrame]


def _edge(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, at the output edge only."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


class Tables:
    """The tables a query may ask for. Nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self.book = OrderBook(spark, folder)
        self._stored: dict[str, DataFrame] = {}

    # clean book
    def items(self):
        return self.book.items()

    def invoices(self):
        return self.book.invoices()

    def vendors(self):
        return self.book.vendors()

    def companies(self):
        return self.book.companies()

    def batches(self):
        return self.book.upload_batches()

    # faulted book
    def faulted(self):
        return self.book.invoices(faulted=True)

    def faulted_items(self):
        return self.book.items(faulted=True)

    def assessed(self):
        return rules.assess(self.faulted(), self.faulted_items(), self.vendors(), AS_OF)

    def findings(self):
        return rules.findings(self.faulted(), self.faulted_items(), self.vendors(), AS_OF)

    def reported(self):
        return self.book.reported_invoices()

    def invoice_rows(self):
        return reads.invoice_rows(self.reported(), self.vendors())

    # duplicates
    def copies(self):
        return self.book.invoices_with_copies()

    def copy_items(self):
        return self.book.item_copies()

    def scan_rows(self):
        return self._once("scan_rows", lambda: duplicates.scan_rows(self.copies(), self.copy_items()))

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that is stored in practice, written once per query."""
        if name not in self._stored:
            self._stored[name] = cut_lineage(build())
        return self._stored[name]

    def pairs(self):
        """Result of the full scan, as the stored findings keep it."""

        return self._once("pairs", lambda: duplicates.duplicate_pairs(self.scan_rows()))

    def pair_findings(self):
        return duplicates.findings(self.pairs(), self.copies(), self.vendors())

    def listing(self):
        stored = self.pair_findings().withColumn("finding_id", F.col("invoice_id"))
        return duplicates.pair_listing(stored, self.copies(), self.vendors())

    def prior(self):
        """Earlier scans: some pairs under the same level, some under another one."""
        residue = F.col("a_id") % 97
        old = self.pairs().select(
            F.col("a_id").alias("invoice_id"),
            F.col("b_id").alias("match_id"),
            F.when(residue == 3, "DUPLICATE_DATE").otherwise(F.col("validation_type")).alias("validation_type"),
        ).filter(residue.isin(1, 3))
        return duplicates.prior_pairs(old)

    # uploads
    def lines(self):
        """Uploaded lines, as the upload files keep them."""
        return self._once("lines", self.book.upload_lines)

    def loaded(self):
        return load.load_lines(self.lines())

    # flat rows of the blend
    def flat(self):
        # A line is known by its content and, among equal lines, by a number.
        # As bytes while rows are shuffled, which take half the room of the digits.
        content = F.unhex(F.md5(F.concat_ws("|", *[
            F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
            ("invoice_id", "product_name", "quantity", "unit_price", "tax_percent")
        ])))
        item = self.faulted_items().withColumn("content", content)
        nth = F.row_number().over(Window.partitionBy("content").orderBy("invoice_id"))
        item = item.withColumn("nth", nth)
        head = self.faulted().select("invoice_id", "vendor_id", "invoice_date")
        key = F.col("invoice_id")
        return (
            item.join(head, "invoice_id")
            .join(self.vendors().select("vendor_id", "vendor_name"), "vendor_id", "left")
            .select(
                F.concat(F.lower(F.hex("content")), F.lit("-"), F.col("nth").cast("string")).alias("row_id"),
                F.concat(F.lit("INV-"), key.cast("string"), F.lit("-"), F.col("quantity").cast("string"))
                .alias("invoice_id"),
                key.alias("order_key"),
                "vendor_name",
                "invoice_date",
                F.when(key % 89 != 0, F.col("quantity")).alias("quantity"),
                "unit_price",
                F.col("tax_percent").alias("gst_percent"),
                F.when(key % 53 == 0, F.col("line_total") + 10).otherwise(F.col("line_total"))
                .cast("decimal(14,2)").alias("total_amount"),
            )
        )

    def coded(self):
        return blend.with_codes(self.flat(), AS_OF)

    def scored(self):
        return blend.score_rows(self.coded())


def _table(method: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _edge(method(Tables(spark, folder)))

    return run


def _csv_round_trip(t: Tables) -> DataFrame:
    """Lines written as CSV text under free-form headers, parsed and normalised again."""
    source = t.lines().select(
        "invoice_number", "vendor_name", "invoice_date", "product_name", "quantity", "unit_price", "gst_percent"
    )
    headers = ["Invoice Number", "VENDOR_NAME", " invoice date", "Product-Name", "quantity", "Unit Price",
               "GST Rate"]
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    as_text = source.select(F.to_csv(F.struct("*"), keep).alias("line"))
    fields = ", ".join(f"c{i} string" for i in range(len(headers)))
    # Stored, or the check for empty rows would parse a line once more for each of its cells.
    parsed = cut_lineage(as_text.select(F.from_csv("line", fields, keep).alias("r")).select("r.*")).toDF(*headers)
    return lines.canonical_rows(parsed).groupBy(*lines.REQUIRED_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


def _csv_files(t: Tables) -> DataFrame:
    """Lines written as CSV files under other headers, some cells with line breaks at their end, and loaded back from the files."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/uploads-{uuid.uuid4().hex}"
    headers = {"invoice_number": "Invoice Number", "vendor_name": "VENDOR_NAME", "invoice_date": " invoice date",
               "product_name": "Product-Name", "quantity": "Quantity", "unit_price": "Unit Price",
               "gst_percent": "GST Rate"}
    # The load takes white space off, so the breaks must not show in the result.
    broken = F.concat("product_name", F.lit("\n\n"))
    shown = t.lines().withColumn(
        "product_name", F.when(F.col("quantity").like("%3%"), broken).otherwise(F.col("product_name"))
    )
    named = shown.select(*[F.col(c).alias(h) for c, h in headers.items()])
    named.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
    discard(t._stored.pop("lines"))
    rows = lines.read_uploads(t.spark, folder).filter("error is null")
    remove(t.spark, folder)
    return rows.groupBy(*lines.REQUIRED_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


def _typed_csv(t: Tables) -> DataFrame:
    """Flat rows for training, written as CSV and read back with their types."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/flat-{uuid.uuid4().hex}"
    rows = t.flat().select("row_id", "vendor_name", "invoice_date", "quantity", "unit_price", "gst_percent", "total_amount")
    rows.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return lines.read_typed_csv(t.spark, folder, rows.schema)


def _parsed_cells(t: Tables) -> DataFrame:
    return t.lines().select(
        text.clean(F.col("invoice_number")).alias("invoice_number"),
        text.parse_date(F.col("invoice_date")).alias("invoice_date"),
        text.product_or_default(F.col("product_name")).alias("product_name"),
        text.parse_number(F.col("quantity")).alias("quantity"),
        text.parse_number(F.col("unit_price")).alias("unit_price"),
        text.parse_number(F.col("gst_percent")).alias("gst_percent"),
    )


def _file_names(t: Tables) -> DataFrame:
    pages = t.spark.read.parquet(f"{t.folder}/pages.parquet")
    return pages.select("page_id", text.file_base_name(F.col("url")).alias("file_name"))


def _expected_totals(t: Tables) -> DataFrame:
    q, p, g, a = (F.col(c) for c in ("quantity", "unit_price", "gst_percent", "total_amount"))
    return t.flat().select(
        "order_key", "quantity", "unit_price", "gst_percent", "total_amount",
        money.expected_total(q, p, g).alias("expected_total"),
        money.total_mismatches(q, p, g, a).alias("is_mismatch"),
    )


def _vendor_ids(t: Tables) -> DataFrame:
    accepted = t.loaded().invoices
    return load.assign_vendor_ids(accepted, t.vendors().select("vendor_id", "company_id", "vendor_name"))


def _linked(t: Tables) -> DataFrame:
    loaded = t.loaded().invoices
    known = load.assign_vendor_ids(loaded, t.vendors().select("vendor_id", "company_id", "vendor_name"))
    return load.link_vendors(loaded, known).select("batch_id", "invoice_number", "company_id", "vendor_id")


def _companies_with_default(t: Tables) -> DataFrame:
    return load.ensure_company(t.book.other_companies(), t.book.default_company())


def _published(t: Tables) -> DataFrame:
    counts = load.batch_counts(t.lines())
    batches = load.batch_rows(counts, counts.filter(F.col("batch_id") % 5 == 3))
    return load.published(t.loaded().invoices, batches).select(
        "batch_id", "invoice_number", "invoice_date", "total_amount"
    )


def _batch_rows(t: Tables) -> DataFrame:
    counts = load.batch_counts(t.lines())
    return load.batch_rows(counts, counts.filter(F.col("batch_id") % 5 == 3))


def _batch_scan(t: Tables) -> DataFrame:
    rows = duplicates.scan_rows(t.copies(), t.copy_items(), [SCANNED_BATCH])
    return duplicates.duplicate_pairs(rows).select("a_id", "b_id", "validation_type")


def _batch_scan_summary(t: Tables) -> DataFrame:
    return duplicates.scan_summary(duplicates.scan_rows(t.copies(), t.copy_items(), [SCANNED_BATCH]))


def _rescored(t: Tables) -> DataFrame:
    assessed = rules.assess(t.copies(), t.copy_items(), t.vendors(), AS_OF)
    return duplicates.rescore(t.pairs(), t.prior(), assessed)


def _first_scores(t: Tables) -> DataFrame:
    """Scores of a first scan, without a list of its pairs."""
    assessed = rules.assess(t.copies(), t.copy_items(), t.vendors(), AS_OF)
    none = t.scan_rows().limit(0).select(F.lit("").alias("validation_type"), F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    return duplicates.scan_scores(t.scan_rows(), none, assessed)


def _current_state(t: Tables) -> DataFrame:
    scores = _rescored(t).filter(F.col("risk_score") > 20)
    return sinks.with_current_state(t.copies(), scores).select("invoice_id", "status", "risk_score")


def _trail(t: Tables) -> DataFrame:
    """The trail as readers see it: one run committed twice under its id, as after a retry, and one after it."""
    root = f"{ensure_checkpoint_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    found = t._once("findings", t.findings)
    headers = found.filter(F.col("rule_no") <= 4)
    for run_id, rows in (("run-1", headers), ("run-1", found), ("run-2", headers)):
        runs.publish({"findings": sinks.trail_rows(rows, t.faulted(), run_id)}, root, run_id)
    return runs.history(t.spark, root, "findings")


def _upload_events(t: Tables) -> DataFrame:
    counts = load.batch_counts(t.lines())
    cells = [F.coalesce(c, F.lit("")) for c in lines.REQUIRED_COLUMNS]
    sizes = t.lines().groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.concat_ws(",", *cells)) + 1).alias("bytes")
    )
    kind = F.col("batch_id") % 10
    uploads = t.batches().select(
        "batch_id", "file_name", "status", kind.isin(1, 5, 9).alias("single"),
        F.when(kind.isin(3, 8), "parsing").when(kind.isin(1, 5), "policy").when(kind == 6, "database save")
        .when(kind == 7, "finalise").alias("phase"),
        F.when(kind.isin(3, 8), "missing columns: unit_price").when(kind.isin(6, 7), "connection lost").alias("error"),
    )
    return sinks.upload_events(uploads.join(sizes, "batch_id"), counts)


def _duplicate_events(t: Tables) -> DataFrame:
    """Events of a scan of three batches against all invoices, and of a scan that failed."""
    events = sinks.duplicate_events(t.pairs(), t.copies(), t.batches(), [0, SCANNED_BATCH, 7])
    failed = sinks.failure_events(t.batches().filter(F.col("batch_id") == 8), "duplicates", "connection lost")
    return events.unionByName(failed)


def _imported_messages(t: Tables) -> DataFrame:
    """Partner and similarity read back from stored message texts."""
    return t.pair_findings().select(
        "invoice_id", "validation_type",
        text.match_id_in(F.col("message")).alias("match_id"),
        text.similarity_in(F.col("message")).alias("similarity"),
    )


def _number_similarity(t: Tables) -> DataFrame:
    """Similarity between the number of an invoice and its planted copy's."""
    rows = t.copies().select("invoice_id", "invoice_number")
    copies = rows.filter(F.col("invoice_id") >= 10_000_000).select(
        (F.col("invoice_id") - 10_000_000).alias("invoice_id"), F.col("invoice_number").alias("other_number")
    )
    return similarity.with_number_similarity(
        rows.join(copies, "invoice_id"), "invoice_number", "other_number"
    ).select("invoice_id", "similarity")


def _item_groups(t: Tables) -> DataFrame:
    prints = duplicates.item_classes(t.copy_items())
    return prints.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("members"), F.min("invoice_id").alias("first_id")
    ).filter(F.col("members") > 1).select("members", "first_id")


def _paid_findings(t: Tables) -> DataFrame:
    stamped = t.findings().withColumn("created_at", F.lit("2001-01-02 00:00:00"))
    return reports.paid_with_mismatch(stamped, t.reported(), t.vendors())


def _blend_given_scores(t: Tables) -> DataFrame:
    rows = t.coded().withColumns(
        {
            "rule_score": blend.rule_component(F.col("codes")),
            "ml_risk_score": (F.col("order_key") % 101).cast("double"),
            "ml_flag": F.col("order_key") % 10 == 0,
        }
    )
    return blend.blend(rows).select("row_id", "order_key", "rule_score", "status", "risk_score").drop("row_id")


def _rule_points(t: Tables) -> DataFrame:
    return t.coded().select(
        "order_key", F.array_join("codes", ",").alias("codes"),
        blend.rule_component(F.col("codes")).alias("rule_score"),
    )


def _outliers(t: Tables) -> DataFrame:
    return t.flat().filter(blend.is_price_outlier(F.col("unit_price"))).select("order_key", "unit_price")


def _ml_rows(t: Tables) -> DataFrame:
    return t.flat().select("row_id", "order_key", "vendor_name", "quantity", "unit_price", "total_amount")


def _price_ratio(t: Tables) -> DataFrame:
    rows = anomaly.with_price_ratio(anomaly.coerce_numbers(_ml_rows(t)))
    return rows.select("order_key", "unit_price", F.round("vendor_avg_price_ratio", 6).alias("ratio"))


def _medians(t: Tables) -> DataFrame:
    rows = anomaly.with_price_ratio(anomaly.coerce_numbers(_ml_rows(t)))
    return anomaly.medians(rows).select("feature", F.round("median", 6).alias("median"))


def _filled(t: Tables) -> DataFrame:
    rows = anomaly.build_features(_ml_rows(t))
    return rows.select("row_id", *anomaly.FEATURES[:3], F.round("vendor_avg_price_ratio", 6).alias("vendor_avg_price_ratio"))


def _scaled(t: Tables) -> DataFrame:
    rows = anomaly.build_features(_ml_rows(t))
    scaled = anomaly.scale(rows, anomaly.scaler(rows))
    # Adding zero turns a negative zero into a plain one.
    return scaled.select("row_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in anomaly.FEATURES])


def _anomaly_scores(t: Tables) -> DataFrame:
    return anomaly.scores(_ml_rows(t))


def _blended_with_ml(t: Tables) -> DataFrame:
    flat = cut_lineage(t.flat())
    # What the blend needs of a row, so that neither the flat rows nor what was shuffled for their codes must stay.
    coded = cut_lineage(blend.with_codes(flat, AS_OF).select("row_id", "invoice_id", "codes"))
    scored = blend.score_rows(coded, anomaly.scores(flat, used=(flat,)))
    return scored.select("row_id", "invoice_id", "rule_score", "ml_risk_score", "ml_flag", "status", "risk_score")


_REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {
    # sources, read shapes, sinks
    "a01_csv_lines": _csv_round_trip,
    "a01_csv_files": _csv_files,
    "a07_typed_csv": _typed_csv,
    "a08_batch_invoices": lambda t: reads.batch_invoices(
        t.invoices(), t.items(), t.vendors(), SCANNED_BATCH
    ).select("invoice_id", "vendor_name", "total_amount", "product_name", "quantity", "unit_price"),
    "a09_company_invoices": lambda t: reads.company_invoices(t.copies(), SCANNED_BATCH).select(
        "invoice_id", "company_id"),
    "a10_upload_history": lambda t: reads.upload_history(t.batches()),
    "a11_batch_detail": lambda t: reads.batch_detail(t.batches(), t.reported(), t.vendors(), SCANNED_BATCH),
    "a12_invoice_list": lambda t: reads.invoice_list(t.reported(), t.vendors()),
    "a13_invoice_detail": lambda t: reads.invoice_detail(t.reported(), t.items(), t.vendors()),
    "a14_export_rows": lambda t: blend.export_rows(t.scored()),
    "a15_findings_trail": _trail,
    "a16_current_state": _current_state,
    "a17_upload_events": _upload_events,
    "a17_validation_events": lambda t: sinks.validation_events(
        t.assessed(), rules.batch_summary(t.assessed()), t.batches()),
    "a17_duplicate_events": _duplicate_events,
    # cells
    "b02_parsed_cells": _parsed_cells,
    "b07_file_names": _file_names,
    "b08_expected_totals": _expected_totals,
    "b14_message_tokens": _imported_messages,
    # load
    "l01_ungrouped_lines": lambda t: load.split_grouped(t.lines())[1].groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("ungrouped")),
    "l02_headers": lambda t: load.headers(load.split_grouped(t.lines())[0]),
    "l03_rejected_invoices": lambda t: t.loaded().rejected,
    "l04_items": lambda t: t.loaded().items,
    "l05_invoices": lambda t: t.loaded().invoices,
    "l06_vendor_ids": _vendor_ids,
    "l06_linked_invoices": _linked,
    "l07_companies": _companies_with_default,
    "l08_single_invoice_policy": lambda t: load.single_invoice_policy(t.lines()),
    "l09_batch_counts": lambda t: load.batch_counts(t.lines()),
    "l10_batch_rows": _batch_rows,
    "l10_published_invoices": _published,
    # rules
    "r01_r10_findings": lambda t: t.findings(),
    "r11_r13_assessment": lambda t: t.assessed().select(
        "invoice_id", "issue_count", "has_critical", "assessed_score", "assessed_status"),
    "r14_batch_summary": lambda t: rules.batch_summary(t.assessed()),
    # blend
    "k1_rule_component": _rule_points,
    "k2_blend": _blend_given_scores,
    "k3_scored_rows": lambda t: t.scored().select("order_key", "rule_score", "status", "risk_score"),
    "k3_scored_with_ml": _blended_with_ml,
    "k4_price_outliers": _outliers,
    "k5_summary": lambda t: blend.summary(t.scored()),
    "k5_results": lambda t: blend.results(t.scored()).withColumn("codes", F.array_join("codes", ",")),
    "k6_gst_mismatch": lambda t: quality.gst_mismatch(t.faulted(), t.items()),
    # quality
    "q1_gstin_format": lambda t: quality.gstin_format(t.companies(), t.vendors()),
    "q2_email_format": lambda t: quality.email_format(t.vendors()),
    "q3_batch_counters": lambda t: quality.batch_counters(t.book.broken_batches()),
    "q4_invoice_money": lambda t: quality.invoice_money(t.faulted()),
    "q5_risk_range": lambda t: quality.risk_range(t.book.broken_risks()),
    "q6_item_ranges": lambda t: quality.item_ranges(t.faulted_items()),
    "q7_uniques": lambda t: quality.uniques(t.companies(), t.vendors()),
    "q8_foreign_keys": lambda t: quality.foreign_keys(
        t.book.remaining_companies(), t.vendors(), t.book.remaining_batches(),
        t.copies(), t.copy_items(), t.findings()),
    "q9_domains": lambda t: quality.domains(
        t.vendors(), t.batches(), t.reported(), t.book.foreign_severities(t.findings())),
    # duplicates
    "d04_number_similarity": _number_similarity,
    "d05_item_groups": _item_groups,
    "d14_pairs": lambda t: t.pairs().select(
        "a_id", "b_id", "level", "validation_type", "severity", "confidence", "penalty", "similarity"),
    "d15_batch_scan": _batch_scan,
    "d16_findings": lambda t: t.pair_findings(),
    "d18_prior_pairs": lambda t: t.prior(),
    "d19_rescore": _rescored,
    "d19_scan_scores": _first_scores,
    "d20_scan_summary": lambda t: duplicates.scan_summary(t.scan_rows()),
    "d20_batch_scan_summary": _batch_scan_summary,
    "d21_pair_listing": lambda t: duplicates.order_listing(t.listing()).withColumn(
        "matched_ids", F.array_join(F.col("matched_ids").cast("array<string>"), ",")),
    "d22_badge_counts": lambda t: duplicates.badge_counts(duplicates.pair_totals(t.scan_rows())),
    # reports
    "s01_duplicate_numbers": lambda t: reports.duplicate_number_members(t.copies()),
    "s02_vendor_spend": lambda t: reports.vendor_spend(t.invoices(), t.vendors()),
    "s03_monthly_trend": lambda t: reports.monthly_trend(t.invoices()),
    "s04_risky_invoices": lambda t: reports.risky_invoices(t.reported(), t.vendors()),
    "s05_top_products": lambda t: reports.top_products(t.items()),
    "s06_tax_summary": lambda t: reports.tax_summary(t.items()),
    "s07_pending_invoices": lambda t: reports.pending_invoices(t.reported(), t.vendors(), AS_OF),
    "s08_invoices_per_vendor": lambda t: reports.invoices_per_vendor(t.invoices(), t.vendors()),
    "s09_value_range": lambda t: reports.invoice_value_range(t.invoices()),
    "s10_vendor_average": lambda t: reports.vendor_average(t.invoices(), t.vendors()),
    "s11_finding_counts": lambda t: reports.finding_counts(t.findings()),
    "s12_potential_loss": lambda t: reports.potential_loss(t.reported()),
    "s13_paid_with_mismatch": _paid_findings,
    "s14_repeated_ids": lambda t: reports.repeated_ids(t.flat()),
    "s15_high_risk": lambda t: reports.high_risk(t.reported()),
    "s16_monthly_anomalies": lambda t: reports.monthly_anomalies(t.reported()),
    "s17_vendor_names": lambda t: reports.vendor_names(t.invoices(), t.book.branch_vendors()),
    # dashboard
    "v01_monthly_series": lambda t: dashboard.monthly_series(t.invoice_rows(), 10),
    "v02_amount_series": lambda t: dashboard.amount_series(t.invoice_rows()),
    "v03_status_distribution": lambda t: dashboard.status_distribution(t.invoice_rows()),
    "v04_vendor_profile": lambda t: dashboard.ranked_vendors(dashboard.vendor_profile(t.invoice_rows())),
    "v05_risk_buckets": lambda t: dashboard.risk_buckets(t.invoice_rows()),
    "v06_duplicate_levels": lambda t: dashboard.measured_levels(duplicates.pair_measures(t.scan_rows())),
    "v07_executive_kpis": lambda t: dashboard.executive_kpis(
        t.invoice_rows(), t.batches(), duplicates.pair_totals(t.scan_rows())),
    "v08_executive_shares": lambda t: dashboard.executive_shares(t.invoice_rows()),
    "v09_vendor_kpis": lambda t: dashboard.vendor_kpis(dashboard.vendor_profile(t.invoice_rows())),
    "v10_spend_share": lambda t: dashboard.spend_share(dashboard.vendor_profile(t.invoice_rows())),
    "v10_vendor_heat": lambda t: dashboard.vendor_heat(dashboard.vendor_profile(t.invoice_rows())),
    "v10_vendor_ranking": lambda t: dashboard.vendor_ranking(dashboard.vendor_profile(t.invoice_rows())),
    "v11_validation_kpis": lambda t: dashboard.validation_kpis(t.invoice_rows()),
    "v12_duplicate_kpis": lambda t: dashboard.duplicate_kpis(
        dashboard.measured_levels(duplicates.pair_measures(t.scan_rows()))),
    "v13_audit_kpis": lambda t: dashboard.audit_kpis(t.batches()),
    "v14_landing_kpis": lambda t: dashboard.landing_kpis(t.invoice_rows()),
    "v15_flagged_invoices": lambda t: dashboard.flagged_invoices(t.invoice_rows()),
    "v16_status_share": lambda t: dashboard.status_share(t.invoice_rows()).withColumn(
        "share", F.round("share", 6)),
    # anomaly
    "m2_price_ratio": _price_ratio,
    "m3_medians": _medians,
    "m3_filled_rows": _filled,
    "m4_scaled_rows": _scaled,
    "m5_m7_anomaly_scores": _anomaly_scores,
}


def entry(spark: SparkSession, folder: str = SMOKE_DIR) -> DataFrame:
    """Flagship: invoices by company and status after validation, with their value and risk."""
    t = Tables(spark, folder)
    assessed = t.assessed()
    return _edge(
        assessed.groupBy("company_id", "assessed_status").agg(
            F.count(F.lit(1)).alias("invoices"),
            F.sum("total_amount").alias("total_amount"),
            F.sum("issue_count").alias("issues"),
            F.max("assessed_score").alias("highest_score"),
        )
    )


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the corpus operators, where they and the packages they need can be imported."""
    try:
        from billsift.llm import queries as corpus
    except ImportError:
        return {}, {}
    found, statements = dict(corpus.QUERIES), dict(corpus.STATEMENTS)
    try:
        import corpus_pipeline
    except ImportError:
        return _prepared(found), statements
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return _prepared(found), statements


def _prepared(found: dict[str, Query]) -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        return lambda spark, folder: query(configure(spark), folder)

    return {name: prepared(query) for name, query in found.items()}


def queries() -> dict[str, Query]:
    return {name: _table(method) for name, method in _REGISTRY.items()} | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    from oracle.sql import statements

    return statements() | _corpus()[1]
