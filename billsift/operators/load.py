"""From transport rows to vendors, invoices, items and batch counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billsift.functions import money, text
from billsift.session import cut_lineage

DEFAULT_COMPANY_ID = 1
GROUP = ["batch_id", "invoice_number"]


def with_line_money(items: DataFrame) -> DataFrame:
    """Add subtotal, tax and total of each line."""
    subtotal = money.line_subtotal(F.col("quantity"), F.col("unit_price"))
    rows = items.withColumn("line_subtotal", subtotal.cast("decimal(14,2)"))
    rows = rows.withColumn(
        "line_tax", money.line_tax(F.col("line_subtotal"), F.col("tax_percent")).cast("decimal(14,2)")
    )
    return rows.withColumn(
        "line_total", (F.col("line_subtotal") + F.col("line_tax")).cast("decimal(14,2)")
    )


def invoice_totals(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Header money per invoice. Sums combine before the shuffle, whatever the group size."""
    return items.groupBy(*(keys or ["invoice_id"])).agg(
        F.sum("line_subtotal").alias("subtotal"),
        F.sum("line_tax").alias("tax_amount"),
        F.sum("line_total").alias("total_amount"),
    )


def split_grouped(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that name an invoice, and the rest."""
    cleaned = lines.withColumn("invoice_number", text.clean(F.col("invoice_number")))
    has_number = F.col("invoice_number") != ""
    return cleaned.filter(has_number), cleaned.filter(~has_number)


def _first_line() -> Column:
    """Date and vendor of the first line in file order."""
    return F.min_by(F.struct("invoice_date", "vendor_name"), F.col("row_order")).alias("first")


def _named_headers(grouped: DataFrame, *also: str) -> DataFrame:
    return grouped.select(
        *GROUP,
        text.parse_date(F.col("first.invoice_date")).alias("invoice_date"),
        text.clean(F.col("first.vendor_name")).alias("vendor_name"),
        *also,
    )


def headers(lines: DataFrame) -> DataFrame:
    """Date and vendor of every invoice, taken from its first line."""
    return _named_headers(lines.groupBy(*GROUP).agg(_first_line()))


def _usable_header() -> Column:
    return (F.col("vendor_name") != "") & F.col("invoice_date").isNotNull()


def split_headers(all_headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected invoices."""
    return all_headers.filter(_usable_header()), all_headers.filter(~_usable_header())


def _worked_out(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but each value is worked out once per row.

    A filter on an ordinary column is moved below it and works its whole expression out for every mention;
    it stays above rows made of an array.
    """
    others = [F.col(c) for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _with_parsed_cells(lines: DataFrame) -> DataFrame:
    """Typed cells and line money; all money is null on a line with an unusable cell.

    Money is computed from the values as written.
    """
    raw_rate = text.clean(F.col("gst_percent"))
    rate = F.when(raw_rate == "", F.lit(0).cast(text.NUMBER_TYPE)).otherwise(
        text.parse_number(F.col("gst_percent"))
    )
    parsed = _worked_out(
        lines,
        {
            "product_name": text.product_or_default(F.col("product_name")),
            "quantity": text.parse_number(F.col("quantity")),
            "unit_price": text.parse_number(F.col("unit_price")),
            "tax_percent": rate,
        },
    )
    subtotal = F.when(F.col("tax_percent").isNotNull(), money.wide_product(F.col("quantity"), F.col("unit_price")))
    priced = _worked_out(parsed, {"line_subtotal": subtotal})
    priced = _worked_out(priced, {"line_tax": money.wide_tax(F.col("line_subtotal"), F.col("tax_percent"))})
    total = F.try_add("line_subtotal", "line_tax").try_cast(money.WIDE)
    # All or nothing: a line whose tax or total is out of range has no money at all.
    return priced.withColumn("line_total", total).withColumns(
        {c: F.when(total.isNotNull(), F.col(c)) for c in ("line_subtotal", "line_tax")}
    )


def parse_items(lines: DataFrame) -> DataFrame:
    """Numeric lines with their money; a line with an unusable cell is skipped.

    Stored quantity, price and rate have two decimals.
    """
    usable = _with_parsed_cells(lines).filter(F.col("line_subtotal").isNotNull())
    return usable.select(
        *GROUP,
        "product_name",
        *[money.wide_rounded(F.col(c)).alias(c) for c in ("quantity", "unit_price", "tax_percent")],
        "line_subtotal",
        "line_tax",
        "line_total",
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines of grouped invoices that are skipped, as they were uploaded, with the cell at fault."""
    cells = ("product_name", "quantity", "unit_price", "gst_percent")
    raw = lines.withColumn("raw", F.struct(*cells))
    skipped = _with_parsed_cells(raw).filter(F.col("line_subtotal").isNull())
    reason = (
        F.when(F.col("quantity").isNull(), "quantity")
        .when(F.col("unit_price").isNull(), "unit_price")
        .when(F.col("tax_percent").isNull(), "gst_percent")
        .otherwise("out of range")
    )
    return skipped.select(*GROUP, "row_order", reason.alias("reason"), "raw.*")


def headers_with_totals(lines: DataFrame) -> DataFrame:
    """Header and money of every invoice from one aggregation over its lines.

    An invoice whose lines were all skipped keeps zero totals.
    """
    zero = F.lit(0).cast("decimal(38,2)")
    cells = _with_parsed_cells(
        lines.select(
            *GROUP, "row_order", "invoice_date", "vendor_name",
            "product_name", "quantity", "unit_price", "gst_percent",
        )
    )
    sums = [
        F.coalesce(F.sum(line), zero).alias(name)
        for line, name in (
            ("line_subtotal", "subtotal"), ("line_tax", "tax_amount"), ("line_total", "total_amount")
        )
    ]
    return _named_headers(cells.groupBy(*GROUP).agg(_first_line(), *sums), "subtotal", "tax_amount",
                          "total_amount")


def invoices(lines: DataFrame) -> DataFrame:
    """Stored headers of the accepted invoices."""
    accepted, _ = split_headers(headers_with_totals(lines))
    return accepted.select(
        *GROUP, "vendor_name", "invoice_date", "subtotal", "tax_amount", "total_amount",
        F.lit("Pending").alias("status"),
        F.lit(0).cast("decimal(5,2)").alias("risk_score"),
    )


def batch_counts(lines: DataFrame) -> DataFrame:
    """total, processed and failed per batch, from one pass over the lines.

    Lines without a number each count as one failed record.
    """
    grouped, ungrouped = split_grouped(lines)
    per_batch = headers(grouped).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(_usable_header()).alias("processed")
    )
    loose = ungrouped.groupBy("batch_id").agg(F.count(F.lit(1)).alias("ungrouped"))
    rows = per_batch.join(loose, "batch_id", "full_outer").na.fill(0, ["groups", "processed", "ungrouped"])
    return rows.select(
        "batch_id",
        "groups",
        "ungrouped",
        (F.col("groups") + F.col("ungrouped")).alias("total"),
        "processed",
        (F.col("groups") - F.col("processed") + F.col("ungrouped")).alias("failed"),
    )


def single_invoice_policy(lines: DataFrame) -> DataFrame:
    """Batches allowed under the one-invoice rule: at most one distinct number."""
    grouped, _ = split_grouped(lines)
    return (
        grouped.select(*GROUP).distinct()
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("invoice_groups"))
        .withColumn("status", F.when(F.col("invoice_groups") > 1, "Failed").otherwise("Completed"))
    )


def batch_rows(counts: DataFrame, failed_batches: DataFrame | None = None) -> DataFrame:
    """Batch table rows: Completed, or Failed with zero counters."""
    rows = counts.select(
        "batch_id",
        F.col("total").alias("total_invoices"),
        F.col("processed").alias("processed_invoices"),
        F.col("failed").alias("failed_invoices"),
        F.lit("Completed").alias("status"),
    )
    if failed_batches is None:
        return rows
    flags = failed_batches.select("batch_id", F.lit(True).alias("is_failed")).distinct()
    is_failed = F.coalesce(F.col("is_failed"), F.lit(False))
    counters = ("total_invoices", "processed_invoices", "failed_invoices")
    return rows.join(flags, "batch_id", "left").select(
        "batch_id",
        *[F.when(is_failed, F.lit(0)).otherwise(F.col(c)).alias(c) for c in counters],
        F.when(is_failed, "Failed").otherwise(F.col("status")).alias("status"),
    )


def published(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows of batches that completed: a failed batch leaves no invoices behind."""
    done = batches.filter(F.col("status") == "Completed").select("batch_id")
    return rows.join(done, "batch_id", "left_semi")


def number_rows(rows: DataFrame, column: str, order: list[str], start: int | Column = 0) -> DataFrame:
    """Consecutive ids in ``order`` without sending all rows through one task.

    Rows are range-partitioned once; each partition numbers its own rows and adds
    the size of the partitions before it. The checkpoint pins the partitioning the
    two uses share, and keeps it if executors are lost in between.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn(
        "_part", F.spark_partition_id()
    )
    parts = cut_lineage(parts)
    # One row per partition, so the single-partition window below stays small.
    offsets = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_part", "_before")
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        parts.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(column, (base + F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_part", "_local", "_before")
    )


def new_vendors(accepted: DataFrame, vendors: DataFrame, company_id: int = DEFAULT_COMPANY_ID) -> DataFrame:
    """Vendor names of accepted invoices that the company does not have yet."""
    known = vendors.filter(F.col("company_id") == company_id).select("vendor_name")
    return (
        accepted.select("vendor_name").distinct()
        .join(known, "vendor_name", "left_anti")
        .withColumn("company_id", F.lit(company_id).cast("bigint"))
    )


def assign_vendor_ids(
    accepted: DataFrame, vendors: DataFrame, company_id: int = DEFAULT_COMPANY_ID
) -> DataFrame:
    """The vendor table with missing vendors appended under fresh ids."""
    fresh = new_vendors(accepted, vendors, company_id)
    highest = vendors.agg(F.coalesce(F.max("vendor_id"), F.lit(0)).alias("m")).scalar()
    numbered = number_rows(fresh, "row_no", ["vendor_name"])
    appended = numbered.select(
        (F.col("row_no") + highest).alias("vendor_id"), "company_id", "vendor_name"
    )
    return vendors.select("vendor_id", "company_id", "vendor_name").unionByName(appended)


def link_vendors(rows: DataFrame, vendors: DataFrame, company_id: int = DEFAULT_COMPANY_ID) -> DataFrame:
    """Vendor id for each invoice by exact name; the lowest id wins among equal names."""
    keyed = (
        vendors.filter(F.col("company_id") == company_id)
        .groupBy("vendor_name")
        .agg(F.min("vendor_id").alias("vendor_id"))
    )
    return rows.join(keyed, "vendor_name", "left").withColumn(
        "company_id", F.lit(company_id).cast("bigint")
    )


def ensure_company(companies: DataFrame, default_row: DataFrame) -> DataFrame:
    """Companies with the default tenant added when it is missing."""
    missing = default_row.join(companies.select("company_id"), "company_id", "left_anti")
    return companies.unionByName(missing.select(*companies.columns))


@dataclass(frozen=True)
class LoadedBatch:
    """Tables produced by one load."""

    invoices: DataFrame
    items: DataFrame
    rejected: DataFrame
    rejected_lines: DataFrame
    ungrouped: DataFrame
    counts: DataFrame


def load_lines(lines: DataFrame) -> LoadedBatch:
    """The whole load: transport rows with ``batch_id`` and ``row_order`` in, tables out."""
    grouped, ungrouped = split_grouped(lines)
    accepted, rejected = split_headers(headers(grouped))
    parsed = parse_items(grouped)
    kept = parsed.join(accepted.select(*GROUP), GROUP, "left_semi")
    return LoadedBatch(
        invoices(grouped), kept, rejected, rejected_lines(grouped), ungrouped, batch_counts(lines)
    )
