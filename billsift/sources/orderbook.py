"""Builds the invoice model from an order-management star schema.

orders -> invoices, lineitem -> items, customer -> vendors, nation -> companies.
Two variants exist: the plain book with known duplicate submissions planted in it,
and the faulted book in which every validation rule has something to find.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.functions import money
from billsift.operators import load

AS_OF = "2001-01-01"
COPY_ID_OFFSET = 10_000_000
COPY_VENDOR_OFFSET = 1_000_000
# Two large groups: one number of one company, and one vendor's bill.
BULK_NUMBER_IDS, BULK_BILL_IDS = (0, 100), (101, 231)
BULK_CENT_FROM, BULK_DAYS_FROM = 160, 201
BULK_NUMBER, BULK_COMPANY, BULK_VENDOR, BULK_DATE = "BULK-RESUBMISSION", 3, 1, "1998-01-05"
COPY_MODULUS = 97
BATCHES = 10

# Fault -> order key modulus that triggers it.
FAULT_MODULUS = {
    "total": 53,
    "quantity": 59,
    "unit_price": 61,
    "tax_percent": 67,
    "product_name": 71,
    "invoice_number": 73,
    "vendor_id": 79,
    "invoice_date": 83,
}


def _hits(key: Column, fault: str) -> Column:
    return key % F.lit(FAULT_MODULUS[fault]) == 0


class OrderBook:
    """Lazy tables of the invoice model over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def companies(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        digits = F.lpad(key.cast("string"), 4, "0")
        return self._read("nation").select(
            key.alias("company_id"),
            F.col("n_name").alias("company_name"),
            F.concat(F.lit("27AACCA"), digits, F.when(key % 9 == 4, "R1Y").otherwise("R1Z"), F.lit("M"))
            .alias("gst_number"),
            F.concat(F.lit("accounts"), (key % 20).cast("string"), F.lit("@ledger.example")).alias("email"),
        )

    def vendors(self) -> DataFrame:
        key = F.col("c_custkey")
        plain = F.concat(
            F.lpad((key % 37).cast("string"), 2, "0"),
            F.lit("VENDR"),
            F.lpad((key % 5000).cast("string"), 4, "0"),
            F.lit("F1Z5"),
        )
        return self._read("customer").select(
            key.alias("vendor_id"),
            F.col("c_nationkey").cast("bigint").alias("company_id"),
            F.col("c_name").alias("vendor_name"),
            F.when(key % 19 == 3, F.lit(None)).when(key % 23 == 5, F.substring(plain, 1, 14)).otherwise(plain)
            .alias("gst_number"),
            F.when(key % 29 == 7, F.concat(F.lit("vendor"), key.cast("string")))
            .when(key % 31 == 2, F.lit(None))
            .otherwise(F.concat(F.lit("vendor"), key.cast("string"), F.lit("@mail.example")))
            .alias("email"),
            F.concat(F.lit("+91-"), F.lpad(key.cast("string"), 10, "0")).alias("phone"),
            F.when(key % 41 == 6, "Suspended")
            .when(key % 7 == 1, "Inactive")
            .when(key % 13 == 1, "Blacklisted")
            .otherwise("Active")
            .alias("status"),
        )

    def items(self, faulted: bool = False, copies: bool = False, named: bool = True) -> DataFrame:
        """One row per invoice line with its money columns; without names the product join is saved."""
        key = F.col("l_orderkey")
        milli = F.round(F.col("l_quantity") * 1000).cast("bigint")
        amount = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        rate = F.round(F.col("l_tax") * 10000).cast("bigint")
        lines = self._read("lineitem").select(
            key, "l_partkey", milli.alias("m"), amount.alias("a"), rate.alias("r")
        )
        if named:
            products = self._read("part").select("p_partkey", "p_name")
            lines = lines.join(products, F.col("l_partkey") == F.col("p_partkey"), "left")
        else:
            lines = lines.withColumn("p_name", F.lit(None).cast("string"))
        unit_cents = F.expr("(2 * a * 1000 + m) div (2 * nullif(m, 0))")
        hundredth = F.lit(Decimal("0.01"))
        quantity = (F.col("m").cast("decimal(18,0)") * F.lit(Decimal("0.001"))).cast("decimal(12,3)")
        price = (unit_cents.cast("decimal(18,0)") * hundredth).cast("decimal(14,2)")
        percent = (F.col("r").cast("decimal(18,0)") * hundredth).cast("decimal(5,2)")
        name = F.col("p_name")
        if faulted:
            quantity = F.when(_hits(key, "quantity"), F.lit(Decimal("0.000"))).otherwise(quantity)
            price = F.when(_hits(key, "unit_price"), -price).otherwise(price)
            percent = F.when(_hits(key, "tax_percent"), percent + F.lit(Decimal("118.00"))).otherwise(percent)
            name = F.when(_hits(key, "product_name"), F.lit("  ")).otherwise(name)
        rows = lines.select(
            key.alias("invoice_id"),
            name.alias("product_name"),
            quantity.cast("decimal(12,3)").alias("quantity"),
            price.cast("decimal(14,2)").alias("unit_price"),
            percent.cast("decimal(5,2)").alias("tax_percent"),
        )
        if copies:
            repeats = F.when(F.col("invoice_id") % COPY_MODULUS == 5, F.array(F.lit(0), F.lit(COPY_ID_OFFSET)))
            rows = rows.withColumn("shift", F.explode(F.coalesce(repeats, F.array(F.lit(0))))).select(
                (F.col("invoice_id") + F.col("shift")).alias("invoice_id"),
                "product_name", "quantity", "unit_price", "tax_percent",
            )
        return load.with_line_money(rows)

    def _headers(self, faulted: bool) -> DataFrame:
        sums = load.invoice_totals(self.items(faulted, named=False))
        zero = F.lit(Decimal("0.00"))
        key = F.col("o_orderkey")
        number = F.concat(F.lit("PO-"), F.lpad(key.cast("string"), 8, "0"))
        vendor = F.col("o_custkey")
        date = F.col("o_orderdate").cast("date")
        total = F.coalesce(F.col("total_amount"), zero)
        if faulted:
            number = F.when(~_hits(key, "invoice_number"), number)
            vendor = F.when(~_hits(key, "vendor_id"), vendor)
            date = F.when(~_hits(key, "invoice_date"), date)
            total = F.when(_hits(key, "total"), total + F.lit(Decimal("10.00"))).otherwise(total)
        owners = self._read("customer").select("c_custkey", "c_nationkey")
        return (
            self._read("orders")
            .join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(sums, F.col("o_orderkey") == F.col("invoice_id"), "left")
            .select(
                key.alias("invoice_id"),
                F.col("c_nationkey").cast("bigint").alias("company_id"),
                vendor.alias("vendor_id"),
                number.alias("invoice_number"),
                (key % BATCHES).alias("batch_id"),
                date.alias("invoice_date"),
                F.coalesce(F.col("subtotal"), zero).cast("decimal(14,2)").alias("subtotal"),
                F.coalesce(F.col("tax_amount"), zero).cast("decimal(14,2)").alias("tax_amount"),
                total.cast("decimal(14,2)").alias("total_amount"),
                F.lit("Pending").alias("status"),
                F.lit(Decimal("0.00")).cast("decimal(5,2)").alias("risk_score"),
                F.col("o_orderstatus").alias("order_status"),
            )
        )

    def invoices(self, faulted: bool = False) -> DataFrame:
        """Invoice headers without planted duplicates."""
        return self._headers(faulted)

    def invoices_with_copies(self) -> DataFrame:
        """Clean headers plus one planted duplicate for each of five residues, and two large groups.

        The copies are made by exploding the row in place, so the book is computed once. The first invoices
        come again under one number of one company; the next ones come again as one vendor's bill, some a
        cent or two days apart.
        """
        residue, key = F.col("invoice_id") % COPY_MODULUS, F.col("invoice_id")
        copies = F.array_compact(F.array(
            F.lit(0),
            F.when(residue.between(1, 5), 1),
            F.when(key.between(*BULK_NUMBER_IDS), 2),
            F.when(key.between(*BULK_BILL_IDS), 3),
        ))
        rows = self._headers(False).withColumn("copy", F.explode(copies))
        is_copy = F.col("copy") == 1
        new_id = F.col("invoice_id") + COPY_ID_OFFSET
        foreign = F.concat(F.lit("ZX"), F.substring(F.md5(new_id.cast("string")), 1, 14))

        def on_copy(by_residue: dict[int, Column], original: Column) -> Column:
            out = original
            for value, replacement in by_residue.items():
                out = F.when(is_copy & (residue == value), replacement).otherwise(out)
            return out

        number, total, date = F.col("invoice_number"), F.col("total_amount"), F.col("invoice_date")
        more = F.lit(Decimal("500.00"))
        numbered, billed = F.col("copy") == 2, F.col("copy") == 3
        bulk = F.col("copy") >= 2

        def in_bulk(by_number: Column | None, by_bill: Column, original: Column) -> Column:
            out = F.when(billed, by_bill)
            return (out if by_number is None else out.when(numbered, by_number)).otherwise(original)

        cent = F.when(key > BULK_CENT_FROM, Decimal("777.78")).otherwise(Decimal("777.77"))
        day = F.date_add(F.lit(BULK_DATE).cast("date"), F.when(key > BULK_DAYS_FROM, 2).otherwise(0))
        shifted = key + COPY_ID_OFFSET * F.col("copy")
        return rows.select(
            F.when(bulk, shifted).when(is_copy, new_id).otherwise(key).alias("invoice_id"),
            F.when(bulk, BULK_COMPANY).otherwise(F.col("company_id")).alias("company_id"),
            in_bulk(
                None, F.lit(BULK_VENDOR).cast("bigint"), on_copy({5: F.col("vendor_id") + COPY_VENDOR_OFFSET}, F.col("vendor_id"))
            ).alias("vendor_id"),
            in_bulk(
                F.lit(BULK_NUMBER),
                F.concat(F.lit("ZX"), F.substring(F.md5(shifted.cast("string")), 1, 14)),
                on_copy({2: foreign, 3: F.concat(number, F.lit("A")), 4: foreign, 5: foreign}, number),
            ).alias("invoice_number"),
            F.when(bulk, key % BATCHES)
            .when(is_copy, F.floor(key / COPY_MODULUS) % BATCHES)
            .otherwise(F.col("batch_id")).alias("batch_id"),
            in_bulk(None, day, on_copy({1: F.date_add(date, 30), 3: F.date_add(date, 20), 4: F.date_add(date, 2)}, date))
            .alias("invoice_date"),
            "subtotal",
            "tax_amount",
            in_bulk(None, cent, on_copy({1: total + more, 3: total + F.lit(Decimal("0.75")), 5: total + more}, total))
            .cast("decimal(14,2)").alias("total_amount"),
            "status",
            "risk_score",
        )

    def item_copies(self) -> DataFrame:
        return self.items(copies=True)

    def reported_invoices(self) -> DataFrame:
        """Faulted headers in the state they have after validation and payment."""
        from billsift.operators import rules

        assessed = rules.assess(self.invoices(faulted=True), self.items(faulted=True), self.vendors(), AS_OF)
        key = F.col("invoice_id")
        status = (
            F.when(key % COPY_MODULUS == 1, "Duplicate")
            .when(F.col("order_status") == "F", "Paid")
            .when(F.col("order_status") == "P", "Pending")
            .otherwise(F.col("assessed_status"))
        )
        return assessed.select(
            "invoice_id", "company_id", "vendor_id", "invoice_number", "batch_id", "invoice_date",
            "subtotal", "tax_amount", "total_amount",
            status.alias("status"),
            F.col("assessed_score").cast("decimal(5,2)").alias("risk_score"),
        )

    def upload_batches(self) -> DataFrame:
        """One row per batch with counters taken from the faulted headers."""
        usable = F.col("vendor_id").isNotNull() & F.col("invoice_date").isNotNull()
        batch = F.col("batch_id")
        return (
            self.invoices(faulted=True)
            .groupBy("batch_id")
            .agg(
                F.count(F.lit(1)).alias("total_invoices"),
                F.count_if(usable).alias("processed_invoices"),
                F.count_if(~usable).alias("failed_invoices"),
            )
            .select(
                "batch_id",
                F.concat(F.lit("orders_"), batch.cast("string"), F.lit(".csv")).alias("file_name"),
                F.when(batch % 3 == 0, "ap_team").otherwise("admin").alias("uploaded_by"),
                F.timestamp_add("DAY", batch.cast("int"), F.lit("2001-01-01 09:00:00").cast("timestamp"))
                .alias("uploaded_at"),
                "total_invoices",
                "processed_invoices",
                "failed_invoices",
                F.when(batch % 5 == 3, "Failed").when(batch % 5 == 4, "Processing").otherwise("Completed")
                .alias("status"),
            )
        )

    # Tables with planted violations, for the checks of stored data.

    def broken_batches(self) -> DataFrame:
        return self.upload_batches().withColumn("failed_invoices", F.col("failed_invoices") - 50)

    def broken_risks(self) -> DataFrame:
        return self.reported_invoices().withColumn("risk_score", F.col("risk_score") + F.col("invoice_id") % 90)

    def remaining_companies(self) -> DataFrame:
        """Company 7 was deleted under its vendors and invoices."""
        return self.companies().filter(F.col("company_id") != 7)

    def remaining_batches(self) -> DataFrame:
        """Batch 4 was deleted under its invoices."""
        return self.upload_batches().filter(F.col("batch_id") != 4)

    def foreign_severities(self, findings: DataFrame) -> DataFrame:
        return findings.withColumn("severity", F.when(F.col("rule_no") == 8, "FATAL").otherwise(F.col("severity")))

    def branch_vendors(self) -> DataFrame:
        """Branches of a vendor carry the name of its head office: several vendors share one name."""
        return self.vendors().withColumn("vendor_name", F.substring("vendor_name", 1, 17))

    def other_companies(self) -> DataFrame:
        """A company table from before the default tenant, and the default tenant's row."""
        return self.companies().filter(F.col("company_id") != load.DEFAULT_COMPANY_ID)

    def default_company(self) -> DataFrame:
        return self.companies().filter(F.col("company_id") == load.DEFAULT_COMPANY_ID).select(
            "company_id",
            F.concat(F.lit("Default of "), F.col("company_name")).alias("company_name"),
            "gst_number",
            "email",
        )

    def upload_lines(self) -> DataFrame:
        """Transport rows as an upload would carry them: text only, with dirty cells."""
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        date = F.col("o_orderdate").cast("date")
        amount = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        milli = F.round(F.col("l_quantity") * 1000).cast("bigint")
        joined = (
            self._read("lineitem")
            .select(key, line, "l_partkey", "l_tax", milli.alias("m"), amount.alias("a"))
            .join(self._read("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
                  key == F.col("o_orderkey"))
            .join(self._read("customer").select("c_custkey", "c_name"),
                  F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(self._read("part").select("p_partkey", "p_name"),
                  F.col("l_partkey") == F.col("p_partkey"), "left")
        )
        unit_cents = F.expr("(2 * a * 1000 + m) div (2 * nullif(m, 0))")
        price = F.concat(F.floor(unit_cents / 100).cast("string"), F.lit("."),
                         F.lpad((unit_cents % 100).cast("string"), 2, "0"))
        quantity = F.floor(F.col("m") / 1000).cast("string")
        percent = F.round(F.col("l_tax") * 100).cast("int").cast("string")
        return joined.select(
            (key % BATCHES).alias("batch_id"),
            F.struct(line, F.col("l_partkey"), F.col("m"), F.col("a")).alias("row_order"),
            F.when(key % 73 == 0, "  ")
            .otherwise(F.concat(F.lit(" PO-"), F.lpad(key.cast("string"), 8, "0"), F.lit("\t")))
            .alias("invoice_number"),
            F.when((key % 79 == 0) | ((key % 11 == 0) & (line % 2 == 0)), "").otherwise(F.col("c_name"))
            .alias("vendor_name"),
            F.when(key % 83 == 0, "2024-02-30")
            .when(key % 3 == 1, F.date_format(date, "dd/MM/yyyy"))
            .when(key % 3 == 2, F.date_format(date, "yyyy-M-d"))
            .otherwise(F.date_format(date, "yyyy-MM-dd"))
            .alias("invoice_date"),
            F.when(key % 71 == 0, "  ").otherwise(F.col("p_name")).alias("product_name"),
            F.when(key % 59 == 0, "abc").otherwise(quantity).alias("quantity"),
            F.when(key % 7 == 0, F.concat(F.substring(price, 1, 1), F.lit(","), F.substring(price, 2, 20)))
            .when(key % 61 == 0, "1_000")
            .otherwise(price)
            .alias("unit_price"),
            F.when(key % 67 == 0, "").otherwise(F.concat(percent, F.lit("%"))).alias("gst_percent"),
        )
