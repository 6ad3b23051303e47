"""The per-file upload as a stream: files dropped into a folder are loaded once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from billsift.operators import load, runs
from billsift.session import cut_lineage
from billsift.sources import lines

VENDORS = "vendor_id bigint, company_id bigint, vendor_name string"


def start(spark: SparkSession, folder: str, output: str, checkpoint: str, vendors: DataFrame | None = None,
          files_per_trigger: int = 1000, multi_line: bool = True,
          most_columns: int = lines.MOST_COLUMNS) -> StreamingQuery:
    """Load line files, each with its own header. A micro-batch is one load.

    The file source records processed files in its checkpoint. Each micro-batch is one run of ``runs`` named
    ``load-<number>``: its tables become visible together, and a retried one replaces what it wrote before. Read them with
    ``runs.history(spark, output, "invoices")``. ``vendors`` are those known before the first load; vendors that
    a load adds are kept beside its invoices. ``most_columns`` cells of a row are read: later files are not known when the
    stream starts, so a wider drop needs a larger number. Files without a usable header are listed under ``refused``.
    """
    raw = (
        spark.readStream.options(**lines.reader_options(multi_line)).schema(lines.cell_schema(most_columns))
        .option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )

    def known_vendors(run_id: str) -> DataFrame:
        earlier = runs.history(spark, output, "vendors", VENDORS, besides=run_id)
        if vendors is None:
            return earlier
        return vendors.select("vendor_id", "company_id", "vendor_name").unionByName(earlier)

    def load_batch(rows: DataFrame, number: int) -> None:
        # Several tables use the rows, and their order ids must not change in between.
        uploads = lines.transport_rows(cut_lineage(lines.placed_cells(rows)))
        loaded = load.load_lines(cut_lineage(lines.upload_lines(uploads)))
        known = known_vendors(f"load-{number}")
        every = cut_lineage(load.assign_vendor_ids(loaded.invoices, known))
        fresh = every.join(known.select("vendor_id"), "vendor_id", "left_anti")
        runs.publish(
            {
                "vendors": fresh.select("vendor_id", "company_id", "vendor_name"),
                "invoices": load.link_vendors(loaded.invoices, every),
                "items": loaded.items,
                "rejected": loaded.rejected,
                "rejected_lines": loaded.rejected_lines,
                "refused": uploads.filter("error is not null").select("file_path", "error"),
                "batches": load.batch_rows(loaded.counts),
            },
            output,
            f"load-{number}",
        )

    return (
        raw.select("*", "_metadata").writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
