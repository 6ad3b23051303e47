"""Findings trail, current state of invoices, exports and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.functions import text
from billsift.operators import runs

FINDING_COLUMNS = [
    "batch_id", "invoice_id", "match_id", "validation_type", "severity", "message",
    "confidence_score", "similarity",
]

# Audit event names by stage.
UPLOAD_EVENTS = (
    "Upload Started",
    "Parsing Started",
    "Parsing Completed",
    "Database Save Started",
    "Database Save Completed",
    "Upload Completed",
)
UPLOAD_FAILED = "Upload Failed"
PAIR_EVENTS = {
    "DUPLICATE_EXACT": "Exact Duplicate Found",
    "DUPLICATE_NEAR": "Near Duplicate Found",
}
OTHER_PAIR_EVENT = "Duplicate Match Found"
SCAN_EVENTS = ("Duplicate Detection Started", "Batch Duplicate Scan Completed")
# Phase of a failed upload -> events before the failure.
FAILED_AFTER = {"parsing": 2, "policy": 3, "database save": 4, "finalise": 5}


def trail_rows(findings: DataFrame, invoices: DataFrame, run_id: str) -> DataFrame:
    """Findings in the shape of the trail; columns a producer lacks become null."""
    batches = invoices.select("invoice_id", "batch_id")
    rows = findings.join(batches, "invoice_id")
    types = {"match_id": "bigint", "confidence_score": "decimal(5,2)", "similarity": "double"}
    for name, kind in types.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(*FINDING_COLUMNS, F.lit(run_id).alias("run_id"))


def append_findings(rows: DataFrame, path: str) -> None:
    """Add to a plain folder. Earlier rows stay; a retried call adds its rows again, unlike ``save_run``."""
    rows.write.mode("append").partitionBy("batch_id").parquet(path)


def save_run(root: str, run_id: str, findings: DataFrame, invoices: DataFrame, events: DataFrame) -> None:
    """Findings, the next state of the invoices and the audit events of a run, visible together or not at all.

    A new run id adds to the trail and replaces the state; a repeated one replaces what it wrote before. Read with
    ``runs.history(spark, root, "findings")``, ``runs.latest(spark, root, "invoices")``, ``runs.history(spark, root, "events")``.
    """
    runs.publish({"findings": findings, "invoices": invoices, "events": events}, root, run_id)


def with_current_state(invoices: DataFrame, scores: DataFrame) -> DataFrame:
    """Next snapshot of invoices: new status and score where there is one."""
    fresh = scores.select(
        "invoice_id", F.col("status").alias("new_status"), F.col("risk_score").alias("new_score")
    )
    return (
        invoices.join(fresh, "invoice_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("risk_score", F.coalesce("new_score", "risk_score").cast("decimal(5,2)"))
        .drop("new_status", "new_score")
    )


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def _event(position: int, name: Column | str, details: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        (F.lit(name) if isinstance(name, str) else name).alias("event"),
        details.alias("details"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _shown(col: Column) -> Column:
    """Text in quotes as a printed mapping shows it."""
    escaped = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(col.contains("'") & ~col.contains('"'), double).otherwise(single)


def _mapping(**values: Column) -> Column:
    """The values as a printed mapping of their names."""
    parts: list[Column | str] = []
    for name, value in values.items():
        parts += [", " if parts else "{", f"'{name}': ", value]
    return _text(*parts, "}")


def upload_events(batches: DataFrame, counts: DataFrame) -> DataFrame:
    """Events of every upload, in order: batch_id, position, event, details.

    batches: batch_id, file_name, status, rows, bytes, single (whether one invoice was allowed), and for uploads that failed
    their ``phase`` (a key of ``FAILED_AFTER``) and ``error``. A failed upload ends with its failure, after the events that
    its phase let happen; without a phase it counts as failed in parsing. A null detail is shown as empty.
    """
    c = F.col
    joined = batches.select("batch_id", "file_name", "status", "rows", "bytes", "single", "phase", "error").join(
        counts, "batch_id"
    )
    phase = F.coalesce(c("phase"), F.when(c("status") == "Failed", "parsing"))
    error = F.coalesce(c("error"), F.lit(""))
    after = F.lit(len(UPLOAD_EVENTS))
    for name, events in FAILED_AFTER.items():
        after = F.when(phase == name, events).otherwise(after)
    details = [
        _text("file=", c("file_name"), " bytes=", c("bytes"), " mode=",
              F.when(c("single"), "single").otherwise("bulk")),
        _text("file=", c("file_name")),
        _text("rows=", c("rows")),
        _text("invoice_groups=", c("groups"), " ungrouped_rows=", c("ungrouped")),
        _text("processed=", c("processed"), " failed=", c("groups") - c("processed")),
        _mapping(batch_id=c("batch_id"), file_name=_shown(c("file_name")), total=c("total"), processed=c("processed"),
                 failed=c("failed"), status=F.lit("'Completed'")),
    ]
    failure = F.when(
        phase == "policy", _text("phase=policy file contains ", c("groups"), " invoices; use bulk upload")
    ).otherwise(_text("phase=", phase, " error=", error))
    passed = F.array(*[
        _event(i, n, F.coalesce(d, F.lit(""))) for i, (n, d) in enumerate(zip(UPLOAD_EVENTS, details))
    ])
    end = F.array(F.struct(after.alias("position"), F.lit(UPLOAD_FAILED).alias("event"), failure.alias("details")))
    return joined.select(
        "batch_id",
        F.inline(F.when(phase.isNull(), passed).otherwise(F.concat(F.slice(passed, 1, after), end))),
    )


def validation_events(assessed: DataFrame, summary: DataFrame, batches: DataFrame) -> DataFrame:
    """Per invoice: critical when it has a critical issue, completed always. Per batch (batch_id, file_name): start and end."""
    c = F.col
    state = _text("invoice_id=", c("invoice_id"), " status=", c("assessed_status"),
                  " risk_score=", text.float_text(c("assessed_score")))
    per_invoice = assessed.select(
        "batch_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(c("has_critical"), _event(1, "Critical Issue Found", state)),
                    _event(2, "Validation Completed", _text(state, " issues=", c("issue_count"))),
                )
            )
        ),
    )
    per_batch = summary.join(batches.select("batch_id", "file_name"), "batch_id", "left").select(
        "batch_id",
        F.inline(
            F.array(
                _event(0, "Validation Started", _text("file=", F.coalesce("file_name", F.lit("")))),
                _event(3, "Batch Validation Completed", _mapping(
                    batch_id=c("batch_id"), total_invoices=c("total_invoices"), valid=c("valid"),
                    needs_review=c("needs_review"), high_risk=c("high_risk"), critical=c("critical"))),
            )
        ),
    )
    return per_invoice.unionByName(per_batch)


def duplicate_events(pairs: DataFrame, invoices: DataFrame, batches: DataFrame,
                     batch_ids: list[int] | None = None) -> DataFrame:
    """Events of a scan: batch_id, position (0 start, 1 match, 2 end), event, details.

    pairs: as ``duplicates.duplicate_pairs`` gives them; batches: batch_id and file_name. Every scanned batch (all, without
    ``batch_ids``) has a start and an end, with or without matches. A match is one event of the batch of its first
    invoice: the scanned one, or the lower id if both are scanned.
    """
    c = F.col
    owners = invoices.select(F.col("invoice_id").alias("id"), "batch_id")
    scanned = F.lit(True) if batch_ids is None else F.coalesce(c("batch_id").isin(batch_ids), F.lit(False))
    sides = owners.select("id", "batch_id", scanned.alias("scanned"))
    matches = pairs
    for side in ("a", "b"):
        matches = matches.join(
            sides.select(*[c(name).alias(f"{side}_{name}") for name in sides.columns]), f"{side}_id"
        )
    matches = matches.filter("a_scanned or b_scanned").select(
        F.when(c("a_scanned"), c("a_batch_id")).otherwise(c("b_batch_id")).alias("batch_id"),
        F.when(c("a_scanned"), c("a_id")).otherwise(c("b_id")).alias("first_id"),
        F.when(c("a_scanned"), c("b_id")).otherwise(c("a_id")).alias("other_id"),
        "level", "validation_type", "similarity",
    )
    name = F.lit(OTHER_PAIR_EVENT)
    for code, event in PAIR_EVENTS.items():
        name = F.when(c("validation_type") == code, event).otherwise(name)
    similarity = F.when(
        c("similarity").isNotNull(), _text(" similarity=", text.float_text(c("similarity").cast("decimal(5,2)")))
    ).otherwise("")
    per_match = matches.select(
        "batch_id", F.lit(1).alias("position"), name.alias("event"),
        _text("invoice_id=", c("first_id"), " <-> invoice_id=", c("other_id"), similarity).alias("details"),
    )
    levels = matches.groupBy(c("batch_id").alias("found_batch")).agg(
        *[F.count_if(c("level") == n).alias(f"n{n}") for n in range(1, 6)]
    )
    found = {n: F.coalesce(c(f"n{n}"), F.lit(0)) for n in range(1, 6)}
    listed = batches if batch_ids is None else batches.filter(c("batch_id").isin(batch_ids))
    per_batch = listed.join(levels, listed["batch_id"].eqNullSafe(levels["found_batch"]), "left").select(
        "batch_id",
        F.inline(F.array(
            _event(0, SCAN_EVENTS[0], _text("file=", F.coalesce("file_name", F.lit("")))),
            _event(2, SCAN_EVENTS[1], _mapping(
                batch_id=c("batch_id"), exact_duplicates=found[1], vendor_duplicates=found[2], near_duplicates=found[3],
                suspicious_duplicates=found[4] + found[5])),
        )),
    )
    return per_match.unionByName(per_batch)


def failure_events(batches: DataFrame, phase: str, error: str) -> DataFrame:
    """The event of a validation or duplicate scan that failed and left nothing behind, per batch (batch_id)."""
    return batches.select(
        "batch_id",
        F.inline(F.array(_event(3, UPLOAD_FAILED, F.lit(f"phase={phase} error={error}")))),
    )


def append_audit(events: DataFrame, path: str, logged_at: str) -> None:
    stamped = events.withColumn("logged_at", F.lit(logged_at).cast("timestamp"))
    stamped.write.mode("append").parquet(path)
