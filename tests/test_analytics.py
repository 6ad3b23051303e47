import random
import statistics
from datetime import date
from decimal import Decimal
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from billsift import session
from billsift.functions import text
from billsift.operators import anomaly, reads, sinks
from billsift.plans import dashboard, reports


def test_risk_buckets(spark):
    scores = ["0", "24.99", "25", "75", "100", "101", None]
    df = spark.createDataFrame([(None if s is None else Decimal(s),) for s in scores], "risk_score decimal(5,2)")
    assert [(r["label"], r["value"]) for r in dashboard.risk_buckets(df).collect()] == [
        ("0–25", 3), ("25–50", 1), ("50–75", 0), ("75–100", 2)]


def test_severity_rank_and_old_messages(spark):
    df = spark.createDataFrame([("CRITICAL",), ("INFO",), ("ODD",), (None,)], "s string")
    assert [r[0] for r in df.select(text.severity_rank(F.col("s"))).collect()] == [0, 3, 9, 9]
    old = spark.createDataFrame([("x | match_id=12 | similarity=93.33",), ("none",)], "m string")
    assert [tuple(r) for r in old.select(text.match_id_in(F.col("m")), text.similarity_in(F.col("m"))).collect()] == [
        (12, 93.33), (None, None)]


def test_reports_on_empty_tables(spark):
    invoices = spark.createDataFrame(
        [], "invoice_id long, vendor_id long, invoice_number string, invoice_date date, "
            "total_amount decimal(14,2), risk_score decimal(5,2), status string")
    vendors = spark.createDataFrame([(1, "Acme", "Active")], "vendor_id long, vendor_name string, status string")
    assert reports.vendor_spend(invoices, vendors).count() == 0
    assert [r["invoice_count"] for r in reports.invoices_per_vendor(invoices, vendors).collect()] == [0]
    assert reports.potential_loss(invoices).first()[0] is None
    rows = reads.invoice_rows(invoices, vendors)
    assert dashboard.validation_kpis(rows).first()["pass_rate"] == 0


def test_share_and_mean_round_half_up(spark):
    invoices = spark.createDataFrame(
        [(1, 1, Decimal("100.01")), (2, 1, Decimal("100.02")), (3, 2, Decimal("0.03"))],
        "invoice_id long, vendor_id long, total_amount decimal(14,2)")
    vendors = spark.createDataFrame([(1, "A", "x"), (2, "B", "x")], "vendor_id long, vendor_name string, status string")
    means = {r["vendor_name"]: float(r["avg_invoice_value"]) for r in reports.vendor_average(invoices, vendors).collect()}
    assert means["A"] == 100.02
    shares = {r["vendor_name"]: float(r["spend_pct"]) for r in reports.vendor_spend(invoices, vendors).collect()}
    assert shares == {"A": 99.99, "B": 0.01}


def ml_frame(spark, count=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, "v%d" % (i % 4), str(rng.randrange(1, 20)), str(round(rng.uniform(90, 110), 2)),
             str(round(rng.uniform(900, 1100), 2))) for i in range(count)]
    rows += [(count + i, "v1", "500", "9000.00", "99999.00") for i in range(3)]
    return spark.createDataFrame(rows, "row_id long, vendor_name string, quantity string, unit_price string, total_amount string")


def test_price_ratio_edges(spark):
    rows = [(1, "zero", 0.0), (2, "zero", 0.0), (3, "one", 7.0), (4, None, 3.0), (5, "two", 1.0), (6, "two", 3.0),
            (7, "mix", -1.0), (8, "mix", 1.0)]
    df = spark.createDataFrame(rows, "row_id long, vendor_name string, unit_price double")
    got = {r["row_id"]: r["vendor_avg_price_ratio"] for r in anomaly.with_price_ratio(df).collect()}
    assert got == {1: None, 2: None, 3: 1.0, 4: None, 5: 0.5, 6: 1.5, 7: 1.0, 8: 1.0}


@pytest.mark.parametrize("size", [1, 2, 501])
def test_exact_medians(spark, size):
    rng = random.Random(size)
    a = [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 6) for _ in range(size)]
    b = [float(rng.randrange(5)) for _ in range(size)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = {r["feature"]: r["median"] for r in anomaly.medians(df, ("a", "b")).collect()}
    assert got == {"a": statistics.median(a), "b": statistics.median(b)}


def test_forest_ranks_planted_outliers_first(spark, tmp_path):
    rows = ml_frame(spark)
    first = anomaly.score(rows).select("row_id", "ml_risk_score", "ml_flag").collect()
    scores = {r["row_id"]: r["ml_risk_score"] for r in first}
    assert sorted(scores, key=scores.get)[-3:] and min(scores[i] for i in (400, 401, 402)) >= 99.0
    assert min(scores.values()) == 0.0 and max(scores.values()) <= 100.0
    assert 0.1 < sum(r["ml_flag"] for r in first) / len(first) < 0.25
    model = anomaly.fit(rows)
    anomaly.save(model, str(tmp_path / "model"))
    stored = anomaly.load(spark, str(tmp_path / "model"))
    again = {r["row_id"]: r["ml_risk_score"] for r in anomaly.score(rows, stored).collect()}
    assert again == scores


def test_few_rows_are_not_scored(spark):
    one = ml_frame(spark).filter("row_id = 0")
    assert [(r["ml_risk_score"], r["ml_flag"]) for r in anomaly.score(one).collect()] == [(0.0, False)]
    with pytest.raises(ValueError):
        anomaly.fit(one)


def test_trail_is_append_only(spark, tmp_path):
    invoices = spark.createDataFrame([(1, 5)], "invoice_id long, batch_id long")
    found = spark.createDataFrame([(1, "FUTURE_DATE", "WARNING", "m")],
                                  "invoice_id long, validation_type string, severity string, message string")
    for run in ("r1", "r2"):
        sinks.append_findings(sinks.trail_rows(found, invoices, run), str(tmp_path / "trail"))
    stored = spark.read.parquet(str(tmp_path / "trail"))
    assert sorted(r["run_id"] for r in stored.filter("batch_id = 5").collect()) == ["r1", "r2"]


def test_export_is_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a; b")], "invoice_id long, issues_summary string")
    sinks.write_export(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("1", "a; b")]


def test_current_state_keeps_untouched_rows(spark):
    invoices = spark.createDataFrame([(1, "Paid", Decimal("1")), (2, "Paid", Decimal("1"))],
                                     "invoice_id long, status string, risk_score decimal(5,2)")
    scores = spark.createDataFrame([(2, "Critical", Decimal("90"))],
                                   "invoice_id long, status string, risk_score decimal(5,2)")
    got = {r["invoice_id"]: (r["status"], float(r["risk_score"])) for r in sinks.with_current_state(invoices, scores).collect()}
    assert got == {1: ("Paid", 1.0), 2: ("Critical", 90.0)}


def test_history_and_series(spark):
    batches = spark.createDataFrame([(i,) for i in range(60)], "batch_id long")
    assert [r["batch_id"] for r in reads.upload_history(batches).collect()] == list(range(59, 9, -1))
    rows = spark.createDataFrame([(date(2024, m, 1), Decimal("0.5")) for m in range(1, 13)] + [(None, Decimal("9"))],
                                 "invoice_date date, total_amount decimal(14,2)")
    assert [r["label"] for r in dashboard.monthly_series(rows, 2).collect()] == ["2024-11", "2024-12"]
    assert [r["value"] for r in dashboard.amount_series(rows).collect()] == [1] * 12


def test_upload_events_by_phase(spark):
    batches = spark.createDataFrame(
        [(1, "it's.csv", "Completed", 3, 90, False, None, None), (2, "b.csv", "Failed", 3, 90, True, "policy", None),
         (3, "c.csv", "Failed", 0, 5, False, None, "no rows"), (4, "d.csv", "Failed", 3, 9, None, "database save", "gone"),
         (5, "e.csv", "Failed", None, None, None, "finalise", None)],
        "batch_id long, file_name string, status string, rows long, bytes long, single boolean, phase string, error string")
    counts = spark.createDataFrame([(i, 2, 1, 1, 3, 2) for i in range(1, 6)],
                                   "batch_id long, groups long, ungrouped long, processed long, total long, failed long")
    events = sinks.upload_events(batches, counts).orderBy("batch_id", "position").collect()
    last = {r["batch_id"]: (r["position"], r["event"], r["details"]) for r in events}
    assert last == {
        1: (5, "Upload Completed",
            str({"batch_id": 1, "file_name": "it's.csv", "total": 3, "processed": 1, "failed": 2, "status": "Completed"})),
        2: (3, "Upload Failed", "phase=policy file contains 2 invoices; use bulk upload"),
        3: (2, "Upload Failed", "phase=parsing error=no rows"),
        4: (4, "Upload Failed", "phase=database save error=gone"),
        5: (5, "Upload Failed", "phase=finalise error="),
    }
    assert [r["details"] for r in events if r["position"] == 0][:2] == [
        "file=it's.csv bytes=90 mode=bulk", "file=b.csv bytes=90 mode=single"]


def test_duplicate_events_of_one_batch(spark):
    pairs = spark.createDataFrame([(1, 2, 3, 93.5, "DUPLICATE_NEAR"), (1, 3, 1, None, "DUPLICATE_EXACT"),
                                   (3, 4, 4, None, "DUPLICATE_DATE")],
                                  "a_id long, b_id long, level int, similarity double, validation_type string")
    invoices = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "invoice_id long, batch_id long")
    batches = spark.createDataFrame([(10, "x.csv"), (20, None), (40, "empty.csv")], "batch_id long, file_name string")
    got = sinks.duplicate_events(pairs, invoices, batches, [20, 40]).orderBy("batch_id", "position", "details").collect()
    empty = {"exact_duplicates": 0, "vendor_duplicates": 0, "near_duplicates": 0, "suspicious_duplicates": 0}
    assert [tuple(r) for r in got] == [
        (20, 0, "Duplicate Detection Started", "file="),
        (20, 1, "Near Duplicate Found", "invoice_id=2 <-> invoice_id=1 similarity=93.5"),
        (20, 1, "Exact Duplicate Found", "invoice_id=3 <-> invoice_id=1"),
        (20, 1, "Duplicate Match Found", "invoice_id=3 <-> invoice_id=4"),
        (20, 2, "Batch Duplicate Scan Completed",
         str({"batch_id": 20, **empty, "exact_duplicates": 1, "near_duplicates": 1, "suspicious_duplicates": 1})),
        (40, 0, "Duplicate Detection Started", "file=empty.csv"),
        (40, 2, "Batch Duplicate Scan Completed", str({"batch_id": 40, **empty})),
    ]


def test_filled_trees_give_the_paths_of_their_nodes():
    rng = np.random.default_rng(5)
    trees = []
    for tree, size in enumerate((1, 2, 7, 200, 256)):
        rows = pd.DataFrame(rng.integers(0, 6, (size, 4)).astype(float), columns=list(anomaly.FEATURES))
        trees.append(anomaly._grow_tree(rows.assign(tree=tree, draw=range(size), row_id=range(size)), 256))
    x = rng.integers(-1, 7, (50, 4)).astype(float)

    def path(nodes, row):
        node = nodes.loc[0]
        while node["feature"] >= 0:
            node = nodes.loc[int(node["left"] if row[int(node["feature"])] <= node["threshold"] else node["right"])]
        return int(node["path"])

    expected = [sum(path(t.set_index("node"), row) for t in trees) for row in x]
    forest = anomaly._filled(pd.concat(trees).sort_values(["tree", "node"]))
    assert forest.depths(x.T, 2).tolist() == expected
    assert forest.depths(x.T[:, :0]).tolist() == []


def test_scores_leave_only_what_they_are_read_from(spark):
    """Tables on the way to the scores go once they are read, and of wide rows only the columns used are stored again."""
    folder = Path(session.ensure_checkpoint_dir(spark).removeprefix("file:"))
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).cast("string").alias("vendor_name"),
        (F.col("id") % 7).alias("quantity"), (F.col("id") * 1.5).alias("unit_price"), (F.col("id") % 5).alias("total_amount"),
        F.lit("of no use here").alias("note"),
    )
    before = set(folder.iterdir())
    expected = {r["row_id"]: tuple(r) for r in anomaly.scores(rows).collect()}
    left = [p for p in set(folder.iterdir()) - before if p.name.startswith("billsift-")]
    columns = [spark.read.parquet(str(p)).columns for p in left]
    assert not [c for c in columns if "vendor_avg_price_ratio" in c and "row_id" in c or "vendor_name" in c or "note" in c]
    wide = session.cut_lineage(rows)
    path = Path(wide._stored_at.removeprefix("file:"))
    found = anomaly.scores(wide, used=(wide,))
    assert not path.exists()
    assert {r["row_id"]: tuple(r) for r in found.collect()} == expected and len(expected) == 60
