from pyspark.sql import functions as F

from billsift.operators import runs

TRAIL = "invoice_id bigint, message string"
STATE = "invoice_id bigint, status string"


def frames(spark, trail, state):
    return {"trail": spark.createDataFrame(trail, TRAIL), "invoices": spark.createDataFrame(state, STATE)}


def read(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_add_up_and_a_repeated_id_replaces_its_rows(spark, tmp_path):
    root = str(tmp_path)
    runs.publish(frames(spark, [(1, "a")], [(1, "Valid")]), root, "r1")
    runs.publish(frames(spark, [(1, "b"), (1, "b")], [(1, "Critical")]), root, "r2")
    assert read(runs.history(spark, root, "trail")) == [(1, "a"), (1, "b"), (1, "b")]
    assert read(runs.latest(spark, root, "invoices")) == [(1, "Critical")]
    runs.publish(frames(spark, [(1, "c")], [(1, "High Risk")]), root, "r2")
    assert read(runs.history(spark, root, "trail")) == [(1, "a"), (1, "c")]
    assert read(runs.latest(spark, root, "invoices")) == [(1, "High Risk")]
    assert sorted((r["run_id"], r["place"]) for r in runs.committed(spark, root).collect()) == [("r1", 1), ("r2", 3)]


def test_a_killed_writer_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path)
    runs.publish(frames(spark, [(1, "a")], [(1, "Valid")]), root, "r1")
    # Ended after all its tables, before its row in the list.
    attempt = runs.stage(frames(spark, [(1, "b")], [(1, "Critical")]), root)
    # Ended in the middle of its tables.
    broken = frames(spark, [(2, "x")], [(2, "x")])
    broken["invoices"] = broken["invoices"].withColumn("status", F.raise_error(F.lit("executor gone")))
    try:
        runs.publish(broken, root, "r3")
        raise AssertionError("the writer should have failed")
    except Exception as error:
        assert "executor gone" in str(error)
    assert read(runs.history(spark, root, "trail")) == [(1, "a")]
    assert read(runs.latest(spark, root, "invoices")) == [(1, "Valid")]
    runs.commit(spark, root, "r2", attempt, ["trail", "invoices"])
    assert read(runs.history(spark, root, "trail")) == [(1, "a"), (1, "b")]


def test_nothing_published_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "new")
    assert read(runs.history(spark, root, "trail", TRAIL)) == []
    runs.publish(frames(spark, [], []), root, "r1", {"trail": ["invoice_id"]})
    assert read(runs.history(spark, root, "trail", TRAIL)) == []
    assert read(runs.latest(spark, root, "invoices")) == []
    runs.publish({"trail": spark.createDataFrame([(7, "é"), (None, None)], TRAIL)}, root, "r'2", {"trail": ["invoice_id"]})
    assert sorted(read(runs.history(spark, root, "trail", TRAIL).select("message").na.fill("")), key=str) == [("",), ("é",)]
