"""Whole runs or nothing: tables of one run become visible together.

A run writes its tables into folders of its own and adds one row to the list of runs when
all of them are complete. Readers take only folders that the list names, so a writer that
is killed leaves the state before it, and a retried job does not double its rows: of a
run id, the attempt listed last counts. Other runs are never rewritten.

    root/<table>/attempt=<attempt>/...     rows of one attempt
    root/listed_runs/attempt=<attempt>/...     one row per finished attempt, written last
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTED = "listed_runs"
_LISTED_SCHEMA = "run_id string, tables array<string>, place bigint, attempt string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    if not _exists(spark, f"{root}/{LISTED}"):
        return spark.createDataFrame([], _LISTED_SCHEMA)
    return spark.read.schema(_LISTED_SCHEMA).parquet(f"{root}/{LISTED}")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """run_id, tables, place (order of publication), attempt: the attempt that counts of every run."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("place"), F.desc("attempt"))
    return _listed(spark, root).withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n")


def stage(tables: Mapping[str, DataFrame], root: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Write the tables of a run where no reader looks yet; gives the attempt to ``commit``."""
    attempt = f"a{uuid.uuid4().hex}"
    for name, rows in tables.items():
        if name == LISTED:
            raise ValueError(f"{LISTED} is the list of runs")
        by = list((partition_by or {}).get(name, ()))
        rows.write.partitionBy(*by).parquet(f"{root}/{name}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, root: str, run_id: str, attempt: str, tables: Sequence[str]) -> None:
    """List a staged attempt: one row in one file, so it is listed or it is not."""
    last = _listed(spark, root).agg(F.coalesce(F.max("place"), F.lit(0)).alias("place")).first()["place"]
    row = spark.createDataFrame([(run_id, list(tables), last + 1)], "run_id string, tables array<string>, place bigint")
    row.coalesce(1).write.parquet(f"{root}/{LISTED}/attempt={attempt}")


def publish(tables: Mapping[str, DataFrame], root: str, run_id: str,
            partition_by: Mapping[str, Sequence[str]] | None = None) -> None:
    """Write the tables of a run and make them visible together, in place of an earlier run of that id."""
    spark = next(iter(tables.values())).sparkSession
    commit(spark, root, run_id, stage(tables, root, partition_by), list(tables))


def _chosen(spark: SparkSession, root: str, name: str, runs: DataFrame, schema: str | None) -> DataFrame:
    # Only the partitions of chosen attempts are read: the join prunes them.
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, attempt string")
    if not _exists(spark, f"{root}/{name}"):
        if schema is None:
            raise ValueError(f"no run wrote {name}")
        return spark.createDataFrame([], schema)
    return reader.parquet(f"{root}/{name}").join(runs.select("attempt"), "attempt", "left_semi").drop("attempt")


def history(spark: SparkSession, root: str, name: str, schema: str | None = None, besides: str | None = None) -> DataFrame:
    """Rows of a table from all committed runs, as of an append-only trail.

    ``schema`` is needed where no run may have written the table yet (that gives no row). ``besides`` leaves out one run:
    what there was before it, if it is done again.
    """
    runs = committed(spark, root).filter(F.array_contains("tables", name))
    if besides is not None:
        runs = runs.filter(F.col("run_id") != besides)
    return _chosen(spark, root, name, runs, schema)


def latest(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """Rows of a table from the run published last among those that hold it, as of a snapshot."""
    runs = committed(spark, root).filter(F.array_contains("tables", name)).orderBy(F.desc("place"), F.desc("attempt")).limit(1)
    return _chosen(spark, root, name, runs, schema)
