"""Session settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: none of them changes a result. AQE re-plans joins from
# measured sizes, splits skewed partitions and merges small ones.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Batches that Python workers see: texts may be long, so fewer rows at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


# How intermediates are written: the fastest level takes about a quarter less room than the default codec.
_DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Functions that run in workers are found there by their module's name, wherever the
    driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="billsift-code-")) / "billsift.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    A private temporary folder is used only where the setting is absent and the
    session runs in one process, as in tests.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="billsift-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


# Whether the shuffle files of a statement go when it ends. Otherwise they wait for the driver to collect garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements made and run inside leave no shuffle files. Nothing made inside is to be run again later."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    For rows several later joins use: they are computed once, a lost executor costs
    a re-read instead of a recomputation, and each reader prunes columns. What was shuffled
    for it is removed.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/billsift-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.options(**_DENSE).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` wrote, once all that is read from them is stored elsewhere.

    Other frames, also those derived from a stored one, are left alone.
    """
    for frame in frames:
        path = frame.__dict__.pop("_stored_at", None)
        if path is not None:
            remove(frame.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that the caller made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
