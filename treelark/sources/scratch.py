"""A folder for scratch tables in the place that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), f"spark-scratch-{os.getpid()}")
    own = f"{root.rstrip('/')}/treelark-scratch-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(at):
        files.deleteOnExit(at)  # of the application: results that are read later may need it until then
    return f"{own}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this application now; results that have not been read yet are lost, and stored tables are made anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark, "x")).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of tables that were saved inside `step`, innermost step last.
STEPS: ContextVar[tuple[list[str], ...]] = ContextVar("STEPS", default=())


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside are removed when it ends: what is on disk at once is one write's."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved inside are removed at the end, but for those to keep; whatever leaves the step must be written by then."""
    own: list[str] = []
    token = STEPS.set((*STEPS.get(), own))
    try:
        yield
    finally:
        STEPS.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written to a new scratch folder and read again: branches share it, and lost executors cost no more than the work since. keep: beyond the step."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, name)
    if STEPS.get() and not keep:
        STEPS.get()[-1].append(path)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stamped(spark: SparkSession, path: str) -> str:
    """A file's path with its length and time of change: another one if the file is written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return f"{path} {status.getLen()} {status.getModificationTime()}"
