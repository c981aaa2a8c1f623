"""Session defaults and stage tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of one trace handled by one task.  A trace longer than this is split.
BLOCK_ROWS = 1_000_000
# Rows of whole events or chunks that one task sorts and joins.
WIDE_ROWS = 50_000
# Rows of a few numbers that one task sorts and joins.
NARROW_ROWS = 500_000


def build_session(app: str = "signalloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC clock and Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that have no path to it.

    Python steps import it there.  A cluster that has installed the package needs nothing, nor
    does a local session that was started in its folder or finds it through ``PYTHONPATH``; a
    driver that found it through ``sys.path`` alone does, since workers do not share that.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="signalloom-ship-"), "signalloom.zip")  # read by the driver alone
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)


def stage_folder(spark: SparkSession) -> str:
    """A new folder for one table, in the shared folder of ``spark.checkpoint.dir``.

    A session on one machine may name none and gets a folder of its own.  On a cluster the
    executors would each write to their own disk, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="signalloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/stage-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


#: Folders made within each open ``stage_scope``, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the stage folders made inside.

    Operators stage what they read several times, and their results read it when they run; so
    write what is to stay before the scope ends, to a folder made before it or elsewhere.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES[:] = [scope for scope in _SCOPES if scope is not made]
        for path in made:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a stage folder that nothing reads any more, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = WIDE_ROWS) -> DataFrame:
    """``df`` by its keys in parts of about ``task_rows`` rows, of which there are ``rows``; a fixed
    number of parts, or one by compressed size, would let a task's memory grow."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / task_rows))
    return df.repartition(parts, *keys)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written inside go when it is written.

    Spark would keep them until its driver collects garbage, so that the files of all steps of a
    job lie on disk at once.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back.

    Cuts the lineage of a result that is read several times, keeps column pruning and
    filter pushdown for its readers, and survives the loss of executors.
    """
    path = stage_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
