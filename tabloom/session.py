"""Session helpers: a local session for tests, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tabloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings every result in this package assumes (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, for clusters that do not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_tabloom_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        # The driver hands the file out while the context lives.
        folder = tempfile.mkdtemp(prefix="tabloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(package, os.path.join(folder, "all", "tabloom"), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "tabloom"), "zip", os.path.join(folder, "all")))
        context._tabloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent only a session in one process gets a temporary folder, once: on a cluster a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that lost executors do not replay its history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of a task, at most, and those from which on all cores take part.
TASK_ROWS = 4_000_000
SHARED_ROWS = 50_000


def tasks_for(spark: SparkSession, rows: int, most: int = TASK_ROWS) -> int:
    """Tasks for ``rows`` rows: one for few, then up to one per core, then as many as keep a task at ``most`` rows."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // SHARED_ROWS)), -(-rows // most))


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` dealt evenly to ``tasks`` tasks; one task leaves it as it is."""
    return df.repartition(tasks) if tasks > 1 else df


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: columnar, prunable, and with a short lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`written` made; frames that read it can no longer be computed."""
    path = getattr(table, "scratch_path", None)
    if path is not None:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the shuffle files of tables that are written only then."""
    spark.sparkContext._jvm.System.gc()
