"""Session defaults shared by tests, the bench and ad-hoc use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "slotwise", **conf: str) -> SparkSession:
    """A small local session; a cluster job brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLOTWISE_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set.

    The fallback is for local tests. It is refused on a cluster, where a machine-local
    folder would be lost together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
    if not _fallback:  # a core setting can't be changed in a running session
        _fallback.append(tempfile.mkdtemp(prefix="slotwise-checkpoint-"))
    return _fallback[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read from there: its plan is not run again."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)
