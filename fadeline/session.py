"""Session factory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fadeline", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; settings of a cluster's own defaults win where it has one.

    On a cluster, leave `cores` out: master and sizes then come from spark-submit. Locally, shuffle
    partitions follow the cores.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if cores:
        builder = builder.master(f"local[{cores}]")
        settings |= {"spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("FADELINE_DRIVER_MEMORY", "8g")}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Where a session on one machine that names no checkpoint folder keeps what it must write.
LOCAL_FOLDER = "/tmp/fadeline-checkpoint"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only a session on one machine may leave it out."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def _goes_at_end(spark: SparkSession, folder: str) -> None:
    """Have a folder deleted when the application ends."""
    own = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = own.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(own)
    store.deleteOnExit(own)


def application_folder(spark: SparkSession) -> str:
    """This application's own folder for files below the shared one; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/fadeline-files/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        _goes_at_end(spark, folder)
    return folder


_folders: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: what reads it does not compute it again, nor lose it with an executor.

    Spark keeps such tables in a folder of the application's own below the shared one, and that goes when the
    application ends.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if (folder := context.getCheckpointDir()) not in _folders:
        _folders.add(folder)
        _goes_at_end(df.sparkSession, folder)
    return df.checkpoint()
