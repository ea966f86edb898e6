"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bound on what an operator may broadcast or hold in a Python worker, in bytes.
BROADCAST_BYTES = 32 << 20
#: The folder that holds this package: Python workers import it from there, whatever folder the driver was started in.
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Whether a query's shuffles are removed when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "tidemark", cores: str = "*", **conf) -> SparkSession:
    """A local session with the settings that the engine expects."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(p for p in (PACKAGE_ROOT, os.environ.get("PYTHONPATH")) if p))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for sessions on clusters where it isn't installed."""
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark"), "zip", PACKAGE_ROOT, os.path.basename(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.addPyFile(made)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (tests, local mode) a temporary folder is made and set
    as the session's checkpoint folder, so that later calls return it again.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> str:
    """The path in the shared folder where df is written as a table.

    What was shuffled to make it is removed as soon as it is written, so an
    operator of many cuts holds the shuffles of one at a time, whenever the
    driver next collects garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as a table in the shared folder and read again.

    The tables, compressed, stay in the shared folder, where every executor
    finds them, also after others were lost.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
