"""Vector collections: Parquet tables of (id, text, meta, embedding) that can be opened, appended to and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pos long, id string, text string, meta string, embedding array<double>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store that Spark reads has something below path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def open_or_create(spark: SparkSession, path: str) -> DataFrame:
    """The collection below path; an empty one is made if there is none."""
    if not exists(spark, path):
        spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows whose id the collection does not hold yet; of rows that share an id, one.

    Ids are stable, so a build that is repeated adds nothing.
    """
    held = open_or_create(rows.sparkSession, path).select("id")
    fresh = rows.select(*[f.split()[0] for f in SCHEMA.split(", ")]).dropDuplicates(["id"]).join(held, "id", "left_anti")
    fresh.select("pos", "id", "text", "meta", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """The rows become the collection."""
    rows.select("pos", "id", "text", "meta", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(path)


def size(spark: SparkSession, path: str) -> int:
    """Number of vectors stored."""
    return open_or_create(spark, path).count()
