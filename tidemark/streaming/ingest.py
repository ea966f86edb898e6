"""Streaming ingest: new files become rows of the document table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import long_enough
from tidemark.sources.files import SUFFIXES, extract
from tidemark.functions.text import stable_id


def file_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """Stream of (path, suffix, content) of files below root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*SUFFIXES))


def documents(rows: DataFrame) -> DataFrame:
    """(id, source, kind, row, text) of raw rows; ids are stable, so a file read twice gives the same ids."""
    cells = F.array_join(F.transform(F.filter(F.map_entries("cells"), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
    text = F.coalesce("text", cells)
    rows = rows.where("kind <> 'error'").select("source", "kind", "part", "row", text.alias("text"))
    return long_enough(rows).select(stable_id(F.col("source"), F.coalesce("part", F.lit("")), F.col("row")).alias("id"), "source", "kind", "row", "text")


def start(spark: SparkSession, root: str, out: str, checkpoint: str, available_now: bool = False):
    """Appends the documents of arriving files to the Parquet table at out."""
    writer = documents(extract(file_stream(spark, root))).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
