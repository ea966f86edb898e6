"""REST pull: token, list and details, as a Spark data source.

Details are fetched on the executors, one partition of ids per task.
"""

from __future__ import annotations

import json
import os
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import cut


def first_line(path: str) -> str:
    """A secret kept as the first line of a file."""
    with open(path) as f:
        return f.readline().strip()


def fetch(url: str, headers: dict[str, str] | None = None, timeout: float = 30) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
        return r.read().decode("utf-8")


def token(url: str, header: str, value: str) -> str:
    """A token, asked for with an access header."""
    return fetch(url, {header: value}).strip().strip('"')


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(0)
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.headers = options["url"], json.loads(options.get("headers", "{}"))
        self.ids, self.parts = json.loads(options.get("ids", "null")), int(options.get("partitions", "8"))

    def partitions(self):
        if self.ids is None:
            return [_Ids([])]
        return [_Ids(self.ids[i :: self.parts]) for i in range(min(self.parts, len(self.ids)))]

    def read(self, partition):
        if self.ids is None:
            rows = json.loads(fetch(self.url, self.headers))
            yield from ((None, json.dumps(r, ensure_ascii=False)) for r in (rows if isinstance(rows, list) else [rows]))
        for i in partition.ids:
            yield i, fetch(f"{self.url.rstrip('/')}/{i}", self.headers)


class RestSource(DataSource):
    """format("tidemark_rest"): options url, headers (JSON), ids (JSON list; then url/<id> for each)."""

    @classmethod
    def name(cls):
        return "tidemark_rest"

    def schema(self):
        return "id string, body string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def pull(spark: SparkSession, url: str, headers: dict[str, str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """(id, body) of a list, or of the details of ids; body is one JSON object."""
    spark.dataSource.register(RestSource)
    reader = spark.read.format("tidemark_rest").option("url", url).option("headers", json.dumps(headers or {}))
    return (reader.option("ids", json.dumps(ids)) if ids is not None else reader).load()


def objects(bodies: DataFrame, schema: str) -> DataFrame:
    """Columns of the JSON objects by name, in whatever order each object has them."""
    return bodies.select(F.from_json("body", schema).alias("o")).select("o.*")


def with_details(items: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """items left-joined with details by key; shared detail columns get the suffix .a."""
    renamed = details.select(key, *[F.col(f"`{c}`").alias(f"{c}.a" if c in items.columns else c) for c in details.columns if c != key])
    return items.join(renamed, key, "left")


def keep_token(path: str, value: str) -> None:
    """A token as the first line of a file that only its owner reads."""
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        print(value, file=f)


def show(df: DataFrame, n: int = 20) -> None:
    """The first rows, in full."""
    df.show(n, truncate=False)


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """df with index, from 0 in the given order; a column of that name is replaced.

    Rows are sorted by range, counted by partition and numbered from the sums
    of earlier partitions: no task sees more than its partition, and no Python.
    """
    ordered = cut(df.drop("index").orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = ordered.groupBy("_p").agg(F.min("_m").alias("_least"), F.count("*").alias("_n"))
    before = sizes.select("_p", "_least", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row per partition
    # Ids count up by one within a partition.
    return ordered.join(F.broadcast(before), "_p").select((F.col("_m") - F.col("_least") + F.col("_b")).alias("index"), *[c for c in df.columns if c != "index"])


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Semicolon CSV with an index column that counts from 0 in the given order."""
    indexed(df, order).sortWithinPartitions("index").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def pull_all(spark: SparkSession, list_url: str, detail_url: str | None, out: str, headers: dict[str, str] | None = None, key: str = "id") -> dict[str, int]:
    """Pulls a list and, with detail_url, the details of its ids; writes list.csv and merged.json below out.

    Columns are those of all objects together, as text; keys that the list
    and the details share get .a in the latter.
    """

    def table(bodies: DataFrame) -> DataFrame:
        objects_ = bodies.select(F.from_json("body", "map<string,string>").alias("o"))
        names = sorted(r[0] for r in objects_.select(F.explode(F.map_keys("o"))).distinct().collect())  # one row per key
        return objects_.select(*[F.col("o")[n].alias(n) for n in names])

    items = cut(table(pull(spark, list_url, headers)))
    write_csv(items, f"{out}/list.csv", [key])
    if detail_url is None:
        return {"list": items.count()}
    ids = [r[0] for r in items.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).collect()]  # what is asked for, one request each
    merged = with_details(items, table(pull(spark, detail_url, headers, ids)), key)
    write_json(merged, f"{out}/merged.json")
    return {"list": items.count(), "details": len(ids)}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
