"""Near-duplicate embeddings by counting collisions in sorted projections.

Equal vectors fall into one class. The others are put in order in many tables:
by a coarse code of the signs of some random projections and, within a code,
by one more projection. (A table without code is one sorted projection; of n
rows its window holds a fixed share, so the collisions of plain projections
grow with the square of the rows. The code cuts each projection into stretches
that hold PER_CODE rows on average.) Two vectors collide in a table if they have the same
code and the second stands in a window of half-width WINDOW around the first.
The code gets one bit for each doubling of the rows, so that a code holds a
few rows at any size. From the threshold follow the chance that a pair at it
collides in a table, and the number of tables in which such a pair has
EXPECTED collisions on average. Pairs with at least COUNT collisions are
confirmed by their cosine in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lists, map_rows
from tidemark.llm.components import components
from tidemark.session import cut

THRESHOLD = 0.9
#: Mean collisions of a pair at the threshold, and the collisions that make a pair a candidate: recall there is about 0.99.
EXPECTED, COUNT = 8.0, 2
#: Rows that a code holds on average, and half-width of the window in standard deviations of a pair at the threshold.
PER_CODE, SPREADS = 4, 2.0
SEED = 7
#: Colliding pairs sent at a time.
PAIRS = 200_000


class Plan:
    """Numbers of bits and tables for n rows and a threshold."""

    def __init__(self, n: int, dims: int, threshold: float = THRESHOLD):
        self.bits = max(1, min(40, math.ceil(math.log2(max(2, n / PER_CODE)))))
        same = (1 - math.acos(threshold) / math.pi) ** self.bits
        inside = math.erf(SPREADS / math.sqrt(2))
        self.window = SPREADS * math.sqrt(2 - 2 * threshold)
        self.tables = math.ceil(EXPECTED / (same * inside))
        self.dims = dims

    def directions(self, table: int) -> np.ndarray:
        """dims x (bits + 1) normal directions of a table; the last one orders."""
        return np.random.default_rng((SEED, table)).standard_normal((self.dims, self.bits + 1))


def usable(embedding: str = "embedding"):
    """Neither null nor empty nor zero, all components finite."""
    c = F.col(embedding)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def named(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, d): d is a digest of the components' bytes, so that vectors need not be compared or moved to find equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
            digests = [hashlib.sha256(values[a:b].tobytes()).digest() for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["vec_id", "embedding", "d"])

    return map_rows(rows, run, "vec_id long, embedding array<double>, d binary")


def collide(classes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) with a > b, once for each table in which the two collide."""
    dims, bits, window = plan.dims, plan.bits, plan.window
    tables = plan.tables

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = [plan.directions(t) for t in range(tables)]
        power = (1 << np.arange(bits, dtype=np.int64))
        for batch in batches:
            x = lists(batch.column(1), dims)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            ids = batch.column(0).to_numpy()
            for t in range(tables):
                p = x @ directions[t]
                code = ((p[:, :bits] > 0) * power).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(code), pa.array(p[:, bits]), pa.array(ids)], ["t", "code", "p", "id"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by table, code and projection; those that can still collide are held."""
        held = None
        for batch in batches:
            t, code, p, i = (col.to_numpy() for col in batch.columns)
            old = 0
            if held is not None:
                old = len(held[0])
                t, code, p, i = (np.concatenate(x) for x in zip(held, (t, code, p, i)))
            group = np.concatenate(([0], np.cumsum((t[1:] != t[:-1]) | (code[1:] != code[:-1]))))
            # One line for all groups, far enough apart that no window reaches from one into the next.
            line = p + group * (np.ptp(p) + 2 * window + 1)
            low = np.searchsorted(line, line - window)
            n = np.arange(len(line)) - low
            n[:old] = 0
            upto = np.cumsum(n)
            start = 0
            while start < len(n):
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
                own = n[start:end]
                first = np.repeat(np.arange(start, end), own)
                second = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[start:end], own)
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(i[first], i[second])), pa.array(np.minimum(i[first], i[second]))], ["a", "b"])
                start = end
            keep = slice(int(low[-1]), None)
            held = t[keep], code[keep], p[keep], i[keep]

    placed = map_rows(classes.select("id", "embedding"), place, "t int, code long, p double, id long")
    ordered = placed.repartition("t", "code").sortWithinPartitions("t", "code", "p", "id")
    return map_rows(ordered, sweep, "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine is at least the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (lists(batch.column(i), len(batch.column(i).flatten()) // batch.num_rows) for i in (2, 3))
            cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            keep = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    vectors = classes.select("id", "embedding")
    both = pairs.join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    return map_rows(both.select("a", "b", "x", "y"), compare, "a long, b long")


def link_embeddings(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    n_links counts the other rows linked directly, copies of the vector
    included. Vectors that are null, empty or zero or hold null or non-finite
    components link with nothing; so do vectors of another length than most,
    except with others of their own length. Rows that share an id count as one
    vector in components. A null id links with its equals only. Other columns
    are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    # 0.0 for -0.0: both are the same number, but not the same bits.
    good = named(rows.where(usable()).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))))
    classes = cut(good.where("vec_id IS NOT NULL").groupBy("d").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("embedding").alias("embedding")))
    links = None
    for found in classes.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy("dims").collect():  # one row per vector length
        own = classes.where(F.size("embedding") == found["dims"])
        hits = collide(own, Plan(found["n"], found["dims"], threshold)).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)
        some = confirm(hits.select("a", "b"), own, threshold)
        links = some if links is None else links.unionByName(some)
    if links is None:
        links = classes.sparkSession.createDataFrame([], "a long, b long")
    links = cut(links)
    sizes = classes.select("id", "size")
    each = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = each.join(sizes.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("size").alias("far"))
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), "component")
    about = classes.join(others, "id", "left").join(labels, "id", "left").select("d", "id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    found = good.select("vec_id", "d").join(about, "d", "left").select("vec_id", "n_links", "component")
    alone = rows.where(~F.coalesce(usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    joined = found.unionByName(alone)
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good AS a, good AS b
    WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.size * b.size) >= {THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS far FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.far = link.a),
component AS (SELECT vec_id, min(far) AS component_id FROM reach GROUP BY vec_id),
links AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN component USING (vec_id) LEFT JOIN links USING (vec_id)
"""


def brute_force(vectors: list[tuple[int, list | None]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """All linked pairs of rows by position; for tests."""
    good = [(i, np.array(v, float)) for i, (_, v) in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for p, (i, x) in enumerate(good):
        for j, y in good[:p]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                out.append((i, j))
    return out
