"""Dense search, rank fusion, context assembly and embedding functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize
from tidemark.session import BROADCAST_BYTES, cut

#: Fusion constant, candidates per list, fused candidates, passages and characters of a context.
RRF, K_LIST, K_FUSED, K_FINAL, CONTEXT_CHARS = 60, 30, 50, 7, 12_000
DIMS = 1024
#: Texts that a model gets at a time, and that are hashed at a time.
MODEL_BATCH, EMBED_ROWS = 100, 128
#: Queries that a group of a cell's vectors meets; queries, components of vectors and pairs compared at a time.
QUERY_BLOCK, QUERY_CHUNK, NEAR_FLOATS, PAIRS = 4096, 128, 512 << 10, 1 << 17
#: Squared lengths below this, and their sums, do not overflow.
HUGE = 1e300
#: Most and fewest pivots, vectors for each; components of a group's vectors.
PIVOTS, MIN_PIVOTS, PIVOT_ROWS, PART_FLOATS = 256, 8, 5000, 4 << 20
#: Rows that are placed at a time; bounds of queries that are ordered at a time.
PLACE_ROWS, REACH_FLOATS = 512, 1 << 20
#: The cell of vectors that meet all queries.
STRAY = -2
#: What distances computed in another order may differ by, absolutely and as a share.
SLACK = 1e-6


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def dense_search(vectors: DataFrame, query: list[float], k: int = K_LIST, key: str = "pos", embedding: str = "embedding") -> DataFrame:
    """Exact nearest neighbours (key, dist, rank) of one query vector: a scan with a top-k per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(key, F.round(squared_l2(F.col(embedding), q), 9).alias("dist")).where("dist IS NOT NULL").orderBy("dist", key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy("dist", key)))


class Nearest:
    """The k nearest rows to each query, of rows (key, vector) that come a block at a time.

    A matrix product gives the distances of all pairs up to rounding. Those that
    it doesn't put beyond the k-th distance known so far are computed again, one
    component after the other, so that sums do not depend on the block. most
    has distances that are known to bound the k-th one; NaN where none is.
    """

    def __init__(self, ids: pa.Array, queries: np.ndarray, k: int, most: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.kind = ids, queries, k, None
        self.last = np.full(len(queries), np.nan) if most is None else most.copy()
        self.columns, (self.norm, self.plain) = np.ascontiguousarray(queries.T), _norms(queries)
        self.doubt = 8 * (queries.shape[1] + 8) * np.finfo(float).eps
        with np.errstate(over="ignore", invalid="ignore"):
            self.sides = np.column_stack([-2 * queries, np.ones(len(queries)), (1 - self.doubt) * self.norm])
        self.found, self.fresh = [], 0

    def add(self, keys: pa.Array, values: np.ndarray, at: np.ndarray | None = None) -> None:
        """Rows that meet the queries at these places, or all."""
        at = np.arange(len(self.queries)) if at is None else at
        self.kind, keys = keys.type, keys.to_numpy(zero_copy_only=False)
        norm, plain = _norms(values)
        rows, odd, every = np.flatnonzero(plain), np.flatnonzero(~plain), np.arange(len(values))
        columns, norm = np.ascontiguousarray(values.T), norm[rows]
        sides = np.column_stack([values[rows], (1 - self.doubt) * norm, np.ones(len(rows))]).T
        for start in range(0, len(at), QUERY_CHUNK):
            q = at[start : start + QUERY_CHUNK]
            fit, wild = q[self.plain[q]], q[~self.plain[q]]
            if len(fit) and len(rows):
                near, row = self._near(fit, sides, norm)
                if len(near) * 8 > len(fit) * len(rows):
                    self._meet(fit, rows, columns, keys)
                else:
                    for i in range(0, len(near), PAIRS):
                        some, which = fit[near[i : i + PAIRS]], rows[row[i : i + PAIRS]]
                        dist = np.zeros(len(some))
                        for held, asked in zip(columns, self.columns):
                            dist += (held[which] - asked[some]) ** 2
                        self._keep(some, keys[which], _rounded(dist))
            for some, which in ((fit, odd), (wild, every)):
                if len(some) and len(which):
                    self._meet(some, which, columns, keys)
        if self.fresh and 2 * self.fresh >= self.k * len(self.queries):
            self._settle()

    def _near(self, q: np.ndarray, sides: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in q, row) of pairs that may be among the k nearest; no product is above its distance."""
        low, most = self.sides[q] @ sides, self.last[q]
        unknown = np.flatnonzero(np.isnan(most))
        most[unknown] = np.inf
        if len(unknown) and len(norm) > self.k:
            some = low[unknown]
            best = np.argpartition(some, self.k - 1, axis=1)[:, : self.k]
            most[unknown] = (np.take_along_axis(some, best, axis=1) + 2 * self.doubt * (self.norm[q[unknown], None] + norm[best])).max(axis=1)
        return np.nonzero(low <= (most * (1 + 1e-12) + 2e-9)[:, None])  # distances are rounded

    def _meet(self, q: np.ndarray, rows: np.ndarray, columns: np.ndarray, keys: np.ndarray) -> None:
        """All pairs of these queries and rows."""
        dist = np.zeros((len(q), len(rows)))
        with np.errstate(over="ignore", invalid="ignore"):
            for held, asked in zip(columns, self.columns):
                dist += (held[rows] - asked[q, None]) ** 2
        dist = _rounded(dist)  # before the k best are told: ties go by key
        if len(rows) > self.k:
            kth = np.partition(dist, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            near, row = np.nonzero((dist <= kth) | np.isnan(kth))
        else:
            near, row = (x.ravel() for x in np.indices(dist.shape))
        self._keep(q[near], keys[rows[row]], dist[near, row])

    def _keep(self, at: np.ndarray, key: np.ndarray, dist: np.ndarray) -> None:
        near = (dist <= self.last[at]) | np.isnan(self.last[at])
        self.found.append((at[near], key[near], dist[near]))
        self.fresh += int(near.sum())

    def _settle(self) -> None:
        """Only the k best of each query stay."""
        at, key, dist = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((np.unique(key, return_inverse=True)[1] if key.dtype == object else key, dist, at))  # NaN sorts last
        at, key, dist = at[order], key[order], dist[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kth, first = place == self.k - 1, place < self.k
        self.last[at[kth]] = np.fmin(self.last[at[kth]], dist[kth])
        self.found, self.fresh = [(at[first], key[first], dist[first])], 0

    def result(self) -> pa.RecordBatch | None:
        """(query_id, key, dist); None if no row has come."""
        if not self.found:
            return None
        self._settle()
        at, key, dist = self.found[0]
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(at)), pa.array(key, self.kind), pa.array(dist)], ["query_id", "key", "dist"])


def _norms(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, and which of them are small enough that sums of products do not overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (values**2).sum(axis=1)
        return norm, norm < HUGE


def _rounded(dist: np.ndarray) -> np.ndarray:
    """Distances with 9 digits."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(dist * 1e9 + 0.5) / 1e9


def _blocks(rows: int, dims: int) -> Iterator[tuple[int, int]]:
    """(start, length) of blocks of rows that are compared at a time."""
    step = max(1, NEAR_FLOATS // dims)
    return ((i, min(step, rows - i)) for i in range(0, rows, step))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows (key, embedding) of a batch whose vectors are complete, by vector length."""
    column = batch.column(1)
    batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(column), 0), False))
    lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths):
        part = batch.filter(pa.array(lengths == dims))
        full = part.column(1).flatten().is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(axis=1)
        yield int(dims), part.filter(pa.array(full))


def _far(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots."""
    out = np.empty((len(values), len(pivots)))
    with np.errstate(over="ignore", invalid="ignore"):
        for i, p in enumerate(pivots):
            out[:, i] = np.sqrt(((values - p) ** 2).sum(axis=1))
    return out


def _cells(values: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(cell, away): a nearest pivot of each row and the distance to it; cell -1 for rows whose distances say nothing.

    A matrix product finds the pivot, up to rounding, which any pivot near
    enough withstands; the distance to it is then taken from the differences.
    """
    cell, away = np.full(len(values), -1), np.zeros(len(values))
    if pivots is None:
        return cell, away
    at = np.flatnonzero(np.isfinite(values).all(axis=1))
    with np.errstate(over="ignore", invalid="ignore"):
        near = (pivots**2).sum(axis=1) - 2 * (values[at] @ pivots.T)
        # Sums of huge components may overflow.
        known = np.isfinite(near).all(axis=1)
        at, near = at[known], near[known].argmin(axis=1)
        far = np.sqrt(((values[at] - pivots[near]) ** 2).sum(axis=1))
    known = np.isfinite(far)
    cell[at[known]], away[at[known]] = near[known], far[known]
    return cell, away


def place_vectors(rows: DataFrame, pivots: dict[int, np.ndarray], key: str, embedding: str) -> DataFrame:
    """(key, embedding, dims, cell, away): each complete vector with its nearest pivot and the distance to it.

    Cell -1 holds vectors whose distances say nothing: those with a component
    that isn't finite, and those of a length without pivots.
    """
    schema = f"`{key}` {dict(rows.dtypes)[key]}, `{embedding}` {dict(rows.dtypes)[embedding]}, dims int, cell int, away double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_length(batch):
                cell, away = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                if dims in pivots and part.num_rows:
                    for i in range(0, part.num_rows, PLACE_ROWS):
                        cell[i : i + PLACE_ROWS], away[i : i + PLACE_ROWS] = _cells(_matrix(part.column(1).slice(i, PLACE_ROWS), dims), pivots[dims])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, dims), pa.int32()), pa.array(cell, pa.int32()), pa.array(away)], [key, embedding, "dims", "cell", "away"])

    return rows.mapInArrow(place, schema)


def _route(part: pa.RecordBatch, dims: int, pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, float, list[float]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, lo, hi) of the queries (query_id, embedding) of one length, as in route_queries, and a bound of each row's k-th distance."""
    known = np.array(sorted(c for d, c in cells if d == dims and c >= 0), int)
    far = _far(_matrix(part.column(1), dims), pivots[dims][known]) if len(known) else np.zeros((part.num_rows, 0))
    first = np.full((len(known), k), np.inf)
    for i, c in enumerate(known):
        first[i, : len(cells[dims, c][2])] = cells[dims, c][2]
    low, high = (np.array([cells[dims, c][i] for c in known], float) for i in (0, 1))
    least = np.full(len(far), np.inf)
    out = []
    step = max(1, REACH_FLOATS // max(1, first.size))
    for i in range(0, len(far) if len(known) else 0, step):
        d = far[i : i + step]
        sound = np.isfinite(d)  # sums of huge components overflow and bound nothing
        reach = (np.where(sound, d, np.inf)[:, :, None] + first).reshape(len(d), -1)
        most = np.partition(reach, k - 1, axis=1)[:, k - 1] * (1 + SLACK) + SLACK
        with np.errstate(invalid="ignore"):
            near = np.where(sound, np.maximum(0.0, np.maximum(d - high, low - d)), 0.0)
        at, cell = np.nonzero(near <= most[:, None])
        bounded = sound[at, cell] & np.isfinite(most[at])
        with np.errstate(invalid="ignore"):
            lo, hi = (np.where(bounded, d[at, cell] + sign * most[at], sign * np.inf) for sign in (-1, 1))
        out.append((at + i, known[cell], lo, hi))
        least[i : i + step] = most
    if (dims, -1) in cells:
        every = np.arange(len(far))
        out.append((every, np.full(len(far), -1), np.full(len(far), -np.inf), np.full(len(far), np.inf)))
    at, cell, lo, hi = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    return at, cell, lo, hi, least


def route_queries(queries: DataFrame, pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, float, list[float]]], k: int, embedding: str) -> DataFrame:
    """(query_id, embedding, dims, cell, lo, hi): each query once for each cell that may hold one of its k nearest vectors.

    cells has, by length and pivot, the least and the largest distance of its
    vectors and the k smallest ones: by the triangle inequality they bound the
    query's k-th distance from above, and its distances to a cell from below.
    lo and hi bound the distances to the pivot of vectors that can be near.
    """
    kinds = dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, `{embedding}` {kinds[embedding]}, dims int, cell int, lo double, hi double"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_length(batch):
                at, cell, lo, hi, _ = _route(part, dims, pivots, cells, k)
                columns = [c.take(pa.array(at, pa.int64())) for c in part.columns]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(len(at), dims), pa.int32()), pa.array(cell, pa.int32()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64())], ["query_id", embedding, "dims", "cell", "lo", "hi"]
                )

    return queries.mapInArrow(route, schema)


def dense_search_all(vectors: DataFrame, queries: DataFrame, k: int = K_LIST, key: str = "pos", embedding: str = "embedding") -> DataFrame:
    """Exact nearest neighbours (query_id, key, dist, rank) of every query (query_id, embedding).

    Vectors are placed at the nearest of a few pivots, once, with the distance
    to it; queries go to the cells that can hold one of their k nearest
    vectors. Vectors and queries meet by cell. Queries of at most
    BROADCAST_BYTES go to all tasks, and vectors stay where they are. Of more
    queries, those of a cell are dealt to several tasks, as are the vectors of
    large cells, so a group's size is bounded and the vectors are read as often,
    whatever the number of queries. To the driver go the pivots, k distances of
    each, and those few queries.

    Vectors and queries with a missing component have no distance, nor have
    those of different lengths; rows without a key are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(key, embedding).where(F.col(key).isNotNull())
    asked = queries.select("query_id", embedding)
    kinds = dict(rows.dtypes) | dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, dist double"
    # Rows in the order of a hash are a sample that does not depend on partitions.
    total = rows.count()
    most = min(PIVOTS, max(MIN_PIVOTS, total // PIVOT_ROWS))
    sound = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # The first of that order, and spare ones: components of others are not looked at.
    share = 16 * most / max(total, 1)
    early = F.xxhash64(key) < F.lit(int(-(2**63) + share * 2**64)) if share < 1 else F.lit(True)
    sample = rows.where(early).where(sound & (F.size(embedding) > 0)).orderBy(F.xxhash64(key), key).limit(most).collect()
    pivots = {d: np.unique(np.array([r[1] for r in sample if len(r[1]) == d], float), axis=0) for d in {len(r[1]) for r in sample}}

    # A few queries go to the vectors: then these are not written, nor moved.
    few = (asked.agg(F.sum(F.size(embedding))).first()[0] or 0) * 8 <= BROADCAST_BYTES
    placed = place_vectors(rows, pivots, key, embedding)
    placed = cut(placed.drop(key, embedding) if few else placed)
    order = W.partitionBy("dims", "cell").orderBy("away")
    nearest = placed.select("dims", "cell", "away").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("dims", "cell").agg(F.array_sort(F.collect_list("away")).alias("first"))
    found = placed.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).join(nearest, ["dims", "cell"]).collect()
    cells = {(r["dims"], r["cell"]): (r["lo"], r["hi"], r["first"]) for r in found}
    parts = {(r["dims"], r["cell"]): -(-r["n"] * r["dims"] // PART_FLOATS) for r in found}

    if few:
        near = met_in_place(rows, asked.toArrow(), pivots, cells, schema, k, key, embedding)
        return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", key))).where(F.col("rank") <= k)

    routed = cut(route_queries(asked, pivots, cells, k, embedding).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20))))
    blocks = {(r["dims"], r["cell"]): -(-r["n"] // QUERY_BLOCK) for r in routed.groupBy("dims", "cell").agg(F.count("*").alias("n")).collect()}
    # A row for each cell that some query goes to: no more than there are pivots.
    plan = spark.createDataFrame([(d, c, int(parts[d, c]), int(b)) for (d, c), b in blocks.items()], "dims int, cell int, parts int, blocks int")
    left = placed.join(F.broadcast(plan), ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64(key), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = routed.join(F.broadcast(plan), ["dims", "cell"]).withColumn("block", F.pmod("_b", "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    group = ["dims", "cell", "part", "block"]

    def meet(held: pa.Table, come: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": come["query_id"].slice(0, 0), key: held[key].slice(0, 0), "dist": pa.array([], pa.float64())})
        if not held.num_rows or not come.num_rows:
            return empty
        away = held["away"].to_numpy()
        # None of the group's queries can have what lies outside all of their rings.
        near = (away >= come["lo"].to_numpy().min()) & (away <= come["hi"].to_numpy().max())
        rows_, dims = held.filter(pa.array(near)).select([key, embedding]).combine_chunks(), held["dims"][0].as_py()
        best = Nearest(come["query_id"].combine_chunks(), _matrix(come[embedding].combine_chunks(), dims), k)
        for part in rows_.to_batches():
            for i, n in _blocks(part.num_rows, dims):
                some = part.slice(i, n)
                best.add(some.column(0), _matrix(some.column(1), dims))
        out = best.result()
        return pa.Table.from_batches([out]).rename_columns(["query_id", key, "dist"]) if out else empty

    near = left.select(*group, key, embedding, "away").groupBy(*group).cogroup(right.select(*group, "query_id", embedding, "lo", "hi").groupBy(*group)).applyInArrow(meet, schema)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", key))).where(F.col("rank") <= k)


def met_in_place(rows: DataFrame, asked: pa.Table, pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, float, list[float]]], schema: str, k: int, key: str, embedding: str) -> DataFrame:
    """(query_id, key, dist): the k nearest rows of each task to the queries asked, of which every task holds all.

    Vectors are placed again as they are read, and each meets the queries that
    go to its cell, within their rings. One between two pivots may come to the
    other one than before, by rounding; where that shows, as its distance is not
    between those known of the cell, it meets all queries.
    """
    held: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]] = {}
    rings: dict[int, tuple[np.ndarray, ...]] = {}
    few: dict[tuple[int, int], np.ndarray] = {}
    for batch in asked.combine_chunks().to_batches():
        for dims, part in _by_length(batch):
            at, cell, lo, hi, least = _route(part, dims, pivots, cells, k)
            with np.errstate(over="ignore"):
                most = least**2 * (1 + SLACK) + SLACK
            held[dims] = part.column(0), _matrix(part.column(1), dims), np.where(np.isfinite(most), most, np.nan)
            # By cell, with those of STRAY and -1 at the end: distances known, queries' rings, and whether none, some or all queries come.
            n = len(pivots.get(dims, ()))
            span = np.array([cells.get((dims, c), (np.inf, -np.inf))[:2] for c in [*range(n), STRAY, -1]], float)
            ring, comes = np.tile([-np.inf, np.inf], (n + 2, 1)), np.zeros(n + 2, int)
            comes[STRAY] = 2
            order = np.argsort(cell, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                c = int(cell[mine[0]])
                ring[c], comes[c] = (lo[mine].min(), hi[mine].max()), 2 if len(mine) == part.num_rows else 1
                if comes[c] == 1:
                    few[dims, c] = at[mine].astype(np.int32)
            rings[dims] = span, ring, comes

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dims: Nearest(ids, q, k, most) for dims, (ids, q, most) in held.items()}
        for batch in batches:
            for dims, part in _by_length(batch):
                for i, n in _blocks(part.num_rows if dims in held else 0, dims):
                    some = part.slice(i, n)
                    values = _matrix(some.column(1), dims)
                    cell, away = _cells(values, pivots.get(dims))
                    span, ring, comes = rings[dims]
                    cell[(away < span[cell, 0]) | (away > span[cell, 1])] = STRAY
                    near = (away >= ring[cell, 0]) & (away <= ring[cell, 1])
                    # Cells that all queries go to are one group.
                    groups = [(np.flatnonzero(near & (comes[cell] == 2)), None)]
                    groups += [(np.flatnonzero(near & (cell == c)), few[dims, c]) for c in np.unique(cell[near & (comes[cell] == 1)]).tolist()]
                    for mine, at in groups:
                        if len(mine):
                            best[dims].add(some.column(0).take(pa.array(mine)), values[mine], at)
        for found in best.values():
            if (out := found.result()) is not None:
                yield pa.RecordBatch.from_arrays(out.columns, ["query_id", key, "dist"])

    return rows.mapInArrow(meet, schema)


def fuse(dense: DataFrame, lexical: DataFrame, top_k: int = K_LIST, key: str = "id", constant: int = RRF, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank, ...): (key, rrf_score, source, rank).

    A document in both lists is reported as 'bm25'. Ties keep the dense list's
    order, then the lexical one's. by parts the input into rankings of their
    own; one that is in one list only is kept.
    """
    if by:
        both = dense.select(*by, key, F.col("rank").alias("d")).join(lexical.select(*by, key, F.col("rank").alias("l")), [*by, key], "full_outer")
        scored = _rrf(both, key, constant, by)
        place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rrf_score"), "_place"))
        return scored.withColumn("rank", place).where(F.col("rank") <= top_k).drop("_place")
    both = dense.select(key, F.col("rank").alias("d")).join(lexical.select(key, F.col("rank").alias("l")), key, "full_outer")
    scored = _rrf(both, key, constant)
    best = scored.orderBy(F.desc("rrf_score"), "_place").limit(top_k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("rrf_score"), "_place"))).drop("_place")


def _rrf(both: DataFrame, key: str, constant: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, rrf_score, source, _place) of joined ranks d and l."""
    score = F.coalesce(1 / (F.lit(constant) + F.col("d")), F.lit(0.0)) + F.coalesce(1 / (F.lit(constant) + F.col("l")), F.lit(0.0))
    source = F.when(F.col("l").isNotNull(), "bm25").otherwise("dense")
    return both.select(*by, key, score.alias("rrf_score"), source.alias("source"), F.coalesce("d", F.lit(1_000_000) + F.col("l")).alias("_place"))


def union_queries(lists: list[DataFrame]) -> DataFrame:
    """Passages of several queries with query_no; query order is kept."""
    out = None
    for i, df in enumerate(lists):
        df = df.withColumn("query_no", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dedup_passages(passages: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The first passage of each text, in the order given, nulls first.

    An aggregate: a text of a third of all rows is one row per task.
    """
    rest = [c for c in passages.columns if c != text]
    place = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])
    return passages.groupBy(text).agg(F.min_by(F.struct(*rest), place).alias("_r")).select(*[F.col(c) if c == text else F.col(f"_r.{c}") for c in passages.columns])


def within_budget(ranked: DataFrame, budget: int = CONTEXT_CHARS, by: tuple[str, ...] = (), order: str = "rank", text: str = "text") -> DataFrame:
    """Whole passages while their characters fit; a first one that is too long is cut and marked.

    Separators do not count. by parts the input into contexts of their own.
    """
    w = W.partitionBy(*by).orderBy(order) if by else W.orderBy(order)
    total = F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.row_number().over(w) == 1
    marked = ranked.withColumns({"_total": total, "_first": first}).where((F.col("_total") <= budget) | F.col("_first"))
    return marked.withColumn(text, F.when(F.length(text) > budget, F.concat(F.left(text, F.lit(budget)), F.lit("..."))).otherwise(F.col(text))).drop("_total", "_first")


def build_context(ranked: DataFrame, budget: int | None = CONTEXT_CHARS, by: tuple[str, ...] = (), order: str = "rank", text: str = "text", sep: str = "\n\n") -> DataFrame:
    """One context string per group, of the passages that fit; budget None takes all."""
    rows = ranked if budget is None else within_budget(ranked, budget, by, order, text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), sep)
    return rows.groupBy(*by).agg(joined.alias("context"), F.count("*").alias("passages"))


def hash_codes(tokens: Column) -> Column:
    """A number of 36 bits for each token, from its MD5: bit 3 tells the sign, those above bit 3 the place."""
    return F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 9), 16, 10).cast("long"))


def hash_vectors(codes: pa.Array, dims: int) -> pa.Array:
    """Feature hashing of lists of codes, scaled to length 1; zero without tokens."""
    owner = pc.list_parent_indices(codes).to_numpy(zero_copy_only=False)
    code = codes.flatten().to_numpy(zero_copy_only=False)
    counts = np.bincount(owner * dims + (code >> 4) % dims, np.where(code & 8, 1.0, -1.0), len(codes) * dims).reshape(-1, dims)
    norm = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    values = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * dims, pa.int32()), pa.array(values.ravel()))


def embed(df: DataFrame, model: Callable[[list[list[str]]], list[list[float]]] | None = None, text: str = "text", dims: int = DIMS, strict: bool = False) -> DataFrame:
    """df with an embedding column.

    model turns a batch of at most MODEL_BATCH token lists into vectors; a
    failing batch gives zero vectors, or raises if strict; one of another size
    than its input always raises. The default hashes tokens and needs no
    network: they become numbers in the JVM, and these vectors, EMBED_ROWS at
    a time, without a Python object for each.
    """

    @F.arrow_udf("array<double>")
    def hashed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Vectors leave as they are made: an iterator's results need not be as long as what came in.
        for codes in parts:
            for i in range(0, len(codes), EMBED_ROWS):
                yield hash_vectors(codes.slice(i, EMBED_ROWS), dims)

    @F.pandas_udf("array<double>")
    def modelled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tokens in parts:
            every = [list(t) if t is not None else [] for t in tokens]
            found = []
            for i in range(0, len(every), MODEL_BATCH):
                batch = every[i : i + MODEL_BATCH]
                try:
                    out = model(batch)
                except Exception:  # noqa: BLE001 - any model failure
                    if strict:
                        raise
                    out = [[0.0] * dims for _ in batch]
                if len(out) != len(batch):
                    raise ValueError("the model returned another number of vectors")
                found += out
            yield pd.Series(found)

    tokens = tokenize(F.col(text))
    return df.withColumn("embedding", modelled(tokens) if model else hashed(hash_codes(tokens)))


def rerank(passages: DataFrame, query: str, top_k: int = K_FINAL, score: Callable[[Column, str], Column] | None = None, text: str = "text") -> DataFrame:
    """The passages that score best against the query; the default is the share of query tokens they hold."""
    if score is None:
        wanted = F.array_distinct(tokenize(F.lit(query)))
        value = F.size(F.array_intersect(tokenize(F.col(text)), wanted)) / F.greatest(F.size(wanted), F.lit(1))
    else:
        value = score(F.col(text), query)
    return passages.withColumn("rerank_score", value).orderBy(F.desc("rerank_score"), "rank").limit(top_k)


def rerank_all(passages: DataFrame, queries: DataFrame, top_k: int = K_FINAL, text: str = "text") -> DataFrame:
    """The passages that score best against each query (query_id, query), by the share of its tokens they hold.

    Passages with a query_id are those of that query; without one, each query
    ranks all of them: tokens meet in a join, so only passages that share a
    token with a query are counted, and texts are joined to the best alone.
    """
    wanted = queries.select("query_id", F.array_distinct(tokenize(F.col("query"))).alias("_wanted"))
    size = F.greatest(F.size("_wanted"), F.lit(1))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", *([] if "query_id" in passages.columns else ["_row"])))
    if "query_id" in passages.columns:
        pairs = passages.withColumn("_tokens", F.array_distinct(tokenize(F.col(text)))).join(wanted, "query_id")
        value = F.size(F.array_intersect("_tokens", "_wanted")) / size
        return pairs.withColumn("rerank_score", value).drop("_tokens", "_wanted").withColumn("_n", place).where(F.col("_n") <= top_k).drop("_n")
    rows = cut(passages.withColumn("_row", F.monotonically_increasing_id()))
    tokens = rows.select("_row", "rank", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("_token"))
    asked = wanted.select("query_id", size.alias("_size"), F.explode("_wanted").alias("_token"))
    held = tokens.join(asked, "_token").groupBy("query_id", "_row").agg(F.first("rank").alias("rank"), (F.count("*") / F.first("_size")).alias("rerank_score"))
    best = cut(held.withColumn("_n", place).where(F.col("_n") <= top_k).drop("_n"))
    # A query that fewer share a token with goes on with the first of the others: they are among the first 2 * top_k of all.
    short = queries.select("query_id").distinct().join(best.groupBy("query_id").count().where(F.col("count") >= top_k), "query_id", "left_anti")
    first = rows.select("_row", "rank").orderBy("rank", "_row").limit(2 * top_k)
    others = short.crossJoin(F.broadcast(first)).join(best.select("query_id", "_row"), ["query_id", "_row"], "left_anti")
    best = best.unionByName(others.withColumn("rerank_score", F.lit(0.0))).withColumn("_n", place).where(F.col("_n") <= top_k)
    return rows.join(best.select("query_id", "_row", "rerank_score"), "_row").drop("_row")
