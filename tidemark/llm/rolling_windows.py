"""Rolling window features from panes of a minute.

1. Rows are pre-aggregated per key and pane: number of rows, sum of values,
   set of labels, and a histogram of values, sorted. Equal values of a pane
   are one entry, so copies shrink before they move.
2. Panes are dealt by key and block, a stretch of time as long as the longest
   window. A window that ends in a block begins in it or in the block before,
   so every pane goes to its own block and the next: two copies, whatever the
   windows' number and length. A key of a third of all rows is thus as many
   groups as there are blocks in its time, and no group grows with the input.
3. Within a block, running sums over the panes give a window's count and sum
   as differences. The panes' histograms, summed up along the time, give a
   window's histogram as a difference of two, and summed up along the values
   they give ranks: a quantile is where the sum reaches its rank. Histograms
   are read in slices of values, so that a slice of all panes fits in memory.
4. The features of a key's panes are joined to its rows by key and pane.

Shuffles carry no texts; their partitions are numbered, so that adaptive
execution doesn't gather these short rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a pane, and of the windows.
PANE, WINDOWS = 60, (3600, 21600)
#: Quantiles: name and per cent; of m values, ascending, number ceil(m * per cent / 100).
QUANTILES = (("median", 50), ("high", 75))
#: Cells of a slice of histograms.
CELLS = 1 << 20


def whole(number: Column, by: int) -> Column:
    """floor(number / by), exact for all longs."""
    return F.call_function("div", number - F.pmod(number, F.lit(by)), F.lit(by))


def panes(rows: DataFrame) -> DataFrame:
    """(key, pane, n, total, labels, sizes, counts) from (key, pane, value, label); the histogram's two arrays are by ascending value (values with several labels stand there once for each)."""
    # Entries before panes: copies of one row, and a pane with a third of all rows, are spread by value and summed up before they move.
    entries = rows.groupBy("key", "pane", "value", "label").agg(F.count("*").alias("n"))
    valued = F.when(F.col("value").isNotNull(), F.struct("value", "n"))
    found = entries.groupBy("key", "pane").agg(
        F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total"), F.collect_set("label").alias("labels"), F.sort_array(F.collect_list(valued)).alias("h")
    )
    return found.select("key", "pane", "n", F.coalesce("total", F.lit(0)).alias("total"), "labels", F.col("h.value").alias("sizes"), F.col("h.n").alias("counts"))


def cumulative(pane_of: np.ndarray, column: np.ndarray, weight: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of weights over the panes before each, one column for each value: shape (panes + 1, values)."""
    grid = np.zeros((shape[0] + 1, shape[1]), np.int64)
    np.add.at(grid, (pane_of + 1, column), weight)
    return np.cumsum(grid, axis=0, out=grid)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(pane of each entry, entries) of a column of lists; entries stay dictionary codes for strings."""
    lists = column.combine_chunks()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.dictionary_encode().indices
    return owner, values.to_numpy(zero_copy_only=False)


def slices(n_panes: int, n_values: int, cells: int) -> list[tuple[int, int]]:
    width = max(1, cells // (n_panes + 1))
    return [(a, min(a + width, n_values)) for a in range(0, n_values, width)]


def distinct_in(owner: np.ndarray, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_panes: int, cells: int) -> np.ndarray:
    """Number of different codes of the panes lo to hi - 1, for each such pair."""
    total = np.zeros(len(lo), np.int64)
    for a, b in slices(n_panes, int(code.max()) + 1 if len(code) else 0, cells):
        own = (code >= a) & (code < b)
        sums = cumulative(owner[own], code[own] - a, np.ones(own.sum(), np.int64), (n_panes, b - a))
        total += (sums[hi] > sums[lo]).sum(axis=1)
    return total


def ranked_in(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_panes: int, percents: Sequence[int], cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of values, quantiles) of the panes lo to hi - 1, for each such pair; a quantile of no values is 0."""
    domain, place = np.unique(value, return_inverse=True)
    before, m = np.zeros(len(lo), np.int64), np.zeros(n_panes + 1, np.int64)
    np.add.at(m, owner + 1, weight)
    m = np.cumsum(m)
    m = m[hi] - m[lo]
    ranks = [-(-m * p // 100) for p in percents]
    found = [np.zeros(len(lo), np.int64) for _ in percents]
    for a, b in slices(n_panes, len(domain), cells):
        own = (place >= a) & (place < b)
        sums = cumulative(owner[own], place[own] - a, weight[own], (n_panes, b - a))
        # Windows in slices as well: one row of the merged histogram each.
        for i in range(0, len(lo), n_panes + 1):
            q = slice(i, i + n_panes + 1)
            merged = np.cumsum(sums[hi[q]] - sums[lo[q]], axis=1) + before[q, None]
            for rank, out in zip(ranks, found):
                at = (merged < rank[q, None]).sum(axis=1)
                here = (rank[q] > before[q]) & (at < b - a)
                out[q][here] = domain[a + at[here]]
            before[q] = merged[:, -1]
    return m, found


def features_of(group: pa.Table, spans: Sequence[int], percents: Sequence[int], cells: int) -> dict[str, np.ndarray]:
    """Features of the windows that end at the group's own panes; spans are the windows' numbers of panes."""
    group = group.sort_by("pane")
    at = group["pane"].to_numpy()
    ends = at[group["own"].to_numpy(zero_copy_only=False)]
    span = np.repeat(np.array(spans, np.int64), len(ends))
    ends = np.tile(ends, len(spans))
    lo, hi = np.searchsorted(at, ends - span), np.searchsorted(at, ends)
    rows, total = (np.concatenate([[0], np.cumsum(group[name].to_numpy())]) for name in ("n", "total"))
    owner, value = flat(group["sizes"])
    m, quantiles = ranked_in(owner, value, flat(group["counts"])[1], lo, hi, len(at), percents, cells)
    return {
        "pane": ends,
        "span": span,
        "n_events": rows[hi] - rows[lo],
        "total": total[hi] - total[lo],
        "n_labels": distinct_in(*flat(group["labels"]), lo, hi, len(at), cells),
        "n_values": m,
        **{f"q{i}": q for i, q in enumerate(quantiles)},
    }


def window_features(
    events: DataFrame,
    key: str,
    time: str | Column,
    value: str | Column,
    label: str,
    windows: Sequence[int] = WINDOWS,
    pane: int = PANE,
    quantiles: Sequence[tuple[str, int]] = QUANTILES,
    partitions: int | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """Two or more rows per row: the event's columns, event_s, window_s, n_events, n_values, total, n_labels and one column for each quantile.

    A row's event_s is its time cut to whole panes; the window before it holds
    the rows of its key with event_s - window <= their time < event_s, so not
    its own pane. windows must be whole numbers of panes. A null key is one
    key. A null value counts as a row only, a null label is none; of no values
    the total is 0 and quantiles are null. A row without time is in no window,
    and its own are empty. Equal times are in one pane, so neither sees the
    other; repeated rows count as often as they stand there, and get equal
    results. No rows give none. The result's names replace columns of the
    events that have them. Texts may be long: only value, label and times move.
    """
    if any(w % pane or w <= 0 for w in windows):
        raise ValueError(f"windows must be whole numbers of panes of {pane} seconds")
    spark = events.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = ("event_s", "window_s", "n_events", "n_values", "total", "n_labels", *(name for name, _ in quantiles))
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    place = whole(as_column(time).cast("long"), pane)
    block = max(windows) // pane
    key_type = events.select(key).schema[0].dataType.simpleString()

    # As a struct a key is never null, and equal to itself in joins.
    wrapped = F.struct(F.col(key).alias("k"))
    small = events.select(wrapped.alias("key"), place.alias("pane"), as_column(value).cast("long").alias("value"), F.col(label).cast("string").alias("label")).where("pane IS NOT NULL")
    dealt = panes(small).withColumn("block", F.explode(F.array(whole(F.col("pane"), block), whole(F.col("pane"), block) + 1)))
    dealt = dealt.withColumn("own", whole(F.col("pane"), block) == F.col("block")).repartition(parts, "key", "block")

    spans, percents = [w // pane for w in windows], [p for _, p in quantiles]
    fields = ["pane", "span", "n_events", "total", "n_labels", "n_values", *(f"q{i}" for i in range(len(percents)))]

    def merge(group: pa.Table) -> pa.Table:
        found = features_of(group, spans, percents, cells)
        keys = group["key"].combine_chunks().field("k").take(pa.array(np.zeros(len(found["pane"]), np.int64)))
        return pa.table({"k": keys, **{f: pa.array(found[f], pa.int64()) for f in fields}})

    features = dealt.groupBy("key", "block").applyInArrow(merge, f"k {key_type}, " + ", ".join(f"{f} long" for f in fields))
    features = features.withColumn("key", F.struct("k")).drop("k").repartition(parts, "key", "pane")

    kept = [c for c in events.columns if c not in made]
    rows = events.select(*kept, wrapped.alias("_key"), place.alias("_pane")).withColumn("event_s", F.col("_pane") * pane)
    named = {"window_s": F.col("span") * pane, "n_events": F.col("n_events"), "n_values": F.col("n_values"), "total": F.col("total"), "n_labels": F.col("n_labels")}
    named |= {name: F.when(F.col("n_values") > 0, F.col(f"q{i}")) for i, (name, _) in enumerate(quantiles)}
    timed = rows.where("_pane IS NOT NULL").repartition(parts, "_key", "_pane")
    # Both sides grow with the input: never broadcast.
    joined = timed.join(features.hint("merge"), (F.col("_key") == F.col("key")) & (F.col("_pane") == F.col("pane")))
    # Rows without time join nothing: their windows are empty.
    none = {"n_events": 0, "n_values": 0, "total": 0, "n_labels": 0}
    untimed = rows.where("_pane IS NULL").withColumn("window_s", F.explode(F.array(*(F.lit(w).cast("long") for w in windows))))
    untimed = untimed.withColumns({name: F.lit(none.get(name)).cast("long") for name in made[2:]})
    out = [f"`{c}`" for c in kept] + list(made)
    return joined.withColumns({"_" + name: c for name, c in named.items()}).select(*(f"`{c}`" for c in kept), "event_s", *(F.col("_" + n).alias(n) for n in made[1:])).unionByName(untimed.select(*out))


def minute_of(doc_id: str = "doc_id") -> Column:
    """The time given to a document: 60 * floor((doc_id + crc32 of the id mod 4000) / 6)."""
    return 60 * whole(F.col(doc_id) + F.crc32(F.col(doc_id).cast("string")) % 4000, 6)


def op11_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the hour and the six hours before every document, within its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", "lang", F.length("text").cast("long").alias("chars"))
    found = window_features(rows, key="source", time=minute_of(), value="chars", label="lang")
    return found.select(
        "doc_id", "window_s", "event_s", "n_events", F.col("total").alias("sum_chars"), F.col("n_labels").alias("n_langs"), F.col("median").alias("median_chars"), F.col("high").alias("high_chars")
    )


#: DuckDB has no crc32: eight steps for each of the id's digits.
ORACLE = r"""
WITH placed AS (
  SELECT doc_id, source, lang, length(text) AS chars,
    60 * ((doc_id + list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
        lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)), lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
      ).xor(4294967295) % 4000) // 6) AS event_s
  FROM documents
),
win AS (SELECT doc_id, source, event_s, window_s FROM placed, (SELECT unnest([3600, 21600]) AS window_s)),
seen AS (
  SELECT w.doc_id, w.window_s, w.event_s, p.doc_id AS other, p.chars, p.lang
  FROM win AS w LEFT JOIN placed AS p ON p.source IS NOT DISTINCT FROM w.source AND p.event_s < w.event_s AND p.event_s >= w.event_s - w.window_s
),
agg AS (
  SELECT doc_id, window_s, event_s, count(other) AS n_events, coalesce(sum(chars), 0)::BIGINT AS sum_chars, count(DISTINCT lang) AS n_langs,
    list_sort(list(chars) FILTER (chars IS NOT NULL)) AS l
  FROM seen GROUP BY doc_id, window_s, event_s
)
SELECT doc_id, window_s::BIGINT AS window_s, event_s, n_events, sum_chars, n_langs, l[(len(l) + 1) // 2] AS median_chars, l[(75 * len(l) + 99) // 100] AS high_chars FROM agg
"""
