"""Bands: numeric ranges with a type, their overlap, domain, depth and levels."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, written

#: Domain of no bands, in MHz, and the least lower edge shown.
DOMAIN = (0.001, 10_000.0)
#: Attributes that a detail view hides, by what their lower-case name holds.
HIDDEN = ("id", ".a", "mhz")


def valid(start: str = "start", end: str = "end") -> Column:
    """Both edges are numbers and start < end. Spark orders NaN last, so it is excluded by name."""
    a, b = F.col(start), F.col(end)
    return F.coalesce((a < b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")), F.lit(False))


def overlapping(bands: DataFrame, low: float, high: float, types: list[str] | None = None) -> DataFrame:
    """Bands that touch the closed range; both predicates reach a Parquet scan."""
    out = bands.where((F.col("start") <= high) & (F.col("end") >= low))
    return out if types is None else out.where(F.col("type").isin(*types))


def overlap_join(bands: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """Every (band, range) pair that overlaps, for ranges (range_id, low, high).

    Both sides are cut into cells of the given width and meet in an equi-join
    on the cell; the pair is reported in the first cell that both share. A
    width near the usual band's length keeps the copies per row few.
    """

    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))

    left = bands.withColumn("_cell", cells("start", "end"))
    right = ranges.withColumn("_cell", cells("low", "high"))
    hit = (F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low"))
    first = F.col("_cell") == F.floor(F.greatest("start", "low") / width)
    return left.join(right, "_cell").where(hit & first).drop("_cell")


#: Cells of a level are twice as wide as those of the level below; edges further out count as the last cells' ones.
LEVELS = 52


def overlap_pairs(bands: DataFrame, ranges: DataFrame, width: float = 1.0) -> DataFrame:
    """Every (band, range) pair that overlaps, for bands (start, end) and ranges (low, high) of any lengths.

    A row is held at the level whose cells are as wide as it is long, by two
    or three of them, and looks for longer ones at the levels that the other side
    holds, in as many cells each. So a row has at most some 150 copies, however long
    it is, and meets at each level only rows about as long as its cells: the
    longer row of a pair holds, the shorter looks. Both edges belong to a
    row; rows with a null or NaN edge, or start above end, overlap nothing;
    infinite edges are allowed; equal rows give a pair each. width is that
    of the narrowest cells: the usual length of short rows. A column of ranges
    that bands have too gets the suffix _range. A crowded cell is
    dealt to several tasks by Spark's skew join.
    """
    far = width * 2.0**LEVELS

    def near(x: Column) -> Column:
        return F.greatest(F.least(x.cast("double"), F.lit(far)), F.lit(-far))

    def placed(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
        """(row, a, b, own): the row as a struct, its edges within the axis, and its level."""
        a, b = F.col(low), F.col(high)
        sound = rows.where((a <= b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")))
        own = F.ceil(F.log2(F.greatest((near(b) - near(a)) / width, F.lit(1.0)))).cast("int")
        return sound.select(F.struct("*").alias(name), near(a).alias(f"{name}_a"), near(b).alias(f"{name}_b"), own.alias(f"{name}_own"))

    def cell(x: Column, level: Column) -> Column:
        return F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), level)))

    def held(rows: DataFrame, name: str) -> DataFrame:
        level = F.col(f"{name}_own")
        return rows.withColumn("level", level).withColumn("cell", F.explode(F.sequence(cell(F.col(f"{name}_a"), level), cell(F.col(f"{name}_b"), level))))

    def looking(rows: DataFrame, name: str, levels: list[int], least: int) -> DataFrame:
        """A copy for each cell at the levels at least so far above the row's own."""
        wanted = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col(f"{name}_own") + least)
        seen = rows.withColumn("level", F.explode(wanted))
        return seen.withColumn("cell", F.explode(F.sequence(cell(F.col(f"{name}_a"), F.col("level")), cell(F.col(f"{name}_b"), F.col("level")))))

    left, right = placed(bands, "start", "end", "b"), placed(ranges, "low", "high", "r")
    levels = lambda rows, name: [r[0] for r in rows.select(f"{name}_own").distinct().collect()]  # noqa: E731 - at most LEVELS + 2
    hit = (F.col("b")["start"] <= F.col("r")["high"]) & (F.col("b")["end"] >= F.col("r")["low"])  # the edges themselves
    # A pair may share several cells: it is reported in the one where the later of both begins.
    once = F.col("cell") == cell(F.greatest("b_a", "r_a"), F.col("level"))
    longer_band = held(left, "b").join(looking(right, "r", levels(left, "b"), 0), ["level", "cell"]).where(hit & once)
    longer_range = looking(left, "b", levels(right, "r"), 1).join(held(right, "r"), ["level", "cell"]).where(hit & once)
    both = longer_band.select("b", "r").unionByName(longer_range.select("b", "r"))
    clash = set(bands.columns)
    return both.select("b.*", *[F.col("r")[c].alias(f"{c}_range" if c in clash else c) for c in ranges.columns])


#: Width of a slice of the axis in running sums.
SLICE = 64.0


def _before(rows: DataFrame, by: list[str], value, name: str) -> DataFrame:
    """(by, _slice, name): the aggregate value over all earlier slices, combined by max or sum; one row per slice."""
    fold, column = value
    parts = rows.groupBy(*by, "_slice").agg(fold(column).alias("_v"))
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*by, "_slice", fold("_v").over(earlier).alias(name))


def running_counts(values: DataFrame, asked: DataFrame, inclusive: bool, width: float = SLICE) -> DataFrame:
    """(x, n): how many values (x) are below each asked x, or not above it. Distinct asked values only.

    Equal values are counted before they move. The running sum passes over the
    distinct points in two steps, within slices of the axis and over the
    slices' totals, so no task sees the whole axis' points.
    """
    points = values.groupBy("x").agg(F.count("*").alias("d")).withColumn("_a", F.lit(0)).unionByName(asked.select("x").distinct().withColumns({"d": F.lit(0).cast("long"), "_a": F.lit(1)}))
    points = points.groupBy("x").agg(F.sum("d").alias("d"), F.max("_a").alias("_a")).where("x IS NOT NULL").withColumn("_slice", F.floor(F.col("x") / width))
    inside = W.partitionBy("_slice").orderBy("x").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    run = F.coalesce(F.sum("d").over(inside), F.lit(0))
    totals = _before(points.withColumn("_all", F.lit(0)), ["_all"], (F.sum, "d"), "_base").drop("_all")
    summed = points.withColumn("_run", run).where("_a = 1").join(totals, "_slice", "left")
    return summed.select("x", (F.col("_run") + F.coalesce("_base", F.lit(0))).alias("n"))


def overlap_counts(bands: DataFrame, ranges: DataFrame, width: float = SLICE) -> DataFrame:
    """(range_id, n): how many bands touch each range (range_id, low, high), for ranges that some band touches.

    A band touches unless it starts above or ends below, and none does both:
    two running counts, instead of the pairs.
    """
    begun = running_counts(bands.select(F.col("start").alias("x")), ranges.select(F.col("high").alias("x")), True, width)
    ended = running_counts(bands.select(F.col("end").alias("x")), ranges.select(F.col("low").alias("x")), False, width)
    counted = ranges.join(begun.select(F.col("x").alias("high"), F.col("n").alias("_b")), "high").join(ended.select(F.col("x").alias("low"), F.col("n").alias("_e")), "low")
    return counted.select("range_id", (F.col("_b") - F.col("_e")).alias("n")).where("n > 0")


def domain(bands: DataFrame) -> DataFrame:
    """(low, high): least start, at least 0.001, and largest end; the default domain without bands."""
    return bands.agg(F.greatest(F.lit(DOMAIN[0]), F.coalesce(F.min("start"), F.lit(DOMAIN[0]))).alias("low"), F.coalesce(F.max("end"), F.lit(DOMAIN[1])).alias("high"))


def depth(bands: DataFrame, by: str = "type") -> DataFrame:
    """(by, depth): most bands of a type that hold one point; touching edges do not overlap.

    Edges at one point are summed first, so the running sum passes over the
    distinct points. It runs in two steps: over slices of the axis, then over
    the slices' totals, so that one type does not end up in one task.
    """
    edges = bands.select(by, F.col("start").alias("x"), F.lit(1).alias("d")).unionByName(bands.select(by, F.col("end").alias("x"), F.lit(-1).alias("d")))
    points = edges.groupBy(by, "x").agg(F.sum("d").alias("d"))
    slices = points.withColumn("_slice", F.floor(F.col("x") / SLICE))
    inside = W.partitionBy(by, "_slice").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    parts = slices.withColumn("_run", F.sum("d").over(inside)).groupBy(by, "_slice").agg(F.max("_run").alias("_peak"), F.sum("d").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_peak", F.col("_peak") + before).groupBy(by).agg(F.max("_peak").alias("depth"))


def islands(bands: DataFrame, by: str = "type", key: str = "id", slices: Column | None = None) -> DataFrame:
    """bands with _island, the start of the run of bands without a gap that each is in.

    What reaches into a slice of the axis from earlier ones is found from one
    row per slice, so a type is not sorted in one task. slices numbers the
    slices in the order of (start, key), by default by widths of SLICE.
    """
    rows = bands.withColumn("_slice", F.floor(F.col("start") / SLICE) if slices is None else slices)
    inside = W.partitionBy(by, "_slice").orderBy("start", key)
    reach = F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1))
    # Columns of joined tables get names of their own, so that bands may have any.
    rows = rows.join(_before(rows, [by], (F.max, "end"), "_reach").withColumnsRenamed({by: "_by", "_slice": "_s"}), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_s")), "left").drop("_by", "_s")
    reach = F.greatest("_reach", reach)  # skips nulls
    rows = rows.withColumn("_fresh", F.when(reach.isNull() | (F.col("start") >= reach), F.col("start"))).drop("_reach")
    rows = rows.join(_before(rows, [by], (F.max, "_fresh"), "_old").withColumnsRenamed({by: "_by", "_slice": "_s"}), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_s")), "left").drop("_by", "_s")
    latest = F.coalesce(F.max("_fresh").over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_old"))
    return rows.withColumn("_island", latest).drop("_slice", "_fresh", "_old")


#: Bands of an island that a task places at most, about, and parts that the axis is cut into for so many.
PIECE, FINER = 2_000_000, 4


def _first_fit(rows: DataFrame, columns: list[T.StructField], by: str, key: str) -> DataFrame:
    """(columns, _island, level) of the rows of islands without level; those with one are bands still open from pieces before, and only taken note of."""
    names = [*(f.name for f in columns), "_island", "level"]
    schema = T.StructType([*columns, T.StructField("_island", rows.schema["_island"].dataType), T.StructField("level", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        open_ends: list[tuple[float, int]] = []  # levels in use, by their end
        free: list[int] = []
        old: set[int] = set()
        for batch in batches:
            levels = []
            read = lambda name: batch.column(name).to_pylist()
            for island, start, end, known in zip(zip(read(by), read("_island")), read("start"), read("end"), read("level")):
                if island != now:
                    now, used, open_ends, free, old = island, 0, [], [], set()
                if known is not None:
                    heapq.heappush(open_ends, (end, known))
                    old.add(known)
                    continue
                if old:
                    used = max(old) + 1
                    free, old = sorted(set(range(used)) - old), set()
                while open_ends and open_ends[0][0] <= start:
                    heapq.heappush(free, heapq.heappop(open_ends)[1])
                level = heapq.heappop(free) if free else used
                used += level == used
                heapq.heappush(open_ends, (end, level))
                levels.append(level)
            own = batch.filter(batch.column("level").is_null())
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[:-1]), pa.array(levels, pa.int32())], names)

    ordered = rows.repartition(by, "_island").sortWithinPartitions(by, "_island", F.col("level").isNull(), "start", key)
    return ordered.mapInArrow(place, schema)


def assign_levels(bands: DataFrame, by: str = "type", key: str = "id", piece: int = PIECE) -> DataFrame:
    """bands with level: the lowest level of its type whose last band has ended when it starts.

    Bands are taken by start, then key; touching edges share a level; columns
    level, _island and _part are replaced. First fit depends on all earlier bands, but
    only through the levels' last ends: gaps that no band covers cut a type
    into independent islands, which go to different tasks. An island of more
    than piece bands is placed piece by piece, one after another, and the
    levels of the bands that are open at a piece's end go on to the next; so a
    task sorts a piece, not the island, and holds an Arrow batch and the open
    levels. The axis is cut into parts by samples of (type, start, key). The
    driver gets a row for each part.
    """
    bands = bands.drop("level", "_island", "_part")
    spark, columns, unplaced = bands.sparkSession, bands.schema.fields, F.lit(None).cast("int").alias("level")
    n = bands.count()
    if n <= piece:
        return _first_fit(islands(bands, by, key).select("*", unplaced), columns, by, key).drop("_island")
    # Written at once: a range partition that is made twice may be cut elsewhere.
    split = cut(bands.repartitionByRange(-(-n * FINER // piece), by, "start", key).withColumn("_part", F.spark_partition_id()))
    rows = cut(islands(split, by, key, F.col("_part")).select("*", unplaced))
    island = F.struct(F.col(by).alias("by"), F.col("_island").alias("at"))
    # The first and the last island of each part, and where its share of the first one starts.
    parts = cut(rows.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.struct(island.alias("island"), F.col("start").alias("start"))).alias("lo"), F.max(island).alias("hi")))
    later: dict[int, list[int]] = {}
    step, filled, before = 0, 0, None
    for r in sorted(parts.collect(), key=lambda r: r["_part"]):
        if goes_on := before is not None and r["lo"]["island"] == before:
            step, filled = (step, filled + r["n"]) if filled + r["n"] <= piece else (step + 1, r["n"])
            if step:
                later.setdefault(step, []).append(r["_part"])
        if not goes_on or r["lo"]["island"] != r["hi"]:
            step, filled = 0, r["n"]
        before = r["hi"]
    first = parts.select("_part", F.col("lo.island").alias("_lo"), F.col("lo.start").alias("_from"))
    known = rows.join(F.broadcast(first.drop("_from")), "_part")
    waits = F.col("_part").isin([p for some in later.values() for p in some]) & island.eqNullSafe(F.col("_lo"))
    paths = [written(_first_fit(known.where(~waits).drop("_part", "_lo"), columns, by, key))]
    still = None
    for step in sorted(later):
        placed = spark.read.parquet(paths[-1]).select(by, "_island", "end", "level")
        following = first.where(F.col("_part").isin(later[step])).groupBy("_lo").agg(F.min("_from").alias("_from"))
        seen = placed if still is None else placed.unionByName(still)
        still = cut(seen.join(F.broadcast(following), island.eqNullSafe(F.col("_lo")) & (F.col("end") > F.col("_from"))).select(by, "_island", "end", "level"))
        own = known.where(F.col("_part").isin(later[step]) & island.eqNullSafe(F.col("_lo"))).drop("_part", "_lo")
        paths.append(written(_first_fit(own.unionByName(still, allowMissingColumns=True), columns, by, key)))
    return spark.read.schema(T.StructType([*columns, T.StructField("level", T.IntegerType())])).parquet(*paths)


def level_counts(placed: DataFrame, by: str = "type") -> DataFrame:
    """(by, levels): number of levels per type."""
    return placed.groupBy(by).agg((F.max("level") + 1).alias("levels"))


def details(raw: Column, names: dict[str, str] | None = None) -> Column:
    """Entries of an attribute map without hidden names and empty values, some renamed."""
    shown = F.map_filter(raw, lambda k, v: v.isNotNull() & (v != "") & ~F.lower(k).rlike("|".join(h.replace(".", r"\.") for h in HIDDEN)))

    def renamed(k: Column, _: Column) -> Column:
        for old, new in (names or {}).items():
            k = F.when(k == old, F.lit(new)).otherwise(k)
        return k

    return F.map_entries(F.transform_keys(shown, renamed))


def layout(placed: DataFrame, low: float, high: float, length: float, thickness: float, by: str = "type") -> DataFrame:
    """Pixel box of each placed band on a logarithmic axis: x, width, y, height within its type's strip."""
    counts = level_counts(placed, by)

    def at(c: str) -> Column:
        return F.log(F.col(c) / low) / F.log(F.lit(high / low)) * length

    height = F.lit(thickness) / F.col("levels")
    return placed.join(counts, by).withColumns({"x": at("start"), "width": at("end") - at("start"), "y": F.col("level") * height, "height": height})
