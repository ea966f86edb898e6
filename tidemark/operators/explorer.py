"""Band explorer: bands of three sources, their levels, domain, overlap query and boxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import format_edge, parse_frequency, parse_range_query
from tidemark.operators import bands

#: Characters of a label that a line shows.
LABEL = 100
#: Source of each type: from and to, and what may serve as label.
PLAN = ("Plan", "fromMhz", "toMhz", ("usageDescriptionDescription",))
EXEMPTION = ("Undantag", "fromMhz", "toMhz", ("usageDescriptionLicenseExcemptionUsageDescription",))
DIRECTION = ("Inriktning", "Från (MHZ)", "Till (MHZ)", ("Populärnamn", "Användning idag"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(raw): the attributes of each JSON object of a file that holds a list, null and nested values as text."""
    rows = spark.read.text(path, wholetext=True)
    each = rows.select(F.explode(F.variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
    return each.select(F.variant_get("v", "$", "map<string,string>").alias("raw"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(raw): the attributes of each row of a comma-separated file with a header."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("raw"))


def as_bands(rows: DataFrame, layout: tuple) -> DataFrame:
    """(type, start, end, label, raw) of attribute maps; rows without two numbers in order are dropped."""
    kind, low, high, labels = layout
    edge = lambda name: parse_frequency(F.col("raw")[name])
    label: list[Column] = [F.nullif(F.col("raw")[name], F.lit("")) for name in labels]
    found = rows.select(F.lit(kind).alias("type"), edge(low).alias("start"), edge(high).alias("end"), F.coalesce(*label, F.lit(kind)).alias("label"), "raw")
    return found.where(bands.valid())


def tooltip() -> Column:
    """A band in a line: the first LABEL characters of its label, and its edges with three decimals."""
    return F.concat(F.left("label", F.lit(LABEL)), F.lit(" ("), format_edge(F.col("start")), F.lit(" - "), format_edge(F.col("end")), F.lit(" MHz)"))


def load(spark: SparkSession, plan: str | None = None, exemptions: str | None = None, direction: str | None = None) -> DataFrame:
    """Bands of the sources given, each with a stable id."""
    parts = [as_bands(read(spark, path), layout) for read, path, layout in ((read_objects, plan, PLAN), (read_objects, exemptions, EXEMPTION), (read_table, direction, DIRECTION)) if path]
    if not parts:
        return spark.createDataFrame([], "type string, start double, end double, label string, raw map<string,string>, id string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return identified(out)


def identified(found: DataFrame) -> DataFrame:
    """Bands with id: a digest of all they hold, so that equal bands have equal ids."""
    return found.withColumn("id", F.md5(F.concat_ws("|", "type", F.col("start").cast("string"), F.col("end").cast("string"), "label", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("raw")))))))


@dataclass
class View:
    """What the explorer shows: bands, placed bands, number of levels by type, domain."""

    shown: DataFrame
    placed: DataFrame
    levels: DataFrame
    domain: DataFrame

    def boxes(self, length: float, thickness: float) -> DataFrame:
        """Box of each band on a logarithmic axis over the domain."""
        low, high = self.domain.first()
        return bands.layout(self.placed, low, high, length, thickness)

    def matches(self, query: str) -> DataFrame | None:
        """Bands that touch the range 'X-Y unit'; None if the query is no range."""
        asked = self.shown.sparkSession.range(1).select(parse_range_query(F.lit(query)).alias("q")).first()["q"]
        return None if asked is None else bands.overlapping(self.shown, asked["min"], asked["max"])


def view(found: DataFrame, types: list[str] | None = None) -> View:
    """The view of the bands of the active types; None takes all. A type without bands has one level."""
    shown = found if types is None else found.where(F.col("type").isin(*types))
    # First fit needs as many levels as bands lie over one point; so levels are counted, and bands found, without placing any.
    levels = bands.depth(shown).select("type", F.col("depth").cast("int").alias("levels"))
    if types is not None:
        every = found.sparkSession.createDataFrame([(t,) for t in types], "type string")
        levels = every.join(levels, "type", "left").select("type", F.coalesce("levels", F.lit(1)).alias("levels"))
    return View(shown, bands.assign_levels(shown), levels, bands.domain(shown))
