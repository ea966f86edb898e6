"""Numbers, units and frequency ranges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

#: A plain decimal number, as Python's float() reads it.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_decimal(c: Column) -> Column:
    """Number with a decimal comma or point; null for anything else."""
    plain = strip(F.replace(c, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def parse_edges(low: Column, high: Column) -> tuple[Column, Column]:
    """Both edges of a range, or null for both if one of them is no number."""
    a, b = parse_decimal(low), parse_decimal(high)
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def parse_band(c: Column) -> Column:
    """'9 kHz - 110 kHz' to an array of both edges in MHz, or null.

    Text behind | and spaces are ignored. Each side is a number and a unit of
    three letters; kHz, MHz and GHz are known in any case, others give a
    negative value. Malformed: null.
    """
    sides = F.split(F.replace(F.split(c, r"\|").getItem(0), F.lit(" "), F.lit("")), "-")

    def edge(s: Column) -> Column:
        pattern = r"^([+]?(?:\d+[.,]?\d*|[.,]\d+))(\D{3})$"
        number = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        unit = F.lower(F.regexp_extract(s, pattern, 2))
        scale = F.when(unit == "khz", 1e-3).when(unit == "mhz", 1.0).when(unit == "ghz", 1e3).when(unit != "", -1.0)
        return number * scale

    a, b = edge(sides.getItem(0)), edge(F.get(sides, F.lit(1)))
    return F.when((F.size(sides) == 2) & a.isNotNull() & b.isNotNull(), F.array(a, b))


def shown_number(c: Column) -> Column:
    """A double as it is usually written: 5.0, 0.009, 0.00005; no exponent from 1e-12 to 1e15."""
    digits = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(c) < 1e15) & ((F.abs(c) > 1e-12) | (c == 0)), digits).otherwise(c.cast("string"))


def parse_frequency(c: Column) -> Column:
    """Leading number times its unit in MHz: kHz, MHz or none, GHz (case matters); NaN without a number.

    Only the first comma is read as a decimal point.
    """
    s = F.regexp_replace(c, r"^([^,]*),", "$1.")
    number = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    scale = F.when(F.contains(c, F.lit("kHz")), 1e-3).when(F.contains(c, F.lit("GHz")), 1e3).otherwise(1.0)
    return F.coalesce(number * scale, F.lit(float("nan")))


def plain_number(c: Column) -> Column:
    """A double without a needless fraction: 5.0 is '5'."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def format_frequency(mhz: Column) -> Column:
    """GHz from 1000 MHz, MHz from 1, kHz from 0.001, else Hz; two decimals but for MHz."""
    return (
        F.when(mhz >= 1000, F.format_string("%.2f GHz", mhz / 1000))
        .when(mhz >= 1, F.concat(plain_number(mhz), F.lit(" MHz")))
        .when(mhz >= 0.001, F.format_string("%.2f kHz", mhz * 1000))
        .otherwise(F.format_string("%.2f Hz", mhz * 1_000_000))
    )


def format_edge(mhz: Column) -> Column:
    """Three decimals."""
    return F.format_string("%.3f", mhz)


def parse_interval(c: Column) -> Column:
    """'X<f≤Y', 'f≤Y' or 'X<f' to a struct (from, to) with null for an open side; null if none fits."""
    s = F.replace(F.replace(c, F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    number = r"(\d+(?:\.\d+)?)"
    low = F.regexp_extract(s, number + r"[A-Za-z]*<f", 1).try_cast("double")
    high = F.regexp_extract(s, r"f≤" + number, 1).try_cast("double")
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("from"), high.alias("to")))


def parse_range_query(c: Column) -> Column:
    """'X-Y unit' (any case, MHz by default) to a struct (min, max) in MHz; null unless min < max."""
    pattern = r"(?i)^\s*([\d.]+)\s*-\s*([\d.]+)\s*(khz|mhz|ghz)?\s*$"
    unit = F.lower(F.regexp_extract(c, pattern, 3))
    scale = F.when(unit == "khz", 1e-3).when(unit == "ghz", 1e3).otherwise(1.0)
    a = F.regexp_extract(c, pattern, 1).try_cast("double") * scale
    b = F.regexp_extract(c, pattern, 2).try_cast("double") * scale
    return F.when(a < b, F.struct(a.alias("min"), b.alias("max")))


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def centre_width(low: Column, high: Column) -> Column:
    return F.struct(((low + high) / 2).alias("centre"), (high - low).alias("width"))


def zoomed(low: Column, high: Column, factor: float, at: Column, least: Column, most: Column) -> Column:
    """A range (low, high) scaled around a value by a factor and kept within (least, most)."""
    return F.struct(clamp(at - (at - low) * factor, least, most).alias("low"), clamp(at + (high - at) * factor, least, most).alias("high"))


def shifted(low: Column, high: Column, by: Column, least: Column, most: Column) -> Column:
    """A range moved by a distance, as far as (least, most) has room for; its width stays."""
    by = clamp(by, least - low, most - high)
    return F.struct((low + by).alias("low"), (high + by).alias("high"))
