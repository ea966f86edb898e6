"""CSV files read in byte ranges by many tasks.

Spark's text source cuts files into ranges and gives whole lines, from any
store. Whether a line begins inside a quoted cell depends on all lines before
it, but only by one bit for each separator that the file may have. So a range
is a map from that bit at its start to the bit at its end and the number of
records ended in it: one pass makes the maps, composing them in order tells
where each range starts, and a second pass parses its lines. Lines of records
that span lines are put together by a group, all others where they are read.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources.files import ROWS

SEPARATORS = ";,\t"
#: What a range may start with: a separator, and whether a quoted cell is open.
STARTS = [(sep, quoted) for sep in SEPARATORS for quoted in (False, True)]
#: Lines that a worker hands over at a time, and characters after which it does so early.
BATCH, BATCH_CHARS = 2000, 4 << 20
#: A cell may be as long as a text can be.
LONGEST_CELL = (1 << 31) - 1
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')

_LINES = "path string, start long, n long, value string, opened int, after int, record array<long>"
_RANGES = "path string, start long, after int, ended array<long>, sep int, head array<string>"
_PLACED = "path string, start long, quoted int, before long, sep int, head array<string>"


def ends_quoted(line: str, sep: str, quoted: bool) -> bool:
    """Whether a line that starts inside a quoted cell, or not, ends inside one. A quote opens a cell only as its first character."""
    at = 0
    while '"' in line[at:] if at else '"' in line:
        if not quoted:
            if line[at] != '"':
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = _QUOTED.match(line, at).end() + 1
        if at > len(line):
            return True
        quoted = False
        at = line.find(sep, at) + 1
        if not at:
            return False
    return quoted


@dataclass
class Range:
    """What is known of a range's lines so far, for each of STARTS."""

    path: str
    start: int
    open: list[bool] = field(default_factory=lambda: [quoted for _, quoted in STARTS])
    ended: list[int] = field(default_factory=lambda: [0] * len(STARTS))
    first: dict[str, list[str]] = field(default_factory=lambda: {sep: [] for sep in SEPARATORS})
    n: int = 0

    def add(self, line: str) -> None:
        blank = line in ("", "\r")
        has = '"' in line
        for i, (sep, quoted) in enumerate(STARTS):
            was = self.open[i]
            if self.start == 0 and not quoted and not self.ended[i] and (was or not blank):
                self.first[sep].append(line)
            if has:
                self.open[i] = ends_quoted(line, sep, was)
            if not self.open[i] and (was or not blank):
                self.ended[i] += 1
        self.n += 1

    def head(self) -> tuple[int, list[str]]:
        """The first separator that gives several columns, else the last one, and the first record."""
        for i, sep in enumerate(SEPARATORS):
            cells = parse("\n".join(self.first[sep]), sep)
            if len(cells) > 1:
                break
        return i, cells


def bits(flags: list[bool]) -> int:
    return sum(1 << i for i, f in enumerate(flags) if f)


def parse(record: str, sep: str) -> list[str]:
    csv.field_size_limit(LONGEST_CELL)
    return next(csv.reader([record], delimiter=sep), [])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, str | None]]:
    """(range, line) of every line, before the line is added; (range, None) at a range's end."""
    now: Range | None = None
    for batch in batches:
        for path, start, raw in zip(*(batch.column(i) for i in range(3))):
            path, start = path.as_py(), start.as_py()
            line = raw.as_py().decode("utf-8", "replace")
            if now is None or (now.path, now.start) != (path, start):
                if now is not None:
                    yield now, None
                now = Range(path, start)
                if start == 0:
                    line = line.removeprefix("﻿")
            yield now, line
    if now is not None:
        yield now, None


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of _RANGES for each range of a task."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("after", pa.int32()), ("ended", pa.list_(pa.int64())), ("sep", pa.int32()), ("head", pa.list_(pa.string()))])
    for now, line in walk(batches):
        if line is not None:
            now.add(line)
        else:
            sep, head = now.head() if now.start == 0 else (None, None)
            yield pa.RecordBatch.from_pylist([{"path": now.path, "start": now.start, "after": bits(now.open), "ended": now.ended, "sep": sep, "head": head}], schema)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_LINES: every line with its number in the range, and for each of STARTS the bit before and behind it and its record in the range. Blank lines outside of cells are left out."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("value", pa.string()), ("opened", pa.int32()), ("after", pa.int32()), ("record", pa.list_(pa.int64()))])
    out, chars = [], 0
    for now, line in walk(batches):
        if line is None:
            continue
        n, opened, record = now.n, bits(now.open), list(now.ended)
        now.add(line)
        out.append({"path": now.path, "start": now.start, "n": n, "value": line, "opened": opened, "after": bits(now.open), "record": record})
        chars += len(line)
        if len(out) >= BATCH or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def composed(ranges: pa.Table) -> pa.Table:
    """_PLACED: where each range of one file starts. A row for a range, so a file of 10 TB has some 80,000 of them."""
    rows = sorted(ranges.to_pylist(), key=lambda r: r["start"])
    sep, head = rows[0]["sep"], rows[0]["head"]
    quoted, before, out = 0, 0, []
    for r in rows:
        out.append({"path": r["path"], "start": r["start"], "quoted": quoted, "before": before, "sep": sep, "head": head})
        i = 2 * sep + quoted
        quoted, before = r["after"] >> i & 1, before + r["ended"][i]
    return pa.Table.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("quoted", pa.int32()), ("before", pa.int64()), ("sep", pa.int32()), ("head", pa.list_(pa.string()))]))


def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS of whole records (path, record, sep, head, value)."""
    schema = pa.schema([("source", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
    for batch in batches:
        out, chars = [], 0
        for r in batch.to_pylist():
            row = {"source": r["path"], "kind": "csv", "part": None, "row": r["record"] + 1, "cells": None, "text": None}
            head = r["head"]
            try:
                cells = parse(r["value"], SEPARATORS[r["sep"]])
            except csv.Error as e:
                out.append(row | {"kind": "error", "text": f"Error: {e}"})
                continue
            if len(cells) <= len(head):
                out.append(row | {"cells": list(dict(zip(head, cells + [""] * (len(head) - len(cells)))).items())})
                chars += len(r["value"])
            if chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, chars = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)


def read_csv_ranges(spark: SparkSession, root: str, over: int = 0, glob: str = "*.[cC][sS][vV]") -> DataFrame:
    """ROWS of all CSV files below root of more than so many bytes, as files.extract gives them, each file read by many tasks.

    Ranges are as long as spark.sql.files.maxPartitionBytes says. Separators
    are sniffed, short records padded and long ones dropped as there, with these
    differences: a row's number counts all records before it, dropped ones
    too, and a record that cannot be parsed is an 'error' row of its own. The
    header has to end in a file's first range. Blank lines are no records; an
    empty file has no rows; a cell left open takes the rest of its file,
    but for a line end at the very end.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, lineSep="\n")
    # The path as the binary-file source writes it.
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    lines = lines.where(F.col("_metadata.file_size") > over).select(path.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    # Written first, so that the planner knows its size and lines move only where it is too large to broadcast.
    placed = cut(lines.mapInArrow(summed, _RANGES).groupBy("path").applyInArrow(composed, _PLACED).withColumnRenamed("path", "_path").withColumnRenamed("start", "_start"))
    marks = lines.mapInArrow(marked, _LINES)

    def at_start(some: DataFrame) -> DataFrame:
        """The lines with what the start of their range says of them."""
        known = some.join(placed, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
        i = F.col("sep") * 2 + F.col("quoted")
        bit = lambda c: F.call_function("shiftright", F.col(c), i).bitwiseAND(1) == 1
        return known.select("path", "start", "n", "value", "sep", "head", bit("opened").alias("opened"), bit("after").alias("after"), (F.col("before") + F.element_at("record", i + 1)).alias("record"))

    alone = at_start(marks).where("NOT opened AND NOT after AND value NOT IN ('', '\\r')").select("path", "record", "sep", "head", "value")
    pieces = at_start(marks.where("opened > 0 OR after > 0")).where("opened OR after").groupBy("path", "record")
    spread = pieces.agg(F.first("sep").alias("sep"), F.first("head").alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "n", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return alone.unionByName(spread).where("record > 0").mapInArrow(celled, ROWS)
