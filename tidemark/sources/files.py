"""Scans of mixed files: CSV with separator sniffing, JSON, spreadsheets, word-processor files, PDF, plain text.

Files come through Spark's binary-file source, so any store works, and are
parsed on the executors one file at a time. Parsers are plain functions of
the bytes; the PDF parser is pluggable because none is bundled.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "csv", "xlsx", "docx", "json")
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a file that leave a worker at a time.
FRAME_ROWS = 4096
#: PDF texts of up to this many characters are left out.
MIN_PDF = 100
#: Rows of raw tables: cells by column name.
ROWS = "source string, kind string, part string, row long, cells map<string,string>, text string"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, glob: str | None = None) -> DataFrame:
    """(path, length, suffix, content) of all files below root with one of the suffixes, in any case."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return reader.load(root).select("path", "length", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*suffixes))


def csv_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of a CSV as they are read: the first of ; , and tab that gives several columns, else one column.

    Rows longer than the header are dropped, shorter ones padded with ''.
    """
    for sep in ";,\t":
        text = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline="\n")
        rows = (r for r in csv.reader(text, delimiter=sep) if r)
        head = next(rows, [])
        if len(head) > 1:
            break
    return (dict(zip(head, r + [""] * (len(head) - len(r)))) for r in rows if len(r) <= len(head))


def read_csv(content: bytes) -> list[dict[str, str]]:
    """The rows of csv_rows at once."""
    return list(csv_rows(content))


def read_xlsx(content: bytes) -> Iterator[tuple[str, list[dict[str, str]]]]:
    """(sheet, rows) of a workbook; the first row names the columns, missing cells are ''."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            table = []
            for row in root.iter(f"{_SHEET}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.iter(f"{_SHEET}c")):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    v = c.find(f"{_SHEET}v")
                    value = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                    cells[at - 1 if letters else n] = shared[int(value)] if c.get("t") == "s" and value else value
                table.append(cells)
            width = max((max(c, default=-1) + 1 for c in table), default=0)
            rows = [[c.get(i, "") for i in range(width)] for c in table]
            yield sheet.get("name"), [dict(zip(rows[0], r)) for r in rows[1:]] if rows else []


def read_docx(content: bytes) -> tuple[list[list[list[str]]], list[str]]:
    """(tables of rows of cells, paragraphs outside tables)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    tables = [[[said(c) for c in row.findall(f"{_WORD}tc")] for row in t.findall(f"{_WORD}tr")] for t in body.findall(f"{_WORD}tbl")]
    return tables, [p for p in map(said, body.findall(f"{_WORD}p")) if p]


def read_pdf(content: bytes) -> str:
    """Pages joined by a newline; '' if no parser is installed or the file is broken."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
    except Exception:  # noqa: BLE001 - a broken file has no text
        return ""


def json_leaves(value, least: int = 100, most: int = 800, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of string leaves longer than least, cut to most characters; list places as [i]."""
    if isinstance(value, str):
        if len(value) > least:
            yield path, value[:most]
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from json_leaves(v, least, most, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from json_leaves(v, least, most, f"{path}[{i}]")


def _flat(value: dict) -> dict[str, str | None]:
    return {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items()}


def parse_file(path: str, suffix: str, content: bytes, pdf: Callable[[bytes], str] = read_pdf, pdf_tables: Callable[[bytes], list] | None = None) -> Iterator[tuple]:
    """Raw rows (kind, part, row, cells, text) of one file; row numbers count from 2, below a header.

    pdf_tables, if given, turns a PDF into tables, each a list of rows as dicts.
    """
    if suffix == "csv":
        yield from (("csv", None, i, r, None) for i, r in enumerate(csv_rows(content), 2))
    elif suffix == "xlsx":
        for sheet, rows in read_xlsx(content):
            yield from (("xlsx", sheet, i, r, None) for i, r in enumerate(rows, 2))
    elif suffix == "docx":
        tables, paragraphs = read_docx(content)
        for n, rows in enumerate(tables):
            yield from (("docx_table", str(n), i, None, " | ".join(c for c in r if c)) for i, r in enumerate(rows, 1))
        if paragraphs:
            yield ("docx_text", None, 0, None, "\n".join(paragraphs))
    elif suffix == "json":
        value = json.loads(content.decode("utf-8-sig"))
        objects = value if isinstance(value, list) else [value]
        for i, v in enumerate(objects):
            if isinstance(v, dict):
                yield ("json", None, i, _flat(v), None)
            else:
                yield from (("json_text", p, i, None, t) for p, t in json_leaves(v))
    elif suffix == "pdf":
        for n, rows in enumerate(pdf_tables(content) if pdf_tables else ()):
            yield from (("pdf_table", str(n), i, {k: str(v) for k, v in r.items()}, None) for i, r in enumerate(rows, 1))
        text = pdf(content)
        if len(text) > MIN_PDF:
            yield ("pdf_text", None, 0, None, text)
    else:
        yield ("text", None, 0, None, content.decode("utf-8", "replace"))


def extract(files: DataFrame, pdf: Callable[[bytes], str] = read_pdf, pdf_tables: Callable[[bytes], list] | None = None) -> DataFrame:
    """ROWS of scanned files; a file that cannot be parsed gives one row of kind 'error' with the reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, suffix, content in zip(frame["path"], frame["suffix"], frame["content"]):
                read = lambda: parse_file(path, suffix, bytes(content), pdf, pdf_tables)  # noqa: B023, E731 - called before the next file
                try:
                    if suffix == "csv":  # read twice, so that no row of a broken file has left, and none is held
                        for _ in read():
                            pass
                        rows = read()
                    else:
                        rows = iter(list(read()))
                except Exception as e:  # noqa: BLE001 - reported as a row
                    rows = iter([("error", None, 0, None, f"{type(e).__name__}: {e}")])
                while some := list(itertools.islice(rows, FRAME_ROWS)):
                    yield pd.DataFrame([(path, *r) for r in some], columns=["source", "kind", "part", "row", "cells", "text"])

    return files.select("path", "suffix", "content").mapInPandas(run, ROWS)


def table_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Raw rows as a table with named columns."""
    return rows.select("source", "row", *[F.coalesce(F.col("cells")[c], F.lit("")).alias(c) for c in columns])


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
