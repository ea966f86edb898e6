"""The index build: files to documents, packed, filtered, embedded and stored as a vector collection and a BM25 index."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import chunks, header_name, split_semantic, stable_id
from tidemark.operators import ingest, lexical, retrieval
from tidemark.session import cut
from tidemark.sources import csv_ranges, files, vectors
from tidemark.sources.rest import indexed

#: Columns of a document before packing.
ITEMS = ("source", "type", "part", "row", "text", "meta")


@dataclass(frozen=True)
class Settings:
    """Parameters of a build; each can be set by an environment variable of the same upper-case name behind TIDEMARK_."""

    data_root: str = "./data"
    index_dir: str = "./index"
    collection: str = "documents"
    embedding_length: int = retrieval.DIMS
    embed_metadata: bool = False
    table_as_document: bool = True
    chunk_tables: bool = False
    group_tables: bool = True
    group_words: int = ingest.PACK_WORDS
    chunk_size: int = 2000
    overlap: int = 200
    questions: tuple[str, ...] = field(default=())
    #: CSV files of more bytes are read in ranges by many tasks.
    whole_csv: int = 64 << 20

    @staticmethod
    def from_env(env: dict[str, str], **given) -> Settings:
        kinds = {"int": int, "bool": lambda x: x.lower() == "true", "str": str, "tuple[str, ...]": lambda x: tuple(json.loads(x))}
        found = {f.name: kinds[f.type](env[name]) for f in Settings.__dataclass_fields__.values() if (name := f"TIDEMARK_{f.name.upper()}") in env}
        return replace(Settings(), **(found | given))

    @property
    def vectors(self) -> str:
        return f"{self.index_dir}/{self.collection}-vectors"

    @property
    def bm25(self) -> str:
        return f"{self.index_dir}/{self.collection}-bm25"


def _shaped(found: DataFrame, kind: str, meta: list[str], part=None) -> DataFrame:
    """ITEMS of extracted documents; the metadata named goes into a JSON object, null values left out."""
    have = [F.col(c) for c in meta if c in found.columns]
    return found.select("source", F.lit(kind).alias("type"), (part if part is not None else F.lit(None).cast("string")).alias("part"), F.col("row").cast("long").alias("row"), "text", F.to_json(F.struct(*have) if have else F.struct(F.lit(None).alias("none"))).alias("meta"))


def tables(raw: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """CSV rows by their header, which is what tells their layout: (names, rows). One pass collects the distinct headers."""
    rows = raw.where("kind = 'csv'").withColumn("_head", F.array_sort(F.map_keys("cells")))
    heads = [r["_head"] for r in rows.select("_head").distinct().collect()]  # as many as there are layouts
    return [(head, files.table_of(rows.where(F.col("_head") == F.array(*[F.lit(h) for h in head])), head)) for head in heads]


def csv_documents(raw: DataFrame) -> list[DataFrame]:
    """ITEMS of CSV rows by layout."""
    out = []
    for head, table in tables(raw):
        table = table.toDF("source", "row", *[header_name(h) for h in head])
        layout = ingest.layout_of(table.columns)
        if layout == "itu":
            meta = ["usage_index", "itu_band", "itu_services", "swedish_usage", "frequency_band", "duplex", "note"]
            found = ingest.itu_documents(table)
            out.append(_shaped(found, "itu_allocation", meta, F.col("usage_index").cast("string")))
        elif layout == "plan":
            meta = ["from_mhz", "to_mhz", "from_str", "to_str", *[name for _, name in ingest.PLAN_META]]
            out.append(_shaped(ingest.plan_documents(table), "allocation_plan", meta))
        else:
            out.append(_shaped(ingest.generic_documents(table), "csv_generic", []))
    return out


def items(raw: DataFrame) -> DataFrame:
    """ITEMS of all raw rows of files, whatever their kind."""
    out = csv_documents(raw)
    pairs = F.array_join(F.transform(F.filter(F.map_entries("cells"), lambda e: ~F.lower(F.trim(F.coalesce(e["value"], F.lit("")))).isin("", "nan", "none")), lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), " | ")
    named = {"xlsx": "excel_row", "pdf_table": "pdf_table_row"}
    for kind, name in named.items():
        out.append(_shaped(raw.where(F.col("kind") == kind).withColumn("text", pairs), name, [], F.col("part")))
    keys = [f"{k}{a}" for k in ("id", "fromMhz", "toMhz", "usageDescriptionLicenseExcemptionUsageDescription", "reference", "condition") for a in ("", ".a")]
    table = raw.where("kind = 'json'").select("source", "row", *[F.col("cells")[k].alias(k) for k in keys])
    out.append(_shaped(ingest.exemption_documents(table), "spectrum_exemption", ["id", "from_mhz", "to_mhz", "usage", "reference"]))
    plain = raw.where(F.col("kind").isin("docx_table", "docx_text", "pdf_text", "json_text"))
    out.append(plain.select("source", F.when(F.col("kind") == "docx_table", "docx_table_row").otherwise(F.col("kind")).alias("type"), "part", F.col("row").cast("long").alias("row"), "text", F.lit("{}").alias("meta")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.where("text <> ''")


def whole_texts(raw_files: DataFrame, words: int = 400) -> DataFrame:
    """ITEMS of files read as plain text: blocks between blank lines, packed."""
    text = raw_files.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))
    blocks = text.select("source", F.posexplode(split_semantic(F.col("text"))).alias("pos", "text"))
    packed = ingest.pack(blocks, words)
    return packed.select("source", F.lit("text_chunk").alias("type"), F.lit(None).cast("string").alias("part"), F.col("block_index").alias("row"), "text", F.lit("{}").alias("meta"))


def documents(spark: SparkSession, settings: Settings, pdf: Callable[[bytes], str] = files.read_pdf, pdf_tables: Callable[[bytes], list] | None = None) -> DataFrame:
    """(id, source, type, part, row, text, meta) of all files: extracted, packed or cut if asked for, at least five characters long.

    Ids are digests of where a text comes from, so a build that is repeated
    gives the same ones.
    """
    found = files.scan(spark, settings.data_root)
    as_text = found.where(F.lit(not settings.table_as_document) & (F.col("suffix") != "json"))
    ranged = F.lit(settings.table_as_document) & (F.col("suffix") == "csv") & (F.col("length") > settings.whole_csv)
    raw = files.extract(found.where((F.lit(settings.table_as_document) | (F.col("suffix") == "json")) & ~ranged), pdf, pdf_tables)
    if settings.table_as_document and not found.where(ranged).isEmpty():
        raw = raw.unionByName(csv_ranges.read_csv_ranges(spark, settings.data_root, settings.whole_csv))
    raw = cut(raw)
    every = items(raw) if settings.table_as_document else items(raw).unionByName(whole_texts(as_text))
    if settings.group_tables:
        placed = every.withColumn("_o", F.struct(F.coalesce("part", F.lit("")).alias("part"), "row", "type"))
        packed = ingest.pack(placed, settings.group_words, order="_o")
        every = packed.select("source", F.lit("grouped_block").alias("type"), F.lit(None).cast("string").alias("part"), F.col("block_index").alias("row"), "text", F.to_json(F.struct("block_index", "words", "items")).alias("meta"))
    every = ingest.long_enough(every)
    if settings.chunk_tables:
        cut_up = every.select("source", "type", "part", "row", "meta", F.posexplode(chunks(F.col("text"), settings.chunk_size, settings.overlap)).alias("chunk_index", "text"))
        every = cut_up.withColumn("part", F.concat_ws(".", "part", F.col("chunk_index").cast("string"))).select(*ITEMS)
    key = stable_id(F.col("source"), F.col("type"), F.coalesce("part", F.lit("")), F.coalesce("row", F.lit(0)))
    return every.select(key.alias("id"), *ITEMS)


def build_index(spark: SparkSession, settings: Settings, model=None, pdf: Callable[[bytes], str] = files.read_pdf, pdf_tables: Callable[[bytes], list] | None = None, docs: DataFrame | None = None) -> dict:
    """Builds both indexes and returns the counts. docs replaces the files' documents: (id, source, type, part, row, text, meta).

    BM25 covers all documents; the vector collection the first of each text
    that passes the quality gate. Both are overwritten, so they stay in step.
    """
    found = documents(spark, settings, pdf, pdf_tables) if docs is None else docs
    found = cut(indexed(found, ["source", "part", "row", "id"]).withColumnRenamed("index", "pos"))
    lexical.build(found, path=settings.bm25)
    good = ingest.quality_gate(ingest.keep_first(found))
    if settings.embed_metadata:
        said = good.withColumn("_said", ingest.embedding_text(["type", "meta"]))
        embedded = retrieval.embed(said, model, "_said", settings.embedding_length).drop("_said")
    else:
        embedded = retrieval.embed(good, model, "text", settings.embedding_length)
    vectors.replace(embedded, settings.vectors)
    return {"documents": found.count(), "vectors": vectors.size(spark, settings.vectors)}


def save_settings(spark: SparkSession, settings: Settings, counts: dict) -> str:
    """Build parameters and counts as one JSON file below the index folder; returns its folder."""
    path = f"{settings.index_dir}/params"
    text = json.dumps(asdict(settings) | counts, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
