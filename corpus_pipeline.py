"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, decontaminate, language_id, near_dedup, toxicity
from tidemark.session import cut, shared_path

#: Columns that the stages pass on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle in the near-duplicate stage: five, as for all near-duplicate stages without a contract of their own (op3 has one: four).
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5."""
    model = toxicity.learned_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model).where("_tox_score < 0.5").select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts with letters; lang becomes the language found."""
    found = language_id.identify(docs, language_id.learned_languages(docs)).where(F.col("_lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("_lang_pred")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (shingles of five words, similarity of 0.8 or more).

    Every different row (doc_id, text) is a document of its own: rows that
    share a doc_id and differ in text both stay, and rows without doc_id go if
    they copy another one. A group's row is that of the smallest doc_id, null
    last, then of the smallest hash; of rows that differ in other columns only,
    the smallest stays, and of equal rows one.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    keyed = docs.withColumns({"_key": row, "_rest": F.struct("lang", "source", "n_chars")})
    links = near_dedup.link_components(keyed.select(F.col("_key").alias("doc_id"), "text"), size=SHINGLE).select(F.col("doc_id").alias("_key"), "component_id")
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key", "_rest")
    # Keys and small columns only; map-side aggregates, so that large groups shrink before they move.
    rows = keyed.groupBy("_key", "doc_id", "_rest").agg(F.count("*").alias("n")).join(links.distinct(), "_key")
    best = rows.groupBy("component_id").agg(F.min_by(F.struct("_key", "_rest", "n"), ranked).alias("b")).select("b.*")
    best = cut(best)
    once, often = best.where("n = 1").drop("n"), best.where("n > 1").drop("n")
    same = lambda kept: (F.col("d._key") == F.col(f"{kept}._key")) & F.col("d._rest").eqNullSafe(F.col(f"{kept}._rest"))
    single = keyed.alias("d").join(once.alias("o"), same("o"), "left_semi").select(*COLUMNS)
    repeated = keyed.alias("d").join(often.alias("m"), same("m"), "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)
    return single.unionByName(repeated)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("_spans") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with digests of ids and decoded bytes."""
    return bpe_codec.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("bpe_codec", encode),
]

#: Learned models and near duplicates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
