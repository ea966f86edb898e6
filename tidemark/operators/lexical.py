"""BM25 index and search as DataFrames.

The index is four tables in Parquet: postings (pos, term, tf, dl, block), terms
(term, df, idf, top), blocks (term, block, top) and stats (n, avgdl). A block
is a stretch of BLOCK positions; top is the largest share of a score, before
the weights, that a term has in the whole corpus or in one block.

Search is exact and prunes by these bounds:

1. Documents with a query's weightiest terms are scored; the k-th best score
   is the threshold, below which nothing is wanted.
2. Terms are ordered by the most that they can add. Those that together stay
   below the threshold are optional: a document that holds no other term is
   never looked at. So the postings of frequent words are not multiplied by the
   queries that hold them.
3. A candidate has its sum over the other terms. It is dropped if that, and the
   most that the optional terms can add in its block, stays below the threshold.
4. What is left is scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize
from tidemark.session import BROADCAST_BYTES, cut, shared_path

#: BM25 parameters: saturation, length share, and the floor of idf as a share of its mean.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Positions of a block; documents that a term must be in to have bounds by block.
BLOCK, FREQUENT = 256, 1024
#: Documents of its weightiest terms, for each wanted one, that a query's threshold is taken from.
SEEDS = 4
#: What sums in another order may differ by.
SLACK = 1e-6


PARTS = ("docs", "postings", "terms", "blocks", "stats")


@dataclass
class Bm25Index:
    docs: DataFrame  # pos, and the columns of the corpus
    postings: DataFrame  # pos, term, tf, dl, block
    terms: DataFrame  # term, df, idf, top
    blocks: DataFrame  # term, block, top
    stats: DataFrame  # n, avgdl

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bm25Index | None:
        """The index, or None with a message if there is none."""
        try:
            return Bm25Index(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))
        except Exception as gone:  # noqa: BLE001 - Spark raises its own classes for a missing path
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            print(f"no index at {path}")
            return None

    def save(self, path: str) -> None:
        """Copies the index below another path, overwriting what is there."""
        for part in PARTS:
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")


def build(docs: DataFrame, pos: str = "pos", text: str = "text", path: str | None = None) -> Bm25Index:
    """Index of docs; a document without tokens has no postings but counts in n and avgdl.

    The index is written below path, overwriting what is there, or to a new
    folder in the shared one: texts are cut into tokens once, and all
    statistics come from the written postings. Each file holds postings of all
    terms, ordered by term: a query reads few row groups of each, and those of a
    frequent term are spread over all files.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "bm25")
    postings = counted(docs.select(F.col(pos).alias("pos"), F.col(text).alias("text")))
    if not docs.groupBy(pos).count().where("count > 1").isEmpty():  # rows that share a position are one document
        postings = postings.groupBy("pos", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    postings = postings.select("pos", "term", "tf", "dl", F.floor(F.col("pos") / BLOCK).alias("block"))
    postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    docs.withColumnRenamed(pos, "pos").write.mode("overwrite").parquet(f"{path}/docs")
    postings = spark.read.parquet(f"{path}/postings")
    n = spark.read.parquet(f"{path}/docs").count()
    avgdl = (postings.agg(F.sum("tf")).first()[0] or 0) / max(n, 1)
    stats = spark.createDataFrame([(n, avgdl)], "n long, avgdl double")
    raw = postings.groupBy("term").agg(F.count("*").alias("df"), F.max(share(avgdl)).alias("top"))
    raw = cut(raw.withColumn("raw", rarity(n)))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    weighted(raw, raw).select("term", "df", "idf", "top").write.mode("overwrite").parquet(f"{path}/terms")
    block_tops(postings, raw, avgdl).write.mode("overwrite").parquet(f"{path}/blocks")
    return Bm25Index.load(spark, path)


def build_for(docs: DataFrame, queries: DataFrame, pos: str = "pos", text: str = "text") -> Bm25Index:
    """The part of build's index that queries (query_id, text) need: their terms, with the statistics of all documents and terms.

    Nothing is written of other terms, nor of texts, which are read twice: to
    count every term's documents, since idf has a floor that is a mean over all
    terms, and for the postings of the queries' terms. Queries that were not
    given here would miss terms.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(pos).alias("pos"), F.col(text).alias("text"))
    asked = cut(query_terms(queries).select("term").distinct())
    repeated = not docs.groupBy("pos").count().where("count > 1").isEmpty()  # rows that share a position are one document
    cut_up = docs.select("pos", tokenize(F.col("text")).alias("_t"))
    # A row without a term counts each row of docs and its tokens. Outer explodes as in counted.
    each = cut_up.select("pos", F.size("_t").alias("dl"), F.explode_outer(F.concat(F.array_distinct("_t"), F.array(F.lit(None).cast("string")))).alias("term"))
    df = F.count_distinct(F.struct("pos")) if repeated else F.count("*")
    counts = cut(each.groupBy("term").agg(df.alias("df"), F.count("*").alias("rows"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("tokens")))
    total = counts.where("term IS NULL").first()
    n, tokens = (total["rows"], total["tokens"]) if total else (0, 0)
    avgdl = tokens / max(n, 1)
    raw = counts.where("term IS NOT NULL").select("term", "df").withColumn("raw", rarity(n))

    if (asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        tokens_ = cut_up.select("pos", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"), F.lit(1).cast("long").alias("tf"))
        held = tokens_.join(F.broadcast(asked), "term", "left_semi")
    else:
        held = counted(docs).join(asked, "term", "left_semi")
    postings = held.groupBy("pos", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    postings = cut(postings.select("pos", "term", "tf", "dl", F.floor(F.col("pos") / BLOCK).alias("block")))
    tops = postings.groupBy("term").agg(F.max(share(avgdl)).alias("top"))
    terms = cut(weighted(raw.join(asked, "term", "left_semi"), raw).join(tops, "term").select("term", "df", "idf", "top"))
    blocks = cut(block_tops(postings, terms, avgdl))
    return Bm25Index(docs.select("pos"), postings, terms, blocks, spark.createDataFrame([(n, avgdl)], "n long, avgdl double"))


def rarity(n: int) -> Column:
    """The logarithm of the odds that one of n documents lacks a term that df hold."""
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def weighted(terms: DataFrame, every: DataFrame) -> DataFrame:
    """terms with idf: rarity, or the floor taken from every term's where it is negative."""
    floor = every.agg((F.lit(EPSILON) * F.avg("raw")).alias("floor"))
    return terms.crossJoin(F.broadcast(floor)).withColumn("idf", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")))  # floor has one row


def block_tops(postings: DataFrame, terms: DataFrame, avgdl: float) -> DataFrame:
    """(term, block, top) of frequent terms. Rarer ones have their bound over all blocks: they would fill a row for each posting."""
    # A table of their own, whose size the planner sees: else postings are shuffled to meet it.
    frequent = cut(terms.where(F.col("df") >= FREQUENT).select("term"))
    return postings.join(frequent, "term", "left_semi").groupBy("term", "block").agg(F.max(share(avgdl)).alias("top"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns, dl, term and tf: a row for each different token of each row.

    A row's tokens are sorted and their runs measured in place, so that no
    token is shuffled. The outer explode keeps Spark from cutting texts into
    tokens once more for a filter on their number.
    """
    rest = [c for c in docs.columns if c != text]
    runs = docs.select(*rest, F.sort_array(tokenize(F.col(text))).alias("_t"))
    places = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1)).otherwise(F.array().cast("array<int>"))
    runs = runs.withColumn("_i", F.filter(places, lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))))
    each = F.transform("_i", lambda i, n: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_i", n + 1), F.size("_t")) - i).cast("long").alias("tf")))
    return runs.select(*rest, F.size("_t").alias("dl"), F.explode_outer(each).alias("_e")).select(*rest, "dl", "_e.term", "_e.tf").where("term IS NOT NULL")


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text); repeated tokens count repeatedly."""
    return queries.select("query_id", F.explode(tokenize(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def share(avgdl: float) -> Column:
    """What a posting adds to a score for each unit of its term's weight."""
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl or 1.0))
    return F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + length)


def weights(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, df, weight, most): weight by occurrences and idf, and the most that a term can add to a score."""
    weight = F.col("qtf") * F.col("idf")
    wanted = query_terms(queries).join(index.terms, "term")
    return wanted.select("query_id", "term", "df", weight.alias("weight"), F.greatest(weight * F.col("top"), F.lit(0.0)).alias("most"))


def summed(index: Bm25Index, wanted: DataFrame) -> DataFrame:
    """(query_id, pos, block, score) of the documents that hold wanted terms (query_id, term, weight): sums over these."""
    avgdl = index.stats.first()["avgdl"]
    # A query set's terms bound what is read; the planner measures them before it picks a join.
    hits = index.postings.join(wanted.select("query_id", "term", "weight"), "term")
    return hits.groupBy("query_id", "pos", "block").agg(F.sum(F.col("weight") * share(avgdl)).alias("score"))


def scores(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, pos, score) of documents that share a term with a query."""
    return summed(index, weights(index, queries)).select("query_id", "pos", "score")


def scores_of(index: Bm25Index, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, pos, score) of the pairs (query_id, pos), over all of the query's terms."""
    avgdl = index.stats.first()["avgdl"]
    held = index.postings.join(pairs.select("pos").distinct(), "pos", "left_semi").join(wanted.select("query_id", "term", "weight"), "term")
    found = held.join(pairs.select("query_id", "pos"), ["query_id", "pos"], "left_semi")
    return found.groupBy("query_id", "pos").agg(F.sum(F.col("weight") * share(avgdl)).alias("score"))


def thresholds(index: Bm25Index, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, least): a score that at least k documents of a query reach; queries without k such documents are left out."""
    order = W.partitionBy("query_id").orderBy(F.desc("most"), "term")
    before = F.coalesce(F.sum("df").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seeds = summed(index, wanted.withColumn("_n", before).where(F.col("_n") < SEEDS * k))
    # The best SEEDS * k of them by these terms: as few rows for each query, however frequent its terms are.
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    seeds = cut(seeds.withColumn("_n", place).where(F.col("_n") <= SEEDS * k).select("query_id", "pos"))
    ranked = scores_of(index, wanted, seeds).withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"))))
    return ranked.where(F.col("_n") == k).select("query_id", F.col("score").alias("least"))


def pruned(index: Bm25Index, wanted: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, pos, block, score, least) of candidates by their other terms, those of them that can be among the k best)."""
    order = W.partitionBy("query_id").orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0)
    least = F.coalesce("least", F.lit(float("-inf")))
    split = wanted.join(thresholds(index, wanted, k), "query_id", "left").withColumn("least", least)
    split = cut(split.withColumn("optional", F.sum("most").over(order) < F.col("least") - SLACK))
    candidates = summed(index, split.where("NOT optional")).join(split.select("query_id", "least").distinct(), "query_id")
    optional = split.where("optional")
    # What optional terms add at most: rare ones anywhere, frequent ones by block.
    rare = optional.where(F.col("df") < FREQUENT).groupBy("query_id").agg(F.sum("most").alias("rare"))
    frequent = optional.where(F.col("df") >= FREQUENT).join(index.blocks.select("term", "block", F.col("top").alias("_top")), "term")
    frequent = frequent.groupBy("query_id", "block").agg(F.sum(F.greatest(F.col("weight") * F.col("_top"), F.lit(0.0))).alias("frequent"))
    bound = F.col("score") + F.coalesce("rare", F.lit(0.0)) + F.coalesce("frequent", F.lit(0.0))
    kept = candidates.join(rare, "query_id", "left").join(frequent, ["query_id", "block"], "left").where(bound >= F.col("least") - SLACK)
    return candidates, kept.select("query_id", "pos")


def best_scores(index: Bm25Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, score) of documents that share a term with a query: the k best ones of each query are among them."""
    wanted = cut(weights(index, queries))
    return scores_of(index, wanted, cut(pruned(index, wanted, k)[1]))


def pruning(index: Bm25Index, queries: DataFrame, k: int = 30) -> dict[str, int]:
    """Rows that a search moves: postings of all terms, those of candidates, and candidates scored in full."""
    wanted = cut(weights(index, queries))
    candidates, kept = pruned(index, wanted, k)
    return {"postings": wanted.agg(F.sum("df")).first()[0] or 0, "candidates": candidates.count(), "scored": kept.count()}


def search(index: Bm25Index, query: str, k: int = 30) -> DataFrame:
    """The k best documents (pos, score, rank); documents without a term score 0, ties keep corpus order."""
    asked = index.docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    return search_all(index, asked, k).drop("query_id")


def search_all(index: Bm25Index, queries: DataFrame, k: int = 30) -> DataFrame:
    """The k best documents (query_id, pos, score, rank) of every query (query_id, text), ranked as in search."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    hits = best_scores(index, queries, k).select("query_id", "pos", F.round("score", 9).alias("score"))
    found = hits.withColumn("rank", place).where(F.col("rank") <= k).drop("rank")
    found = cut(found)  # at most k rows of each query, read again below
    # A query with fewer than k documents above 0 is padded with the first documents that hold none of its terms.
    enough = found.where("score > 0").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(enough, "query_id", "left_anti")
    if not short.isEmpty():
        held = cut(scores(index, short).select("query_id", "pos"))
        most = held.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        # Among the first k + n documents, at least k hold none of the terms of a query that n documents hold terms of.
        first = index.docs.select("pos").orderBy("pos").limit(k + most)
        pairs = first.crossJoin(F.broadcast(short.select("query_id").distinct()))
        rest = pairs.join(held, ["query_id", "pos"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= k)
        found = found.unionByName(rest.select("query_id", "pos", F.lit(0.0).alias("score")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def scan_all(docs: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """search_all over documents (pos, text) that have no index: only what these queries need of one is made."""
    return search_all(build_for(docs, queries), queries, k)


def scan(docs: DataFrame, query: str, k: int = 30) -> DataFrame:
    """search over documents (pos, text) that have no index."""
    return scan_all(docs, docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string"), k).drop("query_id")


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, cf): documents that hold a term, and how often it occurs."""
    return counted(docs.select(F.col(text).alias("text"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
