"""Retrieval for answers: hybrid search, expanded queries, contexts, and the conversation around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize
from tidemark.operators import conversation, lexical, retrieval
from tidemark.plans.index import Settings
from tidemark.session import cut
from tidemark.sources import vectors

#: Columns of a passage.
PASSAGE = "query_id, pos, id, text, meta, score, source, rrf_score, rank"


def expand(queries: DataFrame, presets: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, query_no, query): each query itself as number 0, then the preset questions."""
    every = F.concat(F.array("query"), F.array(*[F.lit(p) for p in presets]).cast("array<string>"))
    return queries.select("query_id", F.posexplode(every).alias("query_no", "query"))


def embed_queries(queries: DataFrame, model=None, dims: int = retrieval.DIMS, prefix: str = "") -> DataFrame:
    """(query_id, embedding) of queries (query_id, query), behind a prefix if the model asks for one."""
    return retrieval.embed(queries.select("query_id", F.concat(F.lit(prefix), "query").alias("text")), model, "text", dims).select("query_id", "embedding")


@dataclass
class Retriever:
    """Both indexes. Without a BM25 index its list is empty."""

    collection: DataFrame  # pos, id, text, meta, embedding
    bm25: lexical.Bm25Index | None
    model: Callable | None = None
    dims: int = retrieval.DIMS
    prefix: str = ""

    @staticmethod
    def open(spark: SparkSession, settings: Settings, model=None) -> Retriever:
        return Retriever(vectors.open_or_create(spark, settings.vectors), lexical.Bm25Index.load(spark, settings.bm25), model, settings.embedding_length)

    def dense(self, queries: DataFrame, k: int = retrieval.K_LIST) -> DataFrame:
        """(query_id, pos, rank) of the nearest passages of every query (query_id, query)."""
        asked = embed_queries(queries, self.model, self.dims, self.prefix)
        return retrieval.dense_search_all(self.collection.select("pos", "embedding"), asked, k).select("query_id", "pos", "rank")

    def lexical(self, queries: DataFrame, k: int = retrieval.K_LIST) -> DataFrame:
        """(query_id, pos, score, rank); no rows without an index."""
        kind = dict(queries.dtypes)["query_id"]
        if self.bm25 is None:
            return queries.sparkSession.createDataFrame([], f"query_id {kind}, pos long, score double, rank int")
        return lexical.search_all(self.bm25, queries.withColumnRenamed("query", "text"), k)

    def hybrid(self, queries: DataFrame, k_dense: int = retrieval.K_LIST, k_lexical: int = retrieval.K_LIST, top_k: int = retrieval.K_LIST) -> DataFrame:
        """PASSAGE rows of every query: both lists fused by reciprocal ranks.

        The score is that of the list which source names: the lexical one's for
        passages in both, 0 for those of the dense list, whose distances rank only.
        """
        lexical_ = cut(self.lexical(queries, k_lexical))
        fused = retrieval.fuse(self.dense(queries, k_dense), lexical_, top_k, key="pos", by=("query_id",))
        fused = fused.join(lexical_.select("query_id", "pos", "score"), ["query_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        held = self.collection.select("pos", "id", "text", "meta")
        if self.bm25 is not None:  # covers all documents, also those without a vector
            held = self.bm25.docs.select("pos", "id", "text", "meta")
        return held.join(fused, "pos").selectExpr(*PASSAGE.split(", "))

    def retrieve(self, queries: DataFrame, presets: tuple[str, ...] = (), n: int = retrieval.K_FUSED) -> DataFrame:
        """PASSAGE rows and query_no of queries and presets; the order is (query_no, rank)."""
        every = expand(queries, presets)
        if not presets:
            return self.hybrid(queries, top_k=n).withColumn("query_no", F.lit(0))
        numbered = every.select(F.struct("query_id", "query_no").alias("query_id"), "query")
        return self.hybrid(numbered, top_k=n).withColumns({"query_no": F.col("query_id.query_no"), "query_id": F.col("query_id.query_id")})


def contexts(found: DataFrame, queries: DataFrame, rerank: bool = False, top_k: int = retrieval.K_FINAL, budget: int = retrieval.CONTEXT_CHARS) -> DataFrame:
    """(query_id, context, passages): of each query's passages the first of each text, the best top_k, as many as fit the budget."""
    return retrieval.build_context(best_passages(found, queries, rerank, top_k), budget, by=("query_id",), order="place")


def best_passages(found: DataFrame, queries: DataFrame, rerank: bool = False, top_k: int = retrieval.K_FINAL) -> DataFrame:
    """The top_k passages of each query, each text once, with place from 1: by the share of query tokens if rerank, else as ranked."""
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("query_id", "text").orderBy("query_no", "rank"))
    once = found.withColumn("_n", first).where("_n = 1").drop("_n")
    order = [F.col("query_no"), F.col("rank")]
    if rerank:
        wanted = F.array_distinct(tokenize(F.col("query")))
        once = once.join(queries.select("query_id", wanted.alias("_w")), "query_id")
        share = F.size(F.array_intersect(F.array_distinct(tokenize(F.col("text"))), F.col("_w"))) / F.greatest(F.size("_w"), F.lit(1))
        once, order = once.withColumn("rerank_score", share).drop("_w"), [F.desc("rerank_score"), *order]
    return once.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= top_k)


class Service:
    """Questions in conversations over a retriever."""

    def __init__(self, spark: SparkSession, retriever: Retriever, log: str, answerer=conversation.extractive, language: str = "sv", presets: tuple[str, ...] = (), rerank: bool = False, suppress_think: bool = False):
        self.spark, self.retriever, self.log, self.answerer = spark, retriever, log, answerer
        self.language, self.presets, self.rerank, self.suppress_think = language, presets, rerank, suppress_think

    def new_conversation(self) -> str:
        return conversation.new_conversation()

    def get_context(self, query: str) -> tuple[str, list[dict]]:
        """The context of a question, and its passages in order."""
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        best = cut(best_passages(self.retriever.retrieve(asked, self.presets), asked, self.rerank))
        context = retrieval.build_context(best, by=("query_id",), order="place").first()
        passages = [r.asDict() for r in best.drop("query_id").orderBy("place").collect()]  # a few passages of one question
        return context["context"] if context else "", passages

    def history(self, conv_id: str) -> list[tuple[str, str]]:
        """Messages of a conversation; none for an unknown one."""
        if not vectors.exists(self.spark, self.log):
            return []
        return conversation.history(self.spark.read.schema(conversation.SCHEMA).parquet(self.log), conv_id)

    def ask(self, query: str, conv_id: str) -> Iterator[str]:
        """The answer in pieces; question and answer enter the log when it has been read to its end."""
        context, _ = self.get_context(query)
        before = self.history(conv_id)
        system, user = conversation.question(query, context, self.language)
        said = []
        for piece in conversation.answer([("system", system), *before, ("user", user)], self.answerer, self.suppress_think):
            said.append(piece)
            yield piece
        for i, (role, text) in enumerate((("user", query), ("assistant", "".join(said)))):
            conversation.append(self.spark, self.log, conv_id, len(before) + i, role, text)
