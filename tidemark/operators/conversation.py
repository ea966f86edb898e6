"""Conversation log, prompt assembly and the answer interface."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "conv_id string, turn long, role string, text string"
SYSTEM = {
    "sv": "Svara på frågan enbart utifrån den givna kontexten. Säg till om svaret inte finns där.",
    "en": "Answer the question from the given context only. Say so if the answer is not in it.",
}


def new_conversation() -> str:
    return str(uuid.uuid4())


def append(spark: SparkSession, path: str, conv_id: str, turn: int, role: str, text: str) -> None:
    """One more message in the log below path."""
    spark.createDataFrame([(conv_id, turn, role, text)], SCHEMA).write.mode("append").parquet(path)


def messages(turn: str = "turn") -> Column:
    """Aggregate: messages (role, text) in order of their turn."""
    return F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))


def histories(log: DataFrame) -> DataFrame:
    """(conv_id, history) of every conversation."""
    return log.groupBy("conv_id").agg(messages().alias("history"))


def history(log: DataFrame, conv_id) -> list[tuple[str, str]]:
    """Messages of one conversation; empty for an unknown one."""
    found = log.where(F.col("conv_id") == conv_id).agg(messages().alias("h")).first()["h"] or []
    return [(m["role"], m["text"]) for m in found]


def prompt(history_col: Column, system: Column, user: Column) -> Column:
    """System message, history, user message."""
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.concat(one("system", system), F.coalesce(history_col, F.array().cast("array<struct<role:string,text:string>>")), one("user", user))


def question(query: str, context: str, language: str = "sv") -> tuple[str, str]:
    """(system, user) texts of a question over a context."""
    head = ("Kontext", "Fråga") if language == "sv" else ("Context", "Question")
    return SYSTEM[language], f"{head[0]}:\n{context}\n\n{head[1]}: {query}"


def extractive(chat: list[tuple[str, str]]) -> Iterator[str]:
    """Default answerer without a model: the first passage of the context, word by word."""
    context = chat[-1][1].split("\n", 1)[-1].split("\n\n", 1)[0]
    yield from re.findall(r"\S+\s*", context)


def answer(chat: list[tuple[str, str]], model: Callable[[list[tuple[str, str]]], Iterator[str]] = extractive, suppress_think: bool = False) -> Iterator[str]:
    """The model's tokens; with suppress_think the whole answer at once, without <think> parts."""
    if not suppress_think:
        yield from model(chat)
        return
    yield re.sub(r"<think>.*?</think>", "", "".join(model(chat)), flags=re.S)
