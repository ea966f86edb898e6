"""Chat formatting by prefix-target expansion.

A conversation gives one training example per assistant turn: all turns
before it are context, only its reply is trainable. Turns behind the last
assistant turn form one example without a target, so that the output holds
every turn. Built-in functions only.

Template of a turn, where role and text are escaped:

    ### <role>: <text> </turn>\n

Escaping turns '&', '#' and '<' into entities (in roles ':' too), so neither
'###' nor '</turn>' can occur inside a text, and it is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
TARGET_ROLE = "assistant"
ENTITIES = (("&", "&amp;"), ("#", "&num;"), ("<", "&lt;"))
ROLE_ENTITIES = (*ENTITIES, (":", "&colon;"))


def escape(c: Column, entities=ENTITIES) -> Column:
    for plain, coded in entities:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, entities=ENTITIES) -> Column:
    for plain, coded in reversed(entities):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, ROLE_ENTITIES), F.lit(SEP))


def format_chat(conversations: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """Examples (conv_id, example, context, target, tail) of conversations (conv_id, turn, role, text).

    The formatted text is context || target || tail; only target is under the
    loss mask. It is the escaped reply, or null in the closing example of a
    conversation that does not end with a target turn. Null texts and roles
    are empty. Turns are ordered by turn (nulls first), role, text; repeated
    rows stay. A null conv_id is a conversation of its own. No rows give no
    examples. Other columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    line = F.transform("turns", lambda t: F.concat(head(t["role"]), escape(t["text"]), F.lit(CLOSE)))
    ends = F.filter(
        F.transform("turns", lambda t, i: F.when((t["role"] == target_role) | (i == F.size("turns") - 1), i + 1)),
        lambda i: i.isNotNull(),
    )
    last = F.element_at("turns", F.col("n"))
    is_target = last["role"] == target_role
    before = F.array_join(F.slice("lines", F.lit(1), F.col("n") - 1), "")
    return (
        grouped.select("conv_id", "turns", line.alias("lines"), ends.alias("ends"))
        .select("conv_id", "turns", "lines", F.posexplode("ends").alias("example", "n"))
        .select(
            "conv_id",
            "example",
            F.when(is_target, F.concat(before, head(last["role"]))).otherwise(F.concat(before, F.element_at("lines", F.col("n")))).alias("context"),
            F.when(is_target, escape(last["text"])).alias("target"),
            F.when(is_target, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(p: Column) -> Column:
        p = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        at = F.locate(SEP, p)
        return F.struct(unescape(F.left(p, at - 1), ROLE_ENTITIES).alias("role"), unescape(F.substring(p, at + len(SEP), F.length(p))).alias("text"))

    return F.transform(pieces, one)


def digest_examples(examples: DataFrame) -> DataFrame:
    """Per conversation what the examples hold: turns of the longest one, all masked text in order.

    The examples come hash-partitioned by conv_id from format_chat, so this
    grouping needs no further exchange.
    """
    formatted = F.concat("context", F.coalesce("target", F.lit("")), "tail")
    masked = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))), lambda e: unescape(e["target"])), "")
    out = (
        examples.withColumn("formatted", formatted)
        .groupBy("conv_id")
        .agg(F.max_by("formatted", "example").alias("longest"), masked.alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"))
        .withColumn("turns", parse_turns(F.col("longest")))
    )
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digest_examples(format_chat(rows.unionByName(probe)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '&', '&amp;'), '#', '&num;'), '<', '&lt;'), ':', '&colon;'))
            + 2 + length(replace(replace(replace(text, '&', '&amp;'), '#', '&num;'), '<', '&lt;')) + 9 AS n FROM c),
s AS (
  SELECT *, sum(n) OVER w AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
