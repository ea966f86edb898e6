"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into (host suffix, path prefix) expressions. A rule is
stored as the SHA-256 of its expression; expressions meet rules in an
equi-join on the first bytes of the digest, full digests confirm the match,
and the longest rule wins. Everything is built-in functions.

A rule can only meet the expression that has as many host labels and path
characters as it has itself, so a URL is expanded to the shapes that the rules
have, whatever its own length. With few shapes and few rules each shape is one
broadcast join and the URL is judged where it stands, without a shuffle; else
the distinct (host, path) are expanded into rows and joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the equi-join uses (4 bytes).
PREFIX_HEX = 8
#: Bytes of rules up to which they are broadcast; more of them are joined by shuffle.
BROADCAST_RULE_BYTES = 8 << 20
#: Shapes (host labels, path length) up to which each is a join of its own.
SHAPES = 24


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rule set of the query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end; '' without it."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host, up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expression(host: Column, path: Column) -> Column:
    """One expression as text. A host holds no '/', so it ends at the first one."""
    return F.concat(host, F.lit("/"), path)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """rule, verdict, host and path length, digest and its prefix; equal rules once, block before allow."""
    rows = [(r.host, r.path, r.verdict) for r in rules]
    if rows:
        values = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rows)
        table = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    else:
        table = spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    table = table.groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    return table.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.length("host").alias("host_len"),
        F.length("path").alias("path_len"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.sha2(expression(F.col("host"), F.col("path")), 256).alias("digest"),
    ).withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))


def suffix_of(host: Column, labels: int) -> Column:
    """The last labels of a host; all of it if it has fewer."""
    return F.substring_index(host, ".", -labels)


def digest_of(host: Column, path: Column, labels: int, length: int) -> Column:
    """Digest of a URL's expression of one shape; null if the path is too short."""
    return F.when(F.length(path) >= length, F.sha2(expression(suffix_of(host, labels), F.left(path, F.lit(length))), 256))


def expand(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(host, path) to one row per expression digest of the shapes."""
    digests = F.array_distinct(F.array(*[digest_of(F.col("host"), F.col("path"), *shape) for shape in shapes]))
    return urls.select("host", "path", F.explode(F.array_compact(digests)).alias("digest")).withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))


def _best(match: str = "r") -> Column:
    """What makes a rule win: its length, then its host's, then block before allow."""
    r = F.col(f"{match}.rule")
    return F.struct(F.length(r).alias("n"), F.col(f"{match}.host_len"), F.col(f"{match}.verdict"), r.alias("rule"))


def judge_in_place(urls: DataFrame, table: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """urls (_host, _path) with _best, by one broadcast join a shape; equal rules stand once, so rows are not multiplied."""
    for i, (labels, length) in enumerate(shapes):
        own = table.where((F.col("labels") == labels) & (F.col("path_len") == length)).select("prefix", "digest", F.struct("rule", "host_len", "verdict").alias(f"_m{i}"))
        own = F.broadcast(own.withColumnsRenamed({"prefix": f"_p{i}", "digest": f"_f{i}"}))
        urls = urls.withColumn(f"_d{i}", digest_of(F.col("_host"), F.col("_path"), labels, length))
        meets = (F.left(f"_d{i}", F.lit(PREFIX_HEX)) == F.col(f"_p{i}")) & (F.col(f"_d{i}") == F.col(f"_f{i}"))
        urls = urls.join(own, meets, "left").drop(f"_d{i}", f"_p{i}", f"_f{i}")
    found = [F.when(F.col(f"_m{i}").isNotNull(), _best(f"_m{i}")) for i in range(len(shapes))]
    best = found[0] if len(found) == 1 else F.greatest(*found)  # greatest skips nulls
    return urls.withColumn("_best", best).drop(*[f"_m{i}" for i in range(len(shapes))])


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with _host, _path, _rule and _verdict.

    The longest rule wins (by rule text, then by host, then block). No rule:
    _rule is null and _verdict the default. A null URL or one without :// has
    an empty host and path and no rule. Repeated rows and all other columns of
    pages stay as they are, but columns whose name is one of the four new ones,
    or starts with one underscore, one of the letters d, f, m or p and
    digits, or is _best (used within), are replaced or dropped.
    """
    spark = pages.sparkSession
    rules = tuple(rules)
    own = re.compile(r"_(host|path|rule|verdict|best|[dfmp]\d+)")
    pages = pages.drop(*[c for c in pages.columns if own.fullmatch(c)])
    with_parts = pages.withColumns({"_host": url_host(F.col(url)), "_path": url_path(F.col(url))})
    if not rules:
        return with_parts.withColumns({"_rule": F.lit(None).cast("string"), "_verdict": F.lit(default)})
    table = rule_table(spark, rules)
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    small = sum(len(r.host) + len(r.path) + 100 for r in rules) <= BROADCAST_RULE_BYTES
    if small and len(shapes) <= SHAPES:
        judged = judge_in_place(with_parts, table, shapes)
    else:
        found = with_parts.select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct()
        hits = (
            expand(found, shapes)
            .alias("e")
            .join((F.broadcast(table) if small else table).alias("r"), F.col("e.prefix") == F.col("r.prefix"))
            .where(F.col("e.digest") == F.col("r.digest"))
            .groupBy(F.col("e.host").alias("_host"), F.col("e.path").alias("_path"))
            .agg(F.max(_best()).alias("_best"))
        )
        judged = with_parts.join(hits, ["_host", "_path"], "left")
    out = judged.withColumns({"_rule": F.col("_best.rule"), "_verdict": F.coalesce("_best.verdict", F.lit(default))})
    return out.select(*pages.columns, "_host", "_path", "_rule", "_verdict")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page URL under RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
