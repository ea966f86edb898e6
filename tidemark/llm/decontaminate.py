"""Benchmark decontamination by a prefix-filtered containment join.

1. Every benchmark item is cut into windows of WINDOW consecutive words (an
   item with fewer words is one window). Equal windows are one.
2. A window is a set of word shingles with their places. Shingles are ordered
   by how rare they are in the whole benchmark. To be contained, all of a
   window's shingles must occur, so a prefix of one is enough to find it: the
   rarest.
3. Documents give a row for each place at which such a prefix shingle may
   stand, with the words around it. A Bloom filter of bounded size, made from
   the prefix shingles, keeps all other places from moving.
4. These rows and the windows meet in an equi-join on the shingle's hash. The
   shingle's place in the window says where the window must begin: there must
   be words before (positional bound) and behind (length bound) it. Then the
   words are compared.
5. Hits are gathered by a digest of the text, and documents fetch those of
   their digest. Texts are not shuffled.

Neither the benchmark nor the documents are collected anywhere: the driver
gets the filter's words, at most 16 MB, and tasks get the filter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import BLOOM_BITS, bloom_of, map_rows, mixed, texts
from tidemark.session import cut

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bytes whose words are hashed at a time.
PIECE = 1 << 19
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased. Null has none."""
    return WORD.findall(text.translate(LOWER)) if text else []


def count_words(text: Column) -> Column:
    """How many words a text has, without Python; A-Z are 0x41 to 0x5A."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")), F.lit(0)).cast("long")


#: Byte -> its lower-case form in a word, or 0 between words.
_BYTES = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, PIECE) - 1, x, np.uint64))))
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of some texts: where they stand, which text they are of, and a 64-bit hash of each.

    The hash is a polynomial over a word's bytes; the sum up to each byte gives
    those of all words at once, without an object for a word.
    """

    def __init__(self, given: list[bytes | None]):
        joined = b"\x00".join(t or b"" for t in given)
        low = _BYTES[np.frombuffer(joined, np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], low != 0, [False])).view(np.int8)))
        self.low, self.start, self.end = low, edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # in pieces, so that a long text needs little memory
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            begin = int(self.start[i])
            power, inverse = _power(int(self.end[j - 1]) - begin + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate(([np.uint64(0)], np.cumsum(low[begin : self.end[j - 1]] * power[:-1], dtype=np.uint64)))
                first, last = self.start[i:j] - begin, self.end[i:j] - begin
                self.hashes[i:j] = mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
            i = j
        starts = np.cumsum([0, *(len(t or b"") + 1 for t in given)])
        self.of = np.searchsorted(starts, self.start, "right") - 1
        self.counts = np.bincount(self.of, minlength=len(given)).astype(np.int64) if len(given) else np.empty(0, np.int64)
        self.begin = np.cumsum(self.counts) - self.counts  # first word of each text

    def said(self, i: int, j: int) -> list[str]:
        """The words from i up to j."""
        return [self.low[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place at which size words stand; shingles of different sizes differ."""
    n = max(0, len(hashes) - size + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i])
    return total.view(np.int64)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def find_windows(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(w, words, item): windows as word lists with a digest w, once for each item that they are in; item ids as text, null as ''."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = [], []
            for item, t in zip(texts(batch.column(0)), texts(batch.column(1))):
                v = words(t)
                found = {tuple(v[i : i + WINDOW]) for i in range(max(1, len(v) - WINDOW + 1))} if v else set()
                for window in found:
                    own.append(item)
                    held.append(list(window))
                if len(held) >= 5000:
                    yield _windows(own, held)
                    own, held = [], []
            yield _windows(own, held)

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    return map_rows(rows, make, "w binary, words array<string>, item string").distinct()


def _windows(items: list[str], held: list[list[str]]) -> pa.RecordBatch:
    w = [hashlib.md5("\x00".join(x).encode("utf-8", "surrogatepass")).digest() for x in held]
    return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(held, pa.list_(pa.string())), pa.array(items, pa.string())], ["w", "words", "item"])


def prefixes(windows: DataFrame) -> DataFrame:
    """(t, at, w, words): each window with the hash and place of its rarest shingle; ties: the least hash, then place.

    How rare a shingle is says in how many windows it stands.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, t, at = [], [], []
            found = Words([" ".join(x).encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()])
            for i, (first, n) in enumerate(zip(found.begin.tolist(), found.counts.tolist())):
                s = shingles(found.hashes[first : first + n], min(SHINGLE, n))
                own += [i] * len(s)
                t.append(s)
                at += range(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(np.concatenate([np.empty(0, np.int64), *t])), pa.array(at, pa.int32())], ["w", "t", "at"])

    once = windows.select("w", "words").groupBy("w").agg(F.first("words").alias("words"))
    tokens = cut(map_rows(once, split, "w binary, t long, at int"))
    rarity = tokens.groupBy("t").agg(F.count("*").alias("df"))
    best = tokens.join(rarity, "t").groupBy("w").agg(F.min(F.struct("df", "t", "at")).alias("m")).select("w", F.col("m.t").alias("t"), F.col("m.at").alias("at"))
    return once.join(best, "w").select("t", "at", "w", "words")


PLACES = "_places array<struct<t: long, p: int, lead: int, around: array<string>>>"


def find_places(documents: DataFrame, text: str, keep: tuple[str, ...], table: DataFrame, bloom_bits: int) -> DataFrame:
    """Per document the columns kept, _digest of the text, _n_words and _places.

    Those are the places p where a prefix shingle, of hash t, may stand, each
    with the words around it, lead of them before it. A null text has none.
    """
    sizes = [r["n"] for r in table.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]  # at most SHINGLE
    wanted = bloom_of(table.select("t"), bloom_bits)
    rows = documents.select(*keep, digest(F.col(text)).alias("_digest"), F.col(text).alias("_text"))
    width = len(keep) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width]) + f", _n_words long, {PLACES}"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_words = Words(batch.column(width).cast(pa.binary()).to_pylist())
            n, begin, hashes, row_of = found_words.counts, found_words.begin, found_words.hashes, found_words.of
            at, t = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for size in sizes:
                found = shingles(hashes, size)
                hit = np.flatnonzero(wanted.has(found))
                hit = hit[row_of[hit] == row_of[hit + size - 1]]  # within one text
                at.append(hit)
                t.append(found[hit])
            at, t = np.concatenate(at), np.concatenate(t)
            order = np.argsort(at, kind="stable")
            at, t = at[order], t[order]
            rows_hit = row_of[at]
            place = at - begin[rows_hit]
            lead = np.minimum(place, WINDOW - 1)
            last = np.minimum(at + WINDOW, (begin + n)[rows_hit])
            around = [found_words.said(i, j) for i, j in zip((at - lead).tolist(), last.tolist())]
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows_hit, minlength=batch.num_rows))))
            flat = pa.StructArray.from_arrays([pa.array(t), pa.array(place.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(around, pa.list_(pa.string()))], ["t", "p", "lead", "around"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*keep, "_digest", "_n_words", "_places"])

    return map_rows(rows, look, schema)


class Benchmark:
    """A benchmark made ready: windows (w, words, item), and those by their prefix shingle."""

    def __init__(self, items: DataFrame, item_id: str = "item_id", item_text: str = "text", bloom_bits: int = BLOOM_BITS):
        self.windows = cut(find_windows(items, item_id, item_text))
        self.table, self.bloom_bits = cut(prefixes(self.windows)), bloom_bits

    def places(self, documents: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return find_places(documents, text, keep, self.table, self.bloom_bits)

    def hits(self, places: DataFrame) -> DataFrame:
        """(_digest, _spans, _items) of the texts, by digest, that hold a window: merged spans [begin, end) in words, sorted item ids."""
        flat = places.select(F.col("_digest").alias("d"), F.explode("_places").alias("x")).select("d", "x.*")
        # Copies of a text give equal rows, which are combined before they move.
        flat = flat.groupBy("d", "t", "p").agg(F.first("lead").alias("lead"), F.first("around").alias("around"))
        n = F.size("words")
        fits = (F.col("lead") >= F.col("at")) & (F.size("around") - F.col("lead") + F.col("at") >= n)
        begin = F.col("p") - F.col("at")
        met = flat.join(self.table, "t").where(fits).where(F.slice("around", F.col("lead") - F.col("at") + 1, n) == F.col("words"))
        met = cut(met.select("d", "w", begin.cast("long").alias("begin"), (begin + n).cast("long").alias("end")))
        held = met.select("d", "w").distinct().join(self.windows.select("w", "item"), "w").groupBy("d").agg(F.array_sort(F.collect_set("item")).alias("items"))
        return cut(merged(met).join(held, "d").select(F.col("d").alias("_digest"), F.col("spans").alias("_spans"), F.col("items").alias("_items")))


def merged(hits: DataFrame) -> DataFrame:
    """(d, spans): spans [begin, end) of each text with those that touch or overlap made one, in order."""
    own = W.partitionBy("d").orderBy("begin")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    fresh = hits.groupBy("d", "begin").agg(F.max("end").alias("end")).withColumn("fresh", (reach.isNull() | (F.col("begin") > reach)).cast("int"))
    islands = fresh.withColumn("n", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0))).groupBy("d", "n").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return islands.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def find_leaks(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """documents with _n_words, _spans (merged, [begin, end) in words) and _items (sorted item ids as text).

    Documents that are null or without words have no spans; items that are
    null or without words match nothing, and an empty benchmark matches
    nothing. Repeated documents give repeated results, a repeated item_id counts
    once, a null item_id counts as ''. All other columns stay, but columns of
    the three new names, and of the name _digest, are replaced or dropped.
    """
    documents = documents.drop("_n_words", "_spans", "_items", "_digest")
    benchmark = Benchmark(items, item_id, item_text, bloom_bits)
    hits = benchmark.hits(benchmark.places(documents, text))
    counted = documents.withColumns({"_n_words": count_words(F.col(text)), "_digest": digest(F.col(text))})
    return with_hits(counted, hits, documents.columns)


def with_hits(rows: DataFrame, hits: DataFrame, columns: list[str]) -> DataFrame:
    none = {"_spans": F.array().cast("array<struct<begin:long,end:long>>"), "_items": F.array().cast("array<string>")}
    return rows.join(hits, "_digest", "left").select(*columns, "_n_words", *[F.coalesce(c, empty).alias(c) for c, empty in none.items()])


def report_leaks(documents: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """As find_leaks, with the columns kept only: texts, which are not among them, are read once."""
    benchmark = Benchmark(items, item_id, item_text, bloom_bits)
    places = cut(benchmark.places(documents, text, keep))
    return with_hits(places.select(*keep, "_digest", "_n_words"), benchmark.hits(places), list(keep))


def hit_words(spans: str = "_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = report_leaks(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


#: Words of a text, as they are cut here, in DuckDB SQL.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least({WINDOW}, len(w)) AS size FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[p + 1 : p + size], ' ') AS win FROM sized, unnest(range(len(w) - size + 1)) AS u(p)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
place AS (SELECT r, size, p, array_to_string(w[p + 1 : p + size], ' ') AS win
    FROM doc, (SELECT DISTINCT size FROM win) AS sizes, unnest(range(greatest(len(w) - size + 1, 0))) AS u(p)),
hit AS (SELECT r, item, size, p FROM place JOIN win USING (size, win)),
hit_words AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + size)) AS u(q) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def brute_force(text: str | None, items: list[tuple[str, str]]) -> tuple[int, int, list[str]]:
    """(words, hit words, items) of one document by looking every window up among all places; for tests."""
    w = words(text)
    hit, ids, places = set(), set(), {}
    for item, t in items:
        v = words(t)
        size = min(WINDOW, len(v))
        if not size:
            continue
        if size not in places:
            places[size] = {}
            for p in range(len(w) - size + 1):
                places[size].setdefault(tuple(w[p : p + size]), []).append(p)
        for i in range(len(v) - size + 1):
            for p in places[size].get(tuple(v[i : i + size]), ()):
                hit.update(range(p, p + size))
                ids.add(item)
    return len(w), len(hit), sorted(ids)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
