"""Language identification by rank-order n-gram profiles.

A language profile is the list of its most frequent letter n-grams, most
frequent first. A document's own list is compared with each profile by the
out-of-place distance: the sum over its n-grams of how far the rank is from
the profile's, or the largest penalty if the profile lacks the n-gram. The
language at the smallest distance wins.

N-grams have 1 to 3 letters of one word, where a word stands between two
boundary marks; everything that is no letter is a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, split_of, texts

#: N-grams in a profile, of a language and of a document.
PROFILE = 300
#: Longest n-gram.
MAX_N = 3
#: At most so many documents of each language are learned from.
TRAIN_ROWS = 2000
UNKNOWN = "und"

_BITS, _MARK = 21, 1
_letter_class: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Code point -> lower-case letter, or the boundary mark."""
    global _letter_class
    if _letter_class is None:
        table = np.full(0x110000, _MARK, dtype=np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low[0]) if len(low) == 1 else c
        _letter_class = table
    return _letter_class


def has_letter(letters: np.ndarray) -> bool:
    return bool((letters != _MARK).any())


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of the text, words parted by single marks, a mark at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    padded = np.full(len(codes) + 2, _MARK, dtype=np.int64)
    padded[1:-1] = _classes()[codes]
    repeated = (padded[1:] == _MARK) & (padded[:-1] == _MARK)
    return padded[np.concatenate(([True], ~repeated))]


def ngram_counts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the letters and their counts, in the order of the n-grams."""
    if len(letters) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mark = letters == _MARK
    one, a, b, c = letters[~mark], letters[:-2], letters[1:-1], letters[2:]
    pairs = (letters[:-1] << _BITS) | letters[1:]
    triples = ((a << (2 * _BITS)) | (b << _BITS) | c)[~mark[1:-1]]  # none reaches over a boundary
    grams = np.concatenate((one, pairs, triples))
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties in the order of the n-grams."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        over = counts > least
        tied = np.flatnonzero(counts == least)[: size - int(over.sum())]
        keep = np.sort(np.concatenate((np.flatnonzero(over), tied)))
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))]


class Profiles:
    """Language profiles as one sorted n-gram table with a rank per language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.languages), len(self.grams)), -1, dtype=np.int32)
        for i, lang in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is 1 at distance 0 and 0 if no n-gram is known."""
        letters = letters_of(text or "")
        if not self.languages or not has_letter(letters):
            return UNKNOWN, 0.0
        own = ranked(*ngram_counts(letters), self.size)
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        ranks = self.ranks[:, at[known]]
        places = np.flatnonzero(known)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - places))
        distance = apart.sum(axis=1) + self.size * (len(own) - len(places))
        best = int(distance.argmin())  # ties: the first language by name
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def training_rows(labelled: DataFrame, text: str, lang: str, key: str, limit: int) -> DataFrame:
    """(lang, text) of at most limit different rows (key, text) of each language, those with the smallest hash.

    A threshold on the hash, from an estimate of how many different rows a
    language has, leaves about twice the rows that are wanted. So the rows that
    move are bounded by limit and languages, however many rows a language or a
    key has; equal rows are combined before they move.
    """
    place = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40))
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("_place"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("_place", 0.02).alias("_n")).select(F.col("lang").alias("_lang"), "_n")
    few = rows.join(sizes, F.col("lang") == F.col("_lang")).where(F.col("_place") * F.col("_n") <= F.lit(float(1 << 40)) * (2 * limit + 100))
    once = few.groupBy("lang", "_place").agg(F.first("text").alias("text"))
    order = W.partitionBy("lang").orderBy("_place")
    return once.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= limit).select("lang", "text")


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = PROFILE, limit: int = TRAIN_ROWS) -> Profiles:
    """Profiles of the languages in labelled rows; rows without language or text teach nothing.

    Learns from a bounded sample of rows per language (limit), of whole texts.
    Rows that share a key and differ in text are different rows; equal rows
    teach once. The driver gets size n-grams a language.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = training_rows(labelled, text, lang, key, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, dict[int, int]] = {}
            for name, t in zip(texts(batch.column(0)), texts(batch.column(1))):
                grams, counts = ngram_counts(letters_of(t))
                into = total.setdefault(name, {})
                for g, n in zip(grams.tolist(), counts.tolist()):
                    into[g] = into.get(g, 0) + n
            flat = [(name, g, n) for name, part in total.items() for g, n in part.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], ["lang", "gram", "n"]
            )

    # Distinct n-grams per language are bounded by the sample.
    sums = map_rows(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "_r").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(profiles, size)


def identify(documents: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """documents with _lang_pred and _lang_score.

    A null text or one without a letter is 'und' with score 0, as is every
    text if no language was learned. Repeated rows and all other columns stay,
    but columns of the two new names are replaced.
    """
    documents = documents.drop("_lang_pred", "_lang_score")
    fields = documents.schema.fields
    at = documents.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _lang_pred string, _lang_score double"
    names = [*(f.name for f in fields), "_lang_pred", "_lang_score"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    return map_rows(documents, predict, schema)


#: Rows with this remainder of crc32(doc_id) modulo 3 are held out.
PARTS, HELD_OUT = 3, 1


def learned_languages(documents: DataFrame) -> Profiles:
    """Profiles from the documents that are not held out."""
    return learn_profiles(documents.where(split_of("doc_id", PARTS) != HELD_OUT))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. A document without id is not held out, and teaches nothing."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents.select("doc_id", "text"), learned_languages(documents))
    return found.select("doc_id", F.coalesce(split_of("doc_id", PARTS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
