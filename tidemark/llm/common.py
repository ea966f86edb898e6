"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a worker turns into Python objects at a time.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Spark's bound on the bytes of an Arrow batch that it sends to a worker.
SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most bits of a Bloom filter (8 MB), bits for each key as long as that allows, and hash functions.
BLOOM_BITS, BLOOM_PER_KEY, BLOOM_HASHES = 1 << 26, 16, 4


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A supplied table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that long texts do not fill a worker. A slice shares its batch's memory."""
    for batch in batches:
        todo = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over small slices of small batches.

    A batch is held by the executor and, while the next one is read, twice by
    the worker. Spark's bound is 64 MB, so it is lowered to BATCH_BYTES, for
    the session, as the rows are made later; a bound that the user set stays.
    """
    if SENT_BYTES not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(SENT_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: fn(small(batches)), schema)


def split_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of an Arrow column, one by one."""
    for x in column:
        yield x.as_py()


def lists(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as an array of that many columns, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A set of 64-bit hashes of bounded size: every member is found, and few others."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def place(self, hashes: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, mask) of each hash by hash function i."""
        with np.errstate(over="ignore"):
            at = mixed(hashes.astype(np.int64, copy=False).view(np.uint64) + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.bits - 1)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for i in range(1, BLOOM_HASHES + 1):
            np.bitwise_or.at(self.words, *self.place(hashes, i))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        left = np.arange(len(hashes))
        for i in range(1, BLOOM_HASHES + 1):  # each function sees what passed the ones before
            word, mask = self.place(hashes[left], i)
            left = left[(self.words[word] & mask) != 0]
        found[left] = True
        return found


def bloom_of(hashes: DataFrame, most_bits: int = BLOOM_BITS) -> Bloom:
    """The Bloom filter of a table's only column of longs.

    Its size follows the number of rows up to most_bits; beyond that it finds
    more strangers, never fewer members. Tasks send the words that they set;
    the driver gets at most most_bits / 64 of them.
    """
    name = hashes.columns[0]
    n = hashes.count()
    bits = min(most_bits, 1 << max(16, (n * BLOOM_PER_KEY).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view(np.int64))], ["word", "mask"])

    whole = Bloom(bits)
    if n:
        rows = hashes.where(F.col(name).isNotNull()).mapInArrow(fill, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        whole.words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return whole
