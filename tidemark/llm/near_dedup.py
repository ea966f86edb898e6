"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

1. Texts become sets of word shingles; equal sets fall into one class, and
   from here on only one document of a class takes part.
2. A class has a signature of CHUNKS x SYMBOLS b-bit MinHash values. Two
   signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 values have,
   by the pigeonhole principle, a chunk with at most ERRORS differing values.
   Each chunk is indexed once for every place at which the error may stand,
   with the value there left out, so such a pair shares an index key.
3. Each class is first paired with the nearest of its buckets' smallest ids,
   and the pair confirmed on full sets. That makes one component of most groups of copies. Then the classes in
   buckets that still hold several components are joined on the rare
   beginnings of their sets, and pairs of different components confirmed: a
   sample of them first, so that most components are one before all that are
   left are looked at. So pairs within a group that can add nothing are never made, and no
   link that could join two components is left out.

The index thus says which classes may have links, and gives the first of them;
the last step is a prefix-filtered set join, not an enumeration of a bucket's
pairs: on groups of copies that enumeration grows with their square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bloom_of, lists, map_rows, mixed, texts
from tidemark.llm.components import components, roots
from tidemark.session import cut

#: Words of a shingle; least similarity in per cent.
SHINGLE, PERCENT = 4, 80
#: Signature: chunks, 16-bit values per chunk, errors allowed in the chunk that pigeonhole grants.
CHUNKS, SYMBOLS, ERRORS = 8, 5, 1
VALUES = CHUNKS * SYMBOLS
#: Signatures that differ in more values do not pair with a bucket's smallest id; they are left to the second step.
MOST_DIFFERENT = 22
#: Further smallest ids that a class is paired with if the nearest one left it apart.
NEXT = 6
#: Each round of the set join looks at so many times the pairs of the one before.
STEP = 16
#: Bits of a set's parity map; 64 to a word.
PARITY_BITS = 512
#: Word hashes kept by a worker.
MEMO = 400_000

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Shingler:
    """Sets of 64-bit shingle hashes; remembers word hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo = size, {}

    def _hash(self, w: bytes) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        h = self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer words than a shingle's are one shingle, none are none."""
        w = words(text)
        if not w:
            return np.empty(0, np.uint64)
        memo = self.memo
        hashes = np.fromiter((memo[x] if x in memo else self._hash(x) for x in w), np.uint64, len(w))
        n = min(self.size, len(w))
        with np.errstate(over="ignore"):
            total = np.full(len(w) - n + 1, n, np.uint64)
            for i in range(n):
                total = mixed(total * _P + hashes[i : len(w) - n + 1 + i])
        return np.unique(total)


def signature(s: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of VALUES minima over the set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            part = s[i : i + 2048, None] * _FACTORS[None, :] + _SHIFTS[None, :]
            np.minimum(least, part.min(axis=0), out=least)
        return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each the parity of the number of shingles that fall on it, as 64-bit integers.

    Shared shingles cancel out: two sets' maps differ in at most as many bits
    as there are shingles that only one of the sets has.
    """
    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def describe(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature) per row; the empty set has no digest."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            n, digests, signatures = [], [], []
            for t in texts(batch.column(1)):
                s = shingler.shingles(t)
                n.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                signatures.append(signature(s).view(np.int16).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int16()))], ["doc_id", "n_shingles", "digest", "sig"]
            )

    return map_rows(documents.select(F.col(key).cast("long").alias("doc_id"), text), look, "doc_id long, n_shingles long, digest binary, sig array<short>")


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """Index keys of signatures, one per chunk and place left out: shape (rows, CHUNKS * SYMBOLS)."""
    out = np.empty((len(sigs), VALUES), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            chunk = sigs[:, c * SYMBOLS : (c + 1) * SYMBOLS].astype(np.uint64)
            for p in range(SYMBOLS):
                packed = np.zeros(len(sigs), np.uint64)
                for i in range(SYMBOLS):
                    if i != p:
                        packed = (packed << np.uint64(16)) | chunk[:, i]
                out[:, c * SYMBOLS + p] = mixed(packed + _P * np.uint64(c * SYMBOLS + p + 1))
    return out


def index(classes: DataFrame) -> DataFrame:
    """(key, id) rows of the multi-index."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = lists(batch.column(1), VALUES).view(np.uint16)
            ids = np.repeat(batch.column(0).to_numpy(), VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(index_keys(sigs).view(np.int64).ravel()), pa.array(ids)], ["key", "id"])

    return map_rows(classes.select("id", "sig"), keys, "key long, id long")


def different(a: str, b: str):
    """Number of differing values of two signature columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)


def sets_of(documents: DataFrame, ids: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, s, bits) of the documents whose id is in ids, and of a few more: s is the full shingle set, bits its parity map. Texts are not shuffled."""
    wanted = bloom_of(ids.select("id"))
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy())))
            sets = [shingler.shingles(t) for t in texts(batch.column(1))]
            columns = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), parity)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "s", "bits"])

    return cut(map_rows(rows, make, "id long, s array<long>, bits array<long>"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    # Cut first: were the distinct in the joins' stage, the tasks of hot ids could not be split.
    return cut(both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b")).distinct()


def ids_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(t, id, n, p, bits): the shingles t with which another set of these can begin to be similar enough.

    Shingles are ordered by rarity within these sets. The first shingle that
    two similar sets share stands early in both: so early that what follows
    it still suffices for the overlap that their sizes ask for. Shingles of
    one set only (most edits of a copy) take their places in the order, but
    are never joined.
    """
    own = ["id", "v"]  # an id may stand for several texts
    tokens = sets.select("id", F.xxhash64("s").alias("v"), F.size("s").alias("n"), F.explode("s").alias("t"))
    common = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(W.partitionBy(*own).orderBy("df", "t")) + F.col("n") - F.count("*").over(W.partitionBy(*own))
    prefix = tokens.join(common, "t").withColumn("p", rank).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    maps = sets.select("id", F.xxhash64("s").alias("v"), "bits").distinct()
    return cut(prefix.join(maps, own).select("t", "id", "n", "p", "bits"))


def across(prefix: DataFrame, comps: DataFrame, percent: int, share: int = 1) -> DataFrame:
    """Pairs (a, b) of different components that can still be similar enough, or one in share of them.

    Two sets that overlap enough differ in few shingles, so their parity maps
    differ in few bits: that leaves out nearly all pairs that only share a
    shingle, and none that is similar.
    """
    rows = cut(prefix.join(comps, "id"))
    x, y = rows.alias("x"), rows.alias("y")
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    room = 1 + F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    unlike = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    near = (F.col("x.t") == F.col("y.t")) & (F.col("x.comp") > F.col("y.comp")) & (room >= overlap) & (unlike <= F.col("x.n") + F.col("y.n") - 2 * overlap)
    if share > 1:
        near &= F.pmod(F.xxhash64(F.least("x.id", "y.id"), F.greatest("x.id", "y.id")), F.lit(share)) == 0
    return x.join(y, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def shares(prefix: DataFrame) -> list[int]:
    """One in how many pairs each round of across looks at: all of them in the last one.

    Links that connect different components after one in STEP of all links was
    followed are at most STEP for each set on average (the sampling lemma of
    Karger, Klein and Tarjan). So with shares that grow by STEP, no round has
    more links than that, though a group of copies has the square of its size.
    """
    sums = prefix.groupBy("t").agg(F.count("*").cast("double").alias("c")).agg(F.sum("c"), F.sum(F.col("c") * F.col("c"))).first()
    rows, pairs = sums[0] or 0.0, sums[1] or 0.0
    out = [1]
    while pairs / out[0] > STEP * rows:
        out.insert(0, out[0] * STEP)
    return out


def named_ids(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("id"), "component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after further links (a, b); an id without label is a component of its own.

    Links are taken between components, so what has been connected before is
    not walked again: the graph shrinks to what is still to be joined.
    """
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    between = cut(between.where("u <> v").distinct())
    if between.isEmpty():
        return labels
    joined = cut(components(between))
    known = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    known = known.select("id", F.coalesce("further", "component").alias("component"))
    return cut(known.unionByName(named_ids(joined).join(labels.select("id"), "id", "left_anti")))


def compared(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """(a, b, d): the pairs whose signatures differ in d values, at most MOST_DIFFERENT."""
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.withColumn("d", different("x", "y")).where(F.col("d") <= MOST_DIFFERENT).select("a", "b", "d")


def buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, id, comp) of all rows, keys of the buckets with several components)."""
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    return labelled, labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")


def link_components(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row.

    component_id is the smallest doc_id reachable by links, the row's own
    included. A null or wordless text has an empty set and links with nothing.
    Rows that share a doc_id count as one document. A null doc_id takes part in
    its class of equal sets only: its component_id is that class's, or null,
    and it is kept only if it is null. Other columns are ignored.
    """
    rows = cut(describe(documents, text, key, size))
    classes = cut(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    first = F.first("id").over(W.partitionBy("key").orderBy("id"))
    stars = cut(index(classes).withColumn("c", first).where("id <> c"))

    # Full sets of all classes that share a bucket, made and written once: every confirmation joins on them.
    members = cut(stars.select("key", "id").unionByName(stars.select("key", F.col("c").alias("id")).distinct()))
    sets = sets_of(documents, members.select("id").distinct(), text, key, size)

    sig = classes.select("id", "sig")
    near = cut(compared(stars.select(F.col("id").alias("a"), F.col("c").alias("b")).distinct(), sig))
    stars_best = cut(near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    # Every class has at most one such link, to a smaller id: the links are trees.
    labels = cut(named_ids(roots(confirm(stars_best, sets, percent))))

    # Classes still apart from a component that one of their buckets' smallest ids is in: their nearest few of these are next.
    named = near.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    apart = named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= NEXT)
    second = cut(apart.select("a", "b").join(stars_best, ["a", "b"], "left_anti"))
    labels = merged(labels, confirm(second, sets, percent))

    labelled, mixed_keys = buckets(members, labels)
    open_ids = cut(labelled.join(mixed_keys, "key", "left_semi").select("id").distinct())
    open_sets = cut(sets.join(open_ids, "id", "left_semi"))
    prefix = prefixes(open_sets, percent)
    for share in shares(prefix):
        comps = open_ids.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
        labels = merged(labels, confirm(across(prefix, comps, percent, share), open_sets, percent))

    named = rows.join(classes.select("digest", "id"), "digest", "left").join(labels, "id", "left")
    component = F.coalesce("component", "id", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {SHINGLE} + 1, 1) END), lambda p: array_to_string(w[p + 1 : p + {SHINGLE}], ' ')))) AS s FROM doc
),
class AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingle AS (SELECT id, n, unnest(s) AS t FROM class),
link AS (
    SELECT a.id AS a, b.id AS b FROM shingle AS a JOIN shingle AS b ON a.t = b.t AND a.id <> b.id
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
),
reach AS (SELECT id, id AS far FROM class UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.far = link.a),
component AS (SELECT id, min(far) AS component FROM reach GROUP BY id),
named AS (SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, sets.doc_id) AS component_id
    FROM sets LEFT JOIN class USING (s) LEFT JOIN component USING (id))
SELECT *, doc_id = component_id AS kept FROM named
"""
