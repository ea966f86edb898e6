"""Document fingerprints by winnowing, in built-in functions.

A text's k-grams of code points are hashed, and of every window of
consecutive k-grams the smallest hash is kept, the rightmost of equal ones.
The kept hashes with their positions are the fingerprint. Two texts that share
a passage of at least WINDOW + GRAM - 1 code points share a kept hash within
it, wherever the passage stands; of other texts about two hashes in each
WINDOW + 1 are kept.

A gram is hashed from its code points at once: 64 bytes are few for a hash
function, fewer than the steps of a column that puts a gram's hash together
from those of shorter runs. (A hash that is carried from one gram to the next
is a loop over rows' characters, which built-in functions don't have without
copying the list so far at each step.) The smallest values
of windows are found in blocks: the least of each block, then that of the
blocks which all windows that start in one block share. A value holds a hash and, below it, its place counted
from the right, so that among equal hashes the rightmost is the smallest.

A text is read in pieces of PIECE windows, so that what a row holds besides
its text and fingerprint is bounded by a piece, and the work is in proportion
to its length. Pieces overlap by a window, which keeps all windows whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut

#: Code points of a gram; grams of a window.
GRAM, WINDOW = 16, 64
#: Values of a block in the search for windows' least ones.
BLOCK = 4
#: Windows of a piece; bits of a value that hold the place within a piece.
PIECE, PLACE = 2048, 13
MASK = (1 << PLACE) - 1
#: The share of an edited text that is replaced: its last 1 / EDIT.
EDIT = 4
#: Ids of a slice when each finds its successor.
SLICE = 500_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, computed once: a lambda's variable, where a column would be evaluated at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rolled(wide: Column, size: int) -> Column:
    """Hashes of all runs of size code points, one for each start, of text in four bytes each; in the low bits their places from the right."""
    last = F.shiftright(F.octet_length(wide), 2) - size
    hashed = lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * size)))
    return F.transform(F.sequence(F.lit(1), 4 * last + 1, F.lit(4)), lambda at, i: hashed(at).bitwiseAND(F.lit(~MASK)).bitwiseOR((F.lit(MASK) - i).cast("long")))


def sliding(values: Column, size: int, body: Callable[[Column], Column]) -> Column:
    """body of the smallest value of each window of size values, by starts; windows end with the values."""

    def widen(now: Column, width: int) -> Column:
        offsets = sorted({min(j * width, size - width) for j in (1, 2, 3)} - {0})
        if not offsets:
            return body(now)
        grown = F.transform(now, lambda x, i: F.least(x, *(F.get(now, i + d) for d in offsets)))
        return let(grown, lambda g: widen(g, min(4 * width, size)))

    return widen(values, 1)


def least_of(values: Column, size: int, windows: Column) -> Column:
    """The smallest value of each of the first windows of size values, by starts; equal neighbours may be given once.

    Windows that start in one block of values have all blocks but their first
    and last in common. Where these hold the least of all, it is the least of
    each window; else the windows of the block are looked at one by one.
    """
    if size == 1:
        return F.slice(values, F.lit(1), windows)
    block = BLOCK if size % BLOCK == 0 and size > BLOCK else 1
    inner = size // block - 1

    def one_by_one(b: Column, common: Column) -> Column:
        own = [F.get(values, block * b + r) for r in range(block)]
        last = [F.get(values, block * b + size + r) for r in range(block - 1)]
        return F.slice(F.array(*(F.least(common, *own[r:], *last[:r]) for r in range(block))), F.lit(1), F.least(F.lit(block), windows - block * b))

    def of_block(least: Column, common: Column, b: Column) -> Column:
        c = F.get(common, b + 1)
        return F.when(c < F.least(F.get(least, b), F.get(least, b + inner + 1)), F.array(c)).otherwise(one_by_one(b, c))

    ceil = lambda n: F.call_function("div", n + (block - 1), F.lit(block)).cast("int")
    leasts = values
    if block > 1:
        leasts = F.transform(F.sequence(F.lit(0), ceil(F.size(values)) - 1), lambda b: F.array_min(F.slice(values, block * b + 1, F.lit(block))))
    starts = F.sequence(F.lit(0), ceil(windows) - 1)
    return let(leasts, lambda a: sliding(a, inner, lambda c: F.flatten(F.transform(starts, lambda b: of_block(a, c, b)))))


def kept_hashes(text: Column, gram: int, window: int, piece: int, part: bool) -> Column:
    """array<struct<hash long, at int>>: what the windows of a text of at least gram code points keep, by position.

    Of a part of a text only whole windows count; else a text with fewer grams than a window is one window.
    """
    if piece + window - 1 > MASK + 1:
        raise ValueError(f"piece and window must stay below {MASK + 2} together")

    def of_piece(wide: Column, start: Column, windows: Column) -> Column:
        """What the windows that start in a piece keep."""

        place = lambda v: (start + (MASK - v.bitwiseAND(MASK))).cast("int")
        entry = lambda v: F.struct(F.shiftright(v, PLACE).alias("hash"), place(v).alias("at"))
        own = let(rolled(wide, gram), lambda v: let(F.least(windows, F.lit(piece)), lambda n: least_of(v, window, n)))
        # Windows move to the right, and so do the places they keep: repeats are neighbours.
        return let(own, lambda a: F.transform(F.filter(a, lambda v, i: (i == 0) | (v != F.get(a, i - 1))), entry))

    def of_text(wide: Column) -> Column:
        """A piece of four bytes for each code point is found without reading what stands before it."""
        grams = F.shiftright(F.octet_length(wide), 2) - (gram - 1)
        windows = F.greatest(grams - (window - 1), F.lit(0 if part else 1))
        cut_out = lambda s: F.substring(wide, 4 * s + 1, F.lit(4 * (piece + window + gram - 2)))
        pieces = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(piece)), lambda s: let(cut_out(s), lambda p: of_piece(p, s, windows - s)))
        return F.when(windows > 0, let(F.flatten(pieces), once)).otherwise(none())

    return let(F.encode(text, "UTF-32"), of_text)


def none() -> Column:
    return F.array().cast("array<struct<hash:bigint,at:int>>")


def once(kept: Column) -> Column:
    """Entries by position without those that stand twice where two ranges of windows meet."""
    return F.filter(kept, lambda v, i: (i == 0) | (v["at"] != F.get(kept, i - 1)["at"]))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> Column:
    """array<struct<hash long, at int>>: kept hashes with their places in the text, by place; null for null.

    A text shorter than a gram is one gram, an empty one has none. A text with
    fewer grams than a window is one window.
    """
    alone = F.array(F.struct(F.shiftright(F.xxhash64(text), PLACE).alias("hash"), F.lit(0).alias("at")))
    return F.when(F.length(text) >= gram, kept_hashes(text, gram, window, piece, False)).when(text == "", none()).when(text.isNotNull(), alone)


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints as a share of all their hashes, 0 to 1; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def digest(numbers: Column) -> Column:
    """Hex SHA-256 of a list of numbers."""
    return F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256)


def fingerprints(documents: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, hashes, places) per row: the fingerprint's kept hashes and their places, by place.

    A null text counts as empty: no hashes. Texts are read whole, whatever
    their length. Equal texts have equal fingerprints; repeated rows give
    repeated results, the key may be null. Other columns are ignored. No rows
    give none.
    """
    rows = documents.select(F.col(key).alias(key), fingerprint(F.coalesce(F.col(text), F.lit("")), gram, window).alias("_kept"))
    return rows.select(key, F.col("_kept.hash").alias("hashes"), F.col("_kept.at").alias("places"))


def successors(ids: DataFrame, levels: int = 3) -> DataFrame:
    """(id, next) for a table of different ids (long): the next larger id, null for the last.

    Ids are ordered within slices of a fixed width, each of which holds no
    more ids than that; the last of a slice is followed by the first of the
    next slice that is not empty, which is found in the same way among the
    slices. So no task orders all ids, and none more than SLICE.
    """
    if not levels:
        return ids.select("id", F.lead("id").over(W.orderBy("id")).alias("next"))
    sliced = ids.withColumn("slice", F.call_function("div", F.col("id") - F.pmod("id", F.lit(SLICE)), F.lit(SLICE)))
    firsts = cut(sliced.groupBy("slice").agg(F.min("id").alias("first")))
    order = successors(firsts.select(F.col("slice").alias("id")), levels - 1)
    follow = order.select(F.col("id").alias("slice"), F.col("next").alias("slice_")).join(firsts.select(F.col("slice").alias("slice_"), F.col("first").alias("first_")), "slice_", "left")
    follow = cut(follow.select("slice", "first_"))
    near = F.lead("id").over(W.partitionBy("slice").orderBy("id"))
    found = sliced.withColumn("near", near).join(follow, "slice", "left")
    return found.select("id", F.coalesce("near", "first_").alias("next"))


def edited_fingerprints(documents: DataFrame, text: str = "text", key: str = "doc_id", edit: int = EDIT, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(key, n_chars, edited, hashes, places_sha256, edited_hashes, next_hashes) per row.

    A row's edited text has its last floor(n_chars / edit) code points
    replaced by the first as many, or all, of the next document: the one with
    the next larger key, after the last the first. Windows before the edit are
    the same in both texts and are read once. Texts are shuffled once, with
    their hashes; the places, of which only a digest is told here, stay behind.

    Null texts count as empty. If rows share the next key, the next document
    is the one whose replacing code points, then hashes, are the smallest. Rows
    that share a key have the same next key. A row without key has no next
    document: it is as if that were empty, and it is next to none. An only key
    is next to itself. Other columns are ignored. No rows give none.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = gram + window - 1  # code points of a window
    text_ = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = documents.select(F.col(key).cast("long").alias("id"), text_)
    n = F.length("text")
    share = F.call_function("div", n, F.lit(edit)).cast("int")

    def extended(last: Column, whole: Column, cut_at: Column) -> Column:
        """Entries of a text behind those that its windows within the first cut_at code points keep, the last of these at place last."""

        def behind(start: Column) -> Column:
            """start is the first window's that reaches over the cut; it may keep what the one before it keeps."""
            moved = F.transform(kept_hashes(F.substr(whole, start + 1), gram, window, piece, True), lambda v: F.struct(v["hash"].alias("hash"), (v["at"] + start).alias("at")))
            return let(moved, lambda a: F.filter(a, lambda v, i: (i > 0) | (v["at"] != last)))

        return let(cut_at - (full - 1), behind)

    def lists(kept: Column, common: Column) -> Column:
        """The hashes, how many of them are from windows before the cut, the place of the last of these, and a digest of all places."""
        last = F.get(common, F.size(common) - 1)["at"]
        return F.struct(kept["hash"].alias("hashes"), F.size(common).alias("common"), last.alias("last"), digest(kept["at"]).alias("places_sha256"))

    cut_at = n - share
    whole = lambda c: F.concat(c, extended(F.get(c, F.size(c) - 1)["at"], F.col("text"), cut_at))
    shared = let(kept_hashes(F.left("text", cut_at), gram, window, piece, True), lambda c: let(whole(c), lambda f: lists(f, c)))
    plain = let(fingerprint(F.col("text"), gram, window, piece), lambda f: lists(f, none()))
    own = F.when(cut_at >= full, shared).otherwise(plain).alias("own")
    # Both joins below read the one shuffle of texts: each takes all of its columns.
    base = rows.where("id IS NOT NULL").select("id", "text", own).repartition(parts, "id")

    needs = cut(rows.where("id IS NOT NULL").groupBy("id").agg(F.max(share).alias("need")))
    first = needs.agg(F.min("id")).first()[0]
    order = successors(needs.select("id")).select("id", F.coalesce("next", F.lit(first).cast("long")).alias("next"))
    wanted = cut(order.join(needs, "id").select(F.col("id").alias("before"), "next", "need"))
    heads = base.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("next")).select("before", F.struct(F.left("text", F.col("need")).alias("head"), "own").alias("h"))
    heads = heads.groupBy("before").agg(F.min("h").alias("h"))

    met = base.join(heads.hint("merge"), F.col("id") == F.col("before"), "left")
    alone = rows.where("id IS NULL").select("id", "text", own, F.lit(None).cast("long").alias("before"), F.lit(None).cast(heads.schema["h"].dataType).alias("h"))
    met = met.unionByName(alone)
    head = F.left(F.coalesce("h.head", F.lit("")), share)
    found = met.select("id", "text", "own", cut_at.alias("cut_at"), F.concat(F.left("text", cut_at), head).alias("edited"), F.coalesce("h.own.hashes", F.array().cast("array<bigint>")).alias("next_hashes"))
    behind = extended(F.col("own.last"), F.col("edited"), F.col("cut_at"))
    edited = F.when(F.col("cut_at") >= full, F.concat(F.slice("own.hashes", F.lit(1), F.col("own.common")), behind["hash"]))
    edited = edited.otherwise(fingerprint(F.col("edited"), gram, window, piece)["hash"])
    found = found.select("id", n.cast("long").alias("n_chars"), "edited", "own", "next_hashes", edited.alias("edited_hashes"))
    return found.select(F.col("id").alias(key), "n_chars", "edited", F.col("own.hashes").alias("hashes"), F.col("own.places_sha256").alias("places_sha256"), "edited_hashes", "next_hashes")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness."""
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("hashes")).alias("fingerprint"),
        digest(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        "places_sha256",
    )
