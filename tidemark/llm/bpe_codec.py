"""Byte-level BPE by a tree reduction over text segments.

A text is halved until a segment has at most LEAF characters; leaves are
encoded alone, and neighbours are joined up the tree. A join re-encodes a
window around the seam and keeps all tokens outside it. The window grows until
what stands outside is provably stable. There are two proofs:

- Between words: the splitting pattern starts a new match, in any context, at
  a white-space character right behind another character. All tokens before
  such a place depend only on the text before it, those behind only on the
  text behind it.
- Within one match of the pattern: a token sequence is the encoding of its
  bytes exactly if each pair of neighbours is, that is, if encoding the two
  tokens' bytes gives the two tokens. The window's new tokens and the kept
  ones are neighbours in two places only, so these two pairs decide.

Text without a place of the first kind within REACH characters of a seam (text
in scripts without spaces, long runs of white space) is cut out once,
with its ends at such places, and its matches are halved and joined with the
second proof. No character is re-encoded at every level of the tree.

Decoding halves the ids and concatenates the bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_rows, texts

#: Characters of a leaf, and of the first window on each side of a seam.
LEAF, WINDOW = 1024, 32
#: Control characters that Python counts as white space and splitting patterns don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters around a seam in which a stable place between words is looked for.
REACH = 4096
#: Tokens of the first window on each side of a seam within one match, and pairs of tokens remembered.
TOKENS, PAIRS = 2, 200_000
#: Ids of a leaf in decoding.
LEAF_IDS = 4096


class TreeCodec:
    """Encodes and decodes with the ranks of a tiktoken encoding without special tokens.

    pattern must let no match hold a white-space character behind any other
    one; the patterns of byte-level vocabularies have that property.
    """

    reach = REACH

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW, reach: int = REACH):
        import tiktoken

        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = {i: len(b) for b, i in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaf, self.window, self.reach = leaf, window, reach

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.coder.encode_ordinary(text[start:end])
        mid = (start + end) // 2
        a, b = self._stable_before(text, max(start, mid - self.reach), mid), self._stable_after(text, mid, min(end, mid + self.reach))
        if (a is None and mid - start > self.reach) or (b is None and end - mid > self.reach):
            return self._around_run(text, start, mid, end)
        return self._join(text, start if a is None else a, mid, end if b is None else b, self._encode(text, start, mid), self._encode(text, mid, end))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of two parts that meet at mid, where text[a:b] is re-encoded."""
        seam = self.coder.encode_ordinary(text[a:b])
        keep = self._tokens(left, -1, text[a:mid])
        skip = self._tokens(right, 1, text[mid:b])
        return left[: len(left) - keep] + seam + right[skip:]

    def _stable_before(self, text: str, low: int, mid: int) -> int | None:
        """The last stable place in (low, mid), looked for in growing windows."""
        width, high = self.window, mid
        while high > low + 1:
            least = max(low + 1, high - width)
            for p in range(high - 1, least - 1, -1):
                if text[p].isspace() and text[p] not in SEPARATORS and not text[p - 1].isspace():
                    return p
            high, width = least, width * 2
        return None

    def _stable_after(self, text: str, mid: int, high: int) -> int | None:
        """The first stable place in (mid, high), looked for in growing windows."""
        width, low = self.window, mid + 1
        while low < high:
            most = min(high, low + width)
            for p in range(low, most):
                if text[p].isspace() and text[p] not in SEPARATORS and not text[p - 1].isspace():
                    return p
            low, width = most, width * 2
        return None

    def _around_run(self, text: str, start: int, mid: int, end: int) -> list[int]:
        """The ids of text[start:end], where the seam stands in a long run without stable places."""
        a, b = self._stable_before(text, start, mid), self._stable_after(text, mid, end)
        a, b = start if a is None else a, end if b is None else b
        left = self._encode(text, start, a) if a > start else []
        right = self._encode(text, b, end) if b < end else []
        return left + self._encode_run(text[a:b]) + right

    def _encode_run(self, run: str) -> list[int]:
        """The ids of a text by its matches; long matches by halves of their bytes."""
        ids: list[int] = []
        for match in self.matches(run):
            ids += self._encode_match(match.encode("utf-8"))
        return ids

    def _encode_match(self, b: bytes) -> list[int]:
        if len(b) <= self.leaf:
            return self.coder._encode_single_piece(b)
        left, right = self._encode_match(b[: len(b) // 2]), self._encode_match(b[len(b) // 2 :])
        i = j = TOKENS
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            seam = self.coder._encode_single_piece(self.coder.decode_bytes(left[len(left) - i :] + right[:j]))
            stable_left = i == len(left) or self._pair(left[-i - 1], seam[0])
            stable_right = j == len(right) or self._pair(seam[-1], right[j])
            if stable_left and stable_right:
                return left[: len(left) - i] + seam + right[j:]
            i, j = i if stable_left else i * 2, j if stable_right else j * 2

    def _pair(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.coder._encode_single_piece(self.coder.decode_bytes([a, b])) == [a, b]
        return known

    def _tokens(self, ids: list[int], step: int, part: str) -> int:
        """How many ids from one end make up exactly the bytes of part."""
        rest, n, at = len(part.encode("utf-8", "surrogatepass")), 0, 0 if step > 0 else -1
        while rest > 0:
            rest -= self.lengths[ids[at]]
            at += step
            n += 1
        if rest:
            raise ValueError("a token crosses a stable place")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.coder.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> TreeCodec:
    """The codec of a .tiktoken file."""
    with open(path, "rb") as f:
        return TreeCodec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, n_tokens, ids_sha256, decoded_sha256[, ids]) per row.

    ids are the token ids of the whole text, decoded_sha256 is of the bytes
    they decode to. Null texts are empty: no tokens. Repeated rows give
    repeated results, columns that are not kept are ignored, and a column to be
    kept whose name is one of the new ones is left out. ids_sha256 is of the ids as
    little-endian unsigned 32-bit integers. ranks_path must be readable on the
    executors.
    """
    keep = tuple(c for c in keep if c not in (key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"))
    fields = documents.select(key, *keep).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(ranks_path, pattern)
        for batch in batches:
            n, coded, decoded, all_ids = [], [], [], []
            for t in texts(batch.column(0)):
                ids = codec.encode(t or "")
                packed = array("I", ids)
                n.append(len(ids))
                coded.append(hashlib.sha256(packed.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(packed, np.int32))  # 4 bytes an id, not an object
            columns = [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return map_rows(documents.select(documents[text].alias("_text"), key, *keep), encode, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the 50k ranks and decoded again."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
