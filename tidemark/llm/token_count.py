"""Token counts by a finite-state transducer compiled from a BPE piece table.

The tokenizer merges the best-scored adjacent pair until none is left. Its
result has two properties that make it finite-state: a prefix of a valid
token sequence is valid, and a sequence is valid if each adjacent pair is. So
the last token of every prefix follows from the last tokens of the prefixes
that end at most max-piece-length characters earlier. A state of the
transducer holds just these: for every suffix of the text read so far that
can still grow into a piece, its trie node, the token before it and the
number of tokens up to it, relative to the whole. Reading a character moves
to the next state and emits the change of the token count.

No piece has a word mark after another character, so after a word mark that
ends a word all histories fall together in one state. Hence the map of a
chunk from entry states to (exit state, count) is a short head, which depends
on the entry state, and a count that does not. Chunk maps compose
associatively; a long text is the scan of its chunks' maps. Texts of more than
SPLIT characters are dealt to tasks as such chunks: the maps are made in
parallel, and what is composed afterwards is their heads and exits, a word or
so each. (In a text without any word's end a chunk is all head; it is then
read in order by the composing task.)

States are compiled when they are first reached and kept per worker, up to a
bound, beyond which the table is emptied and compiled anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, texts

#: The mark that stands for a space.
MARK = "▁"
#: Characters of a chunk.
CHUNK = 16_384
#: Characters above which a text's chunks, of this size, are dealt to tasks.
SPLIT = 1 << 20
#: Compiled transitions kept by a worker.
MAX_TRANSITIONS = 800_000
#: Tokens of a text over which it counts as too long.
LIMIT = 4096


class _State(dict):
    """Transitions character -> (next state, emitted tokens), compiled on first use."""

    __slots__ = ("fst", "items_")

    def __missing__(self, char: str):
        return self.fst.compile(self, char)


class TokenTransducer:
    """The transducer of a piece table: piece -> score; more is better.

    Characters without a piece emit as many tokens as they have UTF-8 bytes
    (byte fallback), or one without it.
    """

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True, max_transitions: int = MAX_TRANSITIONS):
        self.scores, self.byte_fallback, self.max_transitions = scores, byte_fallback, max_transitions
        #: Proper prefixes of pieces: suffixes that can still grow.
        self.growing = {q: q for q in (p[:i] for p in scores for i in range(1, len(p)))}
        self.tokens = {p: p for p in scores}
        self.synced = not any(b == MARK and a != MARK for p in scores for a, b in zip(p, p[1:]))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.transitions = 0
        #: Before the first character, and after a barrier: nothing before.
        self.start = self.state((("", "", 0),))

    def state(self, items: tuple) -> _State:
        found = self.states.get(items)
        if found is None:
            found = self.states[items] = _State()
            found.fst, found.items_ = self, items
        return found

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text by merging best-scored pairs, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether token b can stand right after token a."""
        if not a or (b[0] == MARK and a[-1] != MARK and self.synced):
            return True
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.max_transitions:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def compile(self, state: _State, char: str) -> tuple[_State, int]:
        scores, growing = self.scores, self.growing
        if char not in scores:
            made = (self.start, len(char.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
        else:
            token, count, alive = None, 0, []
            for suffix, before, n in state.items_:
                grown = suffix + char
                if token is None and grown in scores and self.follows(before, grown):
                    token, count = self.tokens[grown], n + 1
                if grown in growing:
                    alive.append((growing[grown], before, n))
            if token is None:
                raise ValueError(f"no token ends at {char!r} after {state.items_!r}")
            items = [(s, b, n - count) for s, b, n in alive]
            if char == MARK and self.synced:
                # What stands before a run of marks no longer matters if it can't be part of a piece.
                items = [(s, b if b[-1:] == MARK else "", n) for s, b, n in items]
            items.append(("", token, 0))
            made = (self.state(tuple(items)), count)
        state[char] = made
        self.transitions += 1
        return made

    def run(self, state: _State, text: str) -> tuple[_State, int]:
        """The state after text and the tokens emitted meanwhile."""
        n = 0
        for c in text:
            state, e = state[c]
            n += e
        return state, n

    # Chunk maps: (head, count behind the head, exit state or None if the head is all of the chunk).

    def chunk_map(self, chunk: str) -> tuple[str, int, _State | None]:
        """The map of a chunk from entry states to exit states and counts."""
        if self.transitions > self.max_transitions:
            self.clear()  # states already held stay valid
        at = self._sync(chunk)
        if at < 0:
            return chunk, 0, None
        # At the mark behind a word's end every history has the same future.
        state, n = self.run(self.start, chunk[at:])
        return chunk[:at], n, state

    def _sync(self, chunk: str) -> int:
        """Where a word mark follows another character, or -1."""
        if not self.synced:
            return -1
        at = chunk.find(MARK, 1)
        while at > 0 and chunk[at - 1] == MARK:
            at = chunk.find(MARK, at + 1)
        return at

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a's chunk followed by b's; associative, with ('', 0, None) as identity."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        return a[0], a[1] + n + b[1], state if b[2] is None else b[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text, spaces already turned into marks."""
        if self.transitions > self.max_transitions:
            self.clear()
        if len(text) <= chunk:
            return self.run(self.start, text)[1]
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, _ = maps[0]
        return self.run(self.start, head)[1] + n


@lru_cache(maxsize=2)
def load(path: str) -> TokenTransducer:
    """The transducer of a sentencepiece BPE model file with identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError(f"{path}: only BPE models with identity normalisation and a dummy prefix are supported")
    return TokenTransducer({p.piece: p.score for p in model.pieces if p.type == 1}, model.trainer_spec.byte_fallback)


def _packed(state: _State | None) -> str | None:
    return None if state is None else json.dumps(state.items_)


def _unpacked(fst: TokenTransducer, packed: str | None) -> _State | None:
    return None if packed is None else fst.state(tuple(map(tuple, json.loads(packed))))


def _counted(columns: list, n_bytes: list[int], n_tokens: list[int], limit: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])


def _count_long(rows: DataFrame, model_path: str, schema: str, key_type: str, limit: int, split: int) -> DataFrame:
    """Counts of long texts (key, text): their chunks' maps in parallel, then the scan over each text's maps."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / split).cast("int"))
    chunks = rows.withColumn("r", F.monotonically_increasing_id()).select("r", "key", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * split + 1, F.lit(split)))).alias("i", "chunk"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = load(model_path)
        for batch in batches:
            out = []
            for i, chunk in zip(batch.column(2), texts(batch.column(3))):
                head, n, state = fst.chunk_map(MARK * (i.as_py() == 0) + chunk.replace(" ", MARK))
                out.append((len(chunk.encode("utf-8", "surrogatepass")), head, n, _packed(state)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string())))], ["r", "key", "i", "n_bytes", "head", "n", "state"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Maps come by text and place; only the state reached so far is held."""
        fst, now = load(model_path), None
        for batch in batches:
            done = []
            for k, row in enumerate(batch.select(["r", "n_bytes", "head", "n", "state"]).to_pylist()):
                if now is None or row["r"] != now[0]:
                    if now is not None:
                        done.append(now)
                    now = [row["r"], batch.column(1).slice(k, 1), 0, 0, fst.start]
                state, n = fst.run(now[4], row["head"])
                now[2] += row["n_bytes"]
                now[3] += n + row["n"]
                now[4] = state if row["state"] is None else _unpacked(fst, row["state"])
            if done:
                yield _counted([pa.concat_arrays([d[1] for d in done])], [d[2] for d in done], [d[3] for d in done], limit)
        if now is not None:
            yield _counted([now[1]], [now[2]], [now[3]], limit)

    mapped = map_rows(chunks.repartition("r", "i"), maps, f"r long, key {key_type}, i int, n_bytes long, head string, n long, state string")
    return map_rows(mapped.repartition("r").sortWithinPartitions("r", "i"), scan, schema)


def count_tokens(documents: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, split: int = SPLIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row.

    Null texts count as empty: 0 bytes, 0 tokens. Texts are counted whole,
    whatever their length; those of more than split characters by several
    tasks. Repeated rows give repeated results; other columns are ignored. No
    rows give none. model_path must be readable on the executors.
    """
    key_type = documents.select(key).schema[0].dataType.simpleString()
    schema = f"key {key_type}, n_bytes long, n_tokens long, over_limit boolean"
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = load(model_path)
        for batch in batches:
            own = list(texts(batch.column(1)))
            yield _counted([batch.column(0)], [len(t.encode("utf-8", "surrogatepass")) for t in own], [fst.count(MARK + t.replace(" ", MARK)) if t else 0 for t in own], limit)

    long = F.length("text") > split
    counted = map_rows(rows.where(~long), count, schema).unionByName(_count_long(rows.where(long), model_path, schema, key_type, limit, split))
    return counted.withColumnRenamed("key", key)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece table."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
