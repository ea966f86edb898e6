"""Toxicity by weak supervision.

1. A bounded sample of labelled rows gives a lexicon: words and word
   beginnings that mark toxic texts. Near copies in the sample count once, so
   that one copied text does not fill the lexicon.
2. Voters: every lexicon entry votes toxic where it occurs; pattern voters
   look at shouting, exclamation and symbol runs; clean voters fire where
   whole parts of the lexicon are absent; the given label is one more voter.
3. A generative label model estimates jointly, by EM, how often each voter
   fires in either class (the given label included) and how voters depend on
   each other: each voter may depend on one other one besides the class, and
   the tree of these pairwise factors is the likeliest one under the present
   posterior. It yields a posterior label for each row.
4. A linear classifier is trained on the posterior labels. It alone scores
   texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, mixed, split_of, texts
from tidemark.session import cut

#: At most so many labelled rows are learned from.
TRAIN_ROWS = 12_000
#: Entries of the lexicon, and lexicon entries that vote.
LEXICON, VOTERS = 512, 192
#: Letters of the word beginnings that may enter the lexicon.
PREFIXES = (4, 5, 6)
#: Toxic texts that an entry must occur in.
MIN_SUPPORT = 3
#: How often a given label is taken to be right before anything is estimated, and the weight in rows of what is believed beforehand.
LABEL_ACCURACY, BELIEF = 0.97, 10.0
#: Min-hashes of a text, and how many must agree for two texts of one label to count as near copies.
HASHES, AGREE = 16, 12
#: Largest bias: a text in which nothing speaks for toxicity is never called toxic, whatever share of the labels is.
MOST_BIAS = -0.1
#: Words of which a worker remembers the entries.
MEMO = 300_000

WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("shouting", "exclamation", "symbols")


def word_features(word: str) -> list[str]:
    """Entries that a lower-case word may stand for."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def patterns(text: str) -> list[float]:
    """Upper-case share of the letters, exclamation marks and symbol runs per 100 words; each from 0 to 1."""
    n = len(text)
    if not n:
        return [0.0] * len(PATTERNS)
    upper = len(_UPPER.findall(text))
    lower = len(_LOWER.findall(text))
    words = text.count(" ") + text.count("\n") + 1
    return [upper / (upper + lower) if upper + lower >= 20 else 0.0, min(1.0, text.count("!") / words), min(1.0, len(_SYMBOLS.findall(text)) / words)]


_UPPER, _LOWER, _SYMBOLS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]"), re.compile(r"[#$%&*@^]{2,}")


_ODD = np.random.default_rng(20240301).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(text: str) -> list[int]:
    """HASHES min-hashes of the word triples; near copies share most of them."""
    w = WORD.findall(text.lower())
    triples = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in triples], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return [int(mixed(hashes * o).min() >> np.uint64(1)) for o in _ODD]


@dataclass
class Model:
    """Linear classifier over lexicon entries and patterns."""

    entries: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    pattern_weights: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))
    bias: float = -2.0
    voters: list[dict] = field(default_factory=list)

    def scorer(self):
        weight = dict(zip(self.entries, self.weights))
        memo: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            z, found = self.bias, set()
            if text:
                for w in set(WORD.findall(text.lower())):
                    own = memo.get(w)
                    if own is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        own = memo[w] = tuple(f for f in word_features(w) if f in weight)
                    if own:
                        found.update(own)
                # Summed in a fixed order, so that equal texts score equally everywhere.
                z += sum(weight[f] for f in sorted(found)) + sum(a * b for a, b in zip(self.pattern_weights, patterns(text)))
            return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))

        return score


def training_sample(labelled: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int) -> DataFrame:
    """(h, text, y) of at most limit different texts: of the labelled keys with the smallest hash, those with the smallest hash.

    Rows without key, text or label teach nothing, and keys without a text take
    no place. A key or a text with several labels is toxic if one of them is.
    Only keys and hashes move before the bound holds, so neither a key on very
    many rows nor a text of very many copies grows the sample.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    rows = labelled.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    chosen = known.join(rows.select(key), key, "left_semi").orderBy(F.xxhash64(key), key).limit(limit)
    rows = rows.join(F.broadcast(chosen), key).select(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"), F.col("_y").alias("y"))
    few = rows.groupBy("h").agg(F.max("y").alias("y")).orderBy("h").limit(limit)
    return rows.select("h", "text").join(F.broadcast(few), "h").groupBy("h").agg(F.first("text").alias("text"), F.max("y").alias("y"))


def keep_one_of_copies(sample: DataFrame) -> list[int]:
    """Hashes h of the sample, one of each group of near copies.

    A text is left out if AGREE of its HASHES min-hashes are those of one text
    kept before it, with the same label: a similarity of their word triples of
    about 0.75. At 0.5 that happens to 4 % of pairs, at 0.3 to none.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [min_hashes(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.list_(pa.int64()))], ["h", "y", "m"])

    rows = map_rows(sample.select("h", "y", "text"), sign, "h long, y int, m array<long>").collect()  # at most TRAIN_ROWS texts
    kept: list[int] = []
    holders: dict[tuple[int, int, int], list[int]] = {}
    for r in sorted(rows, key=lambda r: r["h"]):
        keys = [(r["y"], i, m) for i, m in enumerate(r["m"])]
        agree = Counter(k for key in keys for k in holders.get(key, ()))
        if not agree or max(agree.values()) < AGREE:
            for key in keys:
                holders.setdefault(key, []).append(r["h"])
            kept.append(r["h"])
    return kept


def count_features(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(f, n): in how many of the texts each feature, or each of some features, occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for t in texts(batch.column(0)):
                total.update(features(t) if only is None else features(t) & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["f", "n"])

    return map_rows(rows.select("text"), count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)


def build_lexicon(sample: DataFrame) -> list[str]:
    """Features that mark toxic texts beyond chance, strongest first."""
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    toxic = {r["f"]: r["n"] for r in count_features(sample.where("y = 1"), None).where(F.col("n") >= MIN_SUPPORT).collect()}
    if not toxic:
        return []
    clean = {r["f"]: r["n"] for r in count_features(sample.where("y = 0"), frozenset(toxic)).collect()}
    names = sorted(toxic)
    a = np.array([toxic[f] for f in names], float)
    b = np.array([clean.get(f, 0) for f in names], float)
    c, d = n1 - a, n0 - b
    # G statistic of the 2 x 2 table; the threshold allows for the number of candidates.
    g = 2 * (xlogx(a) + xlogx(b) + xlogx(c) + xlogx(d) - xlogx(a + b) - xlogx(c + d) - xlogx(a + c) - xlogx(b + d) + xlogx(a + b + c + d))
    strong = (a / n1 > 4 * b / n0) & (g >= min(2 * np.log(len(names)) + 6, 0.5 * g.max()))
    order = sorted(np.flatnonzero(strong), key=lambda i: (-g[i], names[i]))
    return [names[i] for i in order[:LEXICON]]


def observe(sample: DataFrame, entries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry present, pattern values, given label) of the sample's rows, in the order of their hash."""
    index = {f: i for i, f in enumerate(entries)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = list(texts(batch.column(1)))
            found = [sorted(index[f] for f in features(t) if f in index) for t in all_texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32())), pa.array([patterns(t) for t in all_texts], pa.list_(pa.float64()))], ["h", "y", "f", "p"]
            )

    rows = sorted(map_rows(sample.select("h", "text", "y"), look, "h long, y int, f array<int>, p array<double>").collect(), key=lambda r: (r["h"], r["y"]))
    present = np.zeros((len(rows), len(entries)), np.float32)
    for i, r in enumerate(rows):
        present[i, r["f"]] = 1
    return present, np.array([r["p"] for r in rows], float).reshape(len(rows), len(PATTERNS)), np.array([r["y"] for r in rows], float)


def votes_of(present: np.ndarray, pattern: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Which voters fire on which row, and their names. The last one is the given label."""
    parts = [present[:, :VOTERS] > 0]
    names = [f"lexicon {i}" for i in range(parts[0].shape[1])]
    for i, name in enumerate(PATTERNS):
        for least in (0.2, 0.5):
            parts.append(pattern[:, i : i + 1] >= least)
            names.append(f"{name} >= {least}")
    for name, own in (("lexicon", present), ("strong half", present[:, : present.shape[1] // 2]), ("weak half", present[:, present.shape[1] // 2 :])):
        parts.append(own.sum(axis=1, keepdims=True) == 0)
        names.append(f"no {name}")
    parts.append((y == 1)[:, None])
    return np.concatenate(parts, axis=1).astype(np.float32), [*names, "label"]


@dataclass
class LabelModel:
    """Posterior of toxic by row; by voter P(fires | class), the voter it depends on (-1: none), and the share of its own evidence."""

    posterior: np.ndarray
    rates: np.ndarray
    parents: np.ndarray
    weight: np.ndarray


def _dependence(joint: np.ndarray, ones: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mutual information of each pair of voters given the class, entropy of each given the class)."""
    n = mass.sum()
    information, entropy = np.zeros(joint.shape[1:]), np.zeros(joint.shape[1])
    for c in range(2):
        m, p = mass[c], ones[c]
        both = joint[c]
        cells = (both, p[:, None] - both, p[None, :] - both, m - p[:, None] - p[None, :] + both)
        sides = ((p, p), (p, m - p), (m - p, p), (m - p, m - p))
        for cell, (a, b) in zip(cells, sides):
            cell = np.maximum(cell, 0)
            ratio = cell * m / np.maximum(a[:, None] * b[None, :], 1e-9)
            information += np.where(cell > 1e-9, cell * np.log(np.maximum(ratio, 1e-12)), 0) / n
        for a in (p, m - p):
            entropy -= np.where(a > 1e-9, a * np.log(np.maximum(a / m, 1e-12)), 0) / n
    return np.maximum(information, 0), np.maximum(entropy, 1e-12)


def _forest(information: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(voter, parent) in an order where parents come first: the forest of most information, of pairs above least (Prim)."""
    v = len(information)
    order, best, parent, out = np.zeros(v, bool), np.full(v, -1.0), np.full(v, -1), []
    for _ in range(v):
        i = int(np.argmax(np.where(order, -2, best)))
        out.append((i, int(parent[i]) if best[i] > least else -1))
        order[i] = True
        better = ~order & (information[i] > best)
        best[better], parent[better] = information[i][better], i
    return out


def label_model(votes: np.ndarray, rounds: int = 15) -> LabelModel:
    """Class, accuracies and pairwise factors of the voters, estimated together; the last voter is the given label.

    The model is P(class) P(label | class) prod P(vote | class, vote of its
    parent). EM starts from the labels, taken to be right in LABEL_ACCURACY of
    all cases; their accuracy is then estimated like that of any voter, with
    that belief as BELIEF rows. To each class are added as many rows that vote
    as all rows do on average, so that voters who always agree count as
    dependent even where the class explains them. A pair of voters gets a
    factor if it is worth its two parameters (by the Bayesian information
    criterion).
    """
    n, v = votes.shape
    label = votes[:, -1]
    q = np.where(label == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    for _ in range(rounds):
        by_class = np.stack([1 - q, q]) + BELIEF / n
        mass = by_class.sum(1)
        ones = by_class @ votes
        joint = np.stack([(votes * w[:, None]).T @ votes for w in by_class])
        rates = (ones + 0.5) / (mass[:, None] + 1)
        rates[:, -1] = (np.array([1 - q, q]) @ label + BELIEF * np.array([1 - LABEL_ACCURACY, LABEL_ACCURACY])) / mass
        information, entropy = _dependence(joint, ones, mass)
        np.fill_diagonal(information, 0)
        information[-1, :] = information[:, -1] = 0  # given the class, a label says nothing about other voters
        parents, weight = np.full(v, -1), np.ones(v)
        z = np.log(q.sum() + 1) - np.log((1 - q).sum() + 1) + np.zeros(n)
        for i, parent in _forest(information, np.log(n) / n):
            if parent < 0:
                on, off = np.log(rates[1, i] / rates[0, i]), np.log((1 - rates[1, i]) / (1 - rates[0, i]))
                z += np.where(votes[:, i] == 1, on, off)
                continue
            parents[i], weight[i] = parent, max(0.0, 1 - information[i, parent] / entropy[i])
            for state in (0, 1):
                base = ones[:, parent] if state else mass - ones[:, parent]
                fires = joint[:, i, parent] if state else ones[:, i] - joint[:, i, parent]
                p = (fires + rates[:, i]) / (base + 1)  # one row's weight of the voter's own rate
                on, off = np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0]))
                z += np.where(votes[:, parent] == state, np.where(votes[:, i] == 1, on, off), 0)
        q = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return LabelModel(q, rates, parents, weight)


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the bias is not penalised."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        grad = x1.T @ (p - q) + penalty * w
        step = np.linalg.solve((x1 * s[:, None]).T @ x1 + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = TRAIN_ROWS) -> Model:
    """A model from the labelled documents given, of at most limit texts.

    With no toxic or no clean label, and without documents, all texts score as
    clean. Ties among texts are broken by their hash, among entries by name, so
    the model does not depend on the order of rows.
    """
    sample = cut(training_sample(documents, labels, key, text, label, limit))
    kept = keep_one_of_copies(sample)  # at most limit hashes
    kept_rows = sample.sparkSession.createDataFrame([(h,) for h in kept], "h long")
    sample = cut(sample.join(F.broadcast(kept_rows), "h", "left_semi"))
    entries = build_lexicon(sample)
    present, pattern, y = observe(sample, entries)
    if not len(y) or y.min() == y.max():
        return Model(bias=-4.0)
    votes, names = votes_of(present, pattern, y)
    found = label_model(votes)
    w, bias = fit_linear(np.concatenate([present, pattern], axis=1).astype(float), found.posterior)
    bias, n = min(bias, MOST_BIAS), len(entries)
    voters = [
        {"voter": v, "fires_clean": float(found.rates[0, i]), "fires_toxic": float(found.rates[1, i]), "depends_on": names[found.parents[i]] if found.parents[i] >= 0 else None, "weight": float(found.weight[i])}
        for i, v in enumerate(names)
    ]
    return Model(entries, w[:n].tolist(), w[n:].tolist(), bias, voters)


def score_texts(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with _tox_score, 0 to 1. A null text scores as the empty one; repeated rows and all other columns stay."""
    documents = documents.drop("_tox_score")
    at = documents.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields) + ", _tox_score double"
    names = [*documents.columns, "_tox_score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own(t) for t in texts(batch.column(at))], pa.float64())], names)

    return map_rows(documents, score, schema)


#: Rows with this remainder of crc32(doc_id) modulo 5 are held out.
PARTS, HELD_OUT = 5, 0


def learned_model(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels that are not held out."""
    return train(documents, labels.where(split_of("doc_id", PARTS) != HELD_OUT))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. A document without id is not held out, and teaches nothing."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned_model(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(split_of("doc_id", PARTS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("_tox_score").alias("score"), (F.col("_tox_score") >= 0.5).cast("int").alias("predicted"))
