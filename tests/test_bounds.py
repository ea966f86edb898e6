"""Pruned lexical search, neighbours by pivots and packing by slices against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.operators import bands, ingest, lexical, retrieval
from tidemark.plans import registry


def plain_bm25(texts, query, k):
    """[(pos, score)] of the k best documents, by the published formula over all documents."""
    tokens = {i: t.lower().split() for i, t in texts}
    n, avgdl = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    score = {}
    for i, t in tokens.items():
        tf = Counter(t)
        score[i] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in query.lower().split() if w in tf)
    return sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("block,frequent", [(256, 1024), (8, 20)])
def test_pruned_search_is_exact(spark, monkeypatch, block, frequent):
    rnd = random.Random(block)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "FREQUENT", frequent)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = [(i, " ".join([rnd.choice(common) for _ in range(rnd.randint(0, 40))] + [rnd.choice(rare) for _ in range(rnd.randint(0, 4))])) for i in range(500)]
    texts += [(500 + i, texts[7][1]) for i in range(60)]  # ties at the end of the list
    index = lexical.build(spark.createDataFrame(texts, "pos long, text string"))
    queries = [(0, "r1 r2 c0 c1 c2"), (1, " ".join(common)), (2, texts[7][1]), (3, "r5 r5 r9"), (4, "unknown"), (5, ""), (6, "c0")]
    asked = spark.createDataFrame(queries, "query_id int, text string")
    got = {}
    for r in lexical.search_all(index, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["score"]))
    for q, text in queries:
        want = plain_bm25(texts, text, 5)
        assert [p for p, _ in got[q]] == [p for p, _ in want] and all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got[q], want)), q
    moved = lexical.pruning(index, asked.where("query_id in (0, 2)"), 5)
    assert moved["scored"] <= moved["candidates"] < moved["postings"]


def plain_nearest(vectors, queries, k):
    out = {}
    for q, x in queries:
        near = []
        for i, v in vectors:
            if i is None or v is None or x is None or len(v) != len(x) or None in v or None in x:
                continue
            d = 0.0
            for a, b in zip(v, x):
                d += (a - b) * (a - b)
            near.append((math.floor(d * 1e9 + 0.5) / 1e9 if math.isfinite(d) else d, i))
        out[q] = [i for _, i in sorted(near, key=lambda e: (math.isnan(e[0]), e[0], e[1]))[:k]]
    return out


def test_neighbours_by_pivots_are_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART_FLOATS", 200)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(9, 5)) * 8
    vectors = [(i, (centres[i % 9 if i % 3 else 0] + rnd.normal(size=5) * 0.3).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(150)]  # a third of the rows are one vector
    vectors += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0]), (None, vectors[0][1]), (2002, [1.0, 2.0]), (2003, []), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2005, [1e200] * 5)]
    queries = [(i, v) for i, v in vectors if i is not None and i % 10 == 0] + [(5000, [0.0] * 5), (5001, [1.0, 2.5]), (5002, [3.0] * 4), (5003, [1e200] * 5)]
    table = spark.createDataFrame(vectors, "pos long, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    want = plain_nearest(vectors, queries, 12)
    got = {q: [] for q, _ in queries}
    for r in retrieval.dense_search_all(table, asked, 12).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["pos"])
    assert got == want
    assert retrieval.dense_search_all(table.limit(0), asked, 12).count() == 0
    assert retrieval.dense_search_all(table, asked.limit(0), 12).count() == 0


def test_pivots_leave_out_far_cells(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(8, 6)) * 100
    vectors = spark.createDataFrame([(i, (centres[i % 8] + rnd.normal(size=6)).tolist()) for i in range(400)], "pos long, embedding array<double>")
    pivots = {6: centres}
    placed = retrieval.place_vectors(vectors, pivots, "pos", "embedding").collect()
    cells = {}
    for c in range(8):
        away = sorted(r["away"] for r in placed if r["cell"] == c)
        cells[6, c] = (away[0], away[-1], away[:5])
    routed = retrieval.route_queries(vectors.withColumnRenamed("pos", "query_id"), pivots, cells, 5, "embedding")
    assert routed.count() == 400  # each query to its own cell only


def plain_pack(rows, most):
    out, sources = [], {}
    for s, o, t in rows:
        sources.setdefault(s, []).append((o is not None, o or 0, t is not None, t or "", t))
    for s, items in sources.items():
        block, used, n, k = [], 0, 0, 0
        for *_, t in sorted(items, key=lambda x: x[:4]):
            w = len((t or "").split())
            if n and used + w > most:
                out.append((s, k, " ".join(block), used, n))
                block, used, n, k = [], 0, 0, k + 1
            used, n = used + w, n + 1
            if t is not None:
                block.append(t)
        out.append((s, k, " ".join(block), used, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("most,slices", [(1, 3), (4, 1), (12, 40), (40, 1024)])
def test_packing_by_slices_equals_plain_packing(spark, most, slices):
    rnd = random.Random(most)
    words = lambda: " ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 9)))
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, *range(80)]), rnd.choice([None, "", words(), words(), words()])) for _ in range(300)]
    got = ingest.pack(spark.createDataFrame(rows, "source string, pos long, text string"), most, slices=slices)
    assert sorted(map(tuple, got.collect()), key=str) == plain_pack(rows, most)
    assert ingest.pack(spark.createDataFrame([], "source string, pos long, text string"), most).count() == 0


def test_a_hot_source_is_many_slices(spark):
    rows = spark.range(3000).selectExpr("'hot' AS by", "id AS o")
    sizes = [r["count"] for r in ingest.sliced(rows, 64).groupBy("slice").count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 600


def test_few_queries_meet_vectors_in_place(spark, monkeypatch):
    """The same rows whether queries go to the vectors or both are dealt by cell; vectors between pivots and of huge norms included."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 5)) * 20
    rows = [(i, (centres[i % 6] + rnd.normal(size=5)).tolist()) for i in range(500)] + [(500 + i, ((centres[i] + centres[i + 1]) / 2).tolist()) for i in range(5)]
    rows += [(600, [1e200] * 5), (601, [float("nan")] * 5), (602, [1e7] * 5), (603, [1.0, 2.0]), (604, None)]
    table = spark.createDataFrame(rows, "pos long, embedding array<double>").repartition(3)
    asked = table.where("pos % 50 = 0 OR pos > 600").select(F.struct(F.col("pos").alias("a")).alias("query_id"), "embedding")
    moved = []
    seen = retrieval.met_in_place
    monkeypatch.setattr(retrieval, "met_in_place", lambda *a: moved.append(1) or seen(*a))
    found = lambda: sorted((r["query_id"]["a"], r["rank"], r["pos"], str(r["dist"])) for r in retrieval.dense_search_all(table, asked, 7).collect())
    few = found()
    assert moved == [1]
    # Distances that the cells do not have: every vector meets all queries.
    monkeypatch.setattr(retrieval, "met_in_place", lambda rows, asked, pivots, cells, *a: seen(rows, asked, pivots, {at: (np.inf, -np.inf, first) for at, (_, _, first) in cells.items()}, *a))
    assert found() == few
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert found() == few and len(few) > 7 * 10


def test_postings_are_counted_in_their_rows(spark):
    """No shuffle of tokens; rows that share a position are one document all the same."""
    docs = spark.createDataFrame([(0, "b a b"), (1, ""), (2, None), (3, "A a a. \U0001f642 ä")], "pos long, text string")
    found = lexical.counted(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 3, "a", 1), (0, 3, "b", 2), (3, 4, "a", 2), (3, 4, "a.", 1), (3, 4, "ä", 1)]
    index = lexical.build(spark.createDataFrame([(5, "x y"), (5, "x"), (6, "y")], "pos long, text string"))
    assert sorted(map(tuple, index.postings.select("pos", "term", "tf").collect())) == [(5, "x", 2), (5, "y", 1), (6, "y", 1)]


def test_vectors_leave_in_small_batches(spark):
    """A worker holds the vectors of EMBED_ROWS texts, not of an Arrow batch: its first result is that long."""
    assert retrieval.EMBED_ROWS * retrieval.DIMS * 8 <= 4 << 20
    docs = spark.range(1000).repartition(1).select(F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("text"))
    found = retrieval.embed(docs)
    assert found.select(F.size("embedding").alias("n")).groupBy("n").count().collect() == [(1024, 1000)]
    assert found.distinct().count() == 1000


@pytest.mark.parametrize("piece", [20, 90])
def test_long_islands_are_placed_in_pieces(spark, monkeypatch, piece):
    rnd = random.Random(51)
    rows = [(t, float(a), float(a + rnd.choice([1, 4, 30, 200])), i) for t, wide in (("one", 60), ("many", 30_000), (None, 90)) for i, a in enumerate(rnd.choices(range(wide), k=150))]
    d = spark.createDataFrame(rows, "type string, start double, end double, id long").repartition(4)
    expected = []
    for t in {r[0] for r in rows}:
        ends = []
        for _, s, e, i in sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], r[3])):
            level = next((k for k, x in enumerate(ends) if x <= s), len(ends))
            ends[level : level + 1] = [e]
            expected.append((t, s, e, i, level))
    sizes, fit = [], bands._first_fit

    def seen(rows, columns, by, key):
        sizes.append(max((r["count"] for r in rows.where("level IS NULL").groupBy(by, "_island").count().collect()), default=0))
        return fit(rows, columns, by, key)

    monkeypatch.setattr(bands, "_first_fit", seen)
    placed = bands.assign_levels(d, piece=piece)
    assert placed.columns == [*d.columns, "level"]
    assert Counter(map(tuple, placed.collect())) == Counter(expected)
    assert max(sizes) <= piece * 1.5 and len(sizes) >= 150 / piece  # parts come from samples


def test_workers_get_small_batches(spark):
    import pyarrow as pa
    from tidemark.llm.common import BATCH_BYTES, map_rows

    def sizes(batches):
        for b in batches:  # a slice shows the buffers of the batch that it is cut from
            yield pa.RecordBatch.from_arrays([pa.array([sum(x.size for x in b.column(0).buffers() if x)])], ["n"])

    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert map_rows(rows, sizes, "n long").agg(F.max("n")).first()[0] < 3 * BATCH_BYTES


@pytest.mark.parametrize("step", [16, 2])
def test_near_copies_make_few_pairs(spark, monkeypatch, step):
    """Copies with two or three edits each, most pairs a little below the similarity: few are compared in full, and no link is lost."""
    rnd = random.Random(41)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(200):
        copy = list(base)
        for _ in range(2 + i % 2):
            copy[rnd.randrange(150)] = f"edit{rnd.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    confirm, pairs = near_dedup.confirm, []
    monkeypatch.setattr(near_dedup, "confirm", lambda p, *rest: pairs.append(p.count()) or confirm(p, *rest))
    monkeypatch.setattr(near_dedup, "STEP", step, raising=False)
    got = near_dedup.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=5).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == root
    assert sum(pairs) <= 8 * len(texts), pairs


def test_parity_maps_never_differ_more_than_their_sets():
    rnd = np.random.default_rng(5)
    for n, m, common in ((0, 1, 0), (30, 33, 28), (900, 700, 650), (5000, 5, 2)):
        a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:common], rnd.integers(0, 1 << 63, m - common, dtype=np.uint64)])
        differ = np.bitwise_count(near_dedup.parity(a) ^ near_dedup.parity(b)).sum()
        assert differ <= n + m - 2 * common
    assert not (near_dedup.parity(a) ^ near_dedup.parity(a[::-1])).any()


def test_searches_of_all_queries_store_no_index(spark, monkeypatch):
    """They answer given queries: neither other terms' postings nor texts are written."""

    def build(*a, **b):
        raise AssertionError("a whole index was built")

    monkeypatch.setattr(lexical, "build", build)
    for name in ("bm25_topk", "bm25_topk_all", "rrf_hybrid", "rrf_hybrid_all"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 30


@pytest.mark.parametrize("most", [lexical.BROADCAST_BYTES, 0])
def test_scan_equals_search_of_an_index(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", most)
    monkeypatch.setattr(lexical, "FREQUENT", 40)
    rnd = random.Random(61)
    words = lambda n: " ".join(f"w{int(rnd.expovariate(0.2))}" for _ in range(n))
    rows = [(i, words(rnd.randrange(1, 12))) for i in range(400)] + [(400, ""), (401, None), (402, "Rare, rare ä"), (403, "w1 w2"), (403, "w2 w3")]
    docs = spark.createDataFrame(rows, "pos long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w0 w0 w7"), (2, "RARE w1"), (3, "unknown"), (4, ""), (5, words(20)), (6, None)], "query_id long, text string")
    index, part = lexical.build(docs), lexical.build_for(docs, asked)
    assert {r["term"] for r in part.postings.collect()} == {r["term"] for r in part.terms.collect()}
    assert {r["term"] for r in part.terms.collect()} <= {r["term"] for r in lexical.query_terms(asked).collect()}
    assert part.stats.collect() == index.stats.collect()
    for name, by, values in (("postings", ["pos", "term"], ["tf", "dl", "block"]), ("terms", ["term"], ["df", "idf", "top"]), ("blocks", ["term", "block"], ["top"])):
        kept, known = ({tuple(r[c] for c in by): [r[c] for c in values] for r in getattr(x, name).collect()} for x in (part, index))
        assert kept and all(known[at] == pytest.approx(row) for at, row in kept.items())
    order = lambda found: sorted((r["query_id"], r["rank"], r["pos"], r["score"]) for r in found.collect())
    assert order(lexical.scan_all(docs, asked, 9)) == order(lexical.search_all(index, asked, 9))
    assert lexical.scan_all(docs.limit(0), asked, 9).count() == 0


def test_few_distances_are_computed_twice():
    """Exact neighbours, ties by key; a block's pairs are not all compared one component after the other."""
    import pyarrow as pa

    rnd = np.random.default_rng(62)
    vectors = rnd.normal(size=(3000, 16))
    vectors[1000:1040] = vectors[3]
    vectors[[7, 1500, 2999]] = np.array([np.nan, np.inf, 1e200])[:, None]
    queries = np.concatenate([vectors[:300], [[1e200] * 16, [np.nan] * 16]])
    computed, best = [], retrieval.Nearest(pa.array(range(302)), queries, 10)
    keep = best._keep
    best._keep = lambda at, key, dist: computed.append(len(at)) or keep(at, key, dist)
    for i in range(0, 3000, 500):
        best.add(pa.array(range(i, i + 500)), vectors[i : i + 500])
    got = best.result().to_pandas().groupby("query_id")["key"].apply(list)
    with np.errstate(over="ignore", invalid="ignore"):
        dist = np.zeros((302, 3000))
        for held, asked in zip(vectors.T, queries.T):
            dist += (held - asked[:, None]) ** 2
        dist = np.floor(dist * 1e9 + 0.5) / 1e9
    assert [got[i] for i in range(302)] == [np.lexsort((np.arange(3000), d))[:10].tolist() for d in dist]
    assert sum(computed) < 300 * 3000 / 20


@pytest.mark.parametrize("rows", [60, 2000])
def test_distances_that_round_to_the_same_are_ties(rows):
    """Sums that differ behind the ninth digit go by key, whatever path computes them."""
    import pyarrow as pa

    rnd = np.random.default_rng(63)
    vectors = np.sqrt(2 + rnd.integers(0, 3, rows) + rnd.choice([-1e-13, 0, 1e-13], rows))[:, None] * [1.0, 0.0]
    best = retrieval.Nearest(pa.array([0, 1]), np.zeros((2, 2)), 10)
    for i in range(0, rows, rows // 2):
        best.add(pa.array(range(rows - i - rows // 2, rows - i)), vectors[rows - i - rows // 2 : rows - i])
    dist = np.floor((vectors**2).sum(axis=1) * 1e9 + 0.5)
    want = np.lexsort((np.arange(rows), dist))[:10].tolist()
    assert best.result().to_pandas().groupby("query_id")["key"].apply(list).tolist() == [want, want]
