"""Rolling windows, fill-in-middle and fingerprints against plain Python, with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, fingerprints, rolling_windows

SF = "/root/testdata/sf0.001"


# 11 rolling windows


def plain_windows(events, windows):
    """(n, values, total, labels, median, high) by (row, window), each by reading all rows."""
    out = Counter()
    for i, (k, t, v, label) in enumerate(events):
        for w in windows:
            seen = [] if t is None else [e for e in events if e[0] == k and e[1] is not None and t // 60 * 60 - w <= e[1] // 60 * 60 < t // 60 * 60]
            values = sorted(e[2] for e in seen if e[2] is not None)
            m = len(values)
            out[(i, w)] = (len(seen), m, sum(values), len({e[3] for e in seen} - {None}), values[(m + 1) // 2 - 1] if m else None, values[-(-75 * m // 100) - 1] if m else None)
    return out


@pytest.mark.parametrize("cells", [7, 64, 1 << 20])
def test_windows_equal_plain_ones(spark, cells):
    rnd = random.Random(cells)
    events = [(rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *range(-5000, 40000, 37)]), rnd.choice([None, 0, 3, 3, rnd.randint(0, 10**12)]), rnd.choice([None, "en", "de", "x"])) for _ in range(400)]
    events += [("hot", 7200, 5, "en")] * 50 + [("alone", 100, 1, None)]
    rows = [(i, *e, "clash", -1) for i, e in enumerate(events)]
    table = spark.createDataFrame(rows, "i long, k string, t long, v long, label string, median string, window_s long")
    want = plain_windows(events, (3600, 21600))
    got = rolling_windows.window_features(table, "k", "t", "v", "label", cells=cells, partitions=5)
    assert got.columns == ["i", "k", "t", "v", "label", "event_s", "window_s", "n_events", "n_values", "total", "n_labels", "median", "high"]
    found = {(r["i"], r["window_s"]): (r["n_events"], r["n_values"], r["total"], r["n_labels"], r["median"], r["high"]) for r in got.collect()}
    assert found == want and got.count() == len(want)


def test_windows_of_nothing_and_of_odd_lengths(spark):
    table = spark.createDataFrame([], "k string, t long, v long, label string")
    assert rolling_windows.window_features(table, "k", "t", "v", "label").count() == 0
    with pytest.raises(ValueError):
        rolling_windows.window_features(table, "k", "t", "v", "label", windows=(90,))
    one = spark.createDataFrame([(1, 0, None, None), (1, 60, 4, "a"), (1, 120, 9, "a")], "k int, t long, v long, label string")
    got = rolling_windows.window_features(one, "k", "t", "v", "label", windows=(60,), quantiles=(("least", 1),)).orderBy("t").collect()
    assert [(r["n_events"], r["n_values"], r["least"]) for r in got] == [(0, 0, None), (1, 0, None), (1, 1, 4)]


def test_windows_move_no_texts_and_split_keys(spark):
    rows = spark.range(3000).select(F.lit("one").alias("source"), F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit("x"), 50).alias("text"))
    found = rolling_windows.window_features(rows.withColumn("chars", F.length("text")).drop("text"), "source", rolling_windows.minute_of(), "chars", "lang")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SinglePartition" not in plan
    # 3,000 documents are some 20 hours of one source: blocks of six hours, so several groups.
    blocks = rows.select(rolling_windows.whole(rolling_windows.minute_of(), 21600)).distinct().count()
    assert blocks >= 3 and found.count() == 6000


def test_op11_times(spark):
    for r in rolling_windows.op11_rolling_windows(spark, SF).collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        assert r["event_s"] == 60 * ((r["doc_id"] + h % 4000) // 6)


# 12 fill-in-middle

UNIT = re.compile(fill_middle.UNIT)


def plain_fill(key, text, seed=1, transformed=90, suffix_first=20):
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fill_middle.MARKS) or h[2] % 100 >= transformed:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_a_plain_one(spark):
    rnd = random.Random(12)
    texts = [None, "", "a", " ", "\r\n\x00", "é漢🙂 x", "a<P>b", "<S", "S>", "<<<", "word " * 30_000] + ["".join(rnd.choice("abZ <>PSM\n0é🙂") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no key", "clash"), (20, "same key", "clash"), (20, "same key", "clash")]
    table = spark.createDataFrame(rows, "doc_id long, text string, output string")
    for given in ({}, {"seed": 7, "transformed": 100, "suffix_first": 50}):
        got = fill_middle.transform(table, **given).withColumn("again", fill_middle.restored()).collect()
        want = sorted(((k, *plain_fill(k, t, **given), t or "") for k, t, _ in rows), key=str)
        assert sorted(map(tuple, got), key=str) == want
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(table.limit(0)).count() == 0


def test_fill_middle_keeps_no_units():
    text = "ab1" * 1000
    assert fill_middle.count_units(text, UNIT) == 2000
    assert list(fill_middle.ends(text, [0, 0, 1, 3, 2000], UNIT)) == [0, 0, 2, 5, 3000]
    seen = []

    class Watched:
        def finditer(self, t):
            for m in UNIT.finditer(t):
                seen.append(m.end())
                yield m

    assert list(fill_middle.ends(text, [5, 9], Watched())) == [8, 14] and len(seen) == 9


# 13 fingerprints


def plain_kept(hashes, window):
    """Winnowing as it is told: (hash, place) of each window's rightmost smallest hash."""
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = max(i + j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1] != (part[at - i], at):
            out.append((part[at - i], at))
    return out


@pytest.mark.parametrize("gram,window,piece", [(16, 64, 2048), (16, 64, 7), (16, 4, 64), (5, 3, 10), (4, 1, 3), (1, 12, 2048)])
def test_fingerprints_equal_plain_winnowing(spark, gram, window, piece):
    rnd = random.Random(gram * window + piece)
    stock = "ab é漢🙂"
    texts = ["", "a", "x" * gram, "x" * 300, "x" * (gram + window - 2), "x" * (gram + window - 1)]
    texts += ["".join(rnd.choice(stock) for _ in range(rnd.choice([gram, gram + 1, gram + window, 200, 1000]))) for _ in range(25)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = table.select("text", fingerprints.fingerprint(F.col("text"), gram, window, piece).alias("f")).collect()
    # The hash of a gram is a function of the gram: read off texts of just one.
    grams = sorted({t[i : i + gram] for t in texts for i in range(len(t) - gram + 1)})
    single = spark.createDataFrame([(g,) for g in grams], "text string").select("text", fingerprints.fingerprint(F.col("text"), gram, window, piece)[0]["hash"].alias("h")).collect()
    of = {r["text"]: r["h"] for r in single}
    assert len(set(of.values())) == len(of)
    for r in got:
        if len(r["text"]) >= gram:
            assert [tuple(v) for v in r["f"]] == plain_kept([of[r["text"][i : i + gram]] for i in range(len(r["text"]) - gram + 1)], window)
        else:
            assert len(r["f"]) == (r["text"] != "")


def test_grams_are_hashed_at_once(spark):
    gram = "abcdefgh é漢🙂xyz"[: fingerprints.GRAM].ljust(fingerprints.GRAM, "-")
    table = spark.createDataFrame([(gram,)], "text string")
    got = table.select(fingerprints.fingerprint(F.col("text"))[0]["hash"], F.shiftright(F.xxhash64(F.encode("text", "UTF-32")), fingerprints.PLACE)).first()
    assert got[0] == got[1]


def test_shared_passages_are_found(spark):
    rnd = random.Random(13)
    word = lambda n: "".join(chr(rnd.randint(97, 122)) for _ in range(n))
    least = fingerprints.GRAM + fingerprints.WINDOW - 1
    pairs = []
    for i in range(40):
        passage = word(least)
        pairs.append((i, word(rnd.randint(0, 5000)) + passage + word(rnd.randint(0, 300)), word(rnd.randint(0, 300)) + passage + word(rnd.randint(0, 5000))))
    table = spark.createDataFrame(pairs, "i long, a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    assert all(r[0] > 0 for r in table.select(F.size(F.array_intersect(a["hash"], b["hash"]))).collect())


def edited_by_hand(rows):
    """text and edited text by id, next id by id, of rows with ids of their own."""
    order = sorted(i for i, _ in rows if i is not None)
    follow = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    by = dict(rows)
    out = {}
    for i, t in rows:
        t = t or ""
        n = len(t)
        out[i] = (t[: n - n // 4] + ((by[follow[i]] or "")[: n // 4] if i is not None else ""), by[follow[i]] or "" if i is not None else "")
    return out


def test_edited_fingerprints_are_those_of_the_edited_texts(spark, monkeypatch):
    rnd = random.Random(14)
    word = lambda n: "".join(rnd.choice("abcdefgh é漢🙂") for _ in range(n))
    sizes = [0, 0, 1, 3, 4, 5, 15, 16, 17, 60, 78, 79, 80, 81, 100, 104, 105, 106, 107, 108, 300, 5000]
    rows = [(i * 7 - 20, word(n)) for i, n in enumerate(sizes * 3)] + [(10**17, None), (-(10**17), word(400)), (None, word(500)), (10**9, word(90))]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, edited string")
    want = edited_by_hand(rows)
    for slice_ in (fingerprints.SLICE, 5):
        monkeypatch.setattr(fingerprints, "SLICE", slice_)
        got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table).collect()}
        assert {i: r["edited"] for i, r in got.items()} == {i: e for i, (e, _) in want.items()}
        texts = [(i, x) for i, x in rows] + [(i, e) for i, (e, _) in want.items()] + [(i, n) for i, (_, n) in want.items()]
        plain = [(r["hashes"], r["places"]) for r in fingerprints.fingerprints(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
        n = len(rows)
        for k, (i, _) in enumerate(rows):
            assert got[i]["hashes"] == plain[k][0] and got[i]["places_sha256"] == hashlib.sha256(",".join(map(str, plain[k][1])).encode()).hexdigest()
        for k, i in enumerate(want):
            assert got[i]["edited_hashes"] == plain[n + k][0] and got[i]["next_hashes"] == plain[2 * n + k][0]


def test_edited_fingerprints_of_awkward_tables(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert [r["edited"] for r in fingerprints.edited_fingerprints(one).collect()] == ["abcdefab"]
    assert fingerprints.edited_fingerprints(one.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "aaaabbbb"), (1, "aaaabbbb"), (2, "zzzz"), (2, "yyyy"), (None, "nnnn"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in fingerprints.edited_fingerprints(same).collect()), key=str)
    assert got == sorted([(1, 8, "aaaabbyy"), (1, 8, "aaaabbyy"), (2, 4, "zzza"), (2, 4, "yyya"), (None, 4, "nnn"), (None, 0, "")], key=str)


def test_op13_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in fingerprints.op13_fingerprints(spark, SF).collect()}
    want = edited_by_hand(rows)
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(want[i][0].encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1 or want[i][0] != t)
    assert len(set(prints.values())) == len(prints)
    near = sorted(r["near_edited"] for r in got.values())
    assert near[len(near) // 2] > 0.5 and sorted(r["near_next"] for r in got.values())[len(near) // 2] < 0.05
