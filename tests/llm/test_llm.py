"""Operators for training text: against libraries, brute force and round trips, with the awkward cases."""

import base64
import hashlib
import io
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import bpe_codec, chat_format, components, decontaminate, embedding_dedup, language_id, near_dedup, queries, token_count, toxicity, url_filter, warc
from tidemark.session import shared_path

DOC = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "a", "a b c", "word " * 3000, "é漢🙂 ☃", "a b c", "x\x00y\r\n\r\nz"]


def docs(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], schema)


def sentence(rnd, n, stock="the of and to in is was for that with on as by at from it an be this are".split()):
    return " ".join(rnd.choice(stock) + str(rnd.randint(0, 40)) for _ in range(n))


# 1 toxicity


def test_toxicity_learns_and_keeps_clean(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, 60) + (" moronword clownish" if i % 5 == 0 else ""), i % 5 == 0) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    got = {r["doc_id"]: r["_tox_score"] for r in toxicity.score_texts(d, model).collect()}
    assert all((got[i] >= 0.5) == b for i, _, b in rows)
    assert any(v["weight"] < 1 for v in model.voters)
    odd = toxicity.score_texts(docs(spark, ODD).withColumn("_tox_score", F.lit("clash")), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["_tox_score"] < 0.5 for r in odd)


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, ["a", None]), empty)
    assert model.entries == [] and model.scorer()(None) < 0.5


# 2 decontamination


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(15)] + [(20, None), (21, ""), (3, "W1 W1 w1, w1 w2")]
    texts = ODD + [" ".join(rnd.choice(vocabulary) for _ in range(40)) for _ in range(20)] + [items[6][1].upper() + " tail"]
    held = [(str(i), t or "") for i, t in items]
    table = spark.createDataFrame(items, "item_id long, text string")
    for bits in (decontaminate.BLOOM_BITS, 64):
        got = decontaminate.find_leaks(docs(spark, texts), table, bloom_bits=bits).orderBy("doc_id").collect()
        for t, r in zip(texts, got):
            n, hit, ids = decontaminate.brute_force(t, held)
            assert (r["_n_words"], sum(s["end"] - s["begin"] for s in r["_spans"]), r["_items"]) == (n, hit, ids)
    none = decontaminate.find_leaks(docs(spark, ["a b"]), table.limit(0)).first()
    assert none["_spans"] == [] and none["_items"] == []


# 3 near-duplicate documents


def brute_components(texts, size=4):
    sets = []
    for t in texts:
        w = near_dedup.words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root


def test_near_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = list(ODD)
    for _ in range(6):
        base = sentence(rnd, 120).split()
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = f"edit{rnd.random()}"
            texts.append(" ".join(copy))
    sizes, root = brute_components(texts)
    got = near_dedup.link_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == root
    assert [r["kept"] for r in got] == [i == c for i, c in enumerate(root)]


def test_near_dedup_empty_and_null_ids(spark):
    assert near_dedup.link_components(docs(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "other")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.link_components(rows).collect()), key=str)
    assert got.count((5, 5, True)) == 2 and (-1, 5, False) in got


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert set(got) == {*range(41), 99, 100} and all(got[i] == 0 for i in range(41)) and got[100] == got[99] == 99


def test_roots_of_trees(spark):
    parents = [(i + 1, i) for i in range(40)] + [(60 + i, 3) for i in range(5)] + [(100, 99)]
    got = {r["node"]: r["component"] for r in components.roots(spark.createDataFrame(parents, "a long, b long")).collect()}
    assert got == {a: 99 if a == 100 else 0 for a, _ in parents}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 chat formatting


def test_chat_round_trip(spark):
    texts = ["", None, r"\### Assistant: </turn> ok", "&lt;&num;#<&amp;", "a\nb </turn>\n### user: x", "plain"]
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "a:b"], texts))]
    rows += [(9, None, None, None), (9, 0, "user", "twice"), (9, 0, "user", "twice"), (None, 0, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.digest_examples(chat_format.format_chat(d)).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 0)
    assert out[0]["n_turns"] == 6 and out[0]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    loss = r"\### Assistant: </turn> ok" + "a\nb </turn>\n### user: x"
    assert (out[0]["loss_chars"], out[0]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[9]["n_turns"] == 3 and out[9]["loss_chars"] == 0 and out[None]["loss_chars"] == 1
    assert chat_format.format_chat(d).where("conv_id = 0").count() == 3  # two targets and the rest
    assert chat_format.digest_examples(chat_format.format_chat(d.limit(0))).count() == 0


# 5 byte-level BPE


def test_bpe_equals_the_library(spark):
    codec = bpe_codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd = random.Random(5)
    for leaf, window in ((1, 1), (3, 2), (7, 5), (64, 8)):
        small = bpe_codec.TreeCodec.__new__(bpe_codec.TreeCodec)
        small.coder, small.lengths, small.leaf, small.window = codec.coder, codec.lengths, leaf, window
        for _ in range(300):
            s = "".join(rnd.choice("ab'l 1 \n\té漢🙂.,   sS") for _ in range(rnd.randint(0, 90)))
            ids = small.encode(s)
            assert ids == codec.coder.encode_ordinary(s) and small.decode(ids) == s.encode()
    got = bpe_codec.encode_documents(docs(spark, ODD), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in ODD]


# 6 language identification


def test_language_id(spark):
    known = {"en": "the cat and the dog were there with that thing of theirs", "de": "der hund und die katze waren nicht mit einem ding dort", "fr": "le chien et la chatte avec une chose dans les jardins"}
    rows = [(i * 3 + k, t + f" {i}", lang, "s") for i in range(8) for k, (lang, t) in enumerate(known.items())] + [(99, None, "en", "s"), (98, "x", None, "s")]
    profiles = language_id.learn_profiles(spark.createDataFrame(rows, DOC))
    assert profiles.languages == sorted(known)
    assert [profiles.predict(t)[0] for t in ("with the thing", "nicht mit der", "dans la chose")] == ["en", "de", "fr"]
    got = language_id.identify(docs(spark, ODD), profiles).orderBy("doc_id").collect()
    assert [r["_lang_pred"] == "und" for r in got] == [True, True, True, False, False, False, False, False, False]
    assert all(0 <= r["_lang_score"] <= 1 for r in got)
    assert language_id.learn_profiles(spark.createDataFrame([], DOC)).predict("abc") == ("und", 0.0)


# 7 WARC


def test_warc_round_trip(spark):
    pages = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, "same"), (4, "u", None), (5, "v", ""), (6, "w", "é\r\n\r\nWARC/1.1\r\n"), (6, "w", "other"), (None, "n", "same")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_archives(d, path)
    got = warc.read_pages(spark, path).collect()
    expected = set()
    for i, _, html in pages:
        payload = (html or "").encode()
        first = {"same": 1, "": 4}.get(html or "", i)
        expected.add((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert len(got) == len(pages) and {tuple(r) for r in got} == expected


# 8 token counts


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), token_count.load(path)
    rnd = random.Random(8)
    for _ in range(1500):
        s = "".join(rnd.choice("aabbee thin  ▁▁\n\t<s>é漢🙂1234.,-'IlL") for _ in range(rnd.randint(1, 60)))
        assert fst.count(token_count.MARK + s.replace(" ", token_count.MARK), chunk=rnd.choice([1, 2, 5, 16, 1000])) == len(library.encode(s)), s
    got = token_count.count_tokens(docs(spark, ODD), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(library.encode(t or "")) for t in ODD]
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in ODD]


# 9 embeddings


def test_embedding_dedup_equals_brute_force(spark):
    rnd = random.Random(9)
    vectors = []
    for _ in range(40):
        base = [rnd.gauss(0, 1) for _ in range(16)]
        vectors += [base, base, [2 * x for x in base], [x + rnd.gauss(0, 0.25) for x in base], [x + rnd.gauss(0, 0.4) for x in base]]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.0]]
    d = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    pairs = embedding_dedup.brute_force(list(enumerate(vectors)))
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(d).collect()}
    assert len(got) == len(vectors)
    found, there = sum(r["n_links"] for r in got.values()), 2 * len(pairs)
    assert found <= there and found >= 0.97 * there
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 205))
    assert (got[206]["component_id"], got[206]["n_links"]) == (205, 1)
    assert embedding_dedup.link_embeddings(d.limit(0)).count() == 0


# 10 URL filter


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://A.Example.ORG/en/17?x#y", "a.example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("x.com/de/", "", "", None, "allow"),
        ("a://b?c://d/e", "b", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    d = spark.createDataFrame([(1, url), (1, url)], "page_id long, url string")
    rows = url_filter.judge_urls(d).select("_host", "_path", "_rule", "_verdict").collect()
    assert [tuple(r) for r in rows] == [(host, path, rule, verdict)] * 2


# pipeline


def test_pipeline_stages_match_the_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "bpe_codec"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in docs_.collect() if decontaminate.brute_force(r["text"], items)[1]}
    kept = corpus_pipeline.drop_leaks(spark, docs_, sf)
    assert kept.columns == docs_.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs_.collect()} - leaked
    rows = docs_.orderBy("doc_id").collect()
    _, root = brute_components([r["text"] for r in rows], corpus_pipeline.SHINGLE)
    one = corpus_pipeline.keep_one_of_each_group(spark, docs_.unionByName(docs_), sf)
    assert sorted(r["doc_id"] for r in one.collect()) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]
    assert corpus_pipeline.keep_identified(spark, docs_, sf).count() == docs_.count()


def test_url_rules_on_awkward_tables(spark):
    rules = [url_filter.Rule("b.a", "/x", "block"), url_filter.Rule("a", "/x/y", "allow"), url_filter.Rule("B.A", "/x", "allow"), url_filter.Rule("", "/", "block")]
    urls = ["h://c.b.a/x/y", "h://b.a/x", "h://a/x", "h://xb.a/x", "h:///q", "h://a./q", "h://" + "l." * 20_000 + "b.a/x", None]
    d = spark.createDataFrame([(i, u, "v", "h", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, _verdict string, _host string, _m0 int, _best int")
    expected = ["b.a/x", "b.a/x", None, None, "/", "/", "b.a/x", None]
    expected[0] = "b.a/x"  # as long as a/x/y, and its host is longer
    for shapes in (24, 0):
        url_filter.SHAPES, before = shapes, url_filter.SHAPES
        try:
            got = url_filter.judge_urls(d, rules).orderBy("page_id")
            assert got.columns == ["page_id", "url", "_host", "_path", "_rule", "_verdict"]
            rows = got.collect()
            assert [r["_rule"] for r in rows] == expected
            assert [r["_verdict"] for r in rows] == ["allow" if e is None else "block" for e in expected]
            assert url_filter.judge_urls(d.limit(0), rules).count() == 0
        finally:
            url_filter.SHAPES = before
    assert url_filter.judge_urls(d, []).where("_rule IS NULL AND _verdict = 'allow'").count() == len(urls)
    plan = url_filter.judge_urls(d, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_languages_with_repeated_ids(spark):
    rows = [(0, f"der hund und die katze nummer {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", "de") for i in range(400)] * 5
    rows += [(i, f"the cat and the dog number {'abcdefghij'[i % 10]}", "en") for i in range(60)] + [(None, "le chien", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    taught = language_id.training_rows(d, "text", "lang", "doc_id", 50).collect()
    count = {}
    for r in taught:
        count[r["lang"]] = count.get(r["lang"], 0) + 1
    assert count == {"de": 50, "en": 50, "fr": 1} and len({tuple(r) for r in taught if r["lang"] == "de"}) == 50
    assert language_id.learn_profiles(d, limit=50).predict("der hund")[0] == "de"
    clash = docs(spark, ODD).withColumn("_lang_pred", F.lit(1)).limit(3)
    assert language_id.identify(clash, language_id.Profiles({})).columns == ["doc_id", "text", "lang", "source", "_lang_pred", "_lang_score"]


def model_languages(rows, size=300):
    """Profiles and predictions as plain Python: {doc_id: (language, score)}."""
    import zlib
    from collections import Counter

    def grams(t):
        found = Counter()
        for w in "".join(c if c.isalpha() else " " for c in t).split():
            low = [c.lower() if len(c.lower()) == 1 else c for c in w]
            padded = ["\x01", *low, "\x01"]
            found.update(tuple(low[i : i + 1]) for i in range(len(low)))
            found.update(tuple(padded[i : i + 2]) for i in range(len(padded) - 1))
            found.update(tuple(padded[i : i + 3]) for i in range(len(padded) - 2))
        return found

    def best(found):
        def packed(g):
            n = 0
            for c in g:
                n = n << 21 | ord(c)
            return n

        return sorted(found, key=lambda g: (-found[g], packed(g)))[:size]

    learned = {}
    for i, t, lang in {r for r in rows if r[2] is not None and r[1] is not None}:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            learned.setdefault(lang, Counter()).update(grams(t))
    ranks = {lang: {g: n for n, g in enumerate(best(c))} for lang, c in learned.items()}
    out = {}
    for i, t, _ in rows:
        own = best(grams(t or ""))
        if not own:
            out[i] = ("und", 0.0)
            continue
        distance = {lang: sum(abs(r[g] - n) if g in r else size for n, g in enumerate(own)) for lang, r in ranks.items()}
        lang = min(sorted(distance), key=distance.get)
        out[i] = (lang, 1 - distance[lang] / (size * len(own)))
    return out


def test_op6_equals_a_plain_model(spark):
    import zlib

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = model_languages(rows)
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"], round(r["score"], 9)) == (expected[r["doc_id"]][0], round(expected[r["doc_id"]][1], 9))
    true = {i: lang for i, _, lang in rows if lang}
    held = [r for r in got if r["held_out"] and r["doc_id"] in true and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_bpe_without_spaces(spark):
    codec = bpe_codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd = random.Random(55)
    han = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(30_000))
    for t in (han, "ab" * 20_000, " " * 20_000, "\n " * 9_000, "x" * 9_000 + " " + han[:9_000] + " so \x1c\x1f! " * 900):
        ids = codec.encode(t)
        assert ids == codec.coder.encode_ordinary(t) and codec.decode(ids) == t.encode()
    done = []
    small = bpe_codec.TreeCodec.__new__(bpe_codec.TreeCodec)
    small.__dict__.update(codec.__dict__)
    small.coder = type("Counting", (), {"_encode_single_piece": lambda _, b: done.append(len(b)) or codec.coder._encode_single_piece(b), "decode_bytes": codec.coder.decode_bytes})()
    small.encode(han)
    assert sum(done) < 2 * len(han.encode())  # not once a level
    for leaf, window, reach in ((1, 1, 1), (3, 2, 2), (7, 5, 9)):
        small.__dict__.update(codec.__dict__ | {"leaf": leaf, "window": window, "reach": reach})
        for _ in range(300):
            s = "".join(rnd.choice("ab'l 1 \n\t\x1c\x85é漢🙂.,   sS") for _ in range(rnd.randint(0, 90)))
            assert small.encode(s) == codec.coder.encode_ordinary(s)


def test_op5_equals_the_library(spark):
    coder = bpe_codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).coder
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = bpe_codec.op5_bpe_codec(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = coder.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    none = docs(spark, ["a"]).limit(0).withColumn("n_tokens", F.lit(1))
    assert bpe_codec.encode_documents(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=("lang", "n_tokens")).columns == ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_op8_equals_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    expected = {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
    for split in (token_count.SPLIT, 500):
        got = token_count.count_tokens(table, path, split=split).collect()
        assert len(got) == len(expected) and {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == expected
    rnd = random.Random(88)
    odd = ["".join(rnd.choice("ab  ▁\n<s>é漢🙂12.") for _ in range(n)) for n in (0, 1, 9, 10, 11, 200, 977)] + ["漢" * 100, " " * 50, None]
    got = token_count.count_tokens(docs(spark, odd).withColumn("n_tokens", F.lit(1)), path, split=10).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(library.encode(t or "")) for t in odd]
    assert token_count.count_tokens(docs(spark, odd).limit(0), path).count() == 0


def test_warc_moves_no_payloads(spark):
    rnd = random.Random(7)
    bodies = [f"page {rnd.random()} " * rnd.randint(1, 9) for _ in range(400)]
    pages = [(i, f"http://h/{i}", rnd.choice(bodies) if i % 3 else "hot") for i in range(3000)] + [(None, None, "hot"), (None, "n", "own"), (5000, "x", "y" * 3_000_000), (5001, "x", "y" * 3_000_000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    first, expected = {}, set()
    for i, _, html in pages:
        first[html] = min(first.get(html, 1 << 60), 1 << 60 if i is None else i)
    for i, _, html in pages:
        other = None if first[html] in (i, 1 << 60) else first[html]
        expected.add((i, len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), "response" if other is None else "revisit", other))
    rows = warc.payloads(d)
    revisits = warc.find_revisits(rows)
    for bits in (64, warc.BLOOM_BITS):  # a filter that takes everything for a revisit, and the usual one
        path = shared_path(spark, "warc")
        warc.write_archives(d, path, bloom_bits=bits, block=100)
        got = warc.read_pages(spark, path).collect()
        assert len(got) == len(pages) and {tuple(r) for r in got} == expected
        plan = warc.responses(rows, revisits, bits, block=10_000)._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line for line in plan.splitlines() if "payload" in line) and "SortMergeJoin" not in plan
    path = shared_path(spark, "warc")
    warc.write_archives(d.limit(0), path)
    assert warc.read_pages(spark, path).count() == 0


def test_warc_reads_pages_a_fixed_number_of_times(spark):
    path = shared_path(spark, "pages")
    spark.range(4000).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id % 2500) AS html", "1 AS digest", "id AS h").write.parquet(path)
    rows = warc.payloads(spark.read.parquet(path))
    revisits = warc.find_revisits(rows)
    assert revisits.count() == 1500
    reads = lambda df: df._jdf.queryExecution().executedPlan().toString().count("pages-")
    known = warc.responses(rows, revisits, 64)  # a filter that takes every response for a revisit
    beyond = warc.responses(rows, revisits, 64, block=10)
    assert reads(known) == 1 and reads(beyond) == 2
    assert known.count() == beyond.count() == 2500


def test_warc_records_are_members_of_bounded_files(spark, tmp_path):
    rnd = random.Random(3)
    big = "".join(chr(rnd.randint(33, 126)) for _ in range(200_000)) * 250  # 50 MB
    pages = [(i, "u", big[: 40_000 + i]) for i in range(60)] + [(100 + i, "u", big + str(i)) for i in range(2)] + [(200, "u", big + "0")]
    path = f"file:{tmp_path}/out"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path, file_bytes=100_000)
    files = sorted(tmp_path.glob("out/*"))
    assert len(files) > 10 and all(f.name.endswith(".warc.gz") for f in files)
    for f in files:
        left, members = f.read_bytes(), 0
        while left:  # each record can be decompressed alone
            one = zlib.decompressobj(wbits=31)
            assert len(list(warc.parse(io.BytesIO(one.decompress(left))))) == 1 and one.eof
            members, left = members + 1, one.unused_data
            assert f.stat().st_size - len(left) < 100_000 or not left
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.read_pages(spark, path).collect()}
    assert got == {i: (len(html), 100 if i == 200 else None) for i, _, html in pages}


def test_warc_copies(spark):
    got = warc.copied_pages(spark.createDataFrame([(0, "u", "a"), (1, "u", "b"), (6, "u", "a")], "page_id long, url string, html string")).select("page_id").collect()
    assert sorted(r[0] for r in got) == [-7, -1, 0, 1, 6, 10_000_000, 10_000_006, 20_000_000]


def test_label_model_beats_flipped_labels():
    import numpy as np

    rnd = np.random.default_rng(11)
    truth = rnd.random(3000) < 0.3
    label = truth ^ (rnd.random(3000) < 0.1)
    fires = lambda p1, p0: rnd.random(3000) < np.where(truth, p1, p0)
    votes = [fires(0.7, 0.1), fires(0.6, 0.05), fires(0.8, 0.3), fires(0.5, 0.02)]
    votes += [votes[0] ^ (rnd.random(3000) < 0.02) for _ in range(4)]  # four echoes of one voter
    found = toxicity.label_model(np.stack([*votes, label], axis=1).astype(np.float32))
    right = lambda p: (p == truth).mean()
    assert right(found.posterior >= 0.5) > right(label) + 0.02
    assert abs(found.rates[1, 3] - 0.5) < 0.05 and abs(found.rates[0, 3] - 0.02) < 0.02  # accuracies
    assert abs(found.rates[1, -1] - 0.9) < 0.04 and abs(found.rates[0, -1] - 0.1) < 0.04  # that of the label too
    echoes = [0, 4, 5, 6, 7]
    assert sum(found.parents[i] in echoes for i in echoes) == 4 and all(found.weight[i] < 0.5 for i in echoes if found.parents[i] >= 0)
    assert found.parents[-1] == -1 and not (found.parents == len(votes)).any()


def test_toxicity_sample_is_bounded(spark):
    rnd = random.Random(12)
    d = spark.createDataFrame([(0, f"text {i} of the hot id") for i in range(500)] + [(i, "one text of many ids") for i in range(1, 300)] + [(i, sentence(rnd, 30)) for i in range(300, 340)] + [(900, None), (None, "x")], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 5000)] + [(0, 0)], "doc_id long, toxic int")
    few = toxicity.training_sample(d, y, "doc_id", "text", "toxic", 100).collect()
    assert len(few) <= 100
    every = toxicity.training_sample(d, y, "doc_id", "text", "toxic", 10_000).collect()
    assert len(every) == 541 and len({r["h"] for r in every}) == 541  # keys without a text take no place, equal texts are one
    base = sentence(rnd, 200).split()
    near = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base[:100] + sentence(rnd, 100).split()), sentence(rnd, 200)]
    rows = spark.createDataFrame([(h, t, 0) for h, t in enumerate(near)] + [(9, near[0], 1)], "h long, text string, y int")
    assert toxicity.keep_one_of_copies(rows) == [0, 2, 3, 9]  # a copy goes; half a copy and one of the other label stay


def test_op1_rows(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = toxicity.op1_toxicity(spark, sf).collect()
    score = toxicity.learned_model(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["score"] == pytest.approx(score(texts[r["doc_id"]])) and r["predicted"] == int(r["score"] >= 0.5)


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "a text", "en", "s", 6), (1, None, None, None, None)], DOC + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, held in ((toxicity.op1_toxicity, 5), (language_id.op6_language_id, 3)):
        got = {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()}
        assert got[None] is False and got[1] is not None, held


def test_decontamination_moves_no_texts(spark):
    items = spark.createDataFrame([(i, sentence(random.Random(i), 30)) for i in range(40)], "item_id long, text string")
    hit = items.where("item_id = 3").first()["text"]
    d = spark.createDataFrame([(i, hit + " copy" if i % 3 else f"own {i}", "c") for i in range(300)], "doc_id long, text string, _spans string")
    found = decontaminate.find_leaks(d, items)
    assert found.columns == ["doc_id", "text", "_n_words", "_spans", "_items"]
    assert all(r["_items"] == (["3"] if r["doc_id"] % 3 else []) and len(r["_spans"]) == (r["doc_id"] % 3 > 0) for r in found.collect())
    benchmark = decontaminate.Benchmark(items)
    plan = benchmark.hits(benchmark.places(d, "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan  # what is moved was cut before, without texts
    told = decontaminate.report_leaks(d, items, keep=("doc_id",)).drop("_n_words").collect()
    assert sorted(told) == sorted(found.select("doc_id", "_spans", "_items").collect())
    assert decontaminate.find_leaks(d.limit(0), items).count() == 0


def test_op2_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(str(r["item_id"]), r["text"] or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = decontaminate.op2_decontamination(spark, sf).collect()
    assert len(got) == len(texts) and any(r["contaminated"] for r in got)
    for r in got:
        n, hit, ids = decontaminate.brute_force(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(ids), decontaminate.items_digest(ids), hit > 0)


def test_op3_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    sizes, root = brute_components([r["text"] for r in rows])
    got = near_dedup.op3_near_dedup(spark, sf).orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    assert [tuple(r) for r in got] == [(i, n, ids[c], i == ids[c]) for i, n, c in zip(ids, sizes, root)] and len(set(root)) < len(rows)


def test_near_dedup_of_one_large_group(spark):
    rnd = random.Random(33)
    base = sentence(rnd, 90).split()
    texts = []
    for i in range(240):
        copy = list(base)
        for _ in range(i % 6):
            copy[rnd.randrange(90)] = f"edit{rnd.random()}"
        texts.append(" ".join(copy if i % 3 else sentence(rnd, 40).split()))
    _, root = brute_components(texts)
    got = near_dedup.link_components(docs(spark, texts).withColumn("component_id", F.lit(1)).repartition(7)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == root


def test_op9_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    pairs = embedding_dedup.brute_force(rows)
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    for a, b in pairs:
        links[rows[a][0]] += 1
        links[rows[b][0]] += 1
    for _ in range(20):
        for a, b in pairs:
            a, b = rows[a][0], rows[b][0]
            root[a] = root[b] = min(root[a], root[b])
    got = {r["vec_id"]: r for r in embedding_dedup.op9_embedding_dedup(spark, sf).collect()}
    assert len(got) == len(rows) and sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(pairs)
    assert all(r["n_links"] <= links[i] and r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert sum(r["component_id"] == root[i] for i, r in got.items()) >= 0.99 * len(rows)


def test_embedding_recall_on_a_skewed_table(spark):
    rnd = random.Random(99)
    hot = [rnd.gauss(0, 1) for _ in range(24)]
    vectors = [[x + rnd.gauss(0, 0.3) for x in hot] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(24)] for i in range(900)]
    d = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n_links int")
    there = 2 * len(embedding_dedup.brute_force(list(enumerate(vectors))))
    found = sum(r["n_links"] for r in embedding_dedup.link_embeddings(d).collect())
    assert 0.97 * there <= found <= there


# pipeline on awkward rows


def odd_documents(spark):
    rnd = random.Random(44)
    base = sentence(rnd, 60)
    near = base + " end"
    rows = [(1, base, "en"), (2, near, "en"), (3, sentence(rnd, 60), "en"), (3, sentence(rnd, 60), "de"), (None, base, "en"), (None, base, "en"), (None, sentence(rnd, 50), None), (5, None, "en"), (6, "", "en"), (7, "12 34", "en"), (1, base, "en"), (1, base, "fr")]
    return rows, spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOC + ", n_chars long")


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rows, d = odd_documents(spark)
    got = corpus_pipeline.keep_one_of_each_group(spark, d, "")
    assert got.columns == d.columns
    kept = sorted(((r["doc_id"], r["text"], r["lang"]) for r in got.collect()), key=str)
    # Rows 1, 2, the null ids' copies and the repeated rows are one group; what shares an id and differs stays.
    assert kept == sorted([(1, rows[0][1], "en"), *(rows[k] for k in (2, 3, 6, 7, 8, 9))], key=str)


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    rows, d = odd_documents(spark)
    sf = str(tmp_path)
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 3)) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, rows[2][1]), (1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, d.limit(0), sf)
        assert none.count() == 0, name
        assert stage(spark, d, sf).count() <= len(rows)
    assert sorted(r["text"] or "" for r in corpus_pipeline.drop_toxic(spark, d, sf).collect()) == sorted(t or "" for _, t, _ in rows)
    assert {r["text"] for r in corpus_pipeline.drop_leaks(spark, d, sf).collect()} == {t for _, t, _ in rows} - {rows[2][1]}
    coder = bpe_codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).coder
    coded = corpus_pipeline.encode(spark, d, sf).collect()
    assert sorted((list(r["ids"]) for r in coded), key=str) == sorted((coder.encode_ordinary(t or "") for _, t, _ in rows), key=str)


def test_pipeline_run_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    score = toxicity.learned_model(docs_, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    rows = [r for r in docs_.orderBy("doc_id").collect() if score(r["text"]) < 0.5]
    found = model_languages([(r["doc_id"], r["text"], r["lang"]) for r in rows])
    rows = [r for r in rows if found[r["doc_id"]][0] != "und"]
    _, root = brute_components([r["text"] for r in rows], corpus_pipeline.SHINGLE)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if not decontaminate.brute_force(r["text"], items)[1]]
    coder = bpe_codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).coder
    got = {r["doc_id"]: (r["lang"], list(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r["doc_id"]: (found[r["doc_id"]][0], coder.encode_ordinary(r["text"])) for r in rows} and 0 < len(rows) < docs_.count()


def test_words_of_many_texts():
    rnd = random.Random(22)
    decontaminate.PIECE, before = 16, decontaminate.PIECE
    try:
        for _ in range(200):
            given = [None if rnd.random() < 0.1 else "".join(rnd.choice("aAzZ09 _-\t\x00éÉ漢🙂[`{") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 5))]
            found = decontaminate.Words([None if t is None else t.encode() for t in given])
            split = [decontaminate.words(t) for t in given]
            assert found.counts.tolist() == [len(w) for w in split] and found.said(0, len(found.start)) == [x for w in split for x in w]
            alone = {x: int(decontaminate.Words([x.encode()]).hashes[0]) for w in split for x in w}
            assert [int(h) for h in found.hashes] == [alone[x] for w in split for x in w] and len(set(alone.values())) == len(alone)
    finally:
        decontaminate.PIECE = before


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
