"""Index build over files, retrieval, answers, HTTP, command line, explorer files and REST pull."""

import http.client
import http.server
import hashlib
import json
import os
import random
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark import web
from tidemark.operators import bands, explorer, ingest, retrieval
from tidemark.plans import index, service
from tidemark.sources import files, rest, vectors

PLAN = "Från (MHz);Till (MHz);Mängd (MHz);Populärnamn;Användning idag\n694;790;96;700 MHz;Mobil  data för allmänheten i hela landet\n3,4;abc;;;radio\n;790;96;x;y\n"
ITU = "Allokerat band enligt ITU-RR;Svensk användning;Frekvensband;Anmärkning\n1|2;tv | radio;9 KHZ - 110 khz;see <b>note</b>\n"


def write_files(root):
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "plan.csv").write_text(PLAN)
    (root / "itu.CSV").write_text(ITU)
    (root / "plain.csv").write_text("name;kind\nred fox;an animal that hunts by night\nblue dog;nan\n")
    (root / "ex.json").write_text(json.dumps([{"id": 7, "fromMhz": 1, "toMhz.a": 2, "condition": "low<br>power &amp; short", "reference": None}, {"id": 8}]))
    (root / "x.pdf").write_bytes(b"pdf")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    write_files(root / "data")
    settings = index.Settings(data_root=str(root / "data"), index_dir=str(root / "index"), group_tables=False, embedding_length=64)
    tables = lambda _: [[{"col": "cell", "none": "None"}]]
    return settings, index.build_index(spark, settings, pdf=lambda _: "p" * 101, pdf_tables=tables)


def test_build_over_files(spark, built):
    settings, counts = built
    docs = spark.read.parquet(f"{settings.bm25}/docs").orderBy("pos").collect()
    assert counts == {"documents": len(docs), "vectors": vectors.size(spark, settings.vectors)} and [r["pos"] for r in docs] == list(range(len(docs)))
    by = {}
    for r in docs:
        by.setdefault(r["type"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"allocation_plan": 2, "itu_allocation": 2, "csv_generic": 2, "spectrum_exemption": 1, "pdf_table_row": 1, "pdf_text": 1}
    plan = json.loads(by["allocation_plan"][0]["meta"])
    assert (plan["from_mhz"], plan["to_str"], plan["bandwidth_mhz"], plan["usage_today"]) == (694.0, "790", "96", "Mobil data för allmänheten i hela landet")
    assert "Bandbredd: 96 MHz" in by["allocation_plan"][0]["text"]
    assert by["itu_allocation"][0]["text"] == f"Användning: tv\nFrekvensband: {9 * 1e-3} - {110 * 1e-3} MHz\nITU-band: 1\t2\nAnmärkning: see  note "
    assert [r["text"] for r in by["csv_generic"]] == ["kind: an animal that hunts by night | name: red fox", "kind: nan | name: blue dog"]
    assert by["spectrum_exemption"][0]["text"] == "ID: 7 | Frekvensområde: 1 - 2 MHz | Villkor: low power & short"
    assert by["pdf_table_row"][0]["text"] == "col: cell"
    again = index.build_index(spark, settings, pdf=lambda _: "p" * 101)
    assert again["documents"] == len(docs) - 1  # overwritten, without the PDF's table
    assert index.build_index(spark, settings, pdf=lambda _: "p" * 101, pdf_tables=lambda _: [[{"col": "cell"}]]) == counts
    path = index.save_settings(spark, settings, counts)
    assert json.loads(spark.read.text(path).first()[0])["vectors"] == counts["vectors"]


def test_build_variants(spark, tmp_path):
    write_files(tmp_path / "data")
    (tmp_path / "data" / "long.csv").write_text("a;b\n" + "\n".join(f"{i};{'w ' * 30}" for i in range(12)))
    base = index.Settings(data_root=str(tmp_path / "data"))
    grouped = index.documents(spark, base).collect()
    assert {r["type"] for r in grouped} == {"grouped_block"} and all(json.loads(r["meta"])["words"] <= 200 for r in grouped) and len({r["id"] for r in grouped}) == len(grouped)
    chunked = index.documents(spark, index.replace(base, group_tables=False, chunk_tables=True, chunk_size=20, overlap=5)).collect()
    assert max(len(r["text"]) for r in chunked) == 20 and len({r["id"] for r in chunked}) == len(chunked)
    texts = index.documents(spark, index.replace(base, group_tables=False, table_as_document=False))
    assert {r["type"] for r in texts.select("type").distinct().collect()} == {"text_chunk", "spectrum_exemption"}
    set_ = index.Settings.from_env({"TIDEMARK_EMBEDDING_LENGTH": "32", "TIDEMARK_GROUP_TABLES": "false", "TIDEMARK_QUESTIONS": '["a", "b"]'}, data_root="d")
    assert (set_.embedding_length, set_.group_tables, set_.questions, set_.data_root) == (32, False, ("a", "b"), "d")


def test_collection_appends_once(spark, tmp_path):
    path = str(tmp_path / "v")
    assert vectors.size(spark, path) == 0
    rows = spark.createDataFrame([(0, "a", "t", "{}", [1.0]), (1, "b", "u", "{}", [2.0])], vectors.SCHEMA)
    vectors.append(rows, path)
    vectors.append(rows.unionByName(rows), path)
    assert vectors.size(spark, path) == 2


def plain_vector(tokens, dims):
    """Feature hashing by MD5, scaled to length 1."""
    v = [0.0] * dims
    for t in tokens:
        h = int(hashlib.md5(t.encode()).hexdigest()[:9], 16)
        v[(h >> 4) % dims] += 1 if h & 8 else -1
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def model_hybrid(docs, query, k=30, top=50):
    """Fused ids of one query, by plain Python: docs are (pos, text, embedding or None)."""
    import math
    import re

    cut = lambda t: re.findall(r"[\w.\-]+", t.lower())
    tokens = {p: cut(t) for p, t, _ in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    score = {p: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in cut(query) if w in t), 9) for p, t in tokens.items()}
    bm25 = sorted(score, key=lambda p: (-score[p], p))[:k]
    v = plain_vector(cut(query), 64)
    dist = {p: sum((a - b) ** 2 for a, b in zip(v, e)) for p, _, e in docs if e is not None}
    dense = sorted(dist, key=lambda p: (round(dist[p], 9), p))[:k]
    fused = {}
    for ranked in (dense, bm25):
        for r, p in enumerate(ranked, 1):
            fused[p] = fused.get(p, 0) + 1 / (60 + r)
    place = {p: i for i, p in enumerate([*dense, *[p for p in bm25 if p not in dense]])}
    return sorted(fused, key=lambda p: (-fused[p], place[p]))[:top]


def test_retrieval_equals_a_plain_model(spark, tmp_path):
    rnd = random.Random(6)
    stock = [f"word{i}" for i in range(60)]
    texts = [" ".join(rnd.choices(stock, k=rnd.randint(3, 25))) for _ in range(60)]
    texts += texts[:3]
    docs = spark.createDataFrame([(f"{i:03}", "s", "t", None, i, t, "{}") for i, t in enumerate(texts)], "id string, source string, type string, part string, row long, text string, meta string")
    settings = index.Settings(index_dir=str(tmp_path), embedding_length=64)
    index.build_index(spark, settings, docs=docs)
    held = {r["pos"]: list(r["embedding"]) for r in vectors.open_or_create(spark, settings.vectors).collect()}
    retriever = service.Retriever.open(spark, settings)
    asked = [(1, "word1 word2 word3"), (2, "word7 unknown"), (3, "word50 word50 word9")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    rows = retriever.hybrid(queries, top_k=50).orderBy("query_id", "rank").collect()
    plain = [(p, t, held.get(p)) for p, t in enumerate(texts)]
    for q, query in asked:
        assert [r["pos"] for r in rows if r["query_id"] == q] == model_hybrid(plain, query)
    both = retriever.retrieve(queries, presets=("word4 word5",)).collect()
    for q, query in asked:
        for no, text in enumerate((query, "word4 word5")):
            assert [r["pos"] for r in sorted(both, key=lambda r: r["rank"]) if (r["query_id"], r["query_no"]) == (q, no)] == model_hybrid(plain, text)
    own = service.Service(spark, retriever, str(tmp_path / "log"))
    context, passages = own.get_context(asked[0][1])
    once = list(dict.fromkeys(texts[p] for p in model_hybrid(plain, asked[0][1])))[:7]
    assert [p["text"] for p in passages] == once and context == "\n\n".join(once)
    assert service.contexts(retriever.retrieve(queries.limit(1)), queries).first()["context"] == context
    ranked = service.best_passages(retriever.retrieve(queries.limit(1)), queries, rerank=True).orderBy("place").collect()
    shares = [len({"word1", "word2", "word3"} & set(r["text"].split())) / 3 for r in ranked]
    assert shares == sorted(shares, reverse=True) and shares[0] == max(len({"word1", "word2", "word3"} & set(t.split())) / 3 for t in texts)
    none = service.Retriever(retriever.collection, None, dims=64)
    assert none.lexical(queries).count() == 0 and none.hybrid(queries).where("source = 'bm25'").count() == 0


def test_service_over_http(spark, built, tmp_path):
    settings, _ = built
    (tmp_path / "pub").mkdir()
    (tmp_path / "pub" / "a.json").write_text("[]")
    own = service.Service(spark, service.Retriever.open(spark, settings), str(tmp_path / "log"))
    running = web.server(own, port=0, public=str(tmp_path / "pub"))
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        c = http.client.HTTPConnection("127.0.0.1", running.server_port)
        c.request(method, path, body)
        r = c.getresponse()
        return r.status, r.read().decode()

    assert call("GET", "/health") == (200, '{"status": "ok"}') and call("GET", "/")[0] == 200 and call("GET", "/nope")[0] == 404
    assert call("GET", "/public/a.json") == (200, "[]") and call("GET", "/public/../log")[0] == 404
    cid = json.loads(call("POST", "/conversation/new")[1])["conversation_id"]
    assert call("POST", "/ask", "{}")[0] == 422
    status, answer = call("POST", "/ask", json.dumps({"query": "red fox animal", "conversation_id": cid}))
    assert status == 200 and "fox" in answer
    call("POST", "/ask", json.dumps({"query": "blue dog", "conversation_id": cid}))
    assert [role for role, _ in own.history(cid)] == ["user", "assistant"] * 2 and own.history(cid)[1][1] == answer and own.history("other") == []
    running.shutdown()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    write_files(tmp_path / "data")
    monkeypatch.setenv("TIDEMARK_EMBEDDING_LENGTH", "32")
    places = ["--data-root", str(tmp_path / "data"), "--index-dir", str(tmp_path / "index")]
    assert cli.main(["build", *places, "--no-group"]) == 0
    assert cli.main(["ask", "red fox", *places]) == 0
    assert "fox" in capsys.readouterr().out


def test_pull(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/token":
                body = "T" if self.headers["X-Key"] == "secret" else "no"
            elif self.headers["X-Key"] != "T":
                body = "[]"
            else:
                body = json.dumps([{"id": 2, "name": "b", "n": None}, {"name": "a;x", "id": 1}] if self.path == "/list" else {"id": int(self.path.rsplit("/", 1)[1]), "name": "d", "more": 1})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{running.server_port}"
    (tmp_path / "secret").write_text("secret\nrest\n")
    args = ["pull", "--token-url", f"{url}/token", "--secret-file", str(tmp_path / "secret"), "--access-header", "X-Key", "--list-url", f"{url}/list", "--detail-url", f"{url}/item", "--out", str(tmp_path / "out")]
    assert cli.main(args) == 0
    table = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out/list.csv")).orderBy("index").collect()
    assert [(r["index"], r["id"], r["name"]) for r in table] == [("0", "1", "a;x"), ("1", "2", "b")]
    merged = spark.read.json(str(tmp_path / "out/merged.json")).orderBy("id").collect()
    assert [(r["id"], r["name"], r["name.a"], r["more"]) for r in merged] == [("1", "a;x", "d", "1"), ("2", "b", "d", "1")]
    running.shutdown()
    rest.keep_token(str(tmp_path / "token"), "T")
    assert rest.first_line(str(tmp_path / "token")) == "T" and (tmp_path / "token").stat().st_mode & 0o077 == 0


def test_index_column_over_many_partitions(spark):
    rows = spark.range(997).select(F.col("id"), (F.col("id") * 7919 % 997).alias("k"), F.lit(5).alias("index")).repartition(13)
    got = rest.indexed(rows, ["k"]).orderBy("k").collect()
    assert [r["index"] for r in got] == list(range(997))


def test_explorer_files(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps([{"id": 1, "fromMhz": "9 kHz", "toMhz": "3,5", "usageDescriptionDescription": ""}, {"id": 2, "fromMhz": 5, "toMhz": 4}, {"fromMhz": None, "toMhz": "x"}], indent=1))
    (tmp_path / "dir.csv").write_text('Från (MHZ),Till (MHZ),Populärnamn,Användning idag\n1,2,,"a, b"\n2,2 GHz,n,\n')
    found = explorer.load(spark, str(tmp_path / "plan.json"), None, str(tmp_path / "dir.csv"))
    got = sorted((r["type"], r["start"], r["end"], r["label"]) for r in found.collect())
    assert got == [("Inriktning", 1.0, 2.0, "a, b"), ("Inriktning", 2.0, 2000.0, "n"), ("Plan", 9 * 1e-3, 3.5, "Plan")]
    seen = explorer.view(found, ["Inriktning", "Undantag"])
    assert {r["type"]: r["levels"] for r in seen.levels.collect()} == {"Inriktning": 1, "Undantag": 1}
    assert seen.matches("x") is None and seen.matches("1.5-1.8").count() == 1 and seen.boxes(100, 10).count() == 2
    assert explorer.load(spark).count() == 0 and explorer.view(found).placed.count() == 3


def test_levels_over_slices(spark):
    rnd = random.Random(40)
    rows = []
    for t, spread in (("dense", 100), ("gaps", 3000), (None, 50)):
        for a in (rnd.uniform(0, spread) for _ in range(150)):
            rows.append((t, a, a + rnd.choice([0.5, 3, 80]), len(rows), 9))
    d = spark.createDataFrame(rows, "type string, start double, end double, id long, level int").repartition(5)
    expected = {}
    for t in {r[0] for r in rows}:
        ends = []
        for _, s, e, i, _ in sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], r[3])):
            level = next((k for k, x in enumerate(ends) if x <= s), len(ends))
            ends[level : level + 1] = [e]
            expected[i] = level
    assert {r["id"]: r["level"] for r in bands.assign_levels(d).collect()} == expected
    ranges = spark.createDataFrame([(i, float(rnd.randint(0, 3000)), 0.0) for i in range(80)], "range_id long, low double, high double").withColumn("high", F.col("low") + F.col("range_id") % 9)
    count = {r["range_id"]: n for r in ranges.collect() if (n := sum(s <= r["high"] and e >= r["low"] for _, s, e, *_ in rows))}
    assert {r["range_id"]: r["n"] for r in bands.overlap_counts(d, ranges).collect()} == count
    pairs = bands.overlap_join(d, ranges, 32.0).groupBy("range_id").agg(F.count("*").alias("n")).collect()
    assert {r["range_id"]: r["n"] for r in pairs} == count


def test_plan_blocks(spark):
    rows = spark.createDataFrame([("f", i, str(i), str(i + 1), "use " * i) for i in range(1, 6)], "source string, row long, `från_(mhz)` string, `till_(mhz)` string, `användning_idag` string")
    got = ingest.plan_blocks(rows, most=16).orderBy("block_index").collect()
    assert [r["items"] for r in got] == [2, 1, 1, 1] and got[0]["text"].startswith("Frekvens: 1-2 MHz | Användning: use Frekvens: 2-3 MHz")


def test_entry_works_without_packages_for_training_text(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nassert 'bm25_topk' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert run.returncode == 0 and ("xxhash" in run.stderr or "left out" in run.stderr or run.stderr == ""), run.stderr


def test_hashed_vectors(spark):
    texts = [None, "", "a", "a a b", "Ärta å ö", " ".join(f"w{i}" for i in range(5000))] * 300
    got = retrieval.embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2), dims=32).collect()
    want = {t: plain_vector((t or "").lower().split(), 32) for t in texts}
    assert len(got) == len(texts) and all(list(r["embedding"]) == want[r["text"]] for r in got)


def test_models_get_batches(spark):
    seen = spark.createDataFrame([(f"t{i}",) for i in range(250)], "text string").coalesce(1)
    sizes = {r["embedding"][0] for r in retrieval.embed(seen, lambda batch: [[float(len(batch))] for _ in batch], dims=1).collect()}
    assert sizes == {100.0, 50.0}


def test_failed_embedding_batch(spark):
    d = spark.createDataFrame([("a b",), (None,)], "text string")

    def broken(_):
        raise RuntimeError("down")

    assert [list(r["embedding"]) for r in retrieval.embed(d, broken, dims=4).collect()] == [[0.0] * 4] * 2
    assert files.SUFFIXES[0] == "pdf"


def test_whole_texts(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ntwo\n")
    assert [r["text"] for r in files.read_text(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]
