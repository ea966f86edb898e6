"""Retrieval, interval, ingest and source operators: goldens, models and the registry against DuckDB."""

import glob
import hashlib
import html
import http.server
import io
import json
import os
import random
import re
import threading
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import bands, conversation, ingest, lexical, retrieval
from tidemark.plans import registry
from tidemark.sources import files, rest
from tidemark.streaming import ingest as stream

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registry_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in registry.ORACLES:
        assert rows
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    plain = lambda rows: sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(rows) == plain(found.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_tokens(spark):
    assert value(spark, text.tokenize(F.lit("Frekvensområde 3,5-4.0 <GHz>!"))) == ["frekvensområde", "3", "5-4.0", "ghz"]
    assert value(spark, text.words(F.lit(""))) == []
    assert value(spark, text.clean_html(F.lit("a<BR/>b &auml; <i>c</i>"))) == "a b ä c"


def test_html_strip_resolves_all_entities(spark, tmp_path):
    pages = ["<p>a &lt;b&gt;&nbsp;&auml;</p>", "&#229;&#x20AC; &amp;lt; &hellip;", "&quot;x&quot;&copy;&middot;&amp;", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["text_md5"] for r in registry.QUERIES["html_strip"](spark, str(tmp_path)).collect()}
    plain = ["a <b>\u00a0ä", "å€ &lt; …", '"x"©·&']
    assert got == {i: hashlib.md5(" ".join(t.split()).encode()).hexdigest() for i, t in enumerate(plain)} | {3: None}
    assert [html.unescape(re.sub("<[^>]+>", "", p)) for p in pages[:3]] == plain


def test_html_strip_keeps_entities_without_a_semicolon(spark, tmp_path):
    """As its SQL does: titles cut off within an entity, unknown names."""
    pages = ["<h1>que&amp;&amp</h1><p>&copy &quot;a&quot;</p>", "&ampx; &am &#; &nosuch; &amp;quot;", "&&amp;amp;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLES["html_strip"]).fetchall())
    assert {r["page_id"]: r["text_md5"] for r in registry.QUERIES["html_strip"](spark, str(tmp_path)).collect()} == want
    assert want[0] == hashlib.md5(b'que&&amp&copy "a"').hexdigest()


@pytest.mark.parametrize("got,expected", [("9 kHz", 0.009), ("3,5", 3.5), ("2 GHz", 2000.0)])
def test_frequencies(spark, got, expected):
    assert value(spark, numbers.parse_frequency(F.lit(got))) == pytest.approx(expected)


def test_ranges(spark):
    q = lambda s: value(spark, numbers.parse_range_query(F.lit(s)))
    assert tuple(q("3400-3800")) == (3400, 3800) and tuple(q("1-2 ghz")) == (1000, 2000)
    assert q("5-3 MHz") is None and q("abc") is None
    assert [value(spark, numbers.format_frequency(F.lit(x))) for x in (1500.0, 5.0, 0.5, 0.0001)] == ["1.50 GHz", "5 MHz", "500.00 kHz", "100.00 Hz"]
    assert value(spark, numbers.parse_band(F.lit("9 kHz - 110 kHz"))) == pytest.approx([0.009, 0.11])
    assert value(spark, numbers.parse_band(F.lit("x"))) is None
    assert tuple(value(spark, numbers.parse_interval(F.lit("3,5<f≤4 MHz")))) == (3.5, 4.0)


def test_fusion_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "id string, rank int")
    got = retrieval.fuse(ranked("abc"), ranked("cda")).orderBy("rank").collect()
    assert [r["id"] for r in got] == list("acbd") and [r["source"] for r in got] == ["bm25", "bm25", "dense", "bm25"]


def test_searches_answer_every_query(spark):
    rnd = random.Random(7)
    rows = [(i, [float(rnd.randint(0, 3)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [1.0])]
    vectors = spark.createDataFrame(rows, "pos long, embedding array<float>").repartition(3)
    near = retrieval.dense_search_all(vectors, vectors.where("pos % 20 = 0").withColumnRenamed("pos", "query_id"), k=5).collect()
    assert {r["query_id"] for r in near} == {0, 20, 40}
    for q in (0, 20, 40):
        expected = sorted((sum((a - b) ** 2 for a, b in zip(v, rows[q][1])), i) for i, v in rows[:60])[:5]
        assert sorted((r["rank"], r["dist"], r["pos"]) for r in near if r["query_id"] == q) == [(n, d, i) for n, (d, i) in enumerate(expected, 1)]

    docs = spark.createDataFrame([(0, "a b"), (1, "b c"), (2, "c d"), (3, ""), (4, "e f")], "pos long, text string")
    queries = spark.createDataFrame([(0, "a"), (100, "d c"), (200, "unknown")], "query_id long, text string")
    index = lexical.build(docs)
    found = lexical.search_all(index, queries, k=3).collect()
    for q, words in ((0, "a"), (100, "d c"), (200, "unknown")):
        alone = lexical.search(index, words, k=3).orderBy("rank").collect()
        assert sorted((r["rank"], r["pos"], r["score"]) for r in found if r["query_id"] == q) == [(r["rank"], r["pos"], r["score"]) for r in alone]

    lists = [spark.createDataFrame([(q, x, i) for q, ids in d.items() for i, x in enumerate(ids, 1)], "query_id int, id string, rank int") for d in ({0: "abc", 1: "xy"}, {0: "cda", 2: "z"})]
    fused = retrieval.fuse(*lists, by=("query_id",)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in fused] == [*((0, x) for x in "acbd"), (1, "x"), (1, "y"), (2, "z")]

    passages = docs.withColumnRenamed("pos", "rank")
    best = retrieval.rerank_all(passages, queries.withColumnRenamed("text", "query"), top_k=2).orderBy("query_id", F.desc("rerank_score"), "rank").collect()
    assert [(r["query_id"], r["rank"], r["rerank_score"]) for r in best] == [(0, 0, 1.0), (0, 1, 0.0), (100, 2, 1.0), (100, 1, 0.5), (200, 0, 0.0), (200, 1, 0.0)]


def test_registered_searches_take_every_query_row(spark):
    expected = {name: {r[0] for r in spark.read.parquet(f"{SF}/{name}.parquet").where(f"{key} % 100 = 0").select(key).collect()} for name, key in (("embeddings", "vec_id"), ("benchmark", "item_id"))}
    got = {name: {r[0] for r in registry.QUERIES[name](spark, SF).select("query_id").distinct().collect()} for name in ("dense_knn_all", "bm25_topk_all", "rrf_hybrid_all", "rerank_top7")}
    assert got["dense_knn_all"] == expected["embeddings"] and got["bm25_topk_all"] == got["rerank_top7"] == expected["benchmark"]
    assert got["rrf_hybrid_all"] == expected["embeddings"] | expected["benchmark"]


def test_embed_hash_has_the_default_length(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = retrieval.embed(documents).select(F.size("embedding")).distinct().collect()
    assert [r[0] for r in lengths] == [retrieval.DIMS] == [1024]
    assert registry.QUERIES["embed_hash"](spark, SF).count() == documents.count()


def test_context_budget(spark):
    def kept(sizes):
        d = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "rank int, text string")
        return [r["text"] for r in retrieval.within_budget(d, 10).orderBy("rank").collect()]

    assert [len(t) for t in kept([4, 6, 1])] == [4, 6] and [len(t) for t in kept([4, 7, 1])] == [4] and kept([11]) == ["x" * 10 + "..."]


def test_packing(spark):
    d = spark.createDataFrame([("s", i, "w " * n) for i, n in enumerate([5, 5, 5, 20, 3, 3])], "source string, pos int, text string")
    got = ingest.pack(d, 12).orderBy("block_index").collect()
    assert [(r["words"], r["items"]) for r in got] == [(10, 2), (5, 1), (20, 1), (6, 2)]


def test_levels_follow_first_fit(spark):
    rnd = random.Random(4)
    rows = [("t", float(a), float(a + rnd.randint(1, 9)), i) for i, a in enumerate(rnd.choices(range(60), k=80))]
    d = spark.createDataFrame(rows, "type string, start double, end double, id long")
    ends, expected = [], {}
    for _, s, e, i in sorted(rows, key=lambda r: (r[1], r[3])):
        level = next((k for k, x in enumerate(ends) if x <= s), len(ends))
        ends[level:level + 1] = [e]
        expected[i] = level
    placed = bands.assign_levels(d)
    assert {r["id"]: r["level"] for r in placed.collect()} == expected
    assert bands.depth(d).first()["depth"] == len(ends) == bands.level_counts(placed).first()["levels"]
    assert tuple(bands.domain(d.limit(0)).first()) == (0.001, 10_000.0)
    assert bands.overlapping(d, 3, 4).count() == sum(s <= 4 and e >= 3 for _, s, e, _ in rows)


def test_bm25_saves_and_loads(spark, tmp_path):
    d = spark.createDataFrame([(0, "red fox"), (1, "blue dog"), (2, "")], "pos long, text string")
    lexical.build(d).save(str(tmp_path / "i"))
    index = lexical.Bm25Index.load(spark, str(tmp_path / "i"))
    got = lexical.search(index, "dog unknown").orderBy("rank").collect()
    assert [r["pos"] for r in got] == [1, 0, 2] and lexical.Bm25Index.load(spark, str(tmp_path / "none")) is None


def sheet(rows):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.CSV").write_text("Från (MHz);Till (MHz);Mängd (MHz);Populärnamn;Användning idag\n694;790;96;700 MHz;Mobil  data\n3,4;abc;;;radio\n;790;96;x;y\n1;2;3;4;5;6\n")
    (tmp_path / "b.xlsx").write_bytes(sheet([["h1", "h2"], ["x", "y"]]))
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "fromMhz": 1, "toMhz": 2}, {"id": 2}, "s" * 150]))
    (tmp_path / "d.docx").write_bytes(b"broken")
    raw = files.extract(files.scan(spark, str(tmp_path))).cache()
    kinds = {r["kind"]: r["n"] for r in raw.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"csv": 3, "xlsx": 1, "json": 2, "json_text": 1, "error": 1}
    columns = ["Från (MHz)", "Till (MHz)", "Mängd (MHz)", "Populärnamn", "Användning idag"]
    plan = ingest.normalise_headers(files.table_of(raw.where("kind = 'csv'"), columns))
    assert ingest.layout_of(plan.columns) == "plan"
    got = ingest.plan_documents(plan).orderBy("row").collect()
    assert [(r["row"], r["from_mhz"], r["to_mhz"]) for r in got] == [(2, 694.0, 790.0), (3, None, None)]
    assert got[0]["text"].split("\n")[0] == "Användning: Mobil data"
    table = files.table_of(raw.where("kind = 'json'"), ["id", "fromMhz", "toMhz"]).replace("", None)
    assert [r["id"] for r in ingest.exemption_documents(table).collect()] == ["1"]
    query = stream.start(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 4


def test_itu_layout(spark):
    d = spark.createDataFrame([("f", 2, "tv | radio || data", "9 kHz - 110 kHz", "note <b>1</b>")], "source string, row long, `användning` string, frekvensband string, `anmärkning` string")
    got = ingest.itu_documents(d).orderBy("usage_index").collect()
    assert [r["text"].split("\n")[0] for r in got] == ["Användning: tv", "Användning: radio", "Användning: data"]
    assert got[0]["band_mhz"] == pytest.approx([0.009, 0.11]) and got[1]["band_mhz"] is None


def test_rest(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps([{"id": 1, "name": "a"}, {"name": "b", "id": 2}] if self.path == "/list" else {"id": int(self.path.rsplit("/", 1)[1]), "name": "d"})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    items = rest.objects(rest.pull(spark, f"{url}/list"), "id long, name string")
    details = rest.objects(rest.pull(spark, f"{url}/item", ids=["1", "2"]), "id long, name string")
    got = rest.with_details(items, details).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "d"), (2, "b", "d")]
    server.shutdown()


def test_conversation(spark, tmp_path):
    path, cid = str(tmp_path / "log"), conversation.new_conversation()
    conversation.append(spark, path, cid, 0, "user", "hi")
    conversation.append(spark, path, cid, 1, "assistant", "ho")
    log = spark.read.parquet(path)
    assert conversation.history(log, cid) == [("user", "hi"), ("assistant", "ho")] and conversation.history(log, "none") == []
    assert list(conversation.answer([], lambda _: iter(["a<think>x\n", "y</think>b"]), suppress_think=True)) == ["ab"]
    assert "".join(conversation.answer([("user", conversation.question("q", "first\n\nsecond")[1])])) == "first"
