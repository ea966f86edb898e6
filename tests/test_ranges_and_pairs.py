"""CSV files read in byte ranges against the whole-file reader, and overlap pairs of any lengths against brute force."""

import tracemalloc
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bands, ingest
from tidemark.plans import index
from tidemark.sources import csv_ranges, files


def test_ends_quoted_as_the_csv_reader_does():
    import csv

    rnd = random.Random(1)
    for _ in range(4000):
        line = "".join(rnd.choice('aa"";,') for _ in range(rnd.randint(0, 9)))
        for sep in ";,":
            for quoted in (False, True):
                # A record that is still open takes the next line.
                rows = list(csv.reader([('"' if quoted else "") + line + "\n", "z\n"], delimiter=sep))
                blank = not quoted and not line
                assert csv_ranges.ends_quoted(line, sep, quoted) == (len(rows) == 1 and not blank), (line, sep, quoted)


@pytest.fixture
def short_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain(root):
    out = []
    for p in sorted(root.rglob("*.*")):
        if p.suffix.lower() == ".csv":
            out += [(f"file:{p}", i, tuple(sorted(r.items()))) for i, r in enumerate(files.read_csv(p.read_bytes()), 2)]
    return sorted(out)


def test_ranges_equal_the_whole_file_reader(spark, tmp_path, short_ranges):
    rnd = random.Random(2)
    cell = lambda sep: rnd.choice(["", "x", "é 🙂", f'"a{sep}b"', '"two\nlines"', '"said ""so"""', 'st"ray', '"\n\n\r\n"', '"' + "long\n" * rnd.randint(1, 90) + '"', "1,5" if sep == ";" else "15"])
    for name, sep in (("a.csv", ";"), ("deep/b b+%.CSV", ","), ("c.csv", "\t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        body = [sep.join(cell(sep) for _ in range(rnd.randint(1, 3))) for _ in range(120)] + [""]
        (tmp_path / name).write_bytes(("﻿" * (sep == ";") + f'\nid{sep}"na\nme"{sep}x\r\n' + "\n".join(body)).encode())
    (tmp_path / "one.csv").write_text("only\n\n1\n2\n")
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"never closed\n' + "more\n" * 200 + "end")
    (tmp_path / "broken.csv").write_bytes(b"a,b\n\xff\xfe,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    (tmp_path / "other.txt").write_text("a,b\n1,2\n")
    got = csv_ranges.read_csv_ranges(spark, str(tmp_path))
    assert sorted((r["source"], r["row"], tuple(sorted(r["cells"].items()))) for r in got.collect()) == plain(tmp_path)
    read = spark.read.text(str(tmp_path / "a.csv"), lineSep="\n").select("_metadata.file_block_start").distinct().count()
    assert read > 5
    few = csv_ranges.read_csv_ranges(spark, str(tmp_path), over=1000)
    assert {r[0] for r in few.select("source").distinct().collect()} == {p for p, *_ in plain(tmp_path) if p.endswith(("/a.csv", "/b b+%.CSV", "/c.csv", "/open.csv"))}


def test_long_records_and_broken_ones(spark, tmp_path, short_ranges):
    (tmp_path / "a.csv").write_text("a,b\n1,2,3\n4,5\nx\ry,1\n6,7\n")
    got = sorted((r["row"], r["kind"], r["cells"]) for r in csv_ranges.read_csv_ranges(spark, str(tmp_path)).collect())
    assert got == [(3, "csv", {"a": "4", "b": "5"}), (4, "error", None), (5, "csv", {"a": "6", "b": "7"})]


def test_index_reads_large_csv_in_ranges(spark, tmp_path, short_ranges):
    (tmp_path / "a.csv").write_text("Name;Kind\n" + "".join(f'name {i};"kind\n{i}"\n' for i in range(100)))
    (tmp_path / "b.csv").write_text("Name;Kind\nsmall;file\n")
    docs = lambda limit: sorted(map(tuple, index.documents(spark, index.Settings(data_root=str(tmp_path), group_tables=False, whole_csv=limit)).collect()))
    assert len(docs(300)) == 101 and docs(300) == docs(1 << 20)


def test_overlap_pairs_of_any_lengths(spark):
    rnd = random.Random(4)
    edge = lambda: rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-20, 20)), rnd.uniform(-1e6, 1e6)])

    def some(n):
        out = [(i, a, a + rnd.choice([0.0, 1.0, 2.0, rnd.random(), 10 ** rnd.uniform(-3, 6)])) for i in range(n) for a in [edge()]]
        inf, nan = float("inf"), float("nan")
        return out + [(n, -inf, inf), (n + 1, 3.0, inf), (n + 2, nan, 1.0), (n + 3, 5.0, 1.0), (n + 4, None, 1.0), (n + 5, -1e300, 0.0), (n + 6, nan, nan), (n + 7, -inf, -inf), (0, *out[0][1:])]

    left, right = some(150), some(120)
    b = spark.createDataFrame(left, "id long, start double, end double").withColumn("cell", F.lit("c"))
    r = spark.createDataFrame(right, "id long, low double, high double").withColumn("level", F.lit("l"))
    touch = lambda x, y: None not in x + y and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and x[2] >= y[1]
    expected = sorted((x[0], y[0]) for x in left for y in right if touch(x, y))
    for width in (1.0, 0.3, 1000.0):
        got = bands.overlap_pairs(b, r, width)
        assert got.columns == ["id", "start", "end", "cell", "id_range", "low", "high", "level"]
        assert sorted((x["id"], x["id_range"]) for x in got.collect()) == expected
    assert bands.overlap_pairs(b.limit(0), r).count() == 0 and bands.overlap_pairs(b, r.limit(0)).count() == 0


def test_csv_rows_are_not_held():
    """Rows come before the file has been read to its end."""
    content = b"a,b\n" + b"1,2\n" * 200_000
    tracemalloc.start()
    assert sum(1 for _ in files.parse_file("x.csv", "csv", content)) == 200_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    assert files.read_csv("\ufeffa;b\n\n1\n1;2;3\n\"x\ny\";é\n".encode()) == [{"a": "1", "b": ""}, {"a": "x\ny", "b": "é"}]
    assert files.read_csv(b"") == [] and files.read_csv(b"a\n1\n") == [{"a": "1"}]


def test_packing_takes_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"text": ["x"] * 1000})
    assert [b.num_rows for b in ingest.few(iter([batch]))] == [256, 256, 256, 232]
