"""Fill-in-middle transformation by a streaming matcher in two passes.

A text is cut into units (a run of letters, or any other character) at two
places drawn from its key, and its parts are put in another order between
marks, so that a model reads what stands before and behind a gap and then
what belongs into it.

The places are given as ranks of units, so the number of units must be known
first. The first pass counts the matches of the unit's pattern; the second
advances one lazy match iterator to the smaller and then to the larger rank.
Neither keeps a match: besides the text and its result a worker holds two
numbers, however many units a text has.

The draws come from a digest of the key alone, so a lost task repeats the same
decisions, and rows do not depend on their neighbours or partitions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, texts

#: One unit; the pattern covers every text without gaps.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Seed of the draws; texts transformed, and of these texts with the suffix first, in per cent.
SEED, TRANSFORMED, SUFFIX_FIRST = 1, 90, 20
#: Forms: unchanged; prefix, suffix, middle; suffix, prefix, middle.
PLAIN, PSM, SPM = "plain", "psm", "spm"


def count_units(text: str, unit: re.Pattern) -> int:
    """Number of matches, none of which is kept."""
    seen = count()
    deque(zip(unit.finditer(text), seen), maxlen=0)
    return next(seen)


def ends(text: str, ranks: Iterable[int], unit: re.Pattern) -> Iterator[int]:
    """Where the first r units end, for each r of the ascending ranks, by one pass that stops at the last of them."""
    matches, done, end = unit.finditer(text), 0, 0
    for r in ranks:
        if r > done:
            end, done = next(islice(matches, r - done - 1, None)).end(), r
        yield end


def draws(key: str | Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the hex SHA-256 of the seed, a colon and the key as text; a null key is an empty text."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(form: str, prefix: str, middle: str, suffix: str, marks: tuple[str, str, str]) -> str:
    p, s, m = marks
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == PSM else f"{s}{suffix}{p}{prefix}{m}{middle}"


def transform(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = SEED,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    marks: tuple[str, str, str] = MARKS,
    unit: str = UNIT,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per row; n counts units, the others code points.

    A null text counts as empty. A text that is empty or holds a mark stays
    plain, as do those that the draw leaves out; their prefix_chars and
    middle_chars are null. Texts are taken whole, whatever their length, one
    at a time. Rows that share a key draw alike, those without key as if it
    were an empty text; repeated rows give repeated results. Other columns are
    ignored. No rows give none. unit must match at every place of a text.
    """
    key_type = documents.select(key).schema[0].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(key, seed), 1)))

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            numbers = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for t, (h1, h2, h3, h4) in zip(texts(batch.column(1)), numbers):
                n = count_units(t, pattern)
                counts.append(n)
                if not t or h3 % 100 >= transformed or any(m in t for m in marks):
                    forms.append(PLAIN)
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(t)
                    continue
                a, b = ends(t, sorted((h1 % (n + 1), h2 % (n + 1))), pattern)
                forms.append(SPM if h4 % 100 < suffix_first else PSM)
                prefixes.append(a)
                middles.append(b - a)
                outputs.append(rearranged(forms[-1], t[:a], t[a:b], t[b:], marks))
            made = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = map_rows(rows, rearrange, f"key {key_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from a transformed one and its form alone.

    A transformed text held no mark, and a mark can't arise where parts meet
    one, so the first mark of a kind is the one that was put there.
    """
    first, second, third = marks
    f = F.col(form)

    def parts(a: str, b: str) -> tuple[Column, Column, Column]:
        """What stands behind mark a, behind mark b and behind the last one."""
        body = F.substr(F.col(output), F.lit(len(a) + 1))
        one = F.substring_index(body, b, 1)
        rest = F.substr(body, F.length(one) + len(b) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    prefix, suffix, middle = parts(first, second)
    suffix_, prefix_, middle_ = parts(second, first)
    return F.when(f == PSM, F.concat(prefix, middle, suffix)).when(f == SPM, F.concat(prefix_, middle_, suffix_)).otherwise(F.col(output))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged, and rebuilt from what was made of them."""
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
unit AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
         ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM doc
),
cut AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM unit
),
part AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM part
"""
