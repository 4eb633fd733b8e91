"""Fill-in-the-middle: a text is cut at two random units and its middle moves to the end.

The units are never stored: the first pass over a text counts them, the second advances one lazy match iterator to the two
ranks at which the text is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import each, fresh, set_batches
from loomery.session import table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: [A-Za-z]+|[^A-Za-z] over the code points of UTF-8
UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z][\x80-\xBF]*")
_LATER_BYTES = bytes(range(0x80, 0xC0))


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers of 32 bits that the seed and the id fix; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def count_units(text: bytes) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def cuts(text: bytes, first: int, second: int) -> tuple[int, int]:
    """The bytes at which the first units end, and the second; first <= second <= units of the text."""
    units, ends, passed = UNIT.finditer(text), [], 0
    for rank in (first, second):
        if rank > passed:
            ends.append(next(islice(units, rank - passed - 1, None)).end())
        else:
            ends.append(ends[-1] if ends else 0)
        passed = rank
    return ends[0], ends[1]


def code_points(text: bytes) -> int:
    return len(text.translate(None, _LATER_BYTES))


def moved(text: bytes, doc_id: object, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, output."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts(text, a, b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", code_points(prefix), code_points(middle), b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", code_points(prefix), code_points(middle), b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain), output for each row.

    `rate` of 100 texts are cut, `spm` of 100 of those put the suffix first. Null texts count as empty; empty texts and texts
    that hold a mark stay plain. Rows of one id are cut at the same draws, repeated rows return repeated rows; a null id
    draws like an empty one. A text of any length is handled in memory linear in it, in addition to which nothing grows. An empty table
    returns no rows; other columns are ignored, whatever their names. No shuffle.
    """
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                rows = [moved(t, i, seed, rate, spm) for i, t in zip(part.column(0).to_pylist(), each(part.column(1)), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(key), F.col(text).cast("string").alias(fresh(docs.select(key), "text")[0])).mapInArrow(run, shape)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks can't arise where parts meet, since a part holds none and `<` begins one."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_batches(spark)
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    output, back = F.col("output"), restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = """
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
b AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM a),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (
  SELECT *, array_to_string(units[1:p], '') AS prefix, array_to_string(units[p + 1:q], '') AS middle,
    array_to_string(units[q + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM d
"""
