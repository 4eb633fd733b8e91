"""What several of the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on at most so many rows in a batch between the JVM and Python: whole texts make batches of thousands of rows
    heavy."""
    before = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(rows if before <= 0 else min(rows, before)))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """The same for what runs within it; the session's own setting returns afterwards."""
    before = spark.conf.get(BATCH)
    set_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from every column of df."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


PLACES = 1 << 22


def place(*columns: Column | str) -> Column:
    """One of PLACES numbers for the values of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(PLACES))


def marks(rows: DataFrame) -> np.ndarray:
    """A bit for each place, set for those in the rows' first column: half a megabyte, whatever the rows (PLACES numbers at most
    reach the driver). A filter by it leaves rows that are not meant where they lie; a join settles those that only share a place."""
    bits = np.zeros(PLACES, bool)
    bits[rows.distinct().toArrow().column(0).to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def is_marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def each(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 of each text, null as empty, some rows at a time: a batch of long texts never stands in Python as a whole."""
    for lo in range(0, len(column), rows):
        yield from raw(column.slice(lo, rows))


def whole(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """All rows of one partition, or None if it has none."""
    rows = [x for x in batches if x.num_rows]
    return pa.Table.from_batches(rows) if rows else None


def by_key(batches: Iterable[pa.RecordBatch], column: int, least: int) -> Iterator[pa.Table]:
    """Rows sorted by a column, as tables that hold every row of each of their keys and about `least` rows."""
    held, rows = [], 0
    for x in batches:
        if not x.num_rows:
            continue
        if rows >= least:
            key = x.column(column).to_numpy(zero_copy_only=False)
            other = np.flatnonzero(key != held[-1].column(column)[held[-1].num_rows - 1].as_py())
            if len(other):
                cut = int(other[0])
                yield pa.Table.from_batches([*held, x.slice(0, cut)])
                held, rows, x = [], 0, x.slice(cut)
        held.append(x)
        rows += x.num_rows
    if held:
        yield pa.Table.from_batches(held)


def slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose weights add up to about most."""
    if len(weights):
        total = np.cumsum(weights, dtype=np.int64)
        cuts = np.unique(np.searchsorted(total, np.arange(most, total[-1] + most, most)))
        cuts = np.unique(np.concatenate([[0], np.minimum(cuts + 1, len(weights)), [len(weights)]]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
