"""Packing token runs into sequences as vector bin packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import slices
from loomery.llm.tokens import encoder
from loomery.session import table

END, ROUND, CHARS = 1, 1024, 1_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, segments, and tokens that bear loss (in a piece, all but its first, which nothing
    foretells)."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2047

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.float64)


def dot_product_bins(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers; sizes: a row of demands an item, each within limits.

    A bin at a time: of the items that still fit, the one whose demands have the largest dot product with what the bin has
    left goes in (both as shares of the limits, each dimension weighted by its mean demand; first of equals).
    """
    share = sizes / limits
    weight = share.mean(axis=0) if len(share) else np.ones(len(limits))
    order = np.argsort(-share.max(axis=1), kind="stable") if len(share) else np.zeros(0, np.int64)
    left_items, bins = share[order], []
    while len(order):
        rest, own = np.ones(len(limits)), []
        open_ = np.ones(len(order), bool)
        while True:
            open_ &= (left_items <= rest + 1e-12).all(axis=1)
            if not open_.any():
                break
            gain = np.where(open_, left_items @ (weight * rest), -1.0)
            best = int(gain.argmax())
            own.append(best)
            open_[best] = False
            rest = rest - left_items[best]
        assert own, "an item is larger than the limits"
        bins.append(order[own].tolist())
        keep = np.ones(len(order), bool)
        keep[own] = False
        order, left_items = order[keep], left_items[keep]
    return bins


def _fill_gaps(bins: list[list[tuple[int, int, int]]], limits: Limits, least: int) -> list[list[tuple[int, int, int]]]:
    """Cuts pieces (item, start, length) of the emptiest bins to close gaps of at least `least` in the fullest."""
    used = lambda b: sum(x[2] for x in b)
    bins = sorted((list(b) for b in bins), key=used, reverse=True)
    i = 0
    # tokens of one more piece that fit under the limits of tokens and of loss
    room = [min(limits.tokens - used(b), limits.loss - used(b) + len(b) + 1) for b in bins]
    while i < len(bins) - 1:
        if room[i] < least or len(bins[i]) >= limits.segments:
            i += 1
            continue
        item, start, length = bins[-1].pop()
        n = min(length, room[i])
        bins[i].append((item, start, n))
        if n < length:
            bins[-1].append((item, start + n, length - n))
        for j in (i, -1):
            room[j] = min(limits.tokens - used(bins[j]), limits.loss - used(bins[j]) + len(bins[j]) + 1)
        if not bins[-1]:
            bins.pop()
            room.pop()
    return bins


def _pack(path: str, limits: Limits, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, base, count = encoder(path), TaskContext.get().partitionId() << 40, 0
        size = min(limits.tokens, limits.loss + 1)
        open_: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids

        def closed() -> tuple[list, int]:
            sizes = np.array([(len(x[3]), 1, len(x[3]) - 1) for x in open_], np.float64).reshape(-1, 3)
            bins = [[(i, 0, len(open_[i][3])) for i in b] for b in dot_product_bins(sizes, limits.vector())]
            rows, n = [], count
            for own in _fill_gaps(bins, limits, least):
                offset = 0
                for i, at, length in own:
                    doc, start, total, ids = open_[i]
                    rows.append((doc, start + at, length, zlib.crc32(ids[at : at + length].tobytes()), total, base + n, offset))
                    offset += length
                n += 1
            open_.clear()
            return rows, n

        schema = None
        for x in batches:
            schema = pa.schema([("doc_id", x.schema.types[0]), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
            rows: list[tuple] = []
            sizes = pc.fill_null(pc.binary_length(x.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            for lo, hi in slices(sizes, CHARS):
                docs, texts = (x.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                for doc, ids in zip(docs, tokenizer.encode(["" if t is None else t for t in texts]), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    whole = len(ids) // size * size
                    for start in range(0, whole, size):
                        rows.append((doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), base + count, 0))
                        count += 1
                    if whole < len(ids):
                        open_.append((doc, whole, len(ids), ids[whole:].copy()))
                    if len(open_) >= ROUND:
                        more, count = closed()
                        rows += more
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
        if open_:
            rows, count = closed()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), least: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    A text's ids end with id 1. Runs of a whole sequence are sequences of their own; what is left of each text is an item of
    the vector bin packing (tokens, segments, loss-bearing tokens), a thousand items at a time within
    one input partition, so nothing is shuffled and a lost task packs the same again. Gaps of `least` tokens or more are
    closed by cutting pieces of the emptiest sequences. sequence_id: partition number, then a counter.
    Null and empty texts are the one id; repeated rows are packed each; an empty table returns no rows.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_pack(tokenizer, limits, least), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: Limits, key: str, tokens: str = "tokens", loss: str = "loss_tokens") -> DataFrame:
    """key, sequence_id for instruction examples that must stay whole, each with its tokens and loss-bearing tokens.

    Null counts are 0. An example over a limit has a sequence of its own. Items are packed by input partition, ROUND at a time.
    """
    own = examples.select(F.col(key).alias("key"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"), F.coalesce(F.col(loss).cast("long"), F.lit(0)).alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for x in batches:
            for lo in range(0, x.num_rows, ROUND):
                part = x.slice(lo, ROUND)
                sizes = np.stack([part.column(1).to_numpy(), np.ones(part.num_rows), part.column(2).to_numpy()], axis=1)
                bins = np.empty(part.num_rows, np.int64)
                for own_ in dot_product_bins(np.minimum(sizes, limits.vector()), limits.vector()):
                    bins[own_] = at
                    at += 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bins)], ["key", "sequence_id"])

    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, sequence_id long").withColumnRenamed("key", key)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, as `pack` gives them: null and empty texts are one id, repeated rows are packed each, an empty table gives no
    rows, columns besides id and text are left behind whatever their names. Ties go to the first sequence."""
    return pack(docs, tokenizer_path())
