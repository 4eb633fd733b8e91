"""SimHash near-duplicates, found with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import each, fresh, is_marked, marks, place, whole
from loomery.llm.gray_index import GrayIndex, gray_rank
from loomery.llm.near_copies import near_copies
from loomery.operators.components import connected_components, local_roots
from loomery.session import materialize, table, written

SEED, SHINGLE = 42, 3


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the lower-cased words' shingles; 0 if there is no word."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = list(accumulate(map((1).__add__, map(len, words))))
        cuts = map(slice, [0, *ends], map((-1).__add__, ends[shingle - 1 :]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = np.array([fingerprint(t, shingle) for t in each(x.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def _masks(limit: int) -> list[int]:
    """Bits that at least one key of any linked pair shares: limit+1 blocks, and as many parts of the rest under each."""
    out, n = [], limit + 1
    for i in range(n):
        block = range(64 * i // n, 64 * (i + 1) // n)
        rest = [b for b in range(64) if b not in block]
        out += [sum(1 << b for b in [*block, *rest[len(rest) * j // n : len(rest) * (j + 1) // n]]) for j in range(n)]
    return out


def _links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = whole(batches)
        if rows is None:
            return
        key, code, node = (rows.column(i).to_numpy() for i in range(3))
        code = code.view(np.uint64)
        order = np.lexsort((gray_rank(code), key))
        key, code, node = key[order], code[order], node[order]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        key, code, node = key[shared], code[shared], node[shared]
        if not len(key):
            return
        root = np.arange(len(key))
        for a, b in GrayIndex(key, code).pairs(limit):
            # stars of what is linked so far: memory stays linear in the rows
            root = local_roots(np.concatenate([np.arange(len(key)), a]), np.concatenate([root, b]), len(key))
        far = root != np.arange(len(key))
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def simhash_components(docs: DataFrame, limit: int = 2, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint), component_id (smallest doc_id reachable over links of limit differing bits).

    Equal fingerprints are folded into one node before any search, so a group of copies of any size is one row there. Two
    fingerprints at limit differences or fewer agree on one of limit+1 blocks and on a part of the rest, so each node goes
    to (limit+1)^2 keyed groups, in which the Gray index finds all pairs; each group returns stars, not pairs. A node has at
    most C(64,1)+C(64,2) distinct neighbours at 2 bits, which bounds the work of crowded groups.
    Null and empty texts have fingerprint 0 and are linked like any other; rows with a null id keep a null component unless
    linked; repeated rows return repeated rows; an empty table returns no rows; other columns are ignored.
    """
    prints = materialize(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null")
    keyed = nodes.select("fp", "node", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(_masks(limit))])).alias("key"))
    links = keyed.select("key", "fp", "node").repartition("key").mapInArrow(_links(limit), "a long, b long")
    group = connected_components(links)
    known = nodes.join(group, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def hex_code(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_code(F.col("fp")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more, found by SimHash and the Gray index and verified):
    the one with the smallest id, ids that are null last; of several texts under that id the one whose hash comes first, of
    repeated rows one.

    Texts that are null or without a word are one group. An empty table gives no rows; other columns stay, whatever their
    names. Only ids and hashes are grouped; texts of rows that are a group of their own stay where they lie, the others meet the kept
    ones in a hash join whose built side holds 24 bytes a row.
    """
    found = near_copies(docs)
    own = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")
    times = found.groupBy("component", "doc_id", "row").agg(F.count("*").alias("times"))
    kept = times.groupBy("component").agg(F.min_by("times", own).alias("times"), F.min(own).alias("at"), F.sum("times").alias("rows"))
    doc, row, many = fresh(docs, "kept_doc", "kept_row", "kept_times")
    kept = written(kept.select("component", "rows", F.col("at.doc_id").alias(doc), F.col("at.row").alias(row), F.col("times").alias(many)))
    grouped = marks(found.join(kept.filter("rows > 1").select("component"), "component", "left_semi").select(place("doc_id", "row")))
    looked = F.pandas_udf(lambda at: pd.Series(is_marked(grouped, at.to_numpy())), "boolean")
    hashed, number = F.xxhash64(docs["text"].cast("string")), docs["doc_id"].cast("long")
    at = looked(place(number, hashed))
    kept = kept.select(doc, row, many)
    known = docs.filter(at).join(kept.hint("shuffle_hash"), hashed.eqNullSafe(kept[row]) & number.eqNullSafe(kept[doc]))
    once = known.filter(F.col(many) == 1).select(docs.columns)
    return docs.filter(~at).unionByName(once).unionByName(known.filter(F.col(many) > 1).dropDuplicates([doc, row]).select(docs.columns))
