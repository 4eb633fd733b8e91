"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import held_out, slices
from loomery.session import table

BUCKETS, ALPHA, GAP = 1 << 16, 0.5, 3


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for other characters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every 1-, 2- and 3-gram, other characters being one kind of gap; letters in each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = _letters()[np.frombuffer((" " * GAP).join(["", *texts, ""]).encode("utf-32-le"), np.uint32)]
    # the gap before a text is its own, so a gram belongs to the text of its first character; the last gap starts none
    owner = np.append(np.repeat(np.arange(len(texts)), sizes + GAP), np.zeros(GAP, np.int64))
    a, b, c = code[:-2], code[1:-1], code[2:]
    found, of = [], []
    for grams_, real, at in ((code * np.uint32(0x85EBCA6B), code > 0, owner), (a * np.uint32(0xC2B2AE35) + b * np.uint32(0x27D4EB2F) + np.uint32(1), (a > 0) | (b > 0), owner[:-2]), (a * np.uint32(0x9E3779B1) + b * np.uint32(0x165667B1) + c * np.uint32(0x85EBCA77) + np.uint32(2), b > 0, owner[:-2])):
        h = grams_[real]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(16)
        found.append(h & np.uint32(BUCKETS - 1))
        of.append(at[real])
    return np.concatenate(found), np.concatenate(of), np.bincount(owner[code > 0], minlength=len(texts))


def _texts(x: pa.RecordBatch, i: int, most: int) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in x.column(i).to_pylist()]
    for lo, hi in slices(np.fromiter((len(t) + GAP for t in texts), np.int64, len(texts)), most):
        yield lo, hi, texts[lo:hi]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}  # the last place: number of texts
    for x in batches:
        for lo, hi, texts in _texts(x, 1, 500_000):
            bucket, of, _ = grams(texts)
            coded = x.column(0).slice(lo, hi - lo).dictionary_encode()
            names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            n = np.bincount(at[of] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row, docs in zip(names, n, np.bincount(at, minlength=len(names)), strict=True):
                own = held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                own[:-1] += row
                own[-1] += docs
    for name, own in held.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])


@dataclass
class Bayes:
    """langs, and the log-probability of each bucket (row) in each language (column), in single precision; sums are in double."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def posterior(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bucket, of, letters = grams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        # the batch as a sparse matrix: one entry for each text and bucket that meet, with its count
        cell, n = np.unique(of * BUCKETS + bucket, return_counts=True)
        row, col = np.divmod(cell, BUCKETS)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(cell):
            total[row[first]] = np.add.reduceat(self.logp[col] * n[:, None], first, axis=0)
        total += self.prior
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), letters


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Bayes:
    """From every row with a text and a language. The driver gets one number for each bucket that a language has: 65536 times the
    languages at most, 0.25 MB each in the model; any number of them is accepted."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    counted = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow().combine_chunks()
    coded = got.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], np.int64)
    n = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    if len(got):
        n[got.column("bucket").to_numpy(), place[coded.indices.to_numpy()]] = got.column("n").to_numpy()
    body, docs_ = n[:-1] + np.float32(ALPHA), n[-1].astype(np.float64)
    total = body.sum(axis=0, dtype=np.float64)
    return Bayes(langs, np.log(body / total).astype(np.float32), np.log((docs_ + 1) / (docs_.sum() + len(langs))) if langs else np.zeros(0))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = model.value
        for x in batches:
            langs, scores = [], []
            for _, _, texts in _texts(x, 1, max(20_000, 2_000_000 // max(4, len(bayes.langs)))):
                if not bayes.langs:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                p, letters = bayes.posterior(texts)
                best = p.argmax(axis=1)
                langs += [bayes.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
                scores += np.where(letters > 0, p[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Bayes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of lang_pred; 0 for und) for each row of docs.

    Texts that are null or without a letter are und; so is every text if nothing was learned. Equal posteriors go to the first
    language by name; long texts are read whole; repeated rows stay; an empty table returns no rows; other columns are ignored.
    The model is a broadcast of 0.25 MB for each language, of which a table has as many as there are languages.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    return identify(docs, train(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
