"""A generalised additive model with pairwise terms, for document quality."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import each, held_out
from loomery.session import table

ROWS, BINS, PAIR_BINS, ROUNDS, PAIRS, RATE, LEAVES, SEED = 20_000, 64, 16, 200, 6, 0.1, 4, 23
SYMBOLS = b"#*$%&|<>"
FEATURES = [
    "log_chars", "log_words", "mean_word", "longest_word", "symbols", "marks", "digits", "upper", "upper_words", "distinct_words", "commonest_word", "same_neighbours", "distinct_pairs",
    "log_lines", "dup_lines", "mean_line", "deflated", "one_char_words", "end_marks", "short_lines", "at_signs", "other_bytes",
]
_MARKS = re.compile(rb"[!?;:\"'()\[\]{}~^=+_/\\-]")
_END = re.compile(rb"[.!?]")


def features(text: bytes) -> list[float]:
    """Figures of one whole text, in the order of FEATURES; an empty text gives zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    w = len(words)
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = int(codes[65:91].sum() + codes[97:123].sum() + codes[128:].sum())
    counts = Counter(words)
    follow = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = n - int(codes[[9, 10, 11, 12, 13, 32]].sum())
    # the start of a text says how far it deflates; all of it goes in, block by block
    deflated = sum(len(zlib.compress(text[i : i + 16384], 1)) for i in range(0, n, 16384))
    return [
        np.log1p(n), np.log1p(w), chars / w, max(map(len, words)), codes[list(SYMBOLS)].sum() / chars, len(_MARKS.findall(text)) / chars, codes[48:58].sum() / chars, codes[65:91].sum() / max(1, letters),
        sum(map(bytes.isupper, words)) / w, len(counts) / w, max(counts.values()) / w, sum(map(bytes.__eq__, words, words[1:])) / w, len(follow) / max(1, w - 1),
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines), deflated / n, sum(len(x) == 1 for x in words) / w, len(_END.findall(text)) / w, sum(len(x) < 40 for x in lines) / len(lines), codes[64] / chars, codes[:9].sum() / n,
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        found = np.array([features(t) for t in each(x.column(x.num_columns - 1))], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], [*x.schema.names[:-1], "x"])


@dataclass
class Additive:
    """score = sigmoid(intercept + sum of table[j][bin of x_j] + sum of pair tables)."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, t in self.pairs:
            total += t[small[a], small[b]]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Shallow tree over ordered bins: the best cuts one after another, and the Newton step of each leaf."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    spans = [(0, len(grad))]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(spans):
            at = np.arange(a + 1, b)
            if len(at):
                won = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], i, int(at[k]))
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quadrants(grad: np.ndarray, weight: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Tree of one cut on each feature of a pair: the two cuts that explain most together, and the step of each quadrant."""
    g, h = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (grad, weight))
    parts = lambda v: (v, v[-1:, :] * 0 + v[:, -1:] - v, v[-1:, :] - v, v[-1, -1] - v[-1:, :] - v[:, -1:] + v)
    gains = sum(x * x / (y + ridge) for x, y in zip(parts(g), parts(h), strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros(grad.shape)
    for rows in (slice(0, i), slice(i, None)):
        for cols in (slice(0, j), slice(j, None)):
            out[rows, cols] = grad[rows, cols].sum() / (weight[rows, cols].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Additive:
    """Cyclic boosting: each round gives every feature one shallow tree; then pairs with the most left to explain get theirs.

    With no row the score is 0.5 everywhere, with one class it is near that class everywhere.
    """
    n, f = x.shape
    mean = (y.sum() + 1) / (n + 2)
    edges, coarse = [_cuts(x[:, j], BINS) for j in range(f)], [_cuts(x[:, j], PAIR_BINS) for j in range(f)]
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], float(np.log(mean / (1 - mean))))
    if not n or len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(n, model.intercept)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(f):
            grad, weight = left()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(bins[j], grad, size), np.bincount(bins[j], weight, size), LEAVES)
            model.tables[j] += step
            total += step[bins[j]]
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    grad, weight = left()
    found = []
    for a in range(f):
        for b in range(a + 1, f):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = small[a] * shape[1] + small[b]
            g, h = np.bincount(cell, grad, shape[0] * shape[1]), np.bincount(cell, weight, shape[0] * shape[1])
            found.append(((g * g / (h + 5)).sum(), a, b, shape, cell))
    for _, a, b, shape, cell in sorted(found, key=lambda z: -z[0])[:pairs]:
        own = np.zeros(shape)
        for _ in range(max(1, rounds // 2)):
            grad, weight = left()
            g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (grad, weight))
            step = _quadrants(g, h)
            own += rate * step
            total += rate * step.ravel()[cell]
        model.pairs.append((a, b, own))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, key: str = "doc_id", text: str = "text") -> Additive:
    """Fits on at most `rows` labelled documents, those whose ids come first by hash; the driver gets their figures only.

    Null labels and ids are left out; an id labelled more than once counts as 1 if at least half of its labels are 1, and one
    with several texts gives the one whose hash comes first, so reruns learn the same. An empty table teaches nothing.
    """
    voted = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("y")).dropna().groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    bounded = voted.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)  # a sample of stated size: small enough to broadcast
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    once = own.join(F.broadcast(bounded), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = once.mapInArrow(_featured, "doc_id long, y double, x array<double>").toArrow().sort_by("doc_id")
    x = np.asarray(got.column("x").combine_chunks().flatten(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy())


def _scored(model: Additive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = np.array([features(t) for t in each(x.column(x.num_columns - 1))], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(model.score(found))], [*x.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score for each row of docs. Null texts count as empty (their figures are all 0) and long ones are read whole;
    repeated rows stay; an empty table gives no rows; other columns are ignored."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 3, 1)
    model = train(docs, table(spark, sf_dir, "labels").filter(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.5), null and empty texts judged like others. Repeated rows
    stay or go together; an empty table gives no rows; other columns stay."""
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1)))
    run = _filtered(model, docs.columns.index("text"))
    return docs.mapInArrow(run, docs.schema)


def _filtered(model: Additive, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = np.array([features(t) for t in each(x.column(at))], np.float64).reshape(-1, len(FEATURES))
            yield x.filter(pa.array(model.score(found) >= 0.5))

    return run
