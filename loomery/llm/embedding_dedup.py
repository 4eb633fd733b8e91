"""Near-duplicate vectors by counting collisions on sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import slices, whole
from loomery.operators.components import connected_components, local_roots
from loomery.session import materialize, table, written

SEED, CROWD, PAIRS = 5, 2048, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio


def _cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(width: float, spread: float) -> float:
    """Chance that two values whose difference is normal with that spread fall in one cell of a grid with random offset."""
    z = width / spread
    return 1 - 2 * _cdf(-z) - 2 / (math.sqrt(2 * math.pi) * z) * (1 - math.exp(-z * z / 2))


@dataclass(frozen=True)
class Plan:
    """Projections: `tables` x `depth` that deal vectors to cells, and `lines` whose window collisions are counted.

    Two unit vectors at the threshold lie sqrt(2 - 2 x threshold) apart, so their values on a random line differ by a normal
    of that spread. All figures follow from it: `tables` so that such a pair shares a cell of one of them with chance
    `recall`, `depth` so that a cell of unrelated vectors holds about `load`, `least` so that such a pair has as many
    collisions with chance `sure`. Nearer pairs are found more surely.
    """

    threshold: float
    tables: int
    depth: int
    width: float
    lines: int
    window: float
    least: int

    @staticmethod
    def of(n: int, threshold: float, recall: float = 0.995, load: int = 64, lines: int = 32, sure: float = 0.9995) -> Plan:
        spread = math.sqrt(2 - 2 * threshold)
        width, window = 4 * spread, 2 * spread
        near, far = same_cell(width, spread), same_cell(width, math.sqrt(2))
        depth = max(1, math.ceil(math.log(max(1, n / load)) / -math.log(far)))
        tables = math.ceil(math.log(1 - recall) / math.log(1 - near**depth))
        hit = 2 * _cdf(2) - 1
        tail, least = 0.0, lines + 1
        while tail < sure and least > 0:
            least -= 1
            tail += math.comb(lines, least) * hit**least * (1 - hit) ** (lines - least)
        return Plan(threshold, tables, depth, width, lines, window, least)

    def project(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a 64-bit cell number for each vector and table, values on the counted lines)."""
        rng = np.random.default_rng([SEED, unit.shape[1]])
        basis = rng.standard_normal((unit.shape[1], self.tables * self.depth + self.lines))
        offset = rng.random(self.tables * self.depth) * self.width
        value = unit @ basis
        cell = np.floor((value[:, : len(offset)] + offset) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.depth)
        out = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64) * MIX, (len(unit), self.tables)).copy()
        for d in range(self.depth):
            out = (out ^ cell[:, :, d]) * MIX
            out ^= out >> np.uint64(29)
        return out, value[:, len(offset) :]


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values in double precision, start of each vector)."""
    return np.asarray(column.flatten(), np.float64), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])


def _matrix(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    x = flat[starts[rows][:, None] + np.arange(dim)]
    # the largest component first, so that tiny and huge vectors keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            flat, starts = _units(x.column(3))
            label = x.column(2).to_numpy().astype(np.int64).view(np.uint64)
            for dim in np.unique(np.diff(starts)).tolist():
                for lo in range(0, x.num_rows, 4096):
                    rows = lo + np.flatnonzero(np.diff(starts)[lo : lo + 4096] == dim)
                    if not len(rows):
                        continue
                    cell, _ = plan.project(_matrix(flat, starts, rows, dim))
                    key = (cell ^ (label[rows, None] + np.uint64(dim << 32)) * MIX).view(np.int64)
                    take = pa.array(np.repeat(rows, plan.tables))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(rows))), *(c.take(take) for c in x.columns)], ["key", "turn", *x.schema.names])

    return run


def _collide(plan: Plan):
    """For the vectors of one cell (or two slices of a crowded one): b = a: n more vectors linked to a; else a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = whole(batches)
        if rows is None:
            return
        key, one, two, own, turn, node, many, label = (rows.column(i).to_numpy() for i in range(8))
        flat, starts = _units(rows.column(8).combine_chunks())
        dims = np.diff(starts)
        order = np.lexsort((node, dims, label, two, one, key))
        arrays = [v[order] for v in (key, one, two, label, dims)]
        run_ = np.cumsum(np.concatenate([[0], np.any([v[1:] != v[:-1] for v in arrays], axis=0).astype(np.int64)])) if len(order) else order
        size = np.bincount(run_)[run_]
        order, run_ = order[size > 1], run_[size > 1]
        if not len(order):
            return
        degree, root = np.zeros(len(order), np.int64), np.arange(len(order))
        for dim in np.unique(dims[order]).tolist():
            part = np.flatnonzero(dims[order] == dim)
            for a, b in _near(plan, order[part], run_[part], one, two, own, turn, flat, starts, dim):
                a, b = part[a], part[b]
                np.add.at(degree, a, many[order[b]])
                np.add.at(degree, b, many[order[a]])
                root = local_roots(np.concatenate([np.arange(len(root)), a]), np.concatenate([root, b]), len(root))
        ids, far = node[order], root != np.arange(len(root))
        counted = np.flatnonzero(degree)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[counted], ids[far]])), pa.array(np.concatenate([ids[counted], ids[root[far]]])), pa.array(np.concatenate([degree[counted], np.zeros(far.sum(), np.int64)]))], ["a", "b", "n"])

    return run


def _near(plan: Plan, rows, run_, one, two, own, turn, flat, starts, dim) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of places in rows. A pair counts in the first table whose cell it shares, so it comes once."""
    unit = np.concatenate([_matrix(flat, starts, rows[i : i + 8192], dim) for i in range(0, len(rows), 8192)])
    cells, values = map(np.concatenate, zip(*(plan.project(unit[i : i + 8192]) for i in range(0, len(unit), 8192)), strict=True))
    _, number = np.unique(run_, return_inverse=True)
    place = np.empty((len(rows), plan.lines), np.int32)
    low, high = np.empty_like(place), np.empty_like(place)
    for k in range(plan.lines):
        # sort the line, cell by cell; a query's window is a range of places
        at = values[:, k] + number * 4096.0
        line = np.argsort(at, kind="stable")
        place[line, k] = np.arange(len(rows))
        low[:, k] = np.searchsorted(at[line], at - plan.window, "left")
        high[:, k] = np.searchsorted(at[line], at + plan.window, "right")
    # pairs come from the windows of the line on which cells spread most, twice as wide there: a pair at the threshold is in
    # one with a chance of 0.9999
    mean = np.stack([np.bincount(number, values[:, k]) for k in range(plan.lines)]) / np.bincount(number)
    best = int(((values - mean.T[number]) ** 2).sum(axis=0).argmax())
    at = values[:, best] + number * 4096.0
    line = np.argsort(at, kind="stable")
    left = np.searchsorted(at[line], at[line] + 2 * plan.window, "right") - np.arange(len(rows)) - 1
    for lo, hi in slices(left + 1, PAIRS):
        n = left[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        a, b = line[a], line[b]
        x, y = rows[a], rows[b]
        new = (one[x] == two[x]) | (own[x] != own[y])  # of two slices: pairs across; within one it is the turn of (i, i)
        a, b = a[new], b[new]
        hits = ((place[b] >= low[a]) & (place[b] < high[a])).sum(axis=1)
        a, b = a[hits >= plan.least], b[hits >= plan.least]
        earlier = (cells[a] == cells[b]) & (np.arange(plan.tables) < turn[rows[a]][:, None])
        a, b = a[~earlier.any(axis=1)], b[~earlier.any(axis=1)]
        linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= plan.threshold
        yield a[linked], b[linked]


def _numbered(own: DataFrame) -> DataFrame:
    """own with its labels as longs: whole numbers as they are, labels of any other type by a table of the distinct ones, so that
    labels are equal only if their own values are."""
    if own.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return own.withColumn("label", F.col("label").cast("long"))
    numbers = written(own.select(F.col("label").alias("name")).dropna().distinct().withColumn("number", F.monotonically_increasing_id()))
    return own.join(numbers, own["label"] == numbers["name"], "left").select("vec_id", F.col("number").alias("label"), "v")


def embedding_components(rows: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", plan: Plan | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Equal vectors of a label are one class with a count, whatever their number. Classes are dealt to cells by several tables
    of random projections (depth grows with the logarithm of the largest label, the number of tables follows); in a cell the
    windows of a sorted line give the pairs, their collisions on all lines are counted, and pairs that pass are verified in
    double precision. A crowded cell is cut into slices and each two slices are a task's work. Tasks return sums and stars,
    not pairs. Null labels, vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths don't link; labels may be of any type. Rows with a null vec_id link and are counted like others; their component is the
    smallest id reached, null if there is none, and they are kept only then. Repeated rows count as vectors of their own; an
    empty table returns no rows; other columns are ignored.
    """
    kind = rows.schema[vector].dataType.simpleString()
    body = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    own = _numbered(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), body.alias("v")))
    ill = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & ~ill & F.exists("v", lambda x: x != 0)
    own = own.withColumn("fit", F.coalesce(fit, F.lit(False)))
    held = materialize(own.select("vec_id", "label", "fit", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")))
    classes = own.filter("fit").groupBy("label", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # a number of its own, whatever the ids are
    plan = plan or Plan.of(classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0], threshold)
    dealt = classes.select("node", "many", "label", "v").mapInArrow(_cells(plan), f"key long, turn int, node long, many long, label long, v {own.schema['v'].dataType.simpleString()}")
    crowds = dealt.groupBy("key").count().filter(F.col("count") > CROWD).select("key", F.ceil(F.col("count") / CROWD).cast("int").alias("parts"))
    cut = dealt.join(crowds, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = cut.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "turn", "node", "many", "label", "v")
    found = materialize(work.repartition("key", "one", "two").mapInArrow(_collide(plan), "a long, b long, n long"))
    degree = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    group = connected_components(found.filter("a <> b").select("a", "b"))
    known = classes.select("label", "h", "g", "node", "many", "first_id").join(degree, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = known.join(known.groupBy("component").agg(F.min("first_id").alias("component_id")), "component")
    known = known.select("label", "h", "g", (F.col("many") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), "component_id")
    linked = held.filter("fit").join(known, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    alone = held.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
