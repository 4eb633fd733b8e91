"""A partitioned index over vectors with exact search: cells around centroids, rings of equal angle within a cell.

The angle between a query and a vector is at least the difference of their angles to any third direction. So a ring whose angles to
its centroid differ from the query's by more than the threshold allows holds no match, and is not scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import materialize, written

#: vectors that k-means is fitted on; vectors a cell, most cells, rounds of k-means; angle of a ring; vectors and queries of one
#: task's product
SAMPLE, IN_CELL, CELLS, ROUNDS, RING, PART, ASKED = 20_000, 8192, 1024, 8, 0.1, 4096, 2048
PROBES, SLACK, DIGITS = 2, 1e-7, 12


@dataclass(frozen=True)
class VectorIndex:
    """vectors: item, unit (length 1), cell, ring, part; rings: cell, ring, part, n; both written. centroids: cells x dimensions."""

    vectors: DataFrame
    rings: DataFrame
    centroids: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, unit of rows whose vector has a direction: neither null nor zero, all of it finite."""
    for x in batches:
        units, kept = [], []
        for i, row in enumerate(x.column(1)):
            v = None if not row.is_valid or row.values.null_count else row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if v is not None and len(v) and np.isfinite(v).all() and (size := np.sqrt(v @ v)) > 0 and np.isfinite(size):
                units.append(v / size)
                kept.append(i)
        yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(kept, pa.int64())), pa.array(units, pa.list_(pa.float64()))], ["item", "unit"])


def units(df: DataFrame, key: str, vector: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("item"), vector).mapInArrow(_units, f"item {kind}, unit array<double>")


def centroids(sample: np.ndarray, cells: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a cell that empties keeps its direction."""
    rng = np.random.default_rng(seed)
    found = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(rounds):
        own = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _placed(shared, ring: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                dots = _matrix(x.column(1)) @ shared.value.T
                cell = np.argmax(dots, axis=1)
                at = np.floor(_angle(dots[np.arange(len(cell)), cell]) / ring)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(cell.astype(np.int32)), pa.array(at.astype(np.int32))], ["item", "unit", "cell", "ring"])

    return run


def build(df: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, ring: float = RING, part: int = PART) -> VectorIndex:
    """Every vector with a direction, in the cell of its nearest centroid. Centroids come from the `sample` vectors that are first by
    hash of the key: the driver holds sample + cells vectors. Without a number of cells there is one for IN_CELL vectors, CELLS at most. Rings of more than `part` vectors are split by hash."""
    own = written(units(df, key, vector))
    cells = cells or max(1, min(CELLS, own.count() // IN_CELL))
    kind = own.schema["item"].dataType.simpleString()
    drawn = own.select("unit", F.xxhash64("item").alias("at")).orderBy("at").limit(sample).toArrow().sort_by("at")
    found = centroids(_matrix(drawn.column("unit").combine_chunks()), cells, ROUNDS) if len(drawn) else np.zeros((0, 1))
    if not len(found):
        placed = own.select("item", "unit", F.lit(0).alias("cell"), F.lit(0).alias("ring"))
    else:
        shared = df.sparkSession.sparkContext.broadcast(found)
        placed = written(own.mapInArrow(_placed(shared, ring), f"item {kind}, unit array<double>, cell int, ring int"))
    parts = placed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = written(placed.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")).drop("parts"))
    return VectorIndex(dealt, written(dealt.groupBy("cell", "ring", "part").agg(F.count("*").alias("n"))), found)


def _routes(shared, rings: np.ndarray, ring: float, probes: int | None):
    """query, cell, ring: the rings that can hold a vector at the least similarity of a query (least, null: any), or without a least
    those of its `probes` nearest cells. rings: (cell, ring) of all rings there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 64):
                part = x.slice(lo, 64)
                dots = _matrix(part.column(1)) @ shared.value.T
                if probes is not None:
                    near = dots >= np.partition(dots, max(0, dots.shape[1] - probes), axis=1)[:, [max(0, dots.shape[1] - probes)]]
                    hit = near[:, rings[:, 0]]
                else:
                    least = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isnan(least), np.pi, _angle(np.nan_to_num(least))) + SLACK
                    own = _angle(dots)[:, rings[:, 0]]
                    hit = (own >= rings[:, 1] * ring - reach[:, None]) & (own <= (rings[:, 1] + 1) * ring + reach[:, None])
                at, which = np.nonzero(hit)
                found = part.take(pa.array(at))
                columns = [found.column(0), found.column(1), *(pa.array(rings[which, j].astype(np.int32)) for j in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "q_unit", "cell", "ring"])

    return run


def _best_of_group(k: int | None, at_least: float | None):
    """Of vectors and queries of one group, each query's k best and what ties with them, at `at_least` or more."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "item", "similarity"]
        kinds = [right.schema.field("query").type, left.schema.field("item").type, pa.float64()]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        corpus, out = _matrix(left.column("unit").combine_chunks()), []
        asked = _matrix(right.column("q_unit").combine_chunks())
        for lo in range(0, len(asked), 256):
            found = np.round(asked[lo : lo + 256] @ corpus.T, DIGITS)
            keep = np.ones(found.shape, bool) if at_least is None else found >= at_least
            if k is not None and found.shape[1] > k:
                keep &= found >= np.partition(found, found.shape[1] - k, axis=1)[:, [found.shape[1] - k]]
            at, which = np.nonzero(keep)
            columns = [right.column("query").take(pa.array(at + lo)), left.column("item").take(pa.array(which)), pa.chunked_array([pa.array(found[at, which])])]
            out.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(out)

    return run


class VectorSearch:
    """`found`: query, item, similarity (cosine, rounded to 12 digits), rank of the k most similar vectors of each query, ties by item;
    or without k all at `at_least` or more, unranked.

    The nearest cells of a query are scored first; its k-th similarity there is the threshold for all other rings. `scored`: query,
    cell, ring, part, n of what the second step scores. Queries without a direction find nothing.
    """

    def __init__(self, index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int | None = None, at_least: float | None = None, ring: float = RING, probes: int = PROBES) -> None:
        self.index, self.k, self.at_least, self.ring = index, k, at_least, ring
        own = written(units(queries, query, vector).withColumnRenamed("item", "query"))
        self.groups = max(1, -(-own.count() // ASKED))
        known = index.rings.select("cell", "ring").distinct().toArrow()  # cells x pi / ring rows at most
        self.known = np.stack([known.column(c).to_numpy() for c in ("cell", "ring")], 1).reshape(-1, 2)
        least = F.lit(at_least).cast("double")
        if k is not None and len(self.known):
            first = self._ranked(self._scored(self._routed(own.withColumn("least", least), probes)))
            kth = first.filter(F.col("rank") == k).select("query", F.col("similarity").alias("kth"))
            own = own.join(kth, "query", "left").select("query", "unit", F.greatest("kth", least).alias("least"))
        else:
            own = own.withColumn("least", least)
        routes = written(self._routed(own, None))
        self.scored = routes.drop("q_unit").join(index.rings, ["cell", "ring"])
        self.found = self._scored(routes) if k is None else self._ranked(self._scored(routes))

    def _routed(self, own: DataFrame, probes: int | None) -> DataFrame:
        kind = own.schema["query"].dataType.simpleString()
        shape = f"query {kind}, q_unit array<double>, cell int, ring int"
        if not len(self.known):
            return own.select("query", F.col("unit").alias("q_unit"), F.lit(0).alias("cell"), F.lit(0).alias("ring")).limit(0)
        shared = own.sparkSession.sparkContext.broadcast(self.index.centroids)
        return own.select("query", "unit", "least").mapInArrow(_routes(shared, self.known, self.ring, probes), shape)

    def _scored(self, routes: DataFrame) -> DataFrame:
        """Rows of one task: one part of a ring (PART vectors) and about ASKED queries."""
        parts = F.broadcast(self.index.rings.select("cell", "ring", "part")) if len(self.known) <= 10_000 else self.index.rings.select("cell", "ring", "part")
        asked = routes.join(parts, ["cell", "ring"]).withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(self.groups)).cast("int"))
        vectors = self.index.vectors.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        keys = ["cell", "ring", "part", "turn"]
        kinds = {f.name: f.dataType.simpleString() for f in (*routes.schema, *vectors.schema)}
        shape = f"query {kinds['query']}, item {kinds['item']}, similarity double"
        return vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best_of_group(self.k, self.at_least), shape)

    def _ranked(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
        return materialize(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k))
