"""The vector index against products of all vectors."""

import numpy as np
import pytest

from loomery.operators import vectors as V


def frame(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, v array<double>").repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Clusters of vectors, copies, and some without a direction."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    found = [centres[i % 12] + 0.25 * rng.normal(size=16) for i in range(900)]
    found += [found[4]] * 5 + [None, np.zeros(16), [np.nan] * 16, [np.inf] + [1.0] * 15, 3 * np.array(found[7])]
    return list(enumerate(found))


def cosines(rows, q):
    def unit(v):
        v = np.full(16, np.nan) if v is None else np.asarray(v, float)
        return v / np.sqrt(v @ v) if np.isfinite(v).all() and v @ v > 0 else None

    a = unit(q)
    return {i: round(float(a @ b), 12) for i, v in rows if a is not None and (b := unit(v)) is not None}


def near(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("cells", "part", "asked"), [(None, 4096, 2048), (12, 20, 7), (1, 100, 2048)])
def test_top_k_equals_all_products(spark, rows, monkeypatch, cells, part, asked):
    monkeypatch.setattr(V, "ASKED", asked)
    queries = [(i, v) for i, v in rows if i % 40 == 0 or i >= 898]
    index = V.build(frame(spark, rows, "d"), "d", "v", cells=cells, part=part)
    search = V.VectorSearch(index, frame(spark, queries, "q"), "q", "v", 5)
    got = {}
    for r in sorted(search.found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append((r["item"], r["similarity"]))
    for i, v in queries:
        want = sorted(cosines(rows, v).items(), key=lambda x: (-round(x[1], 10), x[0]))[:5]
        assert near(got.get(i, []), want), i
    if cells == 12:
        pairs = search.scored.groupBy().sum("n").first()[0]
        assert pairs < 0.6 * len(queries) * len(rows)


def test_threshold_equals_all_products(spark, rows):
    queries = [(i, v) for i, v in rows if i % 40 == 0]
    index = V.build(frame(spark, rows, "d"), "d", "v", cells=12)
    got = {(r["query"], r["item"]) for r in V.VectorSearch(index, frame(spark, queries, "q"), "q", "v", at_least=0.9).found.collect()}
    assert got == {(i, j) for i, v in queries for j, s in cosines(rows, v).items() if s >= 0.9}


def test_index_of_nothing(spark, rows):
    none, some = frame(spark, [], "d"), frame(spark, rows[:3], "d")
    assert V.VectorSearch(V.build(none, "d", "v"), some, "d", "v", 3).found.collect() == []
    assert V.VectorSearch(V.build(some, "d", "v"), none, "d", "v", 3).found.collect() == []
    assert V.VectorSearch(V.build(frame(spark, [(1, None)], "d"), "d", "v"), some, "d", "v", 3).found.collect() == []
    assert len(V.VectorSearch(V.build(some, "d", "v"), some, "d", "v", 5).found.collect()) == 9
