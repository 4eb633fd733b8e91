"""Clamped folds against plain ones."""

import random

from pyspark.sql import functions as F

from loomery.operators import folds, learning


def test_steps_compose():
    rng = random.Random(1)
    for _ in range(2000):
        steps = [(rng.randint(-9, 9), *sorted((rng.randint(-20, 20), rng.randint(-20, 20)))) for _ in range(rng.randint(1, 6))]
        whole = steps[0]
        for s in steps[1:]:
            whole = folds.then(whole, s)
        x = want = rng.randint(-30, 30)
        for s in steps:
            want = folds.applied(s, want)
        assert folds.applied(whole, x) == want


def test_trust_equals_the_ordered_fold_with_one_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i // 3, i, rng.random() < 0.6) for i in range(6000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, at long, i long, up boolean").repartition(5)
    got = {r.k: (r.trust, r.low_quality) for r in learning.trust(df, "k", ["at", "i"], F.col("up")).collect()}
    want = {}
    for k, _, _, up in rows:
        v = want.get(k, (50,))[0]
        v = min(100, v + 2) if up else max(0, v - 5)
        want[k] = (v, not up and v < 20)
    assert got == {k: (v / 100, low) for k, (v, low) in want.items()}


def test_a_hot_key_is_dealt_to_many_tasks(spark, monkeypatch):
    df = spark.range(20_000).select(F.lit("k").alias("k"), "id")
    ranges = df.repartitionByRange(4, "k", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 12_000
    got = folds.clamped(df, "k", ["id"], F.lit(1), F.lit(0), F.when(F.col("id") < 10_000, 50).otherwise(70), 5).collect()
    assert [(r["k"], r["value"], r["last"]) for r in got] == [("k", 70.0, 1.0)]


def test_folds_of_nothing(spark):
    assert folds.clamped(spark.createDataFrame([], "k string, i long"), "k", ["i"], F.lit(1), F.lit(0), F.lit(9), 0).collect() == []
