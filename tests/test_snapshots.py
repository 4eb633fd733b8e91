"""Upserts of bucketed snapshots against the full join."""

import glob
import os
import random

from pyspark.sql import functions as F

from loomery.sources.sinks import upsert
from loomery.sources.snapshots import Snapshot


def files(path):
    return {b: sorted(map(os.path.basename, glob.glob(f"{b}/*.parquet"))) for b in glob.glob(f"{path}/bucket=*")}


def test_upsert_equals_the_full_join_and_leaves_other_buckets(spark, tmp_path):
    rng = random.Random(1)
    at = str(tmp_path / "s")
    frame = lambda rows: spark.createDataFrame(rows, "k long, h string, v long")
    old = [(i, f"h{rng.randrange(9)}", i) for i in range(400)]
    snapshot = Snapshot(at, "k", "h", 16)
    snapshot.create(frame(old))
    for step in range(3):
        staged = [(k, f"h{rng.randrange(9)}", 1000 * step + k) for k in rng.sample(range(440), 4)] + [(old[7][0], old[7][1], -1)]
        staged = list({r[0]: r for r in staged}.values())
        before, current = files(at), snapshot.read(spark)
        joined = upsert(current, frame(staged), "k", "h").cache()
        want = sorted(tuple(r)[:3] for r in joined.collect())
        changes = sorted((r.k, r.action) for r in joined.filter("action <> 'keep'").collect())
        got = sorted((r.k, r.action) for r in snapshot.upsert(frame(staged)).collect())
        assert got == changes and sorted(map(tuple, snapshot.read(spark).collect())) == want
        buckets = {r.b for r in frame([(k, "", 0) for k, _ in changes]).select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("b")).collect()}
        now = files(at)
        for b in before:
            assert (now[b] == before[b]) == (int(b.rsplit("=", 1)[1]) not in buckets)
        joined.unpersist()


def test_upsert_of_nothing_new_writes_nothing(spark, tmp_path):
    at = str(tmp_path / "s")
    df = spark.range(50).selectExpr("id AS k", "concat('h', id) AS h", "id AS v")
    snapshot = Snapshot(at, "k", "h", 4)
    snapshot.create(df)
    before = files(at)
    assert snapshot.upsert(df.withColumn("v", F.lit(9).cast("long"))).collect() == [] and files(at) == before
    assert snapshot.upsert(df.limit(0)).collect() == [] and files(at) == before
