"""Stateful stream operators against plain Python, over a folder of JSON lines read in several micro-batches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import retrieval
from loomery.streaming import operators as S

SCHEMA = "id long, k string, t long, bad boolean, up boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [{"id": i, "k": rng.choice("abc"), "t": 1_700_000_000 + 5 * i + rng.randint(0, 4), "bad": rng.random() < 0.5, "up": rng.random() < 0.4} for i in range(120)]


@pytest.fixture
def stream(spark, rows, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, rows[30 * n : 30 * n + 30])))
    # files come by age
    for n in range(4):
        import os

        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path)).withColumn("at", F.timestamp_seconds("t"))


def test_rate_limit_counts_allowed_requests_only(stream, rows):
    got = {r.id: r.allowed for r in S.run_to_end(S.rate_limit(stream, "k", "id", "at", 3, 60)).collect()}
    log = {}
    for r in sorted(rows, key=lambda r: (r["id"] // 30, r["t"], r["id"])):
        own = [x for x in log.get(r["k"], []) if x > r["t"] - 60]
        assert got[r["id"]] == (len(own) < 3)
        log[r["k"]] = own + [r["t"]] * (len(own) < 3)


def test_trust_goes_on_between_batches(stream, rows):
    got = S.run_to_end(S.trust_updates(stream, "k", "id", "up"), "update")
    value = {}
    for r in rows:
        t = value.get(r["k"], 0.5)
        value[r["k"]] = min(1.0, round(t + 0.02, 6)) if r["up"] else max(0.0, round(t - 0.05, 6))
    seen = {}
    for r in got.collect():
        seen.setdefault(r.k, set()).add(round(r.trust, 4))
    assert all(round(v, 4) in seen[k] for k, v in value.items())


def test_circuit_and_sessions(stream, rows):
    states = S.run_to_end(S.circuit(stream, "k", "id", "bad"), "update").collect()
    assert {r.state for r in states} <= {"open", "closed"} and len(states) >= 3
    got = S.run_to_end(S.sessions(stream, "k", "id", "k", compress=10, keep=4), "update").groupBy("k").agg(F.max("turns").alias("n"), F.max("kept").alias("kept")).collect()
    assert {r.k: r.n for r in got} == {k: sum(r["k"] == k for r in rows) for k in "abc"} and all(r.kept <= 10 for r in got)


def test_latest_and_debounce(stream, rows):
    got = {r.k: r.id for r in S.run_to_end(S.latest(stream, "k", "at", ["id"]), "complete").collect()}
    assert got == {k: max((r["t"], r["id"]) for r in rows if r["k"] == k)[1] for k in "abc"}


def test_walks_of_many_queries_are_walks_of_each(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("a", "d", 1.0)], "source_id string, target_id string, weight double")
    start = spark.createDataFrame([(1, "a"), (2, "c"), (2, "d")], "query_id int, node_id string")
    got = {(r.query_id, r.node_id): r.score for r in retrieval.spread(start, edges, 6, 0.5, 10).collect()}
    links = {}
    for a, b, w in (("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("a", "d", 1.0)):
        links.setdefault(a, {})[b] = links.setdefault(b, {})[a] = w
    for q, own in ((1, ["a"]), (2, ["c", "d"])):
        rank = {n: 1 / len(own) for n in own}
        for _ in range(6):
            new = {n: 0.5 / len(own) for n in own}
            for n, s in rank.items():
                for m, w in links[n].items():
                    new[m] = new.get(m, 0) + 0.5 * s * w / sum(links[n].values())
            rank = new
        for n, s in rank.items():
            assert got[q, n] == pytest.approx(s)


def test_pagerank_leg_keeps_what_a_large_group_reaches(spark):
    leaves = [f"d{i:03d}" for i in range(80)]
    edges = spark.createDataFrame([("s", "g", 1.0)] + [(d, "g", 1.0) for d in leaves] + [(d, "t", 1.0) for d in leaves[50:]], "source_id string, target_id string, weight double")
    documents = spark.createDataFrame([("s", "apple pear plum"), ("t", "unrelated")] + [(d, "unrelated") for d in leaves], "id string, text string")
    queries = spark.createDataFrame([("q", "apple pear plum")], "query_id string, query string")
    assert [(r.node_id, r.rank) for r in retrieval.pagerank(queries, documents, edges, 1).collect()] == [("t", 1)]


def test_state_of_idle_keys_is_dropped(spark, tmp_path):
    """Many keys that come once each: once the watermark has passed their window only the last ones hold state."""
    for n in range(5):
        rows = [{"id": 1000 * n + i, "k": f"{n}:{i}", "t": 1_700_000_000 + 1000 * n + i % 10} for i in range(40)]
        (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("id long, k string, t long").option("maxFilesPerTrigger", 1).json(str(tmp_path)).withColumn("at", F.timestamp_seconds("t"))
    seen = []
    q = S.rate_limit(stream, "k", "id", "at", 3, 60, "10 seconds").writeStream.trigger(availableNow=True).foreachBatch(lambda b, n: seen.append(b.filter("allowed").count())).start()
    q.awaitTermination()
    assert sum(seen) == 200 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 80


def test_queue_lets_go_by_timer(spark, tmp_path):
    rows = [{"s": "ab"[i % 2], "i": i} for i in range(44)]
    (tmp_path / "0.json").write_text("\n".join(map(json.dumps, rows)))
    df = spark.readStream.schema("s string, i long").json(str(tmp_path))
    got = S.run_until(S.released(df, "s", "i", 5, 0.5), 44, "100 milliseconds").collect()
    assert sorted((r.s, r.batch, r.i) for r in got) == sorted(("ab"[i % 2], i // 2 // 5 + 1, i) for i in range(44))


def test_queue_is_waited_for_as_long_as_it_moves(spark, tmp_path):
    """Three batches, 10 seconds apart, take more than the 20 seconds in which one of them must come; a queue that stands still raises."""
    (tmp_path / "0.json").write_text("\n".join(json.dumps({"s": "a", "i": i}) for i in range(12)))
    df = S.released(spark.readStream.schema("s string, i long").json(str(tmp_path)), "s", "i", 5, 10)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    got = S.run_until(df, 12, "100 milliseconds", 20, 1).collect()
    assert sorted((r.batch, r.i) for r in got) == [(i // 5 + 1, i) for i in range(12)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == held
    with pytest.raises(TimeoutError, match="5 of 6 rows"):
        S.run_until(S.released(spark.readStream.schema("s string, i long").json(str(tmp_path)), "s", "i", 5, 1000), 6, "100 milliseconds", 20, 1)
    assert S.run_until(df, 0).collect() == []


def test_cache_of_the_newest_keys_is_bounded(spark, tmp_path):
    rng = random.Random(6)
    rows = [{"id": i, "k": rng.randrange(300), "t": 1_700_000_000 + i // 3} for i in range(2000)]
    for n in range(4):
        (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, rows[500 * n : 500 * n + 500])))
        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    df = spark.readStream.schema("id long, k long, t long").option("maxFilesPerTrigger", 1).json(str(tmp_path)).withColumn("at", F.timestamp_seconds("t"))
    got = S.run_to_end(S.newest(df, "k", "at", "id", 25)).collect()
    assert {v: sum(r.version == v for r in got) for v in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), 25)
    for v in (1, 4):
        last = {}
        for r in rows[: 500 * v]:
            last[r["k"]] = (r["t"], r["id"])
        want = sorted(last.items(), key=lambda x: (-x[1][0], x[0]))[:25]
        assert sorted((r.k, r.id) for r in got if r.version == v) == sorted((k, i) for k, (_, i) in want)
