"""Functions without SQL against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomery.functions import text, values
from loomery.operators import learning, ranking


def test_mmr_equals_the_greedy_choice(spark):
    rng = random.Random(1)
    rows = [(q, i, round(rng.random(), 3), rng.choices("abcdefgh", k=rng.randint(0, 9)), rng.choice("xy")) for q in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "q long, i long, s double, w array<string>, k string").repartition(3)
    got = defaultdict(list)
    for r in sorted(ranking.mmr(df, "q", "i", "s", "w", "k", 5, 0.6, 4).collect(), key=lambda r: r["position"]):
        got[r["q"]].append(r["i"])
    for q in range(4):
        left, chosen = [r for r in rows if r[0] == q], []

        def alike(a, b):
            x, y = set(a[3][:4]), set(b[3][:4])
            return (len(x & y) / len(x | y) if x | y else 0.0) + 0.1 * (a[4] == b[4])

        while len(chosen) < 5:
            best = max(left, key=lambda r: (round(0.6 * r[2] - 0.4 * max((alike(r, c) for c in chosen), default=0.0), 12), r[2], -r[1]))
            chosen.append(best)
            left.remove(best)
        assert got[q] == [r[1] for r in chosen]


def test_semantic_chunks(spark):
    sections = ["name of it", "status open", "rule one " + "x" * 300, "enum a b", "required y", "plain"]
    long = " | ".join(sections)
    classes = [("states", "status|enum"), ("rules", "rule|required")]
    chunk = lambda t, **more: [tuple(c) for c in spark.createDataFrame([(t,)], "t string").select(text.semantic_chunks(F.col("t"), F.lit("T: t"), classes, **more).alias("c")).first()[0]]
    assert chunk("short text") == [("main", "short text")]
    assert chunk(long, most=200, least=1) == [("main", "T: t | name of it | plain"), ("states", "T: t | status open | enum a b"), ("rules", ("T: t | " + sections[2] + " | required y")[:200])]
    assert [k for k, _ in chunk(long, most=200, least=30)] == ["rules"]
    assert chunk(long, most=200, least=5000) == [("main", long[:200])]


def test_feature_hashing_is_the_length_one_vector_of_counts(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcdef") for _ in range(rng.randint(1, 20))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(docs)), "k long, w array<string>")
    slot = {r.t: r.s for r in spark.createDataFrame([(c,) for c in "abcdef"], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(7)).alias("s")).collect()}
    got = defaultdict(dict)
    for r in values.feature_hashing(df, "k", "w", 7).collect():
        got[r.k][r.slot] = r.weight
    for i, d in enumerate(docs):
        n = Counter(slot[t] for t in d)
        size = sum(x * x for x in n.values()) ** 0.5
        assert set(got[i]) == set(n) and all(abs(got[i][s] - x / size) < 1e-12 for s, x in n.items())


def test_hash_embedding_is_the_unit_vector_of_the_digests(spark):
    for t in ("a text", "", "é"):
        data = b"".join(hashlib.sha512(f"{i}:{t}".encode()).digest() for i in range(2))[:80]
        v = np.nan_to_num(np.frombuffer(data, "<f4").astype(float), nan=0.0, posinf=0.0, neginf=0.0)
        v = v / np.abs(v).max()
        got = spark.createDataFrame([(t,)], "t string").select(values.hash_embedding(F.col("t"), 20)).first()[0]
        assert np.allclose(got, v / np.linalg.norm(v), atol=1e-6) and abs(np.linalg.norm(got) - 1) < 1e-5


def test_paragraph_chunks_pack_in_order(spark):
    rng = random.Random(3)
    for _ in range(5):
        t = "\n\n".join("w" * rng.randint(0, 40) for _ in range(30))
        out = []
        for p in t.split("\n\n"):
            if out and len(out[-1]) + len(p) + 2 <= 60:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        assert spark.createDataFrame([(t,)], "t string").select(text.paragraph_chunks(F.col("t"), 60)).first()[0] == out


def test_wave_trace_is_a_record_of_waves_in_order(spark):
    rows = [("q", 2, "b", 0.5), ("q", 1, "z", 0.2), ("q", 1, "a", 0.9), ("r", 3, "c", 0.1)]
    got = {r["q"]: [tuple(w) for w in r["waves"]] for r in learning.wave_trace(spark.createDataFrame(rows, "q string, w int, i string, s double"), "q", "w", "i", "s").collect()}
    assert got == {"q": [(1, 2, 0.9, "a"), (2, 1, 0.5, "b")], "r": [(3, 1, 0.1, "c")]}


def test_document_modes_fall_back_in_four_steps(spark):
    rows = [("schema", "action_rollback", "action", ""), ("x", "action_rollback", "action", ""), ("x", "y", "action", "contract"), ("x", "y", "none", "negative_routing"), ("x", "y", "workflow", "z"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r[0] for r in df.select(text.document_mode(*map(F.col, "abcd"))).collect()]
    assert got == ["lookup", "act", "act", "routing", "diagnose", "lookup"]
    assert re.fullmatch(r"[a-z_ ]+", " ".join(text.QUERY_MODES.values()))


def test_first_rule_equals_trying_all(spark):
    rng = random.Random(5)
    rules = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), i % 9, f"v{i}") for i in range(12)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None])) for i in range(60)]
    for own in (rules, [r for r in rules if r[0] and r[1]], []):
        got = ranking.first_rule(spark.createDataFrame(rows, "i long, a string, b string"), spark.createDataFrame(own, "a string, b string, priority int, v string"), ["a", "b"], "v").collect()
        assert len(got) == len(rows)
        for r in got:
            fit = [(p, v) for a, b, p, v in own if (a is None or a == r.a) and (b is None or b == r.b)]
            assert (r.priority, r.v) == min(fit, default=(None, None))
