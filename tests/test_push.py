"""Local pushes against the walk they bound."""

import random

from loomery.operators import retrieval


def plain(links, seeds, damping, rounds=60):
    degree = {}
    for a, b, w in links:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    score = dict.fromkeys(seeds, 1 / len(seeds))
    for _ in range(rounds):
        new = {s: (1 - damping) / len(seeds) for s in seeds}
        for a, b, w in links:
            for x, y in ((a, b), (b, a)):
                new[y] = new.get(y, 0) + damping * score.get(x, 0) * w / degree[x]
        score = new
    return score, degree


def test_push_is_within_its_bound(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([1.0, 2.0])) for _ in range(90)] + [("hub", f"leaf{i}", 1.0) for i in range(300)] + [("n1", "hub", 1.0)]
    links = [x for x in links if x[0] != x[1]]
    edges = spark.createDataFrame(links, "source_id string, target_id string, weight double")
    starts = {1: ["n1", "n2"], 2: ["hub"], 3: ["n5"], 4: ["alone"]}
    start = spark.createDataFrame([(q, n) for q, ns in starts.items() for n in ns], "query_id int, node_id string")
    for least in (1e-2, 1e-4):
        got = {(r.query_id, r.node_id): r.score for r in retrieval.push(start, edges, 0.5, least).collect()}
        for q, ns in starts.items():
            want, degree = plain(links, ns, 0.5)
            if q == 4:
                assert {k: v for k, v in got.items() if k[0] == 4} == {(4, "alone"): 0.5}
                continue
            for node, score in want.items():
                assert -1e-9 <= score - got.get((q, node), 0.0) <= least * degree[node] + 1e-9, (q, node)
    few = retrieval.push(start.filter("query_id = 1"), edges, 0.5, 1e-2).count()
    assert few < 60  # the hub's leaves are not listed
