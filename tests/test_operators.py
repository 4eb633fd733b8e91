"""Edge cases of the engine's operators on small rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import guards, text, values
from loomery.operators import aggregates, components, filters, graph, graph_rules, joins, learning, ranking, vectors
from loomery.operators.components import connected_components
from loomery.sources import readers, sinks


def one(spark, expression, **columns):
    kinds = {int: "long", float: "double", str: "string", list: "array<string>", type(None): "string", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("r")).first()[0]


def test_components_on_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)] + [(7, 3), (3, 7)] + [(rng.randint(10_000, 10_300), rng.randint(10_000, 10_300)) for _ in range(150)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long").repartition(5))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in list(root)}
    components.ONE_TASK = -1  # in rounds
    try:
        in_rounds = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    finally:
        components.ONE_TASK = 2_000_000
    assert {r.node: r.component for r in in_rounds} == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_nearest_rank_narrows_without_losing_the_element(spark):
    rng = random.Random(2)
    v = [rng.choice([1.0, 2.0, rng.random() * 100]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    for q in (0.0, 0.5, 0.95, 0.999, 1.0):
        assert aggregates.nearest_rank(df, "v", q, small=50) == sorted(v)[min(len(v) - 1, int(len(v) * q))]
    assert aggregates.nearest_rank(df.limit(0), "v", 0.5) is None


def test_masks(spark):
    m = lambda t: one(spark, guards.mask_pii(F.col("t")), t=t)
    assert m("9876543210") == "98xxxxx210" and m("user@domain.com") == "us***@domain.com"
    assert m("1234 5678 9012") == "xxxx xxxx 9012" and m("4111 1111 1111 1111") == "xxxx xxxx xxxx xxxx" and m("ABCDE1234F") == "ABCXXxxxxF"
    assert m(None) is None


def test_look_ahead_mask(spark):
    assert one(spark, guards.replaced(F.col("t"), guards.MONEY_ALWAYS), t="123456789012 is my account") == "XXXXXXXXX**** is my account"


def test_dates(spark):
    r = one(spark, values.date_range(F.col("t"), F.col("d")), t="orders of last 7 days", d=dt.date(2024, 3, 6))
    assert (r["first"], r["last"], r["label"]) == ("2024-02-29", "2024-03-06", "last 7 days")
    assert one(spark, values.date_range(F.col("t"), F.col("d")), t="nothing", d=dt.date(2024, 3, 6)) is None


def test_trust_fold_is_ordered(spark):
    rows = [("a", i, i % 3 == 0) for i in range(40)]
    got = learning.trust(spark.createDataFrame(rows, "k string, i int, up boolean"), "k", ["i"], F.col("up")).first()
    t, low = 0.5, False
    for _, _, up in rows:
        t = min(1.0, round(t + 0.02, 6)) if up else max(0.0, round(t - 0.05, 6))
        low = False if up else t < 0.2
    assert got.trust == pytest.approx(t) and got.low_quality == low


def test_agreement_gate(spark):
    votes = lambda p, *v: [(p, x, dt.datetime(2024, 1, 30)) for x in v]
    df = spark.createDataFrame(votes(1, "A", "A", "A") + votes(2, "A", "A", "B") + votes(3, "A", "A", "A", "B"), "pair_id long, preference string, created_at timestamp")
    got = {r.pair_id: r.weight for r in aggregates.training_triples(df, "TIMESTAMP '2024-01-31 00:00:00'", 0.7).collect()}
    assert got == {1: 1.0, 3: 0.7}


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("c", 1, 50), ("c", 2, 60), ("c", 3, 5)], "k string, i int, n int")
    assert [r.i for r in ranking.budget_prefix(df, "k", [F.col("i")], F.col("n"), 100).collect()] == [1]


def test_as_of_join_prefers_the_latest(spark):
    e = spark.createDataFrame([("a", 10, 1), ("a", 5, 2), ("b", 1, 3)], "k string, t int, e int")
    r = spark.createDataFrame([("a", 4, 100), ("a", 9, 101), ("a", 11, 102)], "k string, t int, r int")
    assert {x.e: x.r for x in joins.latest_before(e, r, "k", "e", "t", "r").collect()} == {1: 101, 2: 100, 3: None}


def test_containment_in_blocks(spark):
    long = spark.createDataFrame([(1, "the red fox"), (2, None), (3, "foxred")], "id int, text string")
    short = spark.createDataFrame([("red",), ("fox",), ("",), (None,), ("e r",)], "n string")
    want = {(1, "red"), (1, "fox"), (1, "e r"), (3, "red"), (3, "fox")}
    assert {(r.id, r.n) for r in joins.contains_text(long, "text", short, "n", block=1).collect()} == want


def test_pagerank_sums_to_one_and_stays_near_the_seed(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b", "t", 1.0), ("b", "c", "t", 2.0), ("a", "c", "t", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    got = {r.id: r.score for r in graph.pagerank(nodes, edges, nodes.filter("id = 'a'"), damping=0.85).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["a"] > got["c"] > got["d"] == 0
    assert graph.pagerank(nodes, edges, nodes.limit(0)).collect() == []


def test_upsert_keeps_equal_rows(spark):
    old = spark.createDataFrame([(1, "x", "h1"), (2, "y", "h2")], "k int, v string, h string")
    new = spark.createDataFrame([(2, "z", "h3"), (1, "w", "h1"), (3, "n", "h4")], "k int, v string, h string")
    assert {r.k: (r.v, r.action) for r in sinks.upsert(old, new, "k", "h").collect()} == {1: ("x", "keep"), 2: ("z", "update"), 3: ("n", "insert")}


def test_yaml_documents(spark, tmp_path):
    api = tmp_path / "r" / "pillar_3_api" / "apis" / "get_order"
    api.mkdir(parents=True)
    (api / "overview.yaml").write_text(json.dumps({"api": {"id": "get_order", "method": "GET", "path": "/orders"}, "classification": {"domain": "orders"}, "retrieval_hints": {"canonical_summary": "reads", "aliases": ["fetch"], "keywords": ["order"]}}))
    (api / "tool_agent_tags.yaml").write_text(json.dumps({"tool_assignment": {"tool_candidate": "order_tool"}, "intent_tags": {"primary": "read", "secondary": ["read", "list"]}}))
    (api / "index.yaml").write_text("{broken: [")
    table = tmp_path / "r" / "pillar_1_schema" / "tables" / "orders"
    table.mkdir(parents=True)
    (table / "_meta.yaml").write_text(json.dumps({"table": "orders", "domain": "orders", "description": "all"}))
    (table / "columns.yaml").write_text(json.dumps({"columns": [{"name": "id", "type": "int"}]}))
    tree = readers.yaml_tree(spark, str(tmp_path))
    row = readers.api_documents(tree).first()
    assert (row.doc_id, row.tool_candidate, row.intent_tags, row.training_ready) == ("get_order", "order_tool", ["read", "list"], False)
    assert readers.table_documents(tree).first().columns == ["id"]
    assert readers.read_all(tree).count() == 5


def test_content_gate(spark):
    ok = lambda t: one(spark, filters.content_ok(F.col("t")), t=t)
    assert ok("a plain sentence of text that is long enough to be kept") and not ok("todo " * 20) and not ok("short") and not ok("-" * 80)


def test_chunks_never_exceed_the_limit(spark):
    got = one(spark, text.paragraph_chunks(F.col("t"), 10), t="aaaa\n\nbbb\n\ncccccccccccc\n\nd")
    assert got == ["aaaa\n\nbbb", "cccccccccccc", "d"]


def test_state_machine(spark):
    df = spark.createDataFrame([(1, 1, "O"), (1, 2, "P"), (1, 3, "O"), (2, 1, "F"), (2, 2, "X")], "k int, i int, s string")
    assert [(r.k, r.i) for r in values.violations(df, "k", [F.col("i")], "s").collect()] == [(1, 3), (2, 2)]


def test_fusion_orders_ties_by_id(spark):
    df = spark.createDataFrame([("q", "exact", "b", 1), ("q", "exact", "a", 1), ("q", "vector", "a", 5)], "query_id string, leg string, node_id string, rank int")
    assert [r.node_id for r in ranking.fuse(df).orderBy("position").collect()] == ["a", "b"]


def test_threshold_search_has_no_rank_cap(spark):
    e = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(80)], "vec_id long, embedding array<float>")
    q = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vectors.VectorSearch(vectors.build(e, "vec_id", "embedding"), q, "query_id", "embedding", at_least=0.8).found
    assert sorted(r.item for r in got.collect()) == [i for i in range(80) if 1 / (1 + (i / 40) ** 2) ** 0.5 >= 0.8] and "rank" not in got.columns


def test_guard_rules(spark):
    tenant = lambda t: one(spark, guards.cross_tenant(F.col("t"), F.lit("7")), t=t)
    assert [tenant(t) for t in ("get details of seller 77", "list what seller 7 sold", "impersonate them", "hello")] == ["BLOCK", "ALLOW", "BLOCK", "ALLOW"]
    assert one(spark, guards.mask_leaks(F.col("t"), F.lit(True)), t="redis, eyJabcdefghijklmnopqrstuvwxyz") == "redis, [REDACTED_TOKEN]"
    assert one(spark, guards.mask_leaks(F.col("t"), tables=["parcels"]), t="redis and parcels table") == "our system and [internal table]"
    assert one(spark, guards.replaced(F.col("t"), guards.PROMISES), t="compensation of Rs. 900") == "compensation as per applicable policy"
    assert one(spark, guards.mask_money(F.col("t"), F.lit("hi")), t="12.5% commission") == "**% commission"


def test_reflection(spark):
    intents = F.array(F.struct(F.lit("track").alias("intent"), F.lit("order").alias("entity")))
    rows = [("ok", "order 12345 shipped", 0.9, "12345", ""), ("low", "order 12345 shipped", 0.4, "12345", ""), ("intent", "nothing", 0.9, None, ""), ("entity", "order shipped", 0.9, "12345", ""), ("made up", "order travels somewhere unknown", 0.9, None, "else")]
    df = spark.createDataFrame(rows, "n string, r string, c double, e string, x string")
    got = df.select("n", guards.reflection(F.lit("status"), F.col("r"), F.col("c"), intents, F.col("e"), F.col("x")).alias("v"))
    assert dict(got.toPandas().itertuples(index=False)) == {"ok": "none", "low": "low_confidence", "intent": "missing_intent", "entity": "wrong_entity", "made up": "hallucination"}


def test_graph_rules_of_nulls_repeats_and_no_rows(spark):
    schema = "id string, tables array<struct<name:string,role:string>>"
    docs = spark.createDataFrame([("a", [("t", "write"), ("u", None), (None, "read")]), ("a", [("t", "write")]), ("b", None), (None, [("t", "read")])], schema)
    got = {tuple(r) for r in graph_rules.api_tables(docs).collect()}
    assert got == {("edge", "api_endpoint:a", "table:t", "writes_table", "write"), ("edge", "api_endpoint:a", "table:u", "reads_table", None)}
    assert graph_rules.api_tables(docs.limit(0)).count() == 0
    assert graph_rules.api_tables(docs).count() == 2
    fields = spark.createDataFrame([("a", [("x", None), (None, True)])], "id string, fields array<struct<name:string,required:boolean>>")
    assert {r.two for r in graph_rules.api_fields(fields).filter("what = 'edge'").collect()} == {"schema_field:a.x"}


def test_paths_and_walks_from_nodes_without_links(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0)], "source_id string, target_id string, weight double")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.hops(edges, start, 5, directed=True).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert graph.hops(edges.limit(0), start, 3).count() == 1
    best = {r.id: (r.cost, r.path) for r in graph.shortest_paths(edges, "a", 4, weighted=True).collect()}
    assert best == {"a": (0.0, "a"), "b": (1.0, "a>b"), "c": (2.0, "a>b>c")}
    assert [r.id for r in graph.shortest_paths(edges.limit(0), "z").collect()] == ["z"]
    nodes = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {r.id: r.score for r in graph.pagerank(nodes, edges.limit(0), start).collect()} == {"a": 1.0, "z": 0.0}
