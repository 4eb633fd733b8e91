"""Queries of the graph, the learning loop and the remaining rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.functions import text as X
from loomery.operators import aggregates as A
from loomery.operators import graph as G
from loomery.operators import joins as J
from loomery.operators import learning as L
from loomery.operators import lexical as I
from loomery.operators import ranking as K
from loomery.operators import vectors as V
from loomery.operators.components import connected_components
from loomery.plans.functions import TURNS, turns
from loomery.plans.views import edges, nodes, raw_edges, view, with_graph, with_views
from loomery.session import table

FOUND = "list_filter({}, lambda x: x IS NOT NULL)"


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


BOTH = "b AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)"


@query("g01_hops", with_graph(f"WITH RECURSIVE {BOTH}, r AS (SELECT 'order:1' AS id, 0 AS depth UNION SELECT b.b, depth + 1 FROM r JOIN b ON b.a = r.id WHERE depth < 3) SELECT id, min(depth)::INT AS depth FROM r GROUP BY 1"))
def g01_hops(spark, d):
    return G.hops(edges(spark, d), seeds(spark, "order:1"), 3)


@query("g02_shortest_path", with_graph("WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM edges), r AS (SELECT 'order:7' AS id, 0 AS hops, 'order:7' AS path UNION SELECT target_id, hops + 1, path || '>' || target_id FROM r JOIN e ON source_id = id WHERE hops < 4) SELECT id, min(hops)::INT AS hops, arg_min(path, lpad(hops::VARCHAR, 3, '0') || path) AS path FROM r GROUP BY 1"))
def g02_shortest_path(spark, d):
    return G.shortest_paths(edges(spark, d), "order:7", 4).select("id", "hops", "path")


@query("g03_weighted_path", with_graph("WITH RECURSIVE b AS (SELECT source_id AS a, target_id AS b, weight FROM edges UNION SELECT target_id, source_id, weight FROM edges), r AS (SELECT 'order:1' AS id, 0.0::DOUBLE AS cost, 0 AS hops UNION SELECT b.b, round(cost + weight, 6), hops + 1 FROM r JOIN b ON b.a = r.id WHERE hops < 3) SELECT id, min(cost) AS cost FROM r GROUP BY 1"))
def g03_weighted_path(spark, d):
    return G.shortest_paths(edges(spark, d), "order:1", 3, weighted=True, directed=False).select("id", "cost")


@query("g04_pagerank", with_graph("WITH RECURSIVE o AS (SELECT source_id, target_id, sum(weight) AS w FROM edges GROUP BY ALL), s AS (SELECT source_id, target_id, w / sum(w) OVER (PARTITION BY source_id) AS share FROM o), j AS (SELECT id, CASE WHEN id IN ('order:1', 'order:2') THEN 0.5::DOUBLE ELSE 0 END AS jump, id NOT IN (SELECT source_id FROM o) AS dangling FROM nodes), r0 AS (SELECT id, jump AS score FROM j), " + ", ".join(f"r{i} AS (SELECT j.id, 0.85 * jump + 0.15 * (coalesce(f.s, 0) + jump * (SELECT coalesce(sum(score), 0) FROM r{i - 1} JOIN j USING (id) WHERE dangling)) AS score FROM j LEFT JOIN (SELECT target_id, sum(score * share) AS s FROM r{i - 1} JOIN s ON source_id = id GROUP BY 1) f ON f.target_id = j.id)" for i in (1, 2, 3)) + " SELECT id, round(score, 8) AS score FROM r3 WHERE score > 0 AND id NOT IN ('order:1', 'order:2')"))
def g04_pagerank(spark, d):
    start = seeds(spark, "order:1", "order:2")
    return G.pagerank(nodes(spark, d), edges(spark, d), start, rounds=3, fixed=True).filter("score > 0").join(start, "id", "left_anti").select("id", F.round("score", 8).alias("score"))


@query("g04_pagerank_converged")
def g04_pagerank_converged(spark, d):
    x = G.pagerank(nodes(spark, d), edges(spark, d), seeds(spark, "order:1", "order:2", "order:3"))
    return x.orderBy(F.desc("score"), "id").limit(20)


@query("g05_chains", with_graph("WITH e AS (SELECT source_id, target_id, edge_type, weight FROM edges), p1 AS (SELECT source_id || '>' || target_id AS path, weight, 1 AS hops, target_id AS t FROM e WHERE source_id IN ('order:1', 'order:5')), p2 AS (SELECT path || '>' || target_id AS path, round(p1.weight + e.weight, 4) AS weight, 2 AS hops, target_id AS t FROM p1 JOIN e ON source_id = t), p3 AS (SELECT path || '>' || target_id AS path, round(p2.weight + e.weight, 4) AS weight, 3 AS hops, target_id AS t FROM p2 JOIN e ON source_id = t) SELECT DISTINCT path, round(weight, 4) AS weight, hops FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)"))
def g05_chains(spark, d):
    return G.chains_from(edges(spark, d), seeds(spark, "order:1", "order:5"), 3)


@query("g06_domain_hops", with_graph(f"WITH {BOTH}, ok AS (SELECT id FROM nodes WHERE node_type IN ('order', 'customer', 'nation')), o AS (SELECT * FROM b WHERE a IN (FROM ok) AND b IN (FROM ok)) SELECT 'order:3' AS id, 0 AS depth UNION SELECT b, 1 FROM o WHERE a = 'order:3' UNION SELECT y.b, 2 FROM o x JOIN o y ON x.b = y.a WHERE x.a = 'order:3' AND y.b <> 'order:3' AND y.b NOT IN (SELECT b FROM o WHERE a = 'order:3')"))
def g06_domain_hops(spark, d):
    ok = nodes(spark, d).filter("node_type IN ('order', 'customer', 'nation')").select("id")
    e = edges(spark, d).join(ok.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ok.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return G.hops(e, seeds(spark, "order:3"), 2)


@query("g07_components", "WITH RECURSIVE e AS (SELECT o_orderkey AS a, 1000000000000 + o_custkey AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1")
def g07_components(spark, d):
    return connected_components(table(spark, d, "orders").select("o_orderkey", 1000000000000 + F.col("o_custkey")))


@query("a27_graph_stats", with_graph("SELECT 'node' AS what, node_type AS type, count(*)::DOUBLE AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'graph', 'avg_degree', round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6)"))
def a27_graph_stats(spark, d):
    return A.graph_stats(nodes(spark, d), edges(spark, d))


@query("a28_quality_report", "SELECT lang, round(avg(coalesce(quality, 0.5)), 4)::DOUBLE AS avg_confidence, round(100.0 * count(quality) / count(*), 4) AS labelled_percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a28_quality_report(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang").agg(F.round(F.avg(F.coalesce(F.col("quality").cast("double"), F.lit(0.5))), 4).alias("avg_confidence"), F.round(100.0 * F.count("quality") / F.count("*"), 4).alias("labelled_percent"))


@query("a29_file_index", "SELECT split_part(p, '/', 2) AS pillar, count_if(s = 0) AS \"0\", count_if(s = 1) AS \"1\", count_if(s = 2) AS \"2\" FROM (SELECT lang || '/' || source || '/' || doc_id AS p, doc_id % 3 AS s FROM documents) GROUP BY 1")
def a29_file_index(spark, d):
    x = table(spark, d, "documents").select(F.split(F.concat_ws("/", "lang", "source", "doc_id"), "/")[1].alias("pillar"), (F.col("doc_id") % 3).alias("s"))
    return x.groupBy("pillar").pivot("s", [0, 1, 2]).count().fillna(0)


@query("a30_index_stats", "SELECT source, count(*) AS documents, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def a30_index_stats(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("a39_ingest_report", "SELECT count(*) AS read, count_if(n_chars < 50) AS too_short, count(DISTINCT sha256(text)) AS distinct_texts, count_if(n_chars > 3600) AS chunked FROM documents")
def a39_ingest_report(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("read"), F.count_if(F.col("n_chars") < 50).alias("too_short"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"), F.count_if(F.col("n_chars") > 3600).alias("chunked"))


@query("g08_edge_weight", with_graph("SELECT source_id, target_id, edge_type, round(CASE edge_type WHEN 'has_part' THEN 1.0 WHEN 'placed_by' THEN 0.9 WHEN 'in_nation' THEN 0.7 ELSE 0.5 END * CASE WHEN weight > 1 THEN 1.2 ELSE 1 END, 6)::DOUBLE AS w FROM edges"))
def g08_edge_weight(spark, d):
    return edges(spark, d).select("source_id", "target_id", "edge_type", F.round(G.edge_weight(F.col("edge_type"), F.col("weight") > 1, F.lit(0)), 6).alias("w"))


@query("g09_freshness", "SELECT o_orderkey, round(coalesce(least(1, greatest(0, 1 - date_diff('day', o_orderdate::DATE, DATE '2001-09-01') / 1800.0) + CASE WHEN o_orderkey % 2 = 0 THEN 0.05 ELSE 0 END), 0.3), 6)::DOUBLE AS f FROM orders")
def g09_freshness(spark, d):
    days = F.datediff(F.to_date(F.lit("2001-09-01")), "o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.round(G.decayed(days, 1800, F.col("o_orderkey") % 2 == 0), 6).alias("f"))


@query("g10_reweight", with_graph("SELECT source_id, target_id, edge_type, round(weight * CASE WHEN source_id LIKE 'order:%' THEN 0.5 ELSE 1 END, 6)::DOUBLE AS weight FROM edges"))
def g10_reweight(spark, d):
    return G.reweight(edges(spark, d), nodes(spark, d).filter("node_type = 'order'").withColumn("confidence", F.lit(0.5)))


@query("g11_build", "SELECT 'doc:' || doc_id AS source_id, 'lang:' || lang AS target_id, 'in_language' AS edge_type FROM documents UNION ALL SELECT 'doc:' || doc_id, 'source:' || source, 'from_source' FROM documents")
def g11_build(spark, d):
    return G.build(table(spark, d, "documents"), "doc_id", "doc", {"in_language": ("lang", F.array("lang")), "from_source": ("source", F.array("source"))})


@query("g12_cross_links", "SELECT DISTINCT 'page:' || page_id AS source_id, 'lang:' || l AS target_id FROM (SELECT page_id, unnest(string_split(url, '/')) AS l FROM pages) WHERE l IN ('en', 'fr', 'de', 'es')")
def g12_cross_links(spark, d):
    langs = table(spark, d, "documents").select(F.col("lang").alias("l")).distinct()
    p = table(spark, d, "pages").select("page_id", "url")
    x = J.contains_part(p, "url", langs, "l", "/").join(p, "url")
    return x.select(F.concat(F.lit("page:"), "page_id").alias("source_id"), F.concat(F.lit("lang:"), "l").alias("target_id")).distinct()


@query("g13_reconcile", with_graph("SELECT CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n FROM (SELECT id FROM nodes WHERE node_type <> 'part') a FULL JOIN (SELECT id FROM nodes WHERE node_type <> 'order') b ON a.id = b.id GROUP BY 1"))
def g13_reconcile(spark, d):
    n = nodes(spark, d)
    return G.reconcile(n.filter("node_type <> 'part'"), n.filter("node_type <> 'order'"), "id")


@query("g14_as_text", with_graph("WITH o AS (SELECT source_id AS id, string_agg(edge_type || ' ' || target_id, '; ' ORDER BY edge_type || ' ' || target_id) AS o FROM edges GROUP BY 1) SELECT id, substr(label || ' (' || node_type || ')' || coalesce(': ' || o, ''), 1, 80) AS text FROM nodes LEFT JOIN o USING (id)"))
def g14_as_text(spark, d):
    return G.as_text(nodes(spark, d), edges(spark, d), 80)


@query("g15_link_types", with_graph("SELECT edge_type, count(*) AS n, count(DISTINCT source_id) AS sources FROM rawedges GROUP BY 1"))
def g15_link_types(spark, d):
    return raw_edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@query("g16_merge_hits", with_views("SELECT user_id AS id, min(1 + event_id % 4) AS depth FROM analytics GROUP BY 1", "analytics"))
def g16_merge_hits(spark, d):
    return G.merge_hits(view(spark, d, "analytics").select(F.col("user_id").alias("id"), (1 + F.col("event_id") % 4).alias("depth")))


@query("w03_strengthen", with_graph("SELECT * FROM edges"))
def w03_strengthen(spark, d):
    return edges(spark, d)


K05_SQL = rf"""
WITH td AS (SELECT doc_id AS id, source AS c, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+')) AS t FROM documents),
tq AS (SELECT item_id AS id, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+')) AS t FROM benchmark),
d AS (SELECT id, c, t, count(*) AS tf FROM td WHERE t <> '' AND t NOT IN {tuple(X.FAQ_STOP)} GROUP BY ALL),
q AS (
  SELECT id, 'src' || ((id + j) % 5) AS c, t, count(*) AS tf FROM tq, (VALUES (0), (1), (2)) v(j)
  WHERE t <> '' AND t NOT IN {tuple(X.FAQ_STOP)} GROUP BY ALL),
n AS (SELECT source AS c, count(*) AS n FROM documents GROUP BY 1),
df AS (SELECT c, t, count(*) AS df FROM d GROUP BY ALL),
qi AS (SELECT q.*, ln((n.n + 1) / (coalesce(df.df, 0) + 1)::DOUBLE) + 1 AS idf FROM q JOIN n USING (c) LEFT JOIN df USING (c, t)),
ql AS (SELECT id, c, sqrt(sum(tf * tf * idf * idf)) AS length FROM qi GROUP BY ALL),
dl AS (SELECT id, sum(tf * tf) AS square FROM d GROUP BY 1),
s AS (
  SELECT qi.id AS question, qi.c, d.id AS doc,
    round(sum(qi.tf * d.tf * qi.idf * qi.idf) / (any_value(ql.length) * sqrt(any_value(dl.square) + sum(d.tf * d.tf * (qi.idf * qi.idf - 1)))), 6) AS score
  FROM qi JOIN d USING (c, t) JOIN ql ON ql.id = qi.id AND ql.c = qi.c JOIN dl ON dl.id = d.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question, c ORDER BY score DESC, doc) AS r FROM s WHERE score > 0)
SELECT question, doc, score, rank FROM (
  SELECT question, doc, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc) AS rank FROM r WHERE r <= 3) WHERE rank <= 5"""


@query("k05_faq", K05_SQL, ints=("rank",))
def k05_faq(spark, d):
    """The three best answers of each of a question's categories, then the five best of those."""
    faq = X.faq_words(F.col("text")).alias("tokens")
    asked = table(spark, d, "benchmark")
    wanted = asked.select(F.col("item_id").alias("item"), F.explode(F.array(*[F.concat(F.lit("src"), (F.col("item_id") + j) % 5) for j in range(3)])).alias("category"))
    docs = table(spark, d, "documents").select("doc_id", "source", faq)
    return I.best_of_categories(I.faq_search(docs, "doc_id", "source", asked.select("item_id", faq), "item_id", wanted, 3), 5)


@query("k05_category_top", "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), t AS (SELECT * FROM r WHERE r <= 3) SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM t ORDER BY 2 LIMIT 5", ints=("position",))
def k05_category_top(spark, d):
    top = K.top_per(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return K.first_k(top, [F.desc("n_chars"), F.col("doc_id")], 5).select("doc_id", "position")


@query("k10_routing", with_views("WITH c AS (SELECT event_id, CASE WHEN intent = 'purchase' AND entity = 'e1' THEN 1 WHEN intent = 'error' THEN 2 ELSE 3 END AS p, 0.3 * confidence + 0.4 * (intent = 'purchase')::INT + 0.3 * (event_id % 10) / 10.0 AS s, user_id FROM analytics) SELECT user_id, event_id, CASE p WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, round(s, 6) DESC, event_id) AS r FROM c) WHERE r = 1", "analytics"))
def k10_routing(spark, d):
    rules = spark.createDataFrame([("purchase", "e1", 1, 0.9), ("error", None, 2, 0.8), (None, None, 3, 0.3)], "intent string, entity string, priority int, sure double")
    s = 0.3 * F.col("confidence") + 0.4 * (F.col("intent") == "purchase").cast("int") + 0.3 * (F.col("event_id") % 10) / 10.0
    x = K.first_rule(view(spark, d, "analytics").withColumn("s", F.round(s, 6)), rules, ["intent", "entity"], "sure")
    return K.top_per(x, ["user_id"], [F.col("priority"), F.desc("s"), F.col("event_id")], 1).select("user_id", "event_id", F.col("sure").alias("confidence"))


@query("k13_hop_order", with_graph("SELECT id, row_number() OVER (ORDER BY CASE WHEN id IN ('order:1', 'nation:3') THEN 0 ELSE 1 END, CASE node_type WHEN 'order' THEN 1 WHEN 'customer' THEN 2 WHEN 'nation' THEN 3 ELSE 9 END, id) AS position FROM nodes WHERE node_type IN ('order', 'nation', 'region') ORDER BY 2 LIMIT 40"), ints=("position",))
def k13_hop_order(spark, d):
    n = nodes(spark, d).filter("node_type IN ('order', 'nation', 'region')")
    rank = F.when(F.col("node_type") == "order", 1).when(F.col("node_type") == "customer", 2).when(F.col("node_type") == "nation", 3).otherwise(9)
    return K.first_k(n, [F.col("id").isin("order:1", "nation:3").desc(), rank, F.col("id")], 40).select("id", "position")


ACT = FOUND.format("[CASE WHEN confidence < 0.5 THEN 'add_knowledge' END, CASE WHEN confidence >= 0.5 AND confidence < 0.65 THEN 'clarify' END, CASE WHEN event_id % 3 = 0 THEN 'fix_routing' END, CASE WHEN feedback_score <= 2 THEN 'review' END]")


def actions(spark, d):
    return view(spark, d, "analytics").withColumn("actions", L.auto_actions(F.col("confidence"), F.col("event_id") % 3, F.col("feedback_score")))


@query("l01_auto_actions", with_views(f"SELECT event_id, array_to_string({ACT}, ',') AS actions FROM analytics", "analytics"))
def l01_auto_actions(spark, d):
    return actions(spark, d).select("event_id", F.array_join("actions", ",").alias("actions"))


@query("l02_routed", with_views(f"WITH x AS (SELECT event_id, unnest({ACT}) AS action FROM analytics), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY event_id) AS rn FROM x) SELECT action, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (rn <= 50) AS items FROM r GROUP BY 1", "analytics"))
def l02_routed(spark, d):
    return L.routed(actions(spark, d), "actions", "event_id")


L03_SQL = "WITH RECURSIVE" + with_views("""
WITH o AS (SELECT session_id, rating >= 4 AS up, row_number() OVER (PARTITION BY session_id ORDER BY created_at, feedback_id) AS i FROM feedback),
f AS (
  SELECT session_id, i, CASE WHEN up THEN least(100, 52) ELSE 45 END AS v, up FROM o WHERE i = 1
  UNION ALL
  SELECT o.session_id, o.i, CASE WHEN o.up THEN least(100, f.v + 2) ELSE greatest(0, f.v - 5) END, o.up
  FROM f JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1)
SELECT session_id, max_by(v, i) / 100.0::DOUBLE AS trust, NOT max_by(up, i) AND max_by(v, i) < 20 AS low_quality FROM f GROUP BY 1""", "feedback")[4:]


@query("l03_trust", L03_SQL)
def l03_trust(spark, d):
    return L.trust(view(spark, d, "feedback"), "session_id", ["created_at", "feedback_id"], F.col("rating") >= 4)


@query("l04_eval_seeds", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) >= 10 AND conv_id % 3 = 0")
def l04_eval_seeds(spark, d):
    return table(spark, d, "conversations").filter((F.col("role") == "user") & (F.length("text") >= 10) & (F.col("conv_id") % 3 == 0)).select("conv_id", "turn", "text")


@query("l05_weakest", with_views("SELECT entity, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY confidence, event_id) AS position FROM analytics WHERE confidence < 0.4) WHERE position <= 3", "analytics"), ints=("position",))
def l05_weakest(spark, d):
    return L.weakest(view(spark, d, "analytics"), ["entity"], "confidence", 0.4, 3, "event_id").select("entity", "event_id", "position")


@query("l06_proposals", with_views("SELECT DISTINCT intent, entity FROM analytics WHERE confidence < 0.2 EXCEPT SELECT intent, entity FROM analytics WHERE model = 'm1' AND entity IN ('e1', 'e2')", "analytics"))
def l06_proposals(spark, d):
    x = view(spark, d, "analytics")
    return L.fresh_proposals(x.filter("confidence < 0.2").select("intent", "entity"), x.filter("model = 'm1' AND entity IN ('e1', 'e2')"), ["intent", "entity"])


@query("l07_insights", with_views("WITH x AS (SELECT user_id, count(DISTINCT intent) AS tools, max(confidence) AS best FROM analytics GROUP BY 1) SELECT user_id, unnest(list_filter([CASE WHEN tools > 1 THEN 'disagreement' END, CASE WHEN best >= 0.85 THEN 'tree_sufficient' END, CASE WHEN best < 0.5 THEN 'gap' END, CASE WHEN best >= 0.9 THEN 'few_shot' END], lambda v: v IS NOT NULL)) AS insight FROM x", "analytics"))
def l07_insights(spark, d):
    return L.insights(view(spark, d, "analytics"), "user_id", "intent", "confidence")


L08_SQL = """
WITH d AS (SELECT doc_id, md5(text) AS h, lang, source, n_chars // 200 AS size, doc_id % 50 = 0 AS asked FROM documents),
e AS (SELECT h, min(doc_id) AS a1 FROM d WHERE NOT asked GROUP BY 1),
i AS (SELECT lang, source, size, min(doc_id) AS a2 FROM d WHERE NOT asked GROUP BY ALL),
v AS (
  SELECT a.vec_id AS doc_id, b.vec_id AS a3, row_number() OVER (
    PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r
  FROM embeddings a, embeddings b
  WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.85)
SELECT doc_id, CASE WHEN a1 IS NOT NULL THEN 'exact' WHEN a2 IS NOT NULL THEN 'intent' WHEN a3 IS NOT NULL THEN 'similar' ELSE 'miss' END AS level,
  coalesce(a1, a2, a3) AS answer
FROM d LEFT JOIN e USING (h) LEFT JOIN i USING (lang, source, size) LEFT JOIN (SELECT * FROM v WHERE r = 1) USING (doc_id) WHERE asked"""


@query("l08_cache_levels", L08_SQL)
def l08_cache_levels(spark, d):
    """Every fiftieth document asks the cache that holds all others: by its text, by language, source and size, by its vector."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang", "source", F.floor(F.col("n_chars") / 200).alias("size"))
    q, held = docs.filter("doc_id % 50 = 0"), docs.filter("doc_id % 50 <> 0")
    e = q.join(held.groupBy("h").agg(F.min("doc_id").alias("a1")), "h").select("doc_id", "a1")
    kind = ["lang", "source", "size"]
    i = q.join(held.groupBy(*kind).agg(F.min("doc_id").alias("a2")), kind).select("doc_id", "a2")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = V.VectorSearch(V.build(vectors.filter("vec_id % 50 <> 0"), "vec_id", "embedding"), vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", 1, at_least=0.85)
    return L.cached(q, e, i, near.found.select(F.col("query").alias("doc_id"), F.col("item").alias("a3")), "doc_id")


@query("l09_second_wave", with_views("SELECT user_id, max(confidence) >= 0.75 AND max((intent <> 'view')::INT) = 1 AS skip FROM analytics GROUP BY 1", "analytics"))
def l09_second_wave(spark, d):
    return L.second_wave(view(spark, d, "analytics"), "user_id", "confidence", F.col("intent") != "view")


@query("l10_deep_routing", with_views("SELECT event_id, confidence > 0.2 AND (intent = 'error' OR entity = 'e0') AS deep FROM analytics", "analytics"))
def l10_deep_routing(spark, d):
    return view(spark, d, "analytics").select("event_id", ((F.col("confidence") > 0.2) & ((F.col("intent") == "error") | (F.col("entity") == "e0"))).alias("deep"))


@query("l11_clarification", with_views("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'which_entity' WHEN event_id % 5 = 1 THEN 'which_param' WHEN confidence < 0.3 THEN 'refuse' WHEN confidence < 0.6 THEN 'uncertain' ELSE 'confident' END AS q FROM analytics", "analytics"))
def l11_clarification(spark, d):
    i = F.col("event_id")
    return view(spark, d, "analytics").select(i, L.clarification(F.col("confidence"), F.when(i % 9 != 0, "e"), F.when(i % 5 == 1, 1).otherwise(0)).alias("q"))


@query("l12_drift", "WITH a AS (SELECT source, count(*) AS before FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS after FROM documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 3 = 0) GROUP BY 1) SELECT source, before, after, (before - after) / before::DOUBLE > 0.1 AS drifted FROM a JOIN b USING (source)")
def l12_drift(spark, d):
    docs = table(spark, d, "documents")
    return L.drift(docs.filter("NOT (source IN ('src1', 'src2') AND doc_id % 3 = 0)"), docs, "source")


@query("l13_promotion", with_views("SELECT model, CASE WHEN l >= 0.02 AND r = 0 THEN 'promote' WHEN l < 0 THEN 'reject' ELSE 'hold' END AS decision FROM (SELECT model, round(avg(confidence), 6) - 0.48 AS l, count(*) % 2 AS r FROM analytics GROUP BY 1)", "analytics"))
def l13_promotion(spark, d):
    x = view(spark, d, "analytics").groupBy("model").agg((F.round(F.avg("confidence"), 6) - 0.48).alias("l"), (F.count("*") % 2).alias("r"))
    return x.select("model", L.promotion(F.col("l"), F.lit(1.0), F.col("r")).alias("decision"))


@query("l14_model_routing", with_views("SELECT event_id, CASE WHEN event_id % 10 > 7 OR confidence < 0.4 THEN 'large' WHEN intent IN ('purchase', 'signup') THEN 'medium' ELSE 'small' END AS m FROM analytics", "analytics"))
def l14_model_routing(spark, d):
    return view(spark, d, "analytics").select("event_id", L.model_for(F.col("intent"), F.col("event_id") % 10 / 10.0, F.col("confidence")).alias("m"))


@query("l15_escalations", with_views("SELECT user_id, array_to_string(list_filter([CASE WHEN count_if(escalated) >= 3 THEN 'failures' END, CASE WHEN count_if(confidence < 0.4) >= 3 THEN 'low_confidence' END, CASE WHEN sum(cost_usd) > 1 THEN 'cost' END, CASE WHEN count(DISTINCT intent) = 1 AND count(*) > 5 THEN 'stuck' END], lambda r: r IS NOT NULL), ',') AS reasons FROM analytics GROUP BY 1", "analytics"))
def l15_escalations(spark, d):
    return L.escalations(view(spark, d, "analytics"), "user_id", F.col("escalated"), "confidence", "cost_usd", "intent")


METRICS = {"cancellations": "cancel", "refunds": "refund", "balance": "wallet", "cost": "commission", "orders": "order"}
L16_SQL = rf"""
{TURNS}, p AS (
  SELECT conv_id, turn, t, CASE {" ".join(f"WHEN contains(lower(t), '{w}') THEN '{m}'" for m, w in METRICS.items())} END AS metric,
    nullif(regexp_extract(t, '(?i)(?:company|seller|client|cid|client_id|company_id)[\s_]*(?:id)?[\s:=#]*(\d{{3,10}})', 1), '') AS company,
    nullif(regexp_extract(t, '(?i)\blast\s+(\d+)\s+days?\b', 1), '') AS n FROM c)
SELECT conv_id, turn, coalesce(metric, 'none') AS metric, company,
  CASE WHEN n IS NOT NULL THEN (DATE '2024-01-31' - (n::INT - 1))::VARCHAR WHEN regexp_matches(t, '(?i)\blast\s+week\b') THEN '2024-01-22'
    WHEN regexp_matches(t, '(?i)\bthis\s+week\b') THEN '2024-01-29' WHEN regexp_matches(t, '(?i)\blast\s+month\b') THEN '2023-12-01'
    WHEN regexp_matches(t, '(?i)\bthis\s+month\b') THEN '2024-01-01' WHEN regexp_matches(t, '(?i)\byesterday\b') THEN '2024-01-30'
    WHEN regexp_matches(t, '(?i)\btoday\b') THEN '2024-01-31' END AS since
FROM p WHERE metric IS NOT NULL OR company IS NOT NULL"""


@query("l16_metric_probe", L16_SQL)
def l16_metric_probe(spark, d):
    probe = L.metric_probe(F.col("t"), METRICS, F.to_date(F.lit("2024-01-31")))
    return turns(spark, d).select("conv_id", "turn", probe.alias("p")).select("conv_id", "turn", "p.*").filter("metric <> 'none' OR company IS NOT NULL")


@query("l17_agent_match", "WITH r(name, w) AS (VALUES ('a', 'the'), ('a', 'and'), ('b', 'that'), ('b', 'the'), ('b', 'for'), ('c', 'les')), q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2))) AS w FROM benchmark), x AS (SELECT item_id, name, count(*) AS overlap FROM q JOIN r USING (w) GROUP BY ALL) SELECT item_id, name, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, name) AS rn FROM x) WHERE rn = 1")
def l17_agent_match(spark, d):
    r = spark.createDataFrame([("a", ["the", "and"]), ("b", ["that", "the", "for"]), ("c", ["les"])], "name string, triggers array<string>")
    return L.matched(table(spark, d, "benchmark").select("item_id", X.words(F.col("text")).alias("w")), "item_id", "w", r, "name", "triggers")


@query("l18_layers", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/(app|web|mobile)/') THEN 'experience' WHEN regexp_matches(url, '(?i)/(orders|checkout|flow)/') THEN 'process' ELSE 'system' END AS layer FROM pages")
def l18_layers(spark, d):
    return table(spark, d, "pages").select("page_id", L.layer(F.col("url")).alias("layer"))


@query("l19_breaker", with_views("WITH f AS (SELECT event_id, user_id, created_at, (intent IN ('error', 'view'))::INT AS f FROM analytics), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS island FROM f), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY created_at, event_id) AS streak FROM i) SELECT event_id FROM s WHERE streak >= 3", "analytics"))
def l19_breaker(spark, d):
    return L.breaker(view(spark, d, "analytics"), "user_id", ["created_at", "event_id"], F.col("intent").isin("error", "view")).filter("open").select("event_id")


L20_SQL = """
SELECT event_id, CASE WHEN x LIKE '%503' THEN 'retry' WHEN x LIKE '%429' THEN 'backoff' WHEN x LIKE '%401' OR x LIKE '%403' THEN 'abort' ELSE 'report' END AS policy
FROM (SELECT event_id, event_type || ' ' || (401 + json_extract(props, '$.k')::BIGINT % 103) AS x FROM events)"""


@query("l20_retry", L20_SQL)
def l20_retry(spark, d):
    code = 401 + F.get_json_object("props", "$.k").cast("long") % 103
    return table(spark, d, "events").select("event_id", L.retry_policy(F.concat_ws(" ", "event_type", code)).alias("policy"))


@query("l23_wave_trace")
def l23_wave_trace(spark, d):
    return L.wave_trace(view(spark, d, "analytics"), "user_id", "intent", "event_id", "confidence")


@query("l24_spikes", with_views("WITH n AS (SELECT intent, CAST(created_at::DATE AS VARCHAR) AS day, count(*) AS n FROM analytics GROUP BY ALL) SELECT intent, day, n, coalesce(n > 1.2 * avg(n) OVER (PARTITION BY intent ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), false) AS spike FROM n", "analytics"))
def l24_spikes(spark, d):
    return L.spikes(view(spark, d, "analytics").withColumn("day", F.to_date("created_at").cast("string")), "intent", "day", 1.2)
