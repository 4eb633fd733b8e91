"""Queries for filters, joins, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.operators import filters as P
from loomery.operators import joins as J
from loomery.operators import lexical as X
from loomery.operators import ranking as K
from loomery.operators import vectors as V
from loomery.plans.views import ASOF, edges, nodes, view, with_graph, with_views
from loomery.session import table

def tokens():
    return F.expr("array_distinct(filter(regexp_extract_all(lower(text), '[a-z0-9_]+', 0), x -> length(x) > 2))")


SQL_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2))"


@query("f01_time_range", with_views(f"SELECT event_id FROM analytics WHERE created_at >= {ASOF} - INTERVAL 3 DAYS AND created_at < {ASOF} - INTERVAL 1 DAYS", "analytics"))
def f01_time_range(spark, d):
    return view(spark, d, "analytics").filter(f"created_at >= {ASOF} - INTERVAL 3 DAYS AND created_at < {ASOF} - INTERVAL 1 DAYS").select("event_id")


@query("f02_payload_filter", with_views("SELECT doc_id FROM kb WHERE entity_type = 'src3' AND repo_id = 'en'", "kb"))
def f02_payload_filter(spark, d):
    return P.payload(view(spark, d, "kb"), entity_type="src3", repo_id="en", capability=None).select("doc_id")


@query("f03_find_nodes", with_graph("SELECT id, label FROM nodes WHERE node_type = 'customer' AND contains(lower(label), '00010') ORDER BY id LIMIT 20"))
def f03_find_nodes(spark, d):
    return P.find_nodes(nodes(spark, d), "customer", None, "00010", 20).select("id", "label")


@query("f04_ilike", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%steel%' OR lower(p_type) LIKE '%steel%'")
def f04_ilike(spark, d):
    return table(spark, d, "part").filter(P.any_ilike(["p_name", "p_type"], "STEEL")).select("p_partkey")


@query("f05_frontier", with_graph("SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE node_type = 'supplier' AND label LIKE '%7')"))
def f05_frontier(spark, d):
    return P.within(edges(spark, d), "source_id", nodes(spark, d).filter("node_type = 'supplier' AND label LIKE '%7'")).select("source_id", "target_id")


@query("f06_content_gate", "SELECT doc_id, length(trim(text)) >= 50 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text)::DOUBLE >= 0.2 AS ok FROM documents")
def f06_content_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", P.content_ok(F.col("text")).alias("ok"))


@query("f07_log_search", "SELECT event_id, event_type FROM events WHERE regexp_matches(props, '\"k\": ?1') AND event_type IN ('error', 'purchase') ORDER BY ts, event_id LIMIT 100")
def f07_log_search(spark, d):
    return table(spark, d, "events").filter(F.col("props").rlike('"k": ?1') & F.col("event_type").isin("error", "purchase")).orderBy("ts", "event_id").limit(100).select("event_id", "event_type")


@query("f08_ingest_filter", with_views("SELECT doc_id, CASE WHEN n < 10 THEN entity_type || ': ' || entity_id ELSE content END AS content FROM (SELECT *, length(trim(content)) AS n FROM (SELECT doc_id, entity_type, entity_id, substr(content, 1, doc_id % 30) AS content FROM kb)) WHERE doc_id % 10 >= 1 AND (n >= 10 OR entity_type IN ('src1', 'src2'))", "kb"))
def f08_ingest_filter(spark, d):
    x = view(spark, d, "kb").select("doc_id", "entity_type", "entity_id", F.expr("substring(content, 1, int(doc_id % 30))").alias("content"), (F.col("doc_id") % 10 / 10.0).alias("trust"))
    return P.ingestible(x, "content", "trust", "entity_type", ["src1", "src2"], F.col("entity_id")).select("doc_id", "content")


@query("f09_export_filter", with_views("SELECT event_id FROM analytics WHERE confidence >= 0.8 AND feedback_score >= 4", "analytics"))
def f09_export_filter(spark, d):
    return view(spark, d, "analytics").filter("confidence >= 0.8 AND feedback_score >= 4").select("event_id")


@query("f10_rejected", with_views("SELECT event_id FROM analytics WHERE feedback_score <= 2 OR (confidence <= 0.4 AND feedback_score IS NULL)", "analytics"))
def f10_rejected(spark, d):
    return view(spark, d, "analytics").filter(P.rejected(F.col("feedback_score"), F.col("confidence"))).select("event_id")


COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


def nearest(corpus, queries, k):
    """query_id, vec_id, similarity, rank."""
    found = V.VectorSearch(V.build(corpus, "vec_id", "embedding"), queries, "query_id", "embedding", k).found
    return found.select(F.col("query").alias("query_id"), F.col("item").alias("vec_id"), "similarity", "rank")


@query("f11_similarity_threshold", f"SELECT q.vec_id AS query_id, c.vec_id, round({COS}, 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND {COS} >= 0.25")
def f11_similarity_threshold(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = V.VectorSearch(V.build(e, "vec_id", "embedding"), q, "query_id", "embedding", at_least=0.25).found
    return found.select(F.col("query").alias("query_id"), F.col("item").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("f12_fallback", with_views("WITH h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, intent = 'error' AND confidence > 0.9 AS own FROM analytics), n AS (SELECT *, count_if(own) OVER (PARTITION BY user_id) AS n FROM h) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY own DESC, r, event_id) AS position, own AS filtered FROM n WHERE own OR n < 3", "analytics"), ints=("position",))
def f12_fallback(spark, d):
    from pyspark.sql import Window

    h = view(spark, d, "analytics").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return P.filtered_then_fallback(h, "user_id", "event_id", "r", (F.col("intent") == "error") & (F.col("confidence") > 0.9))


@query("f13_negative_overlap", f"WITH q AS (SELECT item_id, {SQL_TOKENS} AS w FROM benchmark), k AS (SELECT doc_id, {SQL_TOKENS} AS w FROM documents WHERE lang = 'en') SELECT item_id, doc_id FROM q, k WHERE len(q.w) > 0 AND len(list_intersect(k.w, q.w)) / len(q.w)::DOUBLE > 0.3")
def f13_negative_overlap(spark, d):
    q = table(spark, d, "benchmark").select("item_id", tokens().alias("w"))
    k = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", tokens().alias("w"))
    met = q.select("item_id", F.size("w").alias("n"), F.explode("w").alias("t")).join(k.select("doc_id", F.explode("w").alias("t")), "t")
    return met.groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("share")).filter("share > 0.3").select("item_id", "doc_id")


@query("f14_purge", "SELECT page_id FROM pages WHERE NOT (url LIKE '%.html' OR url LIKE '%#%' OR url LIKE '%utm_source%')")
def f14_purge(spark, d):
    return table(spark, d, "pages").filter(~P.some([F.col("url").like(p) for p in ("%.html", "%#%", "%utm_source%")])).select("page_id")


@query("f15_expire", with_views(f"SELECT event_id, CASE WHEN approved IS NULL AND created_at < {ASOF} - INTERVAL 10 DAYS THEN 'expired' WHEN approved IS NULL THEN 'pending' WHEN approved THEN 'approved' ELSE 'denied' END AS state FROM (SELECT event_id, created_at, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approved FROM analytics)", "analytics"))
def f15_expire(spark, d):
    x = view(spark, d, "analytics").withColumn("approved", F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False))
    return P.expire(x, "approved", "created_at", f"{ASOF} - INTERVAL 10 DAYS").select("event_id", "state")


@query("f16_role_filter", "SELECT page_id FROM pages WHERE page_id % 4 = 1 OR page_id % 6 = 0")
def f16_role_filter(spark, d):
    x = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 1, F.array(F.lit("admin"), F.lit("ops"))).otherwise(F.array(F.lit("ops"))).alias("roles"), F.when(F.col("page_id") % 6 == 0, F.create_map(F.lit("admin"), F.lit("edit"))).alias("permissions"))
    return P.for_role(x, "admin").select("page_id")


@query("f17_templates", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37 ORDER BY o_orderkey LIMIT 5")
def f17_templates(spark, d):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :tenant ORDER BY o_orderkey LIMIT 5", args={"tenant": 37}, orders=table(spark, d, "orders"))


@query("j01_messages_per_session", "SELECT round(avg(n), 6) AS avg_messages, count(*) AS sessions FROM (SELECT s.conv_id, count(m.conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations UNION SELECT 999999) s LEFT JOIN conversations m ON m.conv_id = s.conv_id AND role = 'user' GROUP BY 1)")
def j01_messages_per_session(spark, d):
    m = view(spark, d, "messages")
    s = m.select("conv_id").union(spark.range(999999, 1000000)).distinct()
    n = s.join(m.filter("role = 'user'").select("conv_id", "turn"), "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("avg_messages"), F.count("*").alias("sessions"))


@query("j02_co_members", with_graph("SELECT DISTINCT a.target_id AS left_id, b.target_id AS right_id FROM edges a JOIN edges b USING (source_id) WHERE a.edge_type = 'has_part' AND b.edge_type = 'supplied_by'"))
def j02_co_members(spark, d):
    return J.co_members(edges(spark, d), "has_part", "supplied_by")


@query("j03_edge_nodes", with_graph("SELECT target_id, domain, count(*) AS n FROM edges JOIN nodes ON nodes.id = target_id GROUP BY ALL"))
def j03_edge_nodes(spark, d):
    return edges(spark, d).join(nodes(spark, d), F.col("target_id") == F.col("id")).groupBy("target_id", "domain").agg(F.count("*").alias("n"))


@query("j04_entity_lookup", with_graph("WITH c AS (SELECT event_id, unnest(['order:' || event_id % 300, 'customer:' || event_id % 2000, 'part:' || event_id % 100]) AS v, unnest([0, 1, 2]) AS pos FROM events) SELECT event_id, arg_min(id, pos) AS node_id, min(pos) AS pos FROM c JOIN nodes ON id = v GROUP BY 1"))
def j04_entity_lookup(spark, d):
    c = F.array(F.concat(F.lit("order:"), F.col("event_id") % 300), F.concat(F.lit("customer:"), F.col("event_id") % 2000), F.concat(F.lit("part:"), F.col("event_id") % 100))
    lookup = nodes(spark, d).select(F.col("id").alias("value"), F.col("id").alias("node_id"))
    return J.first_match(table(spark, d, "events"), "event_id", c, lookup, "value", "node_id")


@query("j05_hit_resolution", with_graph("WITH c AS (SELECT vec_id, unnest(['part:' || vec_id, 'order:' || vec_id]) AS v, unnest([0, 1]) AS pos FROM embeddings), m AS (SELECT vec_id, arg_min(id, pos) AS node_id FROM c JOIN nodes ON id = v GROUP BY 1) SELECT vec_id, coalesce(node_id, 'doc:' || label || ':' || vec_id) AS node_id FROM embeddings LEFT JOIN m USING (vec_id)"))
def j05_hit_resolution(spark, d):
    e = table(spark, d, "embeddings")
    lookup = nodes(spark, d).select(F.col("id").alias("value"), F.col("id").alias("node_id"))
    m = J.first_match(e, "vec_id", F.array(F.concat(F.lit("part:"), "vec_id"), F.concat(F.lit("order:"), "vec_id")), lookup, "value", "node_id")
    return e.join(m, "vec_id", "left").select("vec_id", F.coalesce("node_id", F.concat(F.lit("doc:"), "label", F.lit(":"), "vec_id")).alias("node_id"))


@query("j06_one_hop", with_graph("WITH b AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges) SELECT b AS id, min(CASE WHEN b IN ('order:1', 'order:2') THEN 0 ELSE 1 END)::INT AS depth FROM b WHERE a IN ('order:1', 'order:2') GROUP BY 1 UNION SELECT unnest(['order:1', 'order:2']), 0"))
def j06_one_hop(spark, d):
    from loomery.operators.graph import hops

    return hops(edges(spark, d), spark.createDataFrame([("order:1",), ("order:2",)], "id string"), 1)


SNAP = "old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1)"


def snapshots(spark, d):
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return old, new


@query("j07_hash_skip", f"WITH {SNAP} SELECT doc_id FROM new WHERE (doc_id, h) NOT IN (SELECT doc_id, h FROM old)")
def j07_hash_skip(spark, d):
    old, new = snapshots(spark, d)
    return J.changed(new, old, "doc_id", "h").select("doc_id")


@query("j08_snapshot_diff", f"WITH {SNAP} SELECT doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'deleted' WHEN old.h <> new.h THEN 'modified' ELSE 'unchanged' END AS change FROM old FULL JOIN new USING (doc_id)")
def j08_snapshot_diff(spark, d):
    old, new = snapshots(spark, d)
    return J.snapshot_diff(new, old, "doc_id", "h")


@query("j09_part_containment", "SELECT DISTINCT url, nation AS name FROM (SELECT url, unnest(string_split_regex(url, '[/.]')) AS nation FROM pages) WHERE nation IN ('en', 'fr', 'example', 'm')")
def j09_part_containment(spark, d):
    names = spark.createDataFrame([("en",), ("fr",), ("example",), ("m",)], "name string")
    return J.contains_part(table(spark, d, "pages"), "url", names, "name", "[/.]")


@query("j10_text_containment", "SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def j10_text_containment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return J.contains_text(docs, "text", table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")), "needle").select("item_id", "doc_id")


@query("j11_domain_join", "SELECT a.s_suppkey, b.n_name FROM supplier a JOIN nation b ON a.s_nationkey = b.n_nationkey WHERE a.s_acctbal > 0")
def j11_domain_join(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("j12_bridge", "WITH t AS (SELECT n_name AS name, 'g' || n_regionkey AS domain FROM nation UNION ALL SELECT 'Supplier#000000001', 'none'), a AS (SELECT s_name AS api, 'g' || s_suppkey % 9 AS domain, s_name || ' supplies' AS body FROM supplier), o AS (SELECT name, api FROM t JOIN a USING (domain)), x AS (SELECT * FROM o UNION SELECT name, api FROM t, a WHERE name NOT IN (SELECT name FROM o) AND contains(body, name)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY api) AS rn FROM x) SELECT name, string_agg(api, ',' ORDER BY api) AS apis FROM r WHERE rn <= 5 GROUP BY 1")
def j12_bridge(spark, d):
    t = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("g"), "n_regionkey").alias("domain")).union(spark.createDataFrame([("Supplier#000000001", "none")], "name string, domain string"))
    a = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("g"), F.col("s_suppkey") % 9).alias("domain"), F.concat("s_name", F.lit(" supplies")).alias("body"))
    return J.bridge(t, a, "domain", "name", "body")


J13_SQL = with_views("""
WITH good AS (SELECT * FROM analytics WHERE feedback_score >= 4),
bad AS (SELECT *, coalesce(feedback_score, 0) AS score FROM analytics WHERE feedback_score <= 2 OR (confidence <= 0.4 AND feedback_score IS NULL)),
g AS (SELECT *, row_number() OVER (PARTITION BY intent, entity ORDER BY feedback_score DESC, confidence DESC, event_id) AS k FROM good),
b AS (SELECT *, row_number() OVER (PARTITION BY intent, entity ORDER BY score, confidence, event_id) AS k FROM bad),
one AS (SELECT g.intent, g.entity, k, g.event_id AS chosen, b.event_id AS rejected FROM g JOIN b USING (intent, entity, k)),
g2 AS (
  SELECT *, row_number() OVER (PARTITION BY intent ORDER BY feedback_score DESC, confidence DESC, event_id) AS k
  FROM good WHERE event_id NOT IN (SELECT chosen FROM one)),
b2 AS (
  SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score, confidence, event_id) AS k
  FROM bad WHERE event_id NOT IN (SELECT rejected FROM one))
SELECT intent, entity, k, chosen, rejected, 'key' AS pass FROM one WHERE chosen <> rejected
UNION ALL
SELECT intent, g2.entity, k, g2.event_id, b2.event_id, 'wider' FROM g2 JOIN b2 USING (intent, k) WHERE g2.event_id <> b2.event_id""", "analytics")


@query("j13_pairing", J13_SQL)
def j13_pairing(spark, d):
    x = view(spark, d, "analytics")
    bad = x.filter(P.rejected(F.col("feedback_score"), F.col("confidence")))
    good = [F.desc("feedback_score"), F.desc("confidence"), F.col("event_id")]
    return J.kth_pairs(x.filter("feedback_score >= 4"), bad, ["intent", "entity"], good, [F.coalesce("feedback_score", F.lit(0)), F.col("confidence"), F.col("event_id")], "event_id", ["intent"])


@query("j14_run_comparison", with_views("SELECT test_case_id, CASE WHEN NOT a.passed AND b.passed THEN 'improved' WHEN a.passed AND NOT b.passed THEN 'regressed' ELSE 'same' END AS change FROM (SELECT * FROM runs WHERE run_id = 0) a JOIN (SELECT * FROM runs WHERE run_id = 1) b USING (test_case_id)", "runs"))
def j14_run_comparison(spark, d):
    r = view(spark, d, "runs")
    return J.compare_runs(r.filter("run_id = 0"), r.filter("run_id = 1"), "test_case_id")


@query("j15_latest_record", with_views("SELECT f.event_id, r.event_id AS record FROM (SELECT * FROM analytics WHERE intent = 'click') f ASOF LEFT JOIN (SELECT session_id, created_at, max(event_id) AS event_id FROM analytics WHERE intent = 'view' GROUP BY ALL) r ON f.session_id = r.session_id AND f.created_at >= r.created_at", "analytics"))
def j15_latest_record(spark, d):
    x = view(spark, d, "analytics")
    return J.latest_before(x.filter("intent = 'click'"), x.filter("intent = 'view'").withColumnRenamed("event_id", "record"), "session_id", "event_id", "created_at", "record")


@query("j16_neighbours", "WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn = 2) SELECT c.conv_id, c.turn, c.text FROM conversations c JOIN h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 2 AND h.turn + 2 AND c.turn <> h.turn")
def j16_neighbours(spark, d):
    c = table(spark, d, "conversations")
    hits = c.filter("turn = 2").select("conv_id", "turn", F.lit(1).alias("parent_rank"))
    return J.neighbours(hits, c, "conv_id", "turn", "text")


@query("j17_parents", "WITH h AS (SELECT vec_id % 7 AS q, vec_id AS item, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) AS r FROM embeddings), p AS (SELECT q, floor(item / 5.0)::BIGINT AS parent, min(r) AS r FROM h GROUP BY ALL), s AS (SELECT q, parent, row_number() OVER (PARTITION BY q ORDER BY r, parent) AS position FROM p WHERE (q, parent) NOT IN (SELECT q, item FROM h)) SELECT * FROM s WHERE position <= 3", ints=("position",))
def j17_parents(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    h = e.select((F.col("vec_id") % 7).alias("q"), F.col("vec_id").alias("item"), F.row_number().over(Window.partitionBy(F.col("vec_id") % 7).orderBy("vec_id")).alias("r"))
    return J.parents_of(h, e.select(F.col("vec_id").alias("item"), F.floor(F.col("vec_id") / 5.0).alias("parent")), "q", "r", "item", "parent")


@query("j18_chains", with_graph("WITH r AS (SELECT id FROM nodes WHERE node_type IN ('order', 'nation')), e AS (SELECT DISTINCT source_id, target_id FROM edges) SELECT source_id AS source, NULL AS middle, target_id AS target FROM e WHERE source_id IN (FROM r) AND target_id IN (FROM r) UNION SELECT a.source_id, a.target_id, b.target_id FROM e a JOIN e b ON a.target_id = b.source_id WHERE a.source_id IN (FROM r) AND a.target_id NOT IN (FROM r) AND b.target_id IN (FROM r) AND a.source_id <> b.target_id"))
def j18_chains(spark, d):
    return J.chains(edges(spark, d), nodes(spark, d).filter("node_type IN ('order', 'nation')").select("id"))


@query("j19_similarity_top_k", f"SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, c.vec_id, {COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE rank <= 5", ints=("rank",))
def j19_similarity_top_k(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(e, q, 5).withColumn("similarity", F.round("similarity", 6))


@query("j20_failure_totals", with_views("WITH t AS (SELECT dimension, count(*) AS total FROM preferences GROUP BY 1), f AS (SELECT dimension, count(*) AS failures FROM preferences WHERE preference = 'both_bad' AND preset = 'p0' GROUP BY 1) SELECT dimension, total, coalesce(failures, 0) AS failures FROM t LEFT JOIN f USING (dimension)", "preferences"))
def j20_failure_totals(spark, d):
    p = view(spark, d, "preferences")
    f = p.filter("preference = 'both_bad' AND preset = 'p0'").groupBy("dimension").agg(F.count("*").alias("failures"))
    return p.groupBy("dimension").agg(F.count("*").alias("total")).join(f, "dimension", "left").fillna(0, ["failures"])


@query("j21_either_end", with_graph("SELECT id, count(*) AS n FROM nodes JOIN edges ON id = source_id OR id = target_id WHERE node_type = 'supplier' GROUP BY 1"))
def j21_either_end(spark, d):
    n = nodes(spark, d).filter("node_type = 'supplier'").select("id")
    return J.either_end(edges(spark, d)).join(n, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))


@query("j22_partial_match", "SELECT a.n_name AS a, b.r_name AS b FROM nation a, region b WHERE contains(a.n_name, b.r_name) OR contains(b.r_name, a.n_name) OR contains(a.n_name, 'ATION_1') AND b.r_name = 'ASIA'")
def j22_partial_match(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("a"))
    b = table(spark, d, "region").select(F.col("r_name").alias("b"))
    out = J.contains_text(a, "a", b, "b").select("a", "b").unionByName(J.contains_text(b, "b", a, "a").select("a", "b"))
    return out.unionByName(a.filter(F.contains("a", F.lit("ATION_1"))).join(b.filter("b = 'ASIA'").select("b", F.lit(1).alias("k")), F.lit(1) == F.col("k")).select("a", "b")).distinct()


@query("j23_entity_hub", "SELECT n_nationkey AS id, concat_ws(chr(10), 'nation: ' || n_name, 'customers: ' || c, 'suppliers: ' || s) AS body FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*)::VARCHAR AS c FROM customer WHERE c_acctbal < -900 GROUP BY 1) ON k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k2, count(*)::VARCHAR AS s FROM supplier GROUP BY 1) ON k2 = n_nationkey")
def j23_entity_hub(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    c = table(spark, d, "customer").filter("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").cast("string").alias("text"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").cast("string").alias("text"))
    return J.hub(n, "id", {"nation": n, "customers": c, "suppliers": s})


@query("j24_session_seeds", with_graph("WITH s AS (SELECT user_id, list('order:' || event_id % 400 ORDER BY event_id) AS ids FROM events GROUP BY 1) SELECT user_id, id, domain FROM (SELECT user_id, unnest(ids[-3:]) AS id FROM s) JOIN nodes USING (id)"))
def j24_session_seeds(spark, d):
    from loomery.operators.ranking import top_per

    last = top_per(table(spark, d, "events"), ["user_id"], [F.desc("event_id")], 3)
    s = last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit("order:"), x % 400)).alias("ids"))
    return J.last_of_array(s, "user_id", "ids", 3, nodes(spark, d).select("id", "domain"), "id")


def legs(spark, d):
    i = F.col("event_id")
    leg = F.element_at(F.array(*[F.lit(x) for x in K.LEG_WEIGHTS]), (i % 5 + 1).cast("int"))
    return table(spark, d, "events").groupBy((i % 20).alias("query_id"), leg.alias("leg"), (i * 7 % 50).alias("node_id")).agg((F.min(i) % 9 + 1).alias("rank"))


LEGS = "legs AS (SELECT event_id % 20 AS query_id, ['exact', 'pagerank', 'neighbourhood', 'vector', 'lexical'][1 + event_id % 5] AS leg, event_id * 7 % 50 AS node_id, min(event_id) % 9 + 1 AS rank FROM events GROUP BY 1, 2, 3)"
FUSED = "fused AS (SELECT query_id, node_id, round(sum({w} / (60 + rank)) * CASE WHEN node_id % 11 = 0 THEN {p} ELSE 1 END, 6) AS score, array_to_string(list_sort(list(DISTINCT leg)), '+') AS legs FROM legs GROUP BY query_id, node_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS position FROM fused)"
W = "CASE leg WHEN 'exact' THEN 2.0::DOUBLE WHEN 'pagerank' THEN 1.8 WHEN 'neighbourhood' THEN 1.5 WHEN 'vector' THEN 1.0 ELSE 0.8 END"


@query("k01_weighted_fusion", f"WITH {LEGS}, {FUSED.format(w=W, p='0.3::DOUBLE')} SELECT * FROM top WHERE position <= 10", ints=("position",))
def k01_weighted_fusion(spark, d):
    return K.fuse(legs(spark, d), 10, penalised=F.col("node_id") % 11 == 0)


@query("k02_plain_fusion", f"WITH {LEGS}, {FUSED.format(w='1.0::DOUBLE', p='1')} SELECT query_id, round(least(1, max(score) / (1/61.0 + 1/62.0 + 1/63.0 + 1/64.0 + 1/65.0)), 6)::DOUBLE AS confidence FROM top WHERE position <= 10 GROUP BY 1")
def k02_plain_fusion(spark, d):
    return K.fusion_confidence(K.fuse(legs(spark, d), 10, None), 5)


@query("k03_relevance", f"SELECT query_id, vec_id, rank, round(s * (0.5 + (vec_id % 5) / 10.0) * CASE WHEN vec_id % 120 <= 7 THEN 1.0 WHEN vec_id % 120 <= 30 THEN 0.9 WHEN vec_id % 120 <= 90 THEN 0.8 ELSE 0.7 END, 6)::DOUBLE AS relevance FROM (SELECT q.vec_id AS query_id, c.vec_id, {COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE rank <= 5", ints=("rank",))
def k03_relevance(spark, d):
    e = table(spark, d, "embeddings")
    x = nearest(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return x.select("query_id", "vec_id", "rank", F.round(F.col("similarity") * (0.5 + F.col("vec_id") % 5 / 10.0) * K.freshness(F.col("vec_id") % 120), 6).alias("relevance"))


K04_SQL = "WITH td AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2)) AS token FROM documents), tq AS (SELECT item_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2)) AS token FROM benchmark), idf AS (SELECT token, round(ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT id) + 1)::DOUBLE) + 1, 6) AS idf FROM td GROUP BY 1), fd AS (SELECT id, token, count(*) AS tf FROM td GROUP BY ALL), fq AS (SELECT id, token, count(*) AS tf FROM tq GROUP BY ALL), wd AS (SELECT id, token, (0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY id)) * idf AS w FROM fd JOIN idf USING (token)), wq AS (SELECT id, token, (0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY id)) * idf AS w FROM (SELECT fq.*, idf FROM fq JOIN idf USING (token))), nd AS (SELECT id, sqrt(sum(w * w)) AS n FROM wd GROUP BY 1), nq AS (SELECT id, sqrt(sum(w * w)) AS n FROM wq GROUP BY 1), s AS (SELECT wq.id AS item_id, wd.id AS doc_id, round(sum(wq.w * wd.w) / (any_value(nq.n) * any_value(nd.n)), 6) AS score FROM wq JOIN wd USING (token) JOIN nd ON nd.id = wd.id JOIN nq ON nq.id = wq.id GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5"


def k04_tables(spark, d):
    words = F.expr("filter(regexp_extract_all(lower(text), '[a-z0-9_]+', 0), x -> length(x) > 2)").alias("tokens")
    return table(spark, d, "documents").select("doc_id", words), table(spark, d, "benchmark").select("item_id", words)


@query("k04_token_cosine", K04_SQL, ints=("rank",))
def k04_token_cosine(spark, d):
    from loomery.operators.aggregates import idf

    docs, q = k04_tables(spark, d)
    return K.token_cosine(q, docs, idf(docs, "doc_id", "tokens"), 5, "item_id", "doc_id")


@query("k04_indexed_cosine", K04_SQL, ints=("rank",))
def k04_indexed_cosine(spark, d):
    """The same through the inverted index."""
    docs, q = k04_tables(spark, d)
    index, idf = X.cosine_index(docs, "doc_id")
    found = X.Search(index, X.cosine_queries(q, "item_id", idf), 5).found
    return found.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "score", "rank")


@query("k06_mmr")
def k06_mmr(spark, d):
    e = table(spark, d, "embeddings")
    near = nearest(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), tokens().alias("tokens"), F.col("lang").alias("kind"))
    return K.mmr(near.join(docs, "vec_id"), "query_id", "vec_id", "similarity", "tokens", "kind")


@query("k07_keyword_rerank", f"WITH q AS (SELECT item_id, {SQL_TOKENS} AS w FROM benchmark), k AS (SELECT doc_id, lang, {SQL_TOKENS} AS w FROM documents) SELECT item_id, doc_id, round(0.35 * 0.5 + 0.25 * len(list_intersect(k.w, q.w)) / len(q.w)::DOUBLE + 0.2 * (lang = 'en')::INT + 0.1 * 0.5 + 0.1 * 0.9, 6)::DOUBLE AS score FROM q, k WHERE len(list_intersect(k.w, q.w)) > 0")
def k07_keyword_rerank(spark, d):
    q = table(spark, d, "benchmark").select("item_id", tokens().alias("q"))
    k = table(spark, d, "documents").select("doc_id", "lang", tokens().alias("w"))
    met = q.select("item_id", F.size("q").alias("n"), F.explode("q").alias("t")).join(k.select("doc_id", "lang", F.explode("w").alias("t")), "t").groupBy("item_id", "doc_id", "lang").agg((F.count("*") / F.first("n")).alias("overlap"))
    return met.select("item_id", "doc_id", F.round(K.keyword_score(F.lit(0.5), F.col("overlap"), F.col("lang") == "en", F.lit(0.5), F.lit(0.9)), 6).alias("score"))


@query("k08_boosts", with_views("SELECT event_id, confidence, round(confidence * least(3.5, CASE WHEN intent = 'purchase' THEN 2.0 ELSE 1 END * CASE WHEN entity = 'e1' THEN 1.5 ELSE 1 END * CASE WHEN model = 'm1' THEN 1.3 ELSE 1 END), 6)::DOUBLE AS boosted FROM analytics", "analytics"))
def k08_boosts(spark, d):
    b = K.boosted(F.col("confidence"), [(F.col("intent") == "purchase", 2.0), (F.col("entity") == "e1", 1.5), (F.col("model") == "m1", 1.3)])
    return view(spark, d, "analytics").select("event_id", "confidence", F.round(b, 6).alias("boosted"))


@query("k09_hierarchy", "WITH dm AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 3), s AS (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE source IN (SELECT source FROM dm) GROUP BY source, lang), l AS (SELECT d.source, d.lang, doc_id, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY n_chars DESC, doc_id) AS r FROM documents d JOIN s ON d.source = s.source AND d.lang = s.lang AND s.r <= 2) SELECT source, lang, doc_id FROM l WHERE r <= 2")
def k09_hierarchy(spark, d):
    docs = table(spark, d, "documents")
    top = docs.groupBy("source").count().orderBy(F.desc("count"), "source").limit(3).select("source")
    own = docs.join(top, "source", "left_semi")
    services = K.top_per(own.groupBy("source", "lang").count(), ["source"], [F.desc("count"), F.col("lang")], 2).select("source", "lang")
    return K.top_per(own.join(services, ["source", "lang"], "left_semi"), ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")], 2).select("source", "lang", "doc_id")


@query("k11_tournament", with_views("WITH s AS (SELECT user_id, event_id, 0.6 * confidence + 0.2 * (1 - cost_usd / max(cost_usd) OVER (PARTITION BY user_id)) + 0.1 * (1 - latency_ms / max(latency_ms) OVER (PARTITION BY user_id)) + 0.05 AS score FROM analytics) SELECT user_id, event_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, event_id) AS r FROM s) WHERE r = 1", "analytics"))
def k11_tournament(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    s = K.tournament_score(F.col("confidence"), F.col("cost_usd"), F.col("latency_ms"), F.lit(0), F.lit(0), F.max("cost_usd").over(w), F.max("latency_ms").over(w))
    x = view(spark, d, "analytics").withColumn("score", F.round(s, 6))
    return K.top_per(x, ["user_id"], [F.desc("score"), F.col("event_id")], 1).select("user_id", "event_id", "score")


@query("k12_lexical", "SELECT p_partkey, score FROM (SELECT p_partkey, round((contains(lower(p_name), 'steel')::INT * 0.5 + contains(lower(p_type), 'steel')::INT * 0.3 + contains(lower(p_brand), '1')::INT * 0.2), 4)::DOUBLE AS score, p_name FROM part) WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 50")
def k12_lexical(spark, d):
    has = lambda c, w: F.lower(c).contains(w).cast("int")
    x = table(spark, d, "part").withColumn("score", F.round(has("p_name", "steel") * 0.5 + has("p_type", "steel") * 0.3 + has("p_brand", "1") * 0.2, 4))
    return x.filter("score > 0").orderBy(F.desc("score"), "p_name", "p_partkey").limit(50).select("p_partkey", "score")


@query("k14_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def k14_last_turns(spark, d):
    return K.top_per(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn")


@query("k15_budget", "WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, used::BIGINT AS used FROM r WHERE used <= 600")
def k15_budget(spark, d):
    return K.budget_prefix(table(spark, d, "conversations"), "conv_id", [F.desc("turn")], F.length("text"), 600).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("k16_loops", with_views("SELECT event_id FROM (SELECT event_id, intent, list(intent) OVER (PARTITION BY user_id ORDER BY created_at, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l FROM analytics) WHERE len(list_filter(l, lambda x: x = intent)) >= 5", "analytics"))
def k16_loops(spark, d):
    return K.loops(view(spark, d, "analytics"), "user_id", [F.col("created_at"), F.col("event_id")], "intent", 8, 5).filter("looping").select("event_id")


@query("k17_severity", with_views("SELECT event_id, intent FROM analytics ORDER BY list_position(['error', 'purchase', 'signup', 'view', 'click'], intent), created_at DESC, event_id LIMIT 30", "analytics"))
def k17_severity(spark, d):
    rank = F.array_position(F.array(*map(F.lit, ["error", "purchase", "signup", "view", "click"])), F.col("intent"))
    return view(spark, d, "analytics").orderBy(rank, F.desc("created_at"), "event_id").limit(30).select("event_id", "intent")


@query("k18_page", "SELECT o_orderkey, (SELECT count(*) FROM orders)::INT AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def k18_page(spark, d):
    return K.page(table(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20).select("o_orderkey", "total")


@query("k19_split", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) SELECT doc_id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'holdout' END AS part FROM r")
def k19_split(spark, d):
    return K.split(table(spark, d, "documents"), ["lang", "source"], "doc_id").select("doc_id", "part")


@query("k20_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
def k20_sample(spark, d):
    return K.sample(table(spark, d, "documents"), "doc_id", 25).select("doc_id")


@query("k21_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(lower(trim(text)))")
def k21_keep_first(spark, d):
    return K.keep_first(table(spark, d, "documents").select("doc_id", "text"), F.md5(F.lower(F.trim("text"))), [F.col("doc_id")]).select("doc_id")


@query("u01_union", "SELECT 'events' AS origin, count(*) AS n FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations")
def u01_union(spark, d):
    a = table(spark, d, "events").select(F.lit("events").alias("origin"), F.col("event_id").alias("id"))
    return a.unionByName(table(spark, d, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"))).groupBy("origin").agg(F.count("*").alias("n"))


@query("u02_ordered_union", "WITH a AS (SELECT doc_id % 10 AS q, doc_id AS id, doc_id AS r, 0 AS s FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id % 10 AS q, doc_id AS id, 100000000 - doc_id AS r, 1 AS s FROM documents WHERE lang <> 'de'), k AS (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY s, r) AS n FROM (FROM a UNION ALL FROM b)) SELECT q, id, r, row_number() OVER (PARTITION BY q ORDER BY s, r, id) AS position FROM k WHERE n = 1", ints=("position",))
def u02_ordered_union(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 10).alias("q"), F.col("doc_id").alias("id"), "lang")
    one, two = (docs.filter(F.col("lang") != x).drop("lang") for x in ("fr", "de"))
    return K.ordered_union(one.withColumn("r", F.col("id")), two.withColumn("r", 100000000 - F.col("id")), ["q", "id"], "r")


@query("u03_intersection", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def u03_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("u04_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def u04_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").filter("o_orderdate >= DATE '2000-01-01'").select("o_custkey"))


@query("u05_edge_dedup", with_graph("SELECT DISTINCT source_id, target_id, edge_type FROM rawedges"))
def u05_edge_dedup(spark, d):
    from loomery.plans.views import raw_edges

    return raw_edges(spark, d).dropDuplicates(["source_id", "target_id", "edge_type"])
