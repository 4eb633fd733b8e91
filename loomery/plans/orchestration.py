"""Queries of retrieval, routing, approval, catalogues and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.operators import orchestration as O
from loomery.operators import retrieval as H
from loomery.operators.graph import build, strengthen
from loomery.operators.joins import contains_text
from loomery.plans.functions import TURNS, check, on, turns
from loomery.plans.relational import SQL_TOKENS
from loomery.plans.views import raw_edges, view, with_graph, with_views
from loomery.session import table


def corpus(spark, d):
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    # a source is split by language, so that no node has more than its share of links
    links = build(docs.withColumn("group", F.concat_ws("/", "source", "lang")), "doc_id", "doc", {"in_group": ("group", F.array("group"))})
    return q, docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text"), strengthen(links)


@query("h01_hybrid_retrieval")
def h01_hybrid_retrieval(spark, d):
    q, docs, e = corpus(spark, d)
    return H.retrieve(q, docs, e, 10)


@query("h02_context_budget")
def h02_context_budget(spark, d):
    q, docs, e = corpus(spark, d)
    return H.retrieve(q, docs, e, 10, ["exact", "lexical", "vector"], budget=3000).select("query_id", "node_id", "position", "used")


Q = f"q AS (SELECT item_id AS query_id, {SQL_TOKENS} AS w FROM benchmark), d AS (SELECT 'doc:' || doc_id AS node_id, {SQL_TOKENS} AS w FROM documents), qt AS (SELECT query_id, len(w) AS n, unnest(w) AS t FROM q), dt AS (SELECT node_id, unnest(w) AS t FROM d), s AS (SELECT query_id, node_id, count(*) / any_value(n)::DOUBLE AS score FROM qt JOIN dt USING (t) GROUP BY query_id, node_id), r AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s)"


@query("h03_lexical_leg", f"WITH {Q} SELECT * FROM r WHERE rank <= 10", ints=("rank",))
def h03_lexical_leg(spark, d):
    return H.lexical(*corpus(spark, d), 10)


@query("h04_exact_leg", "WITH s AS (SELECT item_id AS query_id, 'doc:' || doc_id AS node_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS rank FROM s) WHERE rank <= 10", ints=("rank",))
def h04_exact_leg(spark, d):
    return H.exact(*corpus(spark, d), 10)


@query("h05_neighbourhood_leg", f"WITH {Q}, st AS (SELECT query_id, node_id FROM r WHERE rank <= 3), g AS (SELECT 'doc:' || doc_id AS node_id, source || '/' || lang AS grp FROM documents), o AS (SELECT DISTINCT query_id, grp FROM st JOIN g USING (node_id)), t AS (SELECT query_id, node_id, count(*) AS score FROM o JOIN g USING (grp) GROUP BY query_id, node_id), u AS (SELECT t.* FROM t ANTI JOIN st ON st.query_id = t.query_id AND st.node_id = t.node_id) SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM u) WHERE rank <= 10", ints=("rank",))
def h05_neighbourhood_leg(spark, d):
    return H.neighbourhood(*corpus(spark, d), 10)


H06_SQL = f"""
WITH {Q}, t AS (SELECT DISTINCT item_id AS query_id, 'doc:' || doc_id AS node_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT t.query_id, min(r.rank) AS first FROM t LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r USING (query_id, node_id) GROUP BY 1)
SELECT count(*) AS answerable, count(first) AS found, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f"""


@query("h06_recall", H06_SQL)
def h06_recall(spark, d):
    """How well the lexical leg finds the documents that hold a question whole: all of them are right answers."""
    q, docs, e = corpus(spark, d)
    right = contains_text(docs.select(F.col("id").alias("node_id"), "text"), "text", q.select("query_id", F.col("query").alias("needle")), "needle").select("query_id", "node_id").distinct()
    first = right.join(H.lexical(q, docs, e, 10), ["query_id", "node_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    return first.agg(F.count("*").alias("answerable"), F.count("first").alias("found"), share((F.col("first") <= 5).cast("int")).alias("recall_at_5"), share(1 / F.col("first")).alias("mrr"))


@query("o01_scoped", with_views("WITH h AS (SELECT user_id, event_id % 40 AS item, confidence, (intent = 'error') AS s FROM analytics), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY s DESC, confidence DESC) AS n FROM h) WHERE n = 1), c AS (SELECT *, count_if(s) OVER (PARTITION BY user_id) AS have FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, item) AS position FROM c WHERE s OR have < 3) SELECT user_id, item, position FROM r WHERE position <= 3", "analytics"), ints=("position",))
def o01_scoped(spark, d):
    h = view(spark, d, "analytics").select("user_id", (F.col("event_id") % 40).alias("item"), "confidence", "intent")
    return O.scoped(h, "user_id", "item", "confidence", F.col("intent") == "error", 3).select("user_id", "item", "position")


@query("o02_extract", "SELECT source, doc_id, n_chars AS confidence, nullif(regexp_extract(text, '(\\d{4,})', 1), '') AS entity_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def o02_extract(spark, d):
    return O.extract(table(spark, d, "documents"), "source", "n_chars", "doc_id", "text")


@query("o03_tool_choice", with_views("WITH c(tool) AS (VALUES ('click_e1'), ('click'), ('search_e2'), ('fallback_error'), ('view'), ('purchase_e0')), n AS (SELECT event_id, intent, entity, unnest([intent || '_' || entity, intent, 'search_' || entity, 'fallback_' || intent]) AS tool, unnest([0, 1, 2, 3]) AS pos FROM analytics) SELECT event_id, arg_min(tool, pos) AS tool FROM n WHERE tool IN (FROM c) AND NOT (event_id % 2 = 0 AND tool = 'click_e1') GROUP BY 1", "analytics"))
def o03_tool_choice(spark, d):
    x = view(spark, d, "analytics")
    c = spark.createDataFrame([(t,) for t in ("click_e1", "click", "search_e2", "fallback_error", "view", "purchase_e0")], "tool string")
    return O.tool_for(x, "event_id", "intent", "entity", c, x.filter("event_id % 2 = 0").select("event_id", F.lit("click_e1").alias("tool")))


@query("o04_evaluation", with_views("SELECT session_id, round(avg((status = 'success')::INT), 6) AS rate, count(*) AS steps, CASE WHEN round(avg((status = 'success')::INT), 6) >= 0.8 THEN 'complete' WHEN round(avg((status = 'success')::INT), 6) >= 0.5 THEN 'partial' WHEN round(avg((status = 'success')::INT), 6) >= 0.3 THEN 'weak' ELSE 'failed' END AS verdict FROM executions GROUP BY 1", "executions"))
def o04_evaluation(spark, d):
    return O.evaluation(view(spark, d, "executions"), "session_id", F.col("status") == "success")


ROLES, RISKS = list(O.ROLE), list(O.RISK)
LEVEL = "least(3, greatest(0, floor(c_acctbal / 2500)))"
on(
    "o05_approval", "customer", "c_custkey",
    lambda: O.approval(F.element_at(F.array(*map(F.lit, ROLES)), (F.col("c_nationkey") % 5 + 1).cast("int")),
                       F.element_at(F.array(*map(F.lit, RISKS)), (F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 2500))) + 1).cast("int"))),
    f"CASE WHEN c_nationkey % 5 = 1 THEN 'manual' WHEN c_nationkey % 5 >= {LEVEL} + 1 THEN 'auto' ELSE 'manual' END",
)


@query("o07_kb_paths", "SELECT p AS path, split_part(p, 'kb/', -1) AS relative FROM (SELECT 'repo/kb/' || source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.yaml' ELSE '.md' END AS p FROM documents) WHERE p LIKE '%.yaml'")
def o07_kb_paths(spark, d):
    p = F.concat(F.lit("repo/kb/"), "source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".yaml").otherwise(".md"))
    return O.kb_paths(table(spark, d, "documents").select(p.alias("path")), "path", "kb")


@query("o08_corrections", "SELECT item_id, text || coalesce(' ' || c, '') AS text FROM benchmark LEFT JOIN (SELECT conv_id AS item_id, string_agg(text, ' ' ORDER BY text) AS c FROM conversations WHERE turn < 2 GROUP BY 1) USING (item_id)")
def o08_corrections(spark, d):
    c = table(spark, d, "conversations").filter("turn < 2").select(F.col("conv_id").alias("item_id"), F.col("text").alias("correction"))
    return O.appended(table(spark, d, "benchmark"), c, "item_id", "text")


@query("o10_process", "WITH s(step, k) AS (VALUES ('O', 1), ('P', 2), ('F', 3)) SELECT o_orderkey, k, round(100.0 * k / 3, 2)::DOUBLE AS percent, CASE k WHEN 1 THEN 'P' WHEN 2 THEN 'F' END AS next, CASE k WHEN 2 THEN 'O' WHEN 3 THEN 'P' END AS previous FROM orders JOIN s ON step = o_orderstatus")
def o10_process(spark, d):
    s = spark.createDataFrame([("O", 1), ("P", 2), ("F", 3)], "step string, k int")
    return O.process_position(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", s)


on(
    "o10_remaining", "orders", "o_orderkey",
    lambda: O.remaining_days(F.when(F.col("o_orderstatus") == "O", F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" days"))).when(F.col("o_orderstatus") == "P", "12-36 hours")),
    "CASE o_orderstatus WHEN 'O' THEN (o_orderkey % 90)::DOUBLE WHEN 'P' THEN 1.0 END",
)
AGENTS = {"orders": ["order", "cancel", "awb"], "money": ["refund", "wallet", "paisa"], "account": ["account", "company"]}
COUNT = {a: " + ".join(f"contains(lower(t), '{w}')::INT" for w in ws) for a, ws in AGENTS.items()}
TOP = f"greatest({', '.join(COUNT.values())})"
check("o11_trigger_route", lambda: O.trigger_route(F.col("t"), AGENTS), f"CASE WHEN {TOP} = 0 THEN NULL " + " ".join(f"WHEN {c} = {TOP} THEN '{a}'" for a, c in COUNT.items()) + " END")
check("o12_specialist", lambda: F.coalesce(F.when(F.col("id") % 4 == 0, "pillar"), O.trigger_route(F.col("t"), AGENTS), F.lit("general")), f"CASE WHEN id % 4 = 0 THEN 'pillar' WHEN {TOP} = 0 THEN 'general' " + " ".join(f"WHEN {c} = {TOP} THEN '{a}'" for a, c in COUNT.items()) + " END")
check("o13_write_detection", lambda: F.when(F.col("id") % 10 >= 8, "hit").when(F.col("t").rlike("(?i)cancel|refund"), "keyword").otherwise("none"), "CASE WHEN id % 10 >= 8 THEN 'hit' WHEN regexp_matches(t, '(?i)cancel|refund') THEN 'keyword' ELSE 'none' END")


@query("o14_wave_consensus", with_views("SELECT user_id, model, count_if(intent <> 'error') AS successes, count_if(intent = 'error') AS errors, count_if(intent = 'error') = 0 AS consensus FROM analytics GROUP BY ALL", "analytics"))
def o14_wave_consensus(spark, d):
    return O.wave_consensus(view(spark, d, "analytics"), ["user_id", "model"], F.col("intent") == "error")


@query("o15_page_documents", "SELECT page_id, 'Page ' || page_id || chr(10) || regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS body FROM pages")
def o15_page_documents(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat_ws("\n", F.concat(F.lit("Page "), "page_id"), F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)).alias("body"))


O16_SQL = with_views("""
WITH x AS (SELECT event_id, created_at FROM analytics WHERE confidence >= 0.6 ORDER BY created_at DESC, event_id LIMIT 5000)
SELECT 'distillation' AS origin, event_id AS id FROM x
UNION ALL SELECT 'knowledge', doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0""", "analytics")


@query("o16_training_corpus", O16_SQL)
def o16_training_corpus(spark, d):
    """The latest 5000 sure answers and all enabled entries: those not labelled toxic."""
    x = view(spark, d, "analytics").filter("confidence >= 0.6").orderBy(F.desc("created_at"), "event_id").limit(5000).select(F.lit("distillation").alias("origin"), F.col("event_id").alias("id"))
    enabled = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    return x.unionByName(enabled.select(F.lit("knowledge").alias("origin"), F.col("doc_id").alias("id")))


@query("o17_jobs", with_views("SELECT user_id, arg_max(intent, (created_at, event_id)) AS intent, count(*) AS changes FROM analytics GROUP BY 1", "analytics"))
def o17_jobs(spark, d):
    return O.jobs(view(spark, d, "analytics"), "user_id", ["created_at", "event_id"], "intent")


@query("o20_forge", with_views("SELECT user_id, max(confidence) < 0.95 AS forge FROM analytics GROUP BY 1", "analytics"))
def o20_forge(spark, d):
    return view(spark, d, "analytics").groupBy("user_id").agg((F.max("confidence") < 0.95).alias("forge"))


@query("o21_cascade", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 0")
def o21_cascade(spark, d):
    c = table(spark, d, "conversations")
    return O.cascade(c, c.filter("conv_id % 4 = 0"), "conv_id").select("conv_id", "turn")


@query("o22_registry_sync", with_graph("SELECT target_id, count(DISTINCT source_id) AS n, array_to_string(list_sort(list(DISTINCT edge_type)), ',') AS kinds FROM rawedges GROUP BY 1"))
def o22_registry_sync(spark, d):
    return raw_edges(spark, d).groupBy("target_id").agg(F.countDistinct("source_id").alias("n"), F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("kinds"))


@query("gb_rules", "SELECT 'part:' || p_partkey AS source_id, 'brand:' || p_brand AS target_id, 'belongs_to_domain' AS edge_type, NULL AS role FROM part UNION ALL SELECT 'part:' || p_partkey, 'word:' || unnest(string_split(p_type, ' ')), 'has_intent', CASE WHEN p_size > 25 THEN 'primary' ELSE 'secondary' END FROM part")
def gb_rules(spark, d):
    return O.graph_rules(table(spark, d, "part"), "p_partkey", "part", [("belongs_to_domain", "brand", F.array("p_brand"), None), ("has_intent", "word", F.split("p_type", " "), F.when(F.col("p_size") > 25, "primary").otherwise("secondary"))])


@query("gb_lookups", "SELECT DISTINCT 'short_name' AS entity_type, unnest(['mod.' || s_name, s_name]) AS entity_value, s_suppkey AS node_id FROM supplier")
def gb_lookups(spark, d):
    x = table(spark, d, "supplier").select(F.array(F.concat(F.lit("mod."), "s_name")).alias("v"), "s_suppkey")
    return O.lookups(x, "short_name", F.col("v"), "s_suppkey")


@query("gb_topic_edges", "SELECT 'topic:' || source AS source_id, 'domain:' || lang AS target_id FROM documents GROUP BY ALL UNION SELECT 'domain:' || lang, 'topic:' || source FROM documents")
def gb_topic_edges(spark, d):
    x = table(spark, d, "documents").select(F.concat(F.lit("topic:"), "source").alias("a"), F.concat(F.lit("domain:"), "lang").alias("b")).distinct()
    return x.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")).unionByName(x.select(F.col("b").alias("source_id"), F.col("a").alias("target_id")))


@query("p01_table_text", "SELECT c_custkey, 'Table: ' || c_name || ' | Columns: id (int), s (text) | Transitions: ' || array_to_string(list_transform(range(1, least(10, 1 + c_custkey % 15) + 1), lambda i: 't' || i), ', ') || CASE WHEN 1 + c_custkey % 15 > 10 THEN ' (+' || (c_custkey % 15 - 9) || ' more)' ELSE '' END AS t FROM customer")
def p01_table_text(spark, d):
    columns = F.array(F.struct(F.lit("id").alias("name"), F.lit("int").alias("type")), F.struct(F.lit("s").alias("name"), F.lit("text").alias("type")))
    steps = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("c_custkey") % 15), lambda i: F.concat(F.lit("t"), i.cast("string")))
    return table(spark, d, "customer").select("c_custkey", O.table_text(F.col("c_name"), columns, steps).alias("t"))


@query("p02_bundles", "SELECT role, chunk, string_agg(text, chr(10) || '---' || chr(10) ORDER BY k) AS body FROM (SELECT role, text, conv_id * 100 + turn AS k, floor((row_number() OVER (PARTITION BY role ORDER BY conv_id * 100 + turn) - 1) / 10.0)::BIGINT AS chunk FROM conversations) GROUP BY role, chunk")
def p02_bundles(spark, d):
    x = table(spark, d, "conversations").withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    return O.bundled(x, ["role"], "k", "text")


check("p03_faq_text", lambda: O.faq_text(F.col("t"), F.when(F.col("id") % 3 > 0, "yes").otherwise(""), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), F.lit("dom")), "CASE WHEN trim(t) <> '' AND id % 3 > 0 THEN 'Q: ' || t || chr(10) || 'A: yes' || chr(10) || 'Keywords: ' || CASE WHEN id % 2 = 0 THEN 'a, b' ELSE 'dom' END END")


@query("p04_hub_sections", "SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_partkey) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 8 GROUP BY 1")
def p04_hub_sections(spark, d):
    from loomery.operators.ranking import top_per

    x = top_per(table(spark, d, "part"), ["p_brand"], [F.col("p_partkey")], 8)
    return x.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]), ", ").alias("parts"))


@query("k22_tiers", with_views("SELECT event_id, CASE WHEN confidence >= 0.75 THEN 1 WHEN confidence >= 0.5 OR event_id % 10 / 10.0 > 0.3 THEN 2 ELSE 3 END AS tier FROM analytics", "analytics"))
def k22_tiers(spark, d):
    return view(spark, d, "analytics").select("event_id", O.tier(F.col("confidence"), F.col("event_id") % 10 / 10.0).alias("tier"))


check("gr21_echo", lambda: O.echo(F.concat(F.lit("x "), F.col("t"), F.when(F.col("id") % 2 == 0, "</trusted>").otherwise("")), F.col("t")), "id % 2 = 0 OR (length(t) >= 50 AND contains('x ' || t, substr(t, 1, 50)))")


@query("e03_guard_registry", f"{TURNS} SELECT conv_id, turn, CASE WHEN contains(t, 'cancel') THEN 'cancel' WHEN contains(t, 'order') THEN 'order' ELSE 'ALLOW' END AS r FROM c")
def e03_guard_registry(spark, d):
    g = O.Registry()
    g.add("cancel", lambda c: F.contains(c, F.lit("cancel")))
    g.add("order", lambda c: F.contains(c, F.lit("order")))
    return turns(spark, d).select("conv_id", "turn", g.guards(F.col("t")).alias("r"))


@query("e07_table_function", "SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id, unnest(range(0, (greatest(1, length(text)) + 999) // 1000)) FROM documents) GROUP BY 1")
def e07_table_function(spark, d):
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, chunk string")
    class Chunks:
        def eval(self, text: str, size: int):
            for i in range(0, max(1, len(text)), size):
                yield i // size, text[i : i + size]

    docs = table(spark, d, "documents")
    spark.udtf.register("fixed_chunks", Chunks)
    return spark.sql("SELECT doc_id, count(*) AS chunks FROM {docs}, LATERAL fixed_chunks(text, 1000) GROUP BY doc_id", docs=docs)


