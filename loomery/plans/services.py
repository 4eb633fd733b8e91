"""Queries of readers by kind, topics, registries and what services keep about their own runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.operators import orchestration as O
from loomery.plans.flows import folder, stream
from loomery.plans.relational import SNAP, snapshots
from loomery.session import table
from loomery.sources import readers as R
from loomery.sources import sinks as W
from loomery.streaming import operators as S

PILLARS = [prefix for prefix, _, _ in R.KINDS.values()]


def as_json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def tree(docs, pillar, folder_, file, doc):
    """The columns of readers.yaml_tree."""
    path = F.concat_ws("/", F.lit(""), F.lit("r"), pillar, F.when(pillar == "pillar_1_schema", "tables").otherwise("apis"), folder_, file)
    return docs.select(path.alias("path"), F.lit("r").alias("repo"), pillar.alias("pillar"), folder_.alias("folder"), file.alias("file"), doc.alias("doc"))


@query("s02_api_documents", """SELECT 'api.' || doc_id AS doc_id, source AS domain, [lang, 'x'] AS intent_tags, CASE WHEN doc_id % 2 = 0 THEN 'read' END AS read_write_type,
    doc_id % 3 = 0 AS training_ready, lang || ' of ' || source || ' | ' || lang || ' | ' || source AS text_for_embedding FROM documents""")
def s02_api_documents(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    part = lambda file, doc: tree(docs, F.lit("pillar_3_apis"), name, F.lit(file), doc)
    hints = F.struct(F.concat("lang", F.lit(" of "), "source").alias("canonical_summary"), F.array("lang").alias("aliases"), F.array("source").alias("keywords"))
    overview = as_json(api=F.struct(F.concat(F.lit("api."), F.col("doc_id").cast("string")).alias("id")), classification=F.struct(F.col("source").alias("domain")), retrieval_hints=hints)
    tags = as_json(intent_tags=F.struct(F.col("lang").alias("primary"), F.array(F.lit("x"), "lang").alias("secondary")), tool_assignment=F.struct(F.when(F.col("doc_id") % 2 == 0, "read").alias("read_write_type")))
    x = R.api_documents(part("overview", overview).unionByName(part("tool_agent_tags", tags)).unionByName(part("index", as_json(training_ready=F.col("doc_id") % 3 == 0))))
    return x.select("doc_id", "domain", "intent_tags", "read_write_type", "training_ready", "text_for_embedding")


@query("s03_table_documents", "SELECT 't' || doc_id AS doc_id, source AS domain, ['id', lang] AS columns, source || ' | id ' || lang AS text_for_embedding FROM documents")
def s03_table_documents(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    part = lambda file, doc: tree(docs, F.lit("pillar_1_schema"), name, F.lit(file), doc)
    column = lambda c: F.struct(c.alias("name"), F.lit("string").alias("type"))
    x = R.table_documents(part("_meta", as_json(domain=F.col("source"), description=F.col("source"))).unionByName(part("columns", as_json(columns=F.array(column(F.lit("id")), column(F.col("lang")))))))
    return x.select("doc_id", "domain", "columns", "text_for_embedding")


@query("s05_read_all", f"SELECT k[2] AS entity_type, k[3] AS capability, k[4]::DOUBLE AS trust_score, count(*) AS n FROM (SELECT doc_id, [{', '.join(f"['{p}', '{n}', '{c}', '{w}']" for n, (p, c, w) in R.KINDS.items())}][doc_id % 13 + 1] AS k FROM documents) WHERE k IS NOT NULL GROUP BY ALL")
def s05_read_all(spark, d):
    docs, n = table(spark, d, "documents"), len(PILLARS)
    pillar = F.concat(F.coalesce(F.get(F.array(*map(F.lit, PILLARS)), (F.col("doc_id") % (n + 1)).cast("int")), F.lit("pillar_0")), F.lit("_x"))
    x = R.read_all(tree(docs, pillar, F.lit("f"), F.col("doc_id").cast("string"), F.lit("{}")))
    return x.groupBy("entity_type", "capability", "trust_score").agg(F.count("*").alias("n"))


S04_SQL = """
WITH r AS (SELECT *, 'cust' || c_nationkey AS repo FROM customer)
SELECT 'api_registry' AS entity_type, 'registry:' || repo || ':c' || c_custkey AS entity_id,
  '[' || repo || ':api_registry] api_id: c' || c_custkey || ' | domain: ' || c_mktsegment || CASE WHEN c_custkey % 3 > 0 THEN ' | calls: ' || c_custkey % 3 ELSE '' END AS content,
  c_mktsegment AS domain FROM r WHERE c_custkey % 5 <> 4
UNION ALL SELECT DISTINCT 'tool_registry', 'registry:' || repo || ':tool_registry', '[' || repo || '] tool_registry: note: none yet', '' FROM r"""


@query("s04_registries", S04_SQL)
def s04_registries(spark, d):
    """A registry of the customers of each nation, some without a name, and one of tools that has no records."""
    c = table(spark, d, "customer").withColumn("repo", F.concat(F.lit("cust"), "c_nationkey"))
    named = F.when(F.col("c_custkey") % 5 != 4, F.concat(F.lit("c"), "c_custkey"))
    record = F.struct(named.alias("api_id"), F.col("c_mktsegment").alias("domain"), (F.col("c_custkey") % 3).alias("calls"), F.array("c_custkey").alias("nested"), F.lit("").alias("empty"))
    apis = c.groupBy("repo").agg(F.to_json(F.struct(F.collect_list(record).alias("apis"))).alias("doc")).withColumn("file", F.lit("api_registry"))
    tools = c.select("repo").distinct().select("repo", F.lit('{"note": "none yet", "_hidden": "x", "tools": []}').alias("doc"), F.lit("tool_registry").alias("file"))
    out = R.registry_documents(apis.unionByName(tools))
    return out.select("entity_type", "entity_id", "content", F.element_at("metadata", "domain").alias("domain"))


@query("s13_event_topic", "SELECT event_type AS intent, count(*) AS n, max(event_id % 7) AS latency FROM events GROUP BY 1")
def s13_event_topic(spark, d):
    at = folder(spark, "topic")
    table(spark, d, "events").select(F.col("event_type").alias("intent"), (F.col("event_id") % 7).cast("double").alias("latency_ms")).write.json(at)
    return S.run_to_end(R.events(spark, "query_completed", path=at)).groupBy("intent").agg(F.count("*").alias("n"), F.max("latency_ms").cast("long").alias("latency"))


@query("s14_message_queue", "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def s14_message_queue(spark, d):
    at = folder(spark, "queue")
    table(spark, d, "conversations").select("conv_id", F.col("role").alias("msg_type")).write.json(at)
    return S.run_to_end(R.messages(S.micro_batches(spark, at, "conv_id long, msg_type string", 100), "user")).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("s15_feedback_topic", "SELECT user_id::VARCHAR AS session_id, sum(event_id % 5 + 1)::BIGINT AS rating FROM events GROUP BY 1")
def s15_feedback_topic(spark, d):
    at = folder(spark, "feedback")
    table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 5 + 1).alias("rating")).write.json(at)
    return S.run_to_end(R.events(spark, "feedback", path=at)).groupBy("session_id").agg(F.sum("rating").alias("rating"))


@query("s16_watched", "SELECT event_id FROM events")
def s16_watched(spark, d):
    at, x = folder(spark, "watched"), table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    x.unionByName(x).write.json(at)
    return S.run_to_end(R.watch(spark, at, "event_id long, at timestamp", "event_id", "at").select("event_id"))


@query("w08_buffered", "SELECT count(*) AS records, true AS bounded FROM conversations")
def w08_buffered(spark, d):
    at = folder(spark, "buffer")
    W.buffered(table(spark, d, "conversations"), at)
    files = spark.read.json(at).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("records"), (F.max("n") <= 50).alias("bounded"))


@query("st04_latest_record", """SELECT user_id, event_id AS feedback, r AS record FROM (SELECT *, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) WHERE event_type = 'click'""")
def st04_latest_record(spark, d):
    return S.run_to_end(S.latest_record(stream(spark, d).withColumn("told", F.col("event_type") == "click"), "user_id", "at", "event_id", "told"))


@query("st07_newest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 20")
def st07_newest(spark, d):
    x = S.run_to_end(S.newest(stream(spark, d), "user_id", "at", "event_id", 20))
    return x.join(F.broadcast(x.agg(F.max("version").alias("version"))), "version").select("user_id", "event_id")


ST08_SQL = """
SELECT role, (row_number() OVER (PARTITION BY role ORDER BY conv_id * 100 + turn) - 1) // 50 + 1 AS batch, conv_id * 100 + turn AS item FROM conversations"""


@query("st08_micro_batches", ST08_SQL)
def st08_micro_batches(spark, d):
    """Turns wait in a queue for each role, which lets 50 go a quarter of a second, by timer."""
    at, c = folder(spark, "docs"), table(spark, d, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("item"))
    c.coalesce(1).write.json(at)
    rows, queues = c.agg(F.count("*"), F.count_distinct("role")).first()
    return S.run_until(S.released(S.micro_batches(spark, at, "role string, item long", 100), "role", "item", 50, 0.25), rows, "100 milliseconds", 60 + rows / 100, max(queues, 1))


@query("e01_strategies", "SELECT event_id AS id, CASE WHEN event_id % 10 / 10.0 >= event_id % 7 / 7.0 THEN 'exact' ELSE 'vector' END AS strategy, round(greatest(event_id % 10 / 10.0, event_id % 7 / 7.0), 6) AS confidence FROM events")
def e01_strategies(spark, d):
    r = O.Registry()
    for name, n in (("exact", 10), ("vector", 7)):
        r.add(name, lambda q, n=n: q.select("id", (F.col("id") % n / float(n)).alias("confidence")))
    return O.strategies(table(spark, d, "events").select(F.col("event_id").alias("id")), r).withColumn("confidence", F.round("confidence", 6))


@query("e04_tool_calls", """SELECT event_id AS id, event_type AS tool, CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'view' AND event_id % 3 <> 0 THEN 'denied' WHEN event_id % 5 = 0 THEN 'invalid' ELSE 'ok' END AS verdict,
    CASE WHEN event_type <> 'error' AND NOT (event_type = 'view' AND event_id % 3 <> 0) AND event_id % 5 = 0 THEN 'user' END AS lacking FROM events""")
def e04_tool_calls(spark, d):
    e = table(spark, d, "events")
    role = F.when(F.col("event_id") % 3 == 0, "admin").otherwise("viewer")
    params = F.create_map(F.lit("user"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")))
    tools = e.filter("event_type <> 'error'").select(F.col("event_type").alias("tool")).distinct().select("tool", F.when(F.col("tool") == "view", F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>")).alias("roles"), F.array(F.lit("user")).alias("required"))
    return O.tool_calls(e.select(F.col("event_id").alias("id"), role.alias("role"), F.col("event_type").alias("tool"), params.alias("params")), tools)


@query("e05_handlers", "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unhandled' END AS handler, count(*) AS n FROM events GROUP BY 1")
def e05_handlers(spark, d):
    at = folder(spark, "handled")
    S.run_to_end(stream(spark, d), each=S.dispatch({"click": lambda b: b.select("event_id"), "view": lambda b: b.select("event_id")}, "event_type", at))
    parts = [spark.read.parquet(f"{at}/{n}").select(F.lit(n).alias("handler")) for n in ("click", "view", "unhandled")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("handler").agg(F.count("*").alias("n"))


@query("o06_field_traces", """WITH own AS (SELECT * FROM (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n <= 3),
    size AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT l_suppkey, l_partkey, count(*) AS s FROM own GROUP BY ALL))
    SELECT l_suppkey, l_partkey, line FROM own JOIN size USING (l_suppkey, l_partkey) WHERE before < 10""")
def o06_field_traces(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return O.field_traces(x, "l_suppkey", "l_partkey", "line").select("l_suppkey", "l_partkey", "line")


@query("o09_update_history", f"WITH {SNAP} SELECT count(*) FILTER (WHERE old.h IS NULL) AS added, count(*) FILTER (WHERE old.h <> new.h) AS modified, count(*) FILTER (WHERE new.h IS NULL) AS removed, count(*) FILTER (WHERE old.h = new.h) AS same FROM old FULL JOIN new USING (doc_id)")
def o09_update_history(spark, d):
    return O.update_history(*snapshots(spark, d), "doc_id", "h")


O09_SQL = """
WITH v AS (SELECT year(o_orderdate)::INT AS version, o_custkey AS k, count(*) AS h FROM orders GROUP BY ALL),
p AS (SELECT version + 1 AS version, k, h AS a FROM v WHERE version < (SELECT max(version) FROM v)),
f AS (SELECT * FROM v FULL JOIN p USING (version, k))
SELECT version, count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE a <> h) AS modified, count(*) FILTER (WHERE h IS NULL) AS removed,
  count(*) FILTER (WHERE a = h) AS same FROM f WHERE version > (SELECT max(version) FROM v) - 5 GROUP BY 1"""


@query("o09_last_updates", O09_SQL)
def o09_last_updates(spark, d):
    """What each of the last five years changed of the customers' numbers of orders."""
    v = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("version"), F.col("o_custkey").alias("k")).agg(F.count("*").alias("h"))
    return O.history(v, "version", "k", "h", 5)


@query("o19_attributed", r"""SELECT conv_id, string_agg('[Source ' || turn + 1 || ': ' || role || ':' || conv_id || ' | Pillar: p | Trust: 0.5]' || chr(10) || text[:400], chr(10) ORDER BY turn) AS context FROM conversations WHERE turn < 8 GROUP BY 1""")
def o19_attributed(spark, d):
    c = table(spark, d, "conversations").filter("turn < 8")
    chunk = F.struct("turn", F.concat_ws(":", "role", F.col("conv_id").cast("string")).alias("source"), F.lit("p").alias("pillar"), F.lit(0.5).alias("trust"), F.col("text").alias("content"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(chunk)).alias("c")).select("conv_id", O.attributed(F.col("c")).alias("context"))


@query("l22_lanes", """WITH x AS (SELECT event_type AS lane, avg(CASE WHEN event_id % 6 = 0 THEN 0 ELSE 1.0 / (event_id % 6) END) AS m, avg(value) AS v FROM events GROUP BY 1), b AS (SELECT m AS bm, v AS bv FROM x WHERE lane = 'click')
    SELECT lane, round(m, 6) AS mrr, round(v, 4) AS latency_ms, round(m - bm, 6) AS mrr_lift, round(v - bv, 4) AS latency_lift FROM x, b""")
def l22_lanes(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("lane"), F.nullif(F.col("event_id") % 6, F.lit(0)).alias("rank"), "value")
    return O.lanes(x, "lane", "rank", "value", "click")
