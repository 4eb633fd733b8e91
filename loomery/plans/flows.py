"""Queries of sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.plans.relational import SNAP, snapshots
from loomery.plans.views import nodes, view, with_graph, with_views
from loomery.session import shared_dir, table
from loomery.sources import digests as T
from loomery.sources import readers as R
from loomery.sources import sinks as W
from loomery.sources.snapshots import Snapshot
from loomery.streaming import operators as S


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_yaml_tree", "SELECT 'en' AS repo, 'pillar_3_apis' AS pillar, count(*) AS n FROM benchmark")
def s01_yaml_tree(spark, d):
    root = folder(spark, "tree")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("a"), "item_id").alias("folder"), F.to_json(F.struct(F.struct(F.col("item_id").alias("id")).alias("api"), F.struct(F.col("text").alias("canonical_summary")).alias("retrieval_hints"))).alias("value"))
    # a text file a document; the writer names the files, so the folder carries the kind
    rows.repartition(4, "folder").write.partitionBy("folder").text(f"{root}/en/pillar_3_apis/apis")
    return R.yaml_tree(spark, root, "part-*").groupBy("repo", "pillar").agg(F.count("*").alias("n"))


@query("s06_fill_missing", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS lang FROM documents")
def s06_fill_missing(spark, d):
    docs = table(spark, d, "documents")
    main = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.col("lang")).alias("lang"))
    return R.fill_missing(main, docs.select("doc_id", F.col("source").alias("lang")), "doc_id", ["lang"])


@query("s07_manifest", f"WITH {SNAP} SELECT doc_id, CASE WHEN new.h IS NULL THEN 'missing' WHEN old.h IS NULL THEN 'extra' WHEN old.h = new.h THEN 'ok' ELSE 'altered' END AS state FROM old FULL JOIN new USING (doc_id)")
def s07_manifest(spark, d):
    old, new = (x.withColumnRenamed("h", "digest") for x in snapshots(spark, d))
    return R.verify(new, old, "doc_id")


S07_TREE_SQL = f"""
WITH {SNAP}, a AS (SELECT doc_id // 100 || '/' || doc_id // 10 || '/' || doc_id AS path, h FROM old), b AS (SELECT doc_id // 100 || '/' || doc_id // 10 || '/' || doc_id AS path, h FROM new)
SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h"""


@query("s07_changed_files", S07_TREE_SQL)
def s07_changed_files(spark, d):
    """Two versions of a folder tree of all documents, compared by the digests of folders."""
    path = F.concat_ws("/", F.floor(F.col("doc_id") / 100), F.floor(F.col("doc_id") / 10), "doc_id")
    old, new = (T.tree(x.select(path.alias("path"), F.col("h").alias("hash"))) for x in snapshots(spark, d))
    return T.Difference(old, new).found


@query("s08_jsonl", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def s08_jsonl(spark, d):
    at = folder(spark, "seeds")
    W.export(table(spark, d, "conversations").withColumn("label", F.when(F.col("role") == "user", "u")), at)
    return R.jsonl(spark, at, "conv_id long, turn long, text string, label string", "label").select("conv_id", "turn", "text")


S09_SQL = """
SELECT _source, count(*) AS n, sum(line)::BIGINT AS lines, max(line) AS last FROM (
  SELECT 'a' AS _source, row_number() OVER (ORDER BY item_id) AS line FROM benchmark
  UNION ALL SELECT 'b', row_number() OVER (ORDER BY conv_id, turn) FROM conversations) GROUP BY 1"""


@query("s09_merged_sources", S09_SQL)
def s09_merged_sources(spark, d):
    """Every file's lines are numbered once, without gaps; parts of a source are files of their own here, so their numbers are those of
    one list of lines."""
    parts = []
    for name, source in (("benchmark", "a"), ("conversations", "b")):
        rows, at = table(spark, d, name), folder(spark, name)
        rows.coalesce(1).write.json(at)
        parts.append(R.with_provenance(spark, at, ", ".join(f"{c} {t}" for c, t in rows.dtypes), source, "r"))
    return R.merged(*parts).groupBy("_source").agg(F.count("*").alias("n"), F.sum("_source_line").alias("lines"), F.max("_source_line").alias("last"))


@query("s10_golden_seeds", "SELECT DISTINCT text AS query, 't' || conv_id % 3 AS expected_tool FROM conversations WHERE turn < 3 EXCEPT SELECT text, 't0' FROM conversations")
def s10_golden_seeds(spark, d):
    c = table(spark, d, "conversations")
    cases = c.filter("turn < 3").groupBy((F.col("conv_id") % 3).alias("k")).agg(F.collect_list("text").alias("queries")).select("queries", F.concat(F.lit("t"), "k").alias("expected_tool"))
    return R.seeds_from_cases(cases, c.select(F.col("text").alias("query"), F.lit("t0").alias("expected_tool")))


@query("s11_faq", r"SELECT doc_id, c AS content, 0.7::DOUBLE AS trust_score FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents) WHERE len(string_split(c, ' ')) >= 20")
def s11_faq(spark, d):
    return R.faq(table(spark, d, "documents"), "doc_id", "text")


@query("s12_scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def s12_scan(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 300000").select("o_orderkey")


@query("s17_changed_objects", f"WITH {SNAP} SELECT new.doc_id FROM new LEFT JOIN old USING (doc_id) WHERE old.h IS NULL OR old.h <> new.h")
def s17_changed_objects(spark, d):
    old, new = snapshots(spark, d)
    return R.changed_files(new, old, "doc_id", "h").select("doc_id")


@query("s18_log_aggregation", "SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def s18_log_aggregation(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("s19_pages", r"SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS route, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS text FROM pages")
def s19_pages(spark, d):
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1).alias("route"), text.alias("text"))


@query("s20_audit", with_graph("SELECT id, 'b' AS missing_in FROM nodes WHERE node_type = 'nation' UNION ALL SELECT id, 'a' FROM nodes WHERE node_type = 'region'"))
def s20_audit(spark, d):
    n = nodes(spark, d)
    return R.audit(n.filter("node_type <> 'region'"), n.filter("node_type <> 'nation'"), "id")


@query("w01_upsert", f"WITH {SNAP} SELECT doc_id, CASE WHEN old.h IS NULL THEN new.h WHEN new.h IS NULL OR old.h = new.h THEN old.h ELSE new.h END AS h, CASE WHEN old.h IS NULL THEN 'insert' WHEN new.h IS NULL OR old.h = new.h THEN 'keep' ELSE 'update' END AS action FROM old FULL JOIN new USING (doc_id)")
def w01_upsert(spark, d):
    old, new = snapshots(spark, d)
    return W.upsert(old, new, "doc_id", "h")


@query("w01_changes", f"WITH {SNAP} SELECT doc_id, CASE WHEN old.h IS NULL THEN 'insert' ELSE 'update' END AS action FROM new LEFT JOIN old USING (doc_id) WHERE old.h IS NULL OR old.h <> new.h")
def w01_changes(spark, d):
    """The same upsert on a bucketed snapshot, which rewrites the changed buckets only."""
    old, new = snapshots(spark, d)
    held = Snapshot(folder(spark, "snapshot"), "doc_id", "h", 32)
    held.create(old)
    return held.upsert(new)


@query("w02_keep_last", "SELECT l_orderkey, l_linenumber, max(l_partkey * 1000000 + l_suppkey) AS k FROM lineitem GROUP BY ALL")
def w02_keep_last(spark, d):
    x = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") * 1000000 + F.col("l_suppkey"))
    return W.keep_last(x, ["l_orderkey", "l_linenumber"], [F.desc("k")]).select("l_orderkey", "l_linenumber", "k")


@query("w04_jsonl_export", """SELECT '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS value FROM conversations""")
def w04_jsonl_export(spark, d):
    return W.as_json(table(spark, d, "conversations").select("conv_id", "turn"))


@query("w05_export_manifest", "SELECT 'conversations' AS type, count(*) AS records, true AS sized, 'done' AS status FROM conversations")
def w05_export_manifest(spark, d):
    m = W.export(table(spark, d, "conversations"), folder(spark, "export"), "conversations")
    return m.select("type", "records", (F.col("bytes") > F.col("records")).alias("sized"), "status")


@query("w06_delete", "SELECT doc_id FROM documents WHERE NOT (source = 'src1' AND lang = 'en')")
def w06_delete(spark, d):
    return W.deleted(table(spark, d, "documents"), (F.col("source") == "src1") & (F.col("lang") == "en")).select("doc_id")


@query("w07_audit_log", with_views("SELECT intent, count(*) * 2 AS n FROM analytics WHERE escalated OR intent = 'click' GROUP BY 1", "analytics"))
def w07_audit_log(spark, d):
    at = folder(spark, "audit")
    rows = view(spark, d, "analytics").filter("escalated OR intent = 'click'").select("event_id", "intent")
    for _ in range(2):
        W.append_audit(rows, at)
    return spark.read.parquet(at).groupBy("intent").agg(F.count("*").alias("n"))


@query("w09_dead_letters", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN 'ok' WHEN event_id % 4 + 1 >= 3 THEN 'dead' ELSE 'retry' END AS route FROM events) GROUP BY 1")
def w09_dead_letters(spark, d):
    x = table(spark, d, "events").withColumn("retry_count", F.col("event_id") % 4)
    return W.dead_letters(x, F.col("event_id") % 5 == 0, "retry_count").groupBy("route").agg(F.count("*").alias("n"))


@query("w10_exposition", with_views("""SELECT 'queries_total{intent="' || intent || '",model="' || model || '"} ' || count(*) AS line FROM analytics GROUP BY intent, model""", "analytics"))
def w10_exposition(spark, d):
    x = view(spark, d, "analytics").groupBy("intent", "model").agg(F.count("*").alias("n"))
    return W.exposition(x, "queries_total", ["intent", "model"], "n")


@query("w11_report", with_views("SELECT 'intents' AS section, '| intent | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || intent || ' | ' || n || ' |', chr(10) ORDER BY '| ' || intent || ' | ' || n || ' |') AS body FROM (SELECT intent, count(*) AS n FROM analytics GROUP BY 1)", "analytics"))
def w11_report(spark, d):
    return W.report({"intents": view(spark, d, "analytics").groupBy("intent").agg(F.count("*").alias("n"))})


@query("w12_tombstones", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS status FROM documents")
def w12_tombstones(spark, d):
    docs = table(spark, d, "documents")
    return W.tombstones(docs.select("doc_id", F.lit(1).alias("status")), docs.filter("doc_id % 7 <> 0"), "doc_id")


def stream(spark, d):
    schema = table(spark, d, "events").schema
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/event[s].parquet")
    return x.withColumn("at", F.col("ts").cast("timestamp"))


@query("st01_decode", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def st01_decode(spark, d):
    x = stream(spark, d).select("event_type", F.from_json("props", "k long").alias("p"))
    return S.run_to_end(x.select("event_type", "p.k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("st02_fan_out", "SELECT 'analytics' AS sink, count(*) AS n FROM events UNION ALL SELECT 'distillation', count(*) FROM events WHERE event_type <> 'error'")
def st02_fan_out(spark, d):
    at = folder(spark, "fan")
    S.run_to_end(stream(spark, d), each=S.fan_out({"analytics": lambda b: b.select("event_id", "value"), "distillation": lambda b: b.filter("event_type <> 'error'").select("event_id", "props")}, at))
    parts = [spark.read.parquet(f"{at}/{n}").select(F.lit(n).alias("sink")) for n in ("analytics", "distillation")]
    return parts[0].unionByName(parts[1]).groupBy("sink").agg(F.count("*").alias("n"))


@query("st03_dead_letters", "SELECT CASE WHEN event_id % 5 <> 0 THEN 'ok' WHEN event_id % 4 + 1 >= 3 THEN 'dead' ELSE 'retry' END AS route, count(*) AS n FROM events GROUP BY 1")
def st03_dead_letters(spark, d):
    at = folder(spark, "dlq")
    x = stream(spark, d).withColumn("retry_count", F.col("event_id") % 4)
    S.run_to_end(x, each=S.with_dead_letters(F.col("event_id") % 5 == 0, "retry_count", at))
    return spark.read.parquet(at).groupBy("route").agg(F.count("*").alias("n"))


@query("st04_feedback_join", "SELECT a.event_id AS feedback, b.event_id AS record FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view'")
def st04_feedback_join(spark, d):
    a = stream(spark, d).filter("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("feedback"))
    b = stream(spark, d).filter("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("record"))
    return S.run_to_end(S.joined(a, b, "user_id", "at", "1 HOUR").select("feedback", "record"))


@query("st05_sliding_repeats", "WITH w AS (SELECT user_id, event_type, unnest(range(0, 2)) AS i, ts FROM events), s AS (SELECT user_id, event_type, time_bucket(INTERVAL 12 HOUR, ts) - to_hours(i * 12) AS start FROM w) SELECT user_id, event_type, CAST(start AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY ALL HAVING n >= 3")
def st05_sliding_repeats(spark, d):
    x = S.counts(stream(spark, d), "at", "1 day", "user_id", "event_type", slide="12 hours")
    return S.run_to_end(x, "complete").filter("n >= 3").withColumn("start", F.col("start").cast("string"))


@query("st06_rate_limit")
def st06_rate_limit(spark, d):
    return S.run_to_end(S.rate_limit(stream(spark, d), "user_id", "event_id", "at", 2, 36000)).groupBy("allowed").agg(F.count("*").alias("n"))


@query("st07_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def st07_latest(spark, d):
    return S.run_to_end(S.latest(stream(spark, d), "user_id", "at", ["event_id"]), "complete")


@query("st09_sessions", "SELECT user_id, count(*) AS turns FROM events GROUP BY 1")
def st09_sessions(spark, d):
    return S.run_to_end(S.sessions(stream(spark, d), "user_id", "event_id", "event_type"), "update").select("user_id", "turns")


@query("st10_debounce", "SELECT count(DISTINCT event_id) AS n FROM events")
def st10_debounce(spark, d):
    return S.run_to_end(S.debounced(stream(spark, d), ["event_id"], "at", "5 days").select("event_id")).agg(F.count("*").alias("n"))


#: all events are one batch here, so what the batch leaves is the fold over all of a user's events
ST11_SQL = """
WITH RECURSIVE o AS (SELECT user_id, event_id % 5 >= 3 AS up, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT user_id, i, CASE WHEN up THEN 52 ELSE 45 END AS v, up FROM o WHERE i = 1
  UNION ALL
  SELECT o.user_id, o.i, CASE WHEN o.up THEN least(100, f.v + 2) ELSE greatest(0, f.v - 5) END, o.up
  FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, max_by(v, i) / 100.0::DOUBLE AS trust, NOT max_by(up, i) AND max_by(v, i) < 20 AS low_quality FROM f GROUP BY 1"""


@query("st11_trust_updates", ST11_SQL)
def st11_trust_updates(spark, d):
    return S.run_to_end(S.trust_updates(stream(spark, d).withColumn("up", F.col("event_id") % 5 >= 3), "user_id", "event_id", "up"), "update")


@query("st12_daily_counts", "SELECT CAST(date_trunc('day', ts)::TIMESTAMP AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st12_daily_counts(spark, d):
    return S.run_to_end(S.counts(stream(spark, d), "at", "1 day", "event_type"), "complete").withColumn("start", F.col("start").cast("string"))


@query("st13_daily_budget", "SELECT CAST(date_trunc('day', ts)::TIMESTAMP AS VARCHAR) AS start, round(sum(value / 1e5), 6) AS spent FROM events GROUP BY 1")
def st13_daily_budget(spark, d):
    x = stream(spark, d).withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w")).agg(F.round(F.sum(F.col("value") / 1e5), 6).alias("spent")).select(F.col("w.start").cast("string").alias("start"), "spent")
    return S.run_to_end(x, "complete")


@query("l19_circuit_stream")
def l19_circuit_stream(spark, d):
    return S.run_to_end(S.circuit(stream(spark, d).withColumn("bad", F.col("event_type") == "error"), "user_id", "event_id", "bad"), "update")
