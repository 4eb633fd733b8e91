"""Queries over usage, cost, feedback, preference and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.operators import aggregates as A
from loomery.plans.views import ASOF, view, with_views
from loomery.session import table

USAGE = "count(*) AS queries, round(avg(confidence), 4) AS avg_confidence, round(avg(latency_ms), 4) AS avg_latency_ms, round(coalesce(avg(escalated::INT), 0), 4) AS escalation_rate, round(sum(cost_usd), 8) AS total_cost, round(avg(cost_usd), 6) AS avg_cost"
AGE = f"date_diff('day', created_at::DATE, ({ASOF})::DATE)"
DECAY = f"CASE WHEN {AGE} <= 7 THEN 1.0 WHEN {AGE} <= 30 THEN 0.9 WHEN {AGE} <= 90 THEN 0.8 ELSE 0.7 END"


@query("a01_dashboard", with_views(f"SELECT {USAGE}, (SELECT latency_ms FROM analytics WHERE created_at >= {ASOF} - INTERVAL 7 DAYS ORDER BY latency_ms LIMIT 1 OFFSET (SELECT (count(*) * 0.95)::BIGINT - CASE WHEN (count(*) * 0.95)::BIGINT > count(*) * 0.95 THEN 1 ELSE 0 END FROM analytics WHERE created_at >= {ASOF} - INTERVAL 7 DAYS)) AS p95_latency_ms FROM analytics WHERE created_at >= {ASOF} - INTERVAL 7 DAYS", "analytics"))
def a01_dashboard(spark, d):
    rows = A.since(view(spark, d, "analytics"), ASOF, 7)
    return A.usage(rows).withColumn("p95_latency_ms", F.lit(A.nearest_rank(rows, "latency_ms", 0.95)))


@query("a01_daily_trend", with_views(f"SELECT CAST(created_at::DATE AS VARCHAR) AS day, {USAGE} FROM analytics GROUP BY 1", "analytics"))
def a01_daily_trend(spark, d):
    return A.usage(view(spark, d, "analytics").withColumn("day", F.to_date("created_at").cast("string")), "day")


@query("a01_breakdowns", with_views(f"SELECT 'intent' AS dim, intent AS key, {USAGE} FROM analytics GROUP BY intent UNION ALL SELECT 'entity', entity, {USAGE} FROM analytics GROUP BY entity UNION ALL SELECT 'model', model, {USAGE} FROM analytics GROUP BY model", "analytics"))
def a01_breakdowns(spark, d):
    return A.breakdown(view(spark, d, "analytics"), ["intent", "entity", "model"])


@query("a02_confidence_buckets", with_views("SELECT count_if(confidence < 0.3) AS bucket_0, count_if(confidence >= 0.3 AND confidence < 0.5) AS bucket_1, count_if(confidence >= 0.5 AND confidence < 0.8) AS bucket_2, count_if(confidence >= 0.8) AS bucket_3 FROM analytics", "analytics"))
def a02_confidence_buckets(spark, d):
    return A.buckets(view(spark, d, "analytics"), "confidence", [0.3, 0.5, 0.8])


@query("a03_p95_by_intent", with_views("SELECT intent, latency_ms AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY intent) AS n FROM analytics) WHERE rn = least(n, floor(n * 0.95) + 1)", "analytics"))
def a03_p95_by_intent(spark, d):
    return A.nearest_rank_by(view(spark, d, "analytics"), ["intent"], "latency_ms", 0.95, "p95")


@query("a04_intent_deep_dive", with_views(f"SELECT entity, model, {USAGE} FROM analytics WHERE intent = 'purchase' GROUP BY ALL", "analytics"))
def a04_intent_deep_dive(spark, d):
    return A.usage(view(spark, d, "analytics").filter("intent = 'purchase'"), "entity", "model")


@query("a05_cost_report", with_views("WITH p AS (SELECT 'model' AS dim, model AS key, cost_usd FROM analytics UNION ALL SELECT 'intent', intent, cost_usd FROM analytics UNION ALL SELECT 'day', CAST(created_at::DATE AS VARCHAR), cost_usd FROM analytics), g AS (SELECT dim, key, count(*) AS queries, round(sum(cost_usd), 8) AS cost FROM p GROUP BY ALL) SELECT *, round(sum(cost) OVER (PARTITION BY dim), 8) AS dim_total FROM g", "analytics"))
def a05_cost_report(spark, d):
    return A.cost_report(view(spark, d, "analytics"), {"model": F.col("model"), "intent": F.col("intent"), "day": F.to_date("created_at")})


@query("a06_hourly_traffic", with_views("SELECT hour(created_at)::INT AS hour, count(*) AS n FROM analytics GROUP BY 1", "analytics"))
def a06_hourly_traffic(spark, d):
    return view(spark, d, "analytics").groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("n"))


@query("a07_session_cost", with_views("SELECT session_id, CAST(created_at::DATE AS VARCHAR) AS day, count(*) AS events, round(sum(cost_usd), 8) AS cost, count(DISTINCT intent) AS intents FROM analytics GROUP BY ALL", "analytics"))
def a07_session_cost(spark, d):
    return view(spark, d, "analytics").groupBy("session_id", F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("events"), F.round(F.sum("cost_usd"), 8).alias("cost"), F.countDistinct("intent").alias("intents"))


@query("a08_feedback_summary", with_views("SELECT CAST(created_at::DATE AS VARCHAR) AS day, count(*) AS n, round(avg(rating), 4) AS avg_rating, count_if(rating = 1) AS r1, count_if(rating = 2) AS r2, count_if(rating = 3) AS r3, count_if(rating = 4) AS r4, count_if(rating = 5) AS r5 FROM feedback GROUP BY 1", "feedback"))
def a08_feedback_summary(spark, d):
    return view(spark, d, "feedback").groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("rating"), 4).alias("avg_rating"), *[F.count_if(F.col("rating") == i).alias(f"r{i}") for i in range(1, 6)])


@query("a08_low_scores", with_views("SELECT feedback_id, session_id, rating FROM feedback WHERE rating <= 2 ORDER BY created_at DESC, feedback_id LIMIT 20", "feedback"))
def a08_low_scores(spark, d):
    return view(spark, d, "feedback").filter("rating <= 2").orderBy(F.desc("created_at"), "feedback_id").limit(20).select("feedback_id", "session_id", "rating")


@query("a09_learning_section", with_views(f"SELECT count(*) AS records, count(DISTINCT session_id) AS sessions, count(DISTINCT model) AS models, round(sum(cost_usd), 8) AS cost, round(avg(feedback_score), 4) AS avg_feedback FROM analytics WHERE created_at >= {ASOF} - INTERVAL 7 DAYS AND created_at < {ASOF}", "analytics"))
def a09_learning_section(spark, d):
    return A.since(view(spark, d, "analytics"), ASOF, 7).agg(F.count("*").alias("records"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("model").alias("models"), F.round(F.sum("cost_usd"), 8).alias("cost"), F.round(F.avg("feedback_score"), 4).alias("avg_feedback"))


@query("a09_top_intents", with_views("SELECT intent, entity, count(*) AS n FROM analytics GROUP BY ALL ORDER BY n DESC, intent, entity LIMIT 10", "analytics"))
def a09_top_intents(spark, d):
    return view(spark, d, "analytics").groupBy("intent", "entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent", "entity").limit(10)


@query("a10_conversation_section", "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS avg_chars FROM conversations GROUP BY role")
def a10_conversation_section(spark, d):
    return view(spark, d, "messages").groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("content")), 4).alias("avg_chars"))


@query("a11_tool_usage", with_views("SELECT tool_name, count(*) AS calls, count_if(status = 'success') AS succeeded, count_if(status <> 'success') AS failed, round(avg((status = 'success')::INT), 4) AS success_rate, round(avg(duration_ms), 4) AS avg_ms FROM executions GROUP BY 1 ORDER BY calls DESC, tool_name LIMIT 15", "executions"))
def a11_tool_usage(spark, d):
    ok = F.col("status") == "success"
    return view(spark, d, "executions").groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(A.rate(ok), 4).alias("success_rate"), F.round(F.avg("duration_ms"), 4).alias("avg_ms")).orderBy(F.desc("calls"), "tool_name").limit(15)


@query("a12_cost_by_model_day", with_views("SELECT model, CAST(created_at::DATE AS VARCHAR) AS day, round(sum(cost_usd), 8) AS cost, grouping(day) AS is_total FROM (SELECT model, created_at, created_at::DATE AS day, cost_usd FROM analytics) GROUP BY GROUPING SETS ((model, created_at::DATE, day), (model)) HAVING false UNION ALL SELECT model, CAST(created_at::DATE AS VARCHAR), round(sum(cost_usd), 8), 0 FROM analytics GROUP BY 1, 2 UNION ALL SELECT model, NULL, round(sum(cost_usd), 8), 1 FROM analytics GROUP BY 1 UNION ALL SELECT NULL, NULL, round(sum(cost_usd), 8), 1 FROM analytics", "analytics"))
def a12_cost_by_model_day(spark, d):
    x = view(spark, d, "analytics").withColumn("day", F.to_date("created_at").cast("string"))
    return x.rollup("model", "day").agg(F.round(F.sum("cost_usd"), 8).alias("cost"), F.grouping("day").cast("long").alias("is_total"))


@query("a13_accuracy_section", with_views("SELECT intent, count_if(confidence >= 0.9) AS high, count_if(confidence >= 0.7 AND confidence < 0.9) AS middle, count_if(confidence < 0.7) AS low, round(100.0 * count_if(escalated) / count(*), 4) AS escalated_percent FROM analytics GROUP BY intent", "analytics"))
def a13_accuracy_section(spark, d):
    c = F.col("confidence")
    return view(spark, d, "analytics").groupBy("intent").agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("middle"), F.count_if(c < 0.7).alias("low"), F.round(100.0 * F.count_if("escalated") / F.count("*"), 4).alias("escalated_percent"))


@query("a14_pair_stats", with_views("SELECT intent, count_if(feedback_score >= 4) AS chosen, count_if(feedback_score <= 2) AS rejected, least(count_if(feedback_score >= 4), count_if(feedback_score <= 2)) AS pairs FROM analytics GROUP BY intent ORDER BY pairs DESC, intent LIMIT 10", "analytics"))
def a14_pair_stats(spark, d):
    good, bad = F.count_if(F.col("feedback_score") >= 4), F.count_if(F.col("feedback_score") <= 2)
    return view(spark, d, "analytics").groupBy("intent").agg(good.alias("chosen"), bad.alias("rejected"), F.least(good, bad).alias("pairs")).orderBy(F.desc("pairs"), "intent").limit(10)


@query("a15_coverage_gaps", "SELECT unnest(['faq', 'policy', 'process', 'troubleshooting', 'src1']) AS source EXCEPT SELECT DISTINCT source FROM documents")
def a15_coverage_gaps(spark, d):
    return A.coverage_gaps(table(spark, d, "documents"), "source", ["faq", "policy", "process", "troubleshooting", "src1"])


@query("a15_knowledge_stats", "SELECT source, count(*) AS entries, max(doc_id) AS last_id, count_if(n_chars > 3600) AS chunked FROM documents GROUP BY source")
def a15_knowledge_stats(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.max("doc_id").alias("last_id"), F.count_if(F.col("n_chars") > 3600).alias("chunked"))


STATS = f"count(*) AS votes, count_if(preference = 'A') AS n_a, count_if(preference = 'B') AS n_b, count_if(preference = 'both_good') AS n_both_good, count_if(preference = 'both_bad') AS n_both_bad, round(count_if(preference = 'A') / nullif(count_if(preference IN ('A', 'B')), 0)::DOUBLE, 4) AS win_rate_a, round(sum(CASE WHEN preference = 'A' THEN {DECAY} ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN preference IN ('A', 'B') THEN {DECAY} ELSE 0 END), 0)::DOUBLE, 4) AS weighted_win_rate_a, count(*) >= 50 AS sample_sufficient"


@query("a16_preference_stats", with_views(f"SELECT preset, dimension, {STATS} FROM preferences GROUP BY ALL", "preferences"))
def a16_preference_stats(spark, d):
    return A.preference_stats(view(spark, d, "preferences"), ASOF, 50, "preset", "dimension")


AGREE = "c AS (SELECT pair_id, preference, count(*) AS n FROM preferences GROUP BY ALL), g AS (SELECT pair_id, sum(n)::BIGINT AS annotators, round(max(n) / sum(n)::DOUBLE, 4) AS agreement, arg_min(preference, lpad((1000 - n)::VARCHAR, 6, '0') || preference) AS majority FROM c GROUP BY pair_id)"


@query("a17_agreement", with_views(f"WITH {AGREE} SELECT * FROM g", "preferences"))
def a17_agreement(spark, d):
    return A.agreement(view(spark, d, "preferences"))


@query("a18_training_triples", with_views(f"WITH {AGREE}, l AS (SELECT pair_id, max(created_at) AS created_at FROM preferences GROUP BY 1) SELECT pair_id, majority AS chosen, CASE majority WHEN 'A' THEN 'B' ELSE 'A' END AS rejected, round(CASE WHEN agreement >= 1 THEN 1.0 ELSE 0.7 END * {DECAY}, 4)::DOUBLE AS weight FROM g JOIN l USING (pair_id) WHERE agreement >= 0.6 AND majority IN ('A', 'B')", "preferences"))
def a18_training_triples(spark, d):
    return A.training_triples(view(spark, d, "preferences"), ASOF, 0.6)


@query("a19_failure_report", with_views("SELECT dimension, count(*) AS total, count_if(preference = 'both_bad') AS failures, CAST(min(created_at) FILTER (preference = 'both_bad') AS VARCHAR) AS first_seen, CAST(max(created_at) FILTER (preference = 'both_bad') AS VARCHAR) AS last_seen, round(count_if(preference = 'both_bad') / count(*)::DOUBLE, 4) AS failure_rate, count_if(preference = 'both_bad') / count(*)::DOUBLE > 0.2 AS flagged FROM preferences GROUP BY 1", "preferences"))
def a19_failure_report(spark, d):
    return A.failure_report(view(spark, d, "preferences"), "dimension", F.col("preference") == "both_bad")


@query("a20_run_metrics", with_views("SELECT run_id, count(*) AS cases, count_if(passed) AS passed, round(avg(score), 4) AS avg_score, round(min(latency_ms), 4) AS min_latency, round(max(latency_ms), 4) AS max_latency, round(sum(cost_usd), 8) AS cost, sum(tokens_used)::BIGINT AS tokens, round(avg(passed::INT), 4) AS accuracy FROM runs GROUP BY 1", "runs"))
def a20_run_metrics(spark, d):
    return A.run_metrics(view(spark, d, "runs"))


@query("a21_tool_weights", with_views("WITH s AS (SELECT tool_name AS tool, avg((status = 'success')::INT) AS success, avg(duration_ms) AS latency FROM executions GROUP BY 1), c AS (SELECT intent AS tool, avg(confidence) AS confidence, avg(feedback_score) AS rating FROM analytics GROUP BY 1) SELECT tool, round(greatest(0, least(1, 0.4 * success + 0.3 * (rating - 1) / 4 + 0.2 * confidence - 0.1 * latency / (SELECT max(latency) FROM s))), 4) AS weight FROM s JOIN c USING (tool)", "analytics", "executions"))
def a21_tool_weights(spark, d):
    x = view(spark, d, "executions").groupBy(F.col("tool_name").alias("tool")).agg(F.avg((F.col("status") == "success").cast("double")).alias("success"), F.avg("duration_ms").alias("latency"))
    tools = view(spark, d, "analytics").withColumn("tools_used", F.array("intent")).withColumn("tool", F.explode("tools_used")).groupBy("tool").agg(F.avg("confidence").alias("confidence"), F.avg("feedback_score").alias("rating"))
    return A.tool_weights(x.join(tools.select("tool", "confidence"), "tool", "left"), tools.select("tool", "rating"))


@query("a22_leaderboard", with_views("SELECT *, row_number() OVER (PARTITION BY intent ORDER BY confidence DESC, cost, model) AS rank FROM (SELECT intent, model, count(*) AS runs, round(avg(confidence), 6) AS confidence, round(avg(cost_usd), 8) AS cost, round(avg(latency_ms), 6) AS latency FROM analytics GROUP BY ALL)", "analytics"), ints=("rank",))
def a22_leaderboard(spark, d):
    return A.leaderboard(view(spark, d, "analytics"), "intent", "model")


@query("a23_retrieval_eval", with_views("WITH r AS (SELECT category, CASE WHEN event_id % 13 < 10 THEN 1 + event_id % 13 END AS rank FROM (SELECT event_type AS category, event_id FROM events)) SELECT category, count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)), 4) AS recall_1, round(avg(coalesce((rank <= 3)::INT, 0)), 4) AS recall_3, round(avg(coalesce((rank <= 5)::INT, 0)), 4) AS recall_5, round(avg(coalesce((rank <= 10)::INT, 0)), 4) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY 1"))
def a23_retrieval_eval(spark, d):
    ranks = table(spark, d, "events").select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 13 < 10, 1 + F.col("event_id") % 13).alias("rank"))
    return A.retrieval_eval(ranks, (1, 3, 5, 10), "category")


@query("a24_endpoint_usage", "SELECT event_type AS endpoint, count(*) AS calls, round(avg(value), 4) AS avg_latency, round(avg((event_id % 11 = 0)::INT), 4) AS error_rate FROM events GROUP BY 1 ORDER BY calls DESC, endpoint LIMIT 3")
def a24_endpoint_usage(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("calls"), F.round(F.avg("value"), 4).alias("avg_latency"), F.round(A.rate(F.col("event_id") % 11 == 0), 4).alias("error_rate")).orderBy(F.desc("calls"), "endpoint").limit(3)


@query("a25_benchmark_metrics", with_views("SELECT category, count(*) AS n, round(avg(passed::INT), 4) AS accuracy, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(avg((status_error)::INT), 4) AS error_rate FROM (SELECT *, event_error AS status_error FROM (SELECT event_type AS category, value > 50 AS passed, value AS latency_ms, event_type = 'error' AS event_error FROM events)) GROUP BY 1"))
def a25_benchmark_metrics(spark, d):
    return view(spark, d, "runs").groupBy("category").agg(F.count("*").alias("n"), F.round(A.rate(F.col("passed")), 4).alias("accuracy"), F.round(F.percentile("latency_ms", 0.5), 4).alias("p50"), F.round(A.rate(F.col("category") == "error"), 4).alias("error_rate"))


@query("a26_lane_report", with_views("SELECT model, count(*) AS n, round(avg(confidence), 4) AS avg_score, round(avg(latency_ms), 4) AS avg_latency, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM analytics GROUP BY 1", "analytics"))
def a26_lane_report(spark, d):
    return view(spark, d, "analytics").groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_score"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.round(F.percentile("latency_ms", 0.95), 6).alias("p95"))


@query("a31_idf", "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) + 1, 6) AS idf FROM t WHERE length(token) > 2 GROUP BY 1")
def a31_idf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr("filter(regexp_extract_all(lower(text), '[a-z0-9_]+', 0), x -> length(x) > 2)").alias("tokens"))
    return A.idf(docs, "doc_id", "tokens")


@query("a32_intent_centroids", "WITH t AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), v AS (SELECT lang, doc_id, token, count(*)::DOUBLE AS w FROM t WHERE length(token) > 2 GROUP BY ALL), n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM v GROUP BY 1 HAVING n >= 3), m AS (SELECT lang, token, sum(w) / any_value(n) AS w FROM v JOIN n USING (lang) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w DESC, token) AS pos FROM m) SELECT lang, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY lang)), 6) AS weight FROM r WHERE pos <= 20")
def a32_intent_centroids(spark, d):
    tokens = table(spark, d, "documents").select("lang", "doc_id", F.explode(F.expr("filter(regexp_extract_all(lower(text), '[a-z0-9_]+', 0), x -> length(x) > 2)")).alias("token"))
    return A.centroids(tokens.groupBy("lang", "doc_id", "token").agg(F.count("*").cast("double").alias("w")), "lang", "token", "w", "doc_id", 3, 20)


@query("a33_daily_budget", with_views("WITH c AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS errors FROM c LEFT JOIN (SELECT created_at::DATE AS day, count(*) AS n FROM analytics WHERE escalated GROUP BY 1) USING (day)", "analytics"))
def a33_daily_budget(spark, d):
    return A.calendar(view(spark, d, "analytics").filter("escalated").withColumnRenamed("created_at", "day"), "2023-12-30", "2024-01-31", "day", F.count("*"), "errors")


@query("a33_user_cost", with_views("SELECT user_id, CAST(created_at::DATE AS VARCHAR) AS day, round(sum(cost_usd), 6) AS spent, round(greatest(0, 0.5 - sum(cost_usd)), 6) AS remaining FROM analytics GROUP BY ALL ORDER BY spent DESC, user_id, day LIMIT 50", "analytics"))
def a33_user_cost(spark, d):
    return view(spark, d, "analytics").groupBy("user_id", F.to_date("created_at").cast("string").alias("day")).agg(F.round(F.sum("cost_usd"), 6).alias("spent"), F.round(F.greatest(F.lit(0.0), 0.5 - F.sum("cost_usd")), 6).alias("remaining")).orderBy(F.desc("spent"), "user_id", "day").limit(50)


@query("a34_cache_stats", with_views("SELECT level, count(*) AS lookups, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share, round(sum(CASE WHEN level <> 'miss' THEN cost_usd ELSE 0 END), 4) AS saved FROM (SELECT CASE WHEN event_id % 10 < 3 THEN 'exact' WHEN event_id % 10 < 5 THEN 'intent' WHEN event_id % 10 < 6 THEN 'similar' ELSE 'miss' END AS level, cost_usd FROM analytics) GROUP BY 1", "analytics"))
def a34_cache_stats(spark, d):
    i = F.col("event_id") % 10
    x = view(spark, d, "analytics").withColumn("level", F.when(i < 3, "exact").when(i < 5, "intent").when(i < 6, "similar").otherwise("miss"))
    n = x.count()
    return x.groupBy("level").agg(F.count("*").alias("lookups"), F.round(F.count("*") / F.lit(n), 4).alias("share"), F.round(F.sum(F.when(F.col("level") != "miss", F.col("cost_usd")).otherwise(0.0)), 4).alias("saved"))


@query("a35_pattern_cache", with_views("SELECT tool_name, count_if(status = 'success') AS success_count, count(*) AS total_count, round(avg(duration_ms), 4) AS avg_latency_ms, round(count_if(status = 'success') / count(*)::DOUBLE, 4) AS confidence, count_if(status = 'success') / count(*)::DOUBLE >= 0.9 AND count_if(status = 'success') >= 30 AS fast_path FROM executions GROUP BY 1", "executions"))
def a35_pattern_cache(spark, d):
    return A.pattern_cache(view(spark, d, "executions"), "tool_name")


@query("a36_memory", with_views("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rn FROM analytics) SELECT user_id, count(*) AS occurrences, string_agg(event_id::VARCHAR, ',' ORDER BY rn DESC) FILTER (rn <= 10) AS recent, round(least(1, 0.3 + 0.1 * count(*)), 4)::DOUBLE AS confidence FROM r GROUP BY 1", "analytics"))
def a36_memory(spark, d):
    return A.memory(view(spark, d, "analytics"), "user_id", "event_id", ["created_at", "event_id"])


@query("a37_status_counts", with_views("SELECT tool_name, count_if(status = 'success') AS success, count_if(status = 'failed') AS failed FROM executions GROUP BY 1", "executions"))
def a37_status_counts(spark, d):
    return view(spark, d, "executions").groupBy("tool_name").pivot("status", ["success", "failed"]).count()


@query("a38_bifurcation", "WITH k AS (SELECT doc_id, source, source || '_' || lang AS k FROM documents), n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) < 8 THEN source || '_misc' ELSE k END AS k2 FROM k), p AS (SELECT *, floor((row_number() OVER (PARTITION BY k2 ORDER BY doc_id) - 1) / 20.0)::BIGINT AS part, count(*) OVER (PARTITION BY k2) AS size FROM n) SELECT CASE WHEN size > 20 THEN k2 || '_' || (part + 1)::VARCHAR ELSE k2 END AS tool, count(*) AS members FROM p GROUP BY 1")
def a38_bifurcation(spark, d):
    return A.bifurcate(table(spark, d, "documents"), ["source", "lang"], 8, 20, "doc_id")


@query("a40_histogram", with_views("WITH b AS (SELECT unnest([5, 10, 25, 50, 100, 250, 500]::DOUBLE[]) AS b) SELECT intent, b::VARCHAR AS le, count_if(latency_ms <= b) AS n FROM analytics, b GROUP BY ALL UNION ALL SELECT intent, '+Inf', count(latency_ms) FROM analytics GROUP BY 1", "analytics"))
def a40_histogram(spark, d):
    return A.histogram(view(spark, d, "analytics"), "latency_ms", [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0], "intent")


@query("a41_evidence_counts", with_views("SELECT user_id AS query_id, count(DISTINCT intent) AS legs, count(*) AS evidence, round(count_if(confidence >= 0.5) / count(*)::DOUBLE, 4) AS signal FROM analytics GROUP BY 1", "analytics"))
def a41_evidence_counts(spark, d):
    return view(spark, d, "analytics").groupBy(F.col("user_id").alias("query_id")).agg(F.countDistinct("intent").alias("legs"), F.count("*").alias("evidence"), F.round(F.count_if(F.col("confidence") >= 0.5) / F.count("*"), 4).alias("signal"))


@query("a42_best_params", with_views("SELECT user_id, intent, arg_max(model, (confidence, model)) AS model FROM analytics GROUP BY ALL", "analytics"))
def a42_best_params(spark, d):
    return A.best_params(view(spark, d, "analytics"), "user_id", "intent", "model", "confidence")
