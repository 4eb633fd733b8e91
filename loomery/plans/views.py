"""The driver's tables as the engine's inputs, once as DataFrames and once as the SQL the oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.session import table

ASOF = "TIMESTAMP '2024-01-31 00:00:00'"

#: Expressions that mean the same in Spark SQL and in DuckDB.
VIEWS = {
    "analytics": ("events", "event_id, user_id, 's' || CAST(user_id AS STRING) AS session_id, event_type AS intent, 'e' || CAST(user_id % 5 AS STRING) AS entity, (event_id % 100) / 100.0D AS confidence, value AS latency_ms, value / 100000.0D AS cost_usd, event_type = 'error' AS escalated, 'm' || CAST(event_id % 3 AS STRING) AS model, CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 10 < 7 THEN CAST(1 + event_id % 5 AS INT) END AS feedback_score"),
    "executions": ("events", "event_id, 's' || CAST(user_id AS STRING) AS session_id, event_type AS tool_name, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status, value AS duration_ms, CAST(ts AS TIMESTAMP) AS created_at"),
    "feedback": ("events", "event_id AS feedback_id, 's' || CAST(user_id AS STRING) AS session_id, CAST(1 + event_id % 5 AS INT) AS rating, CAST(ts AS TIMESTAMP) AS created_at"),
    "messages": ("conversations", "conv_id, turn, role, text AS content"),
    "kb": ("documents", "doc_id, source AS entity_type, CAST(doc_id AS STRING) AS entity_id, lang AS repo_id, text AS content, n_chars"),
    "preferences": ("events", "event_id, CAST(floor(event_id / 3.0D) AS BIGINT) AS pair_id, user_id AS voter, CASE (event_id * 7 + user_id) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'both_good' ELSE 'both_bad' END AS preference, 'p' || CAST(event_id % 2 AS STRING) AS preset, event_type AS dimension, CAST(ts AS TIMESTAMP) AS created_at"),
    "runs": ("events", "CAST(event_id % 2 AS INT) AS run_id, CAST(floor(event_id / 2.0D) AS BIGINT) AS test_case_id, value > 50 AS passed, (event_id % 50) / 50.0D AS score, value AS latency_ms, value / 100000.0D AS cost_usd, event_id % 900 AS tokens_used, event_type AS category"),
    "pages_": ("pages", "page_id, url, html"),
}
DUCK = {"CAST(": "CAST(", " AS STRING)": " AS VARCHAR)", "0D": "0::DOUBLE"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, quoted, now = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def with_views(sql: str, *names: str) -> str:
    """sql with a WITH clause for the views it names."""
    parts = []
    for n in names:
        source, columns = VIEWS[n]
        for a, b in DUCK.items():
            columns = columns.replace(a, b)
        parts.append(f"{n} AS (SELECT {columns} FROM {source})")
    rest = sql.strip()
    if not parts:
        return rest
    if rest[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {rest[5:]}"
    return f"WITH {', '.join(parts)} {rest}"


NODES_SQL = """nodes AS (
SELECT 'region:' || r_regionkey AS id, 'region' AS node_type, r_name AS label, r_name AS domain FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'geo' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supply' FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_brand FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'order', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders)"""
EDGES_SQL = """rawedges AS (
SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'in_region' AS edge_type FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'has_part' FROM lineitem
UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem),
edges AS (SELECT source_id, target_id, edge_type, round(1.0 + 0.1 * (count(*) - 1), 4)::DOUBLE AS weight FROM rawedges GROUP BY ALL)"""


def with_graph(sql: str, *names: str) -> str:
    """sql over nodes and edges (and other views)."""
    rest = sql.strip()
    recursive = "RECURSIVE " if rest[:15].upper() == "WITH RECURSIVE " else ""
    rest = rest[15:] if recursive else rest[5:] if rest[:5].upper() == "WITH " else None
    head = f"WITH {recursive}{NODES_SQL}, {EDGES_SQL}"
    head += "".join(f", {with_views('SELECT', n)[5:].removesuffix(' SELECT')}" for n in names)
    return f"{head}, {rest}" if rest else f"{head} {sql.strip()}"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    t = lambda name, kind, key, label, domain: table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("node_type"), F.col(label).cast("string").alias("label"), domain.alias("domain"))
    parts = [t("region", "region", "r_regionkey", "r_name", F.col("r_name")), t("nation", "nation", "n_nationkey", "n_name", F.lit("geo")), t("customer", "customer", "c_custkey", "c_name", F.col("c_mktsegment")), t("supplier", "supplier", "s_suppkey", "s_name", F.lit("supply")), t("part", "part", "p_partkey", "p_name", F.col("p_brand"))]
    orders = table(spark, sf_dir, "orders")
    out = orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.lit("order").alias("node_type"), F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderpriority").alias("domain"))
    for p in parts:
        out = out.unionByName(p)
    return out


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    def t(name, a, ak, b, bk, kind):
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{a}:"), ak).alias("source_id"), F.concat(F.lit(f"{b}:"), bk).alias("target_id"), F.lit(kind).alias("edge_type"))

    out = t("nation", "nation", "n_nationkey", "region", "n_regionkey", "in_region")
    for p in (t("customer", "customer", "c_custkey", "nation", "c_nationkey", "in_nation"), t("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"), t("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by"), t("lineitem", "order", "l_orderkey", "part", "l_partkey", "has_part"), t("lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "supplied_by")):
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomery.operators.graph import strengthen

    return strengthen(raw_edges(spark, sf_dir))
