"""Queries of the rules that build a graph, over documents that the test tables stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.catalog import query
from loomery.operators import graph_rules as G
from loomery.session import table

API = "SELECT 'api.' || doc_id AS id, 'api_endpoint:api.' || doc_id AS me, * FROM documents"
COVERS = {"en": ["a0", "a1"], "de": ["a1"]}


def sql(*parts: str, source: str = API) -> str:
    """Parts: the columns of a rule's rows, comma-separated as in G.COLUMNS, and where they come from."""
    named = [f"SELECT {p}" for p in parts]
    return f"WITH d AS ({source}), x(what, one, two, kind, extra) AS ({' UNION ALL '.join(named)}) SELECT DISTINCT * FROM x WHERE one IS NOT NULL AND two IS NOT NULL"


def apis(spark, d, **columns):
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("api."), F.col("doc_id").cast("string")).alias("id"), *[F.expr(c).alias(n) for n, c in columns.items()])


@query("gb01_intents", sql("'node', 'intent:' || n, n, 'intent', lang FROM t", "'lookup', lower(n), 'intent:' || n, 'intent_name', NULL FROM t", source="SELECT 1 AS one").replace("), x(", "), t AS (SELECT DISTINCT lang, unnest(['Find_' || source, 'Show_' || lang]) AS n FROM documents), x(", 1))
def gb01_intents(spark, d):
    return G.intents(table(spark, d, "documents").select(F.col("lang").alias("group"), F.expr("array('Find_' || source, 'Show_' || lang)").alias("names")))


@query("gb02_apis", sql("'node', me, id, 'api_endpoint', source FROM d", "'lookup', id, me, 'api_id', NULL FROM d", "'lookup', '/' || source || '/' || doc_id, me, 'api_path', NULL FROM d"))
def gb02_apis(spark, d):
    return G.apis(apis(spark, d, path="'/' || source || '/' || doc_id", domain="source"))


@query(
    "gb03_api_links",
    sql(
        "'edge', me, 'domain:' || source, 'belongs_to_domain', NULL FROM d",
        "'edge', me, 'tool:get_' || lang, 'implements_tool', NULL FROM d",
        "'edge', me, 'tool:t' || doc_id % 9, 'implements_tool', NULL FROM d WHERE doc_id % 2 = 0",
        "'lookup', 'get_' || lang, 'tool:get_' || lang, 'tool_name', NULL FROM d",
        "'lookup', 't' || doc_id % 9, 'tool:t' || doc_id % 9, 'tool_name', NULL FROM d WHERE doc_id % 2 = 0",
        "'edge', me, 'agent:a' || doc_id % 3, 'assigned_to_agent', 'owner' FROM d",
        "'edge', me, 'agent:a' || doc_id % 5, 'assigned_to_agent', 'secondary' FROM d WHERE doc_id % 7 > 0",
        "'edge', me, 'intent:' || lang, 'has_intent', 'primary' FROM d",
        "'edge', me, 'intent:' || source, 'has_intent', 'secondary' FROM d",
    ),
)
def gb03_api_links(spark, d):
    return G.api_links(apis(spark, d, domain="source", tools="array('get_' || lang, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id % 9 END)", owner="'a' || doc_id % 3", agents="CASE WHEN doc_id % 7 > 0 THEN array('a' || doc_id % 5) END", intent="lang", intents="array(source)"))


@query("gb04_api_tables", sql("'edge', me, 'table:' || source, 'reads_table', 'read' FROM d", "'edge', me, 'table:t' || doc_id % 11, CASE WHEN doc_id % 3 = 0 THEN 'writes_table' ELSE 'reads_table' END, CASE WHEN doc_id % 3 = 0 THEN 'write' END FROM d"))
def gb04_api_tables(spark, d):
    return G.api_tables(apis(spark, d, tables="array(struct(source AS name, 'read' AS role), struct('t' || doc_id % 11 AS name, CASE WHEN doc_id % 3 = 0 THEN 'write' END AS role))"))


@query("gb05_api_access", sql("'edge', me, 'role:' || lang, 'requires_role', NULL FROM d", "'lookup', 'param:p' || doc_id % 4, me, 'param', NULL FROM d", "'lookup', 'param:' || source, me, 'param', NULL FROM d", "'edge', 'page:' || doc_id % 50, me, 'has_action', 'panel_usage' FROM d"))
def gb05_api_access(spark, d):
    return G.api_access(apis(spark, d, roles="array(lang)", params="array('p' || doc_id % 4, source)", pages="array(doc_id % 50)"))


@query("gb06_api_fields", sql("'node', 'schema_field:' || k, k, 'schema_field', NULL FROM f", "'edge', me, 'schema_field:' || k, 'has_field', CASE WHEN r THEN 'true' ELSE 'false' END FROM f", "'lookup', 'field:' || n, 'schema_field:' || k, 'field', NULL FROM f").replace("), x(", "), f AS (SELECT me, n, id || '.' || n AS k, r FROM (SELECT me, id, 'id' AS n, true AS r FROM d UNION ALL SELECT me, id, lang, doc_id % 2 = 0 FROM d)), x(", 1))
def gb06_api_fields(spark, d):
    return G.api_fields(apis(spark, d, fields="array(struct('id' AS name, true AS required), struct(lang AS name, doc_id % 2 = 0 AS required))"))


TABLES = "SELECT 't' || p_partkey AS name, 'table:t' || p_partkey AS me, p_brand AS domain, 'db' || p_partkey % 6 AS connection FROM part"


def stored(spark, d):
    return table(spark, d, "part").selectExpr("'t' || p_partkey AS name", "'main.t' || p_partkey AS canonical", "p_brand AS domain", "'db' || p_partkey % 6 AS connection")


@query("gb07_tables", sql("'node', me, name, 'table', domain FROM d", "'lookup', name, me, 'table_name', NULL FROM d", "'lookup', 'main.' || name, me, 'table_name', NULL FROM d", "'edge', me, 'domain:' || domain, 'belongs_to_domain', NULL FROM d", source=TABLES))
def gb07_tables(spark, d):
    return G.tables(stored(spark, d))


@query("gb08_modules", sql("'node', 'module:' || s_suppkey, s_suppkey::VARCHAR, 'module', s_nationkey::VARCHAR FROM d", "'edge', 'module:' || s_suppkey, 'domain:' || s_nationkey, 'belongs_to_domain', NULL FROM d", "'edge', 'module:' || l_suppkey, 'table:t' || l_partkey, 'reads_table', NULL FROM lineitem", "'edge', 'module:' || l_suppkey, 'api_endpoint:api.' || l_orderkey, 'has_api', NULL FROM lineitem", source="SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)"))
def gb08_modules(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS l_suppkey", "CAST(s_suppkey AS STRING) AS name", "s_nationkey AS domain")
    return G.modules(table(spark, d, "lineitem").join(s, "l_suppkey").selectExpr("name", "domain", "array('t' || l_partkey) AS tables", "array('api.' || l_orderkey) AS apis"))


@query("gb09_pages", sql("'node', 'page:' || page_id, url, 'page', NULL FROM d", "'lookup', url, 'page:' || page_id, 'page_route', NULL FROM d", "'lookup', page_id::VARCHAR, 'page:' || page_id, 'page_id', NULL FROM d", "'edge', 'page:' || page_id, 'role:r' || page_id % 3, 'requires_role', NULL FROM d", "'edge', 'page:' || page_id, 'api_endpoint:api.' || page_id, 'has_action', NULL FROM d", source="SELECT page_id, url FROM pages"))
def gb09_pages(spark, d):
    return G.pages(table(spark, d, "pages").selectExpr("page_id AS id", "url AS route", "array('r' || page_id % 3) AS roles", "array('api.' || page_id) AS apis"))


@query(
    "gb10_actions",
    sql(
        "'lookup', 'do' || doc_id, 'action:' || source || '.do' || doc_id, 'action_name', NULL FROM documents",
        "'edge', 'action:' || source || '.do' || doc_id, 'table:' || lang, 'reads_table', NULL FROM documents",
        "'edge', 'action:' || source || '.do' || doc_id, 'api_endpoint:api.' || doc_id, 'calls_api', NULL FROM documents",
        "'edge', 'action:' || source || '.do' || doc_id, 'job:j' || doc_id % 8, 'dispatches_job', NULL FROM documents WHERE doc_id % 4 = 0",
        "'lookup', 'flow' || event_id, 'workflow:w.flow' || event_id, 'workflow_name', NULL FROM events",
        "'edge', 'workflow:w.flow' || event_id, 'action:x.do' || user_id, 'uses_action', NULL FROM events",
        "'edge', 'workflow:w.flow' || event_id, 'table:' || event_type, 'reads_table', NULL FROM events",
        source="SELECT 1 AS one",
    ),
)
def gb10_actions(spark, d):
    docs = table(spark, d, "documents").selectExpr("source || '.do' || doc_id AS id", "array(lang) AS tables", "array('api.' || doc_id) AS apis", "CASE WHEN doc_id % 4 = 0 THEN array('j' || doc_id % 8) END AS jobs")
    flows = table(spark, d, "events").selectExpr("'w.flow' || event_id AS id", "array('x.do' || user_id) AS actions", "array(event_type) AS tables")
    return G.actions(docs, flows)


@query(
    "gb11_agents",
    sql(
        "'edge', 'agent:a' || s_suppkey, 'skill:s' || s_nationkey, 'has_skill', NULL FROM supplier",
        "'edge', 'skill:s' || n_nationkey, 'tool:' || n_name, 'uses_tool', NULL FROM nation",
        "'edge', 'agent:a1', 'topic:' || doc_id, 'covers_topic', NULL FROM documents WHERE lang IN ('en', 'de')",
        "'edge', 'agent:a0', 'topic:' || doc_id, 'covers_topic', NULL FROM documents WHERE lang = 'en'",
        source="SELECT 1 AS one",
    ),
)
def gb11_agents(spark, d):
    own = table(spark, d, "supplier").selectExpr("'a' || s_suppkey AS name", "array('s' || s_nationkey) AS skills")
    skills = table(spark, d, "nation").selectExpr("'s' || n_nationkey AS name", "array(n_name) AS tools")
    return G.agents(own, skills, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")), COVERS)


@query("gb13_connections", sql("'node', 'module:' || connection, connection, 'module', NULL FROM d", "'edge', me, 'module:' || connection, 'uses_connection', NULL FROM d", source=TABLES))
def gb13_connections(spark, d):
    return G.connections(stored(spark, d))
