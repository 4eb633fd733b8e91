"""Rules that turn documents of a knowledge base into nodes, lookups and edges; one document a row, lists in array columns. A
document may also come in several rows with a part of its lists each, for equal results are put together.

Every rule is a union of projections and explodes, so it adds no shuffle but the one that puts equal rows together.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what a rule returns. node: one is the id, two the label, kind the node type, extra the domain; lookup: one is the value, two
#: the node it stands for; edge: from one to two, extra a role or flag of the edge
COLUMNS = "what", "one", "two", "kind", "extra"


def ref(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def _row(docs: DataFrame, what: str, one: Column, two: Column, kind: str, extra: Column | None) -> DataFrame:
    extra = F.lit(None) if extra is None else extra
    return docs.select(F.lit(what).alias("what"), one.alias("one"), two.alias("two"), F.lit(kind).alias("kind"), extra.cast("string").alias("extra")).filter("one is not null and two is not null")


def node(docs: DataFrame, kind: str, key: Column, label: Column, domain: Column | None = None) -> DataFrame:
    return _row(docs, "node", ref(kind, key), label, kind, domain)


def lookup(docs: DataFrame, kind: str, value: Column, at: Column) -> DataFrame:
    return _row(docs, "lookup", value, at, kind, None)


def edge(docs: DataFrame, kind: str, start: Column, end: Column, extra: Column | None = None) -> DataFrame:
    return _row(docs, "edge", start, end, kind, extra)


def edges_to(docs: DataFrame, kind: str, start: Column, target: str, keys: Column, extra: Column | None = None) -> DataFrame:
    """An edge for each element of an array; null arrays and elements give none."""
    each = docs.select(start.alias("_start"), F.explode(keys).alias("_key"), (F.lit(None) if extra is None else extra).alias("_extra"))
    return edge(each, kind, F.col("_start"), ref(target, F.col("_key")), F.col("_extra"))


def together(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def intents(taxonomy: DataFrame) -> DataFrame:
    """From (group, names)."""
    each = taxonomy.select("group", F.explode("names").alias("name"))
    return together([node(each, "intent", F.col("name"), F.col("name"), F.col("group")), lookup(each, "intent_name", F.lower("name"), ref("intent", F.col("name")))])


def apis(docs: DataFrame) -> DataFrame:
    """From (id, path, domain)."""
    at = ref("api_endpoint", F.col("id"))
    return together([node(docs, "api_endpoint", F.col("id"), F.col("id"), F.col("domain")), lookup(docs, "api_id", F.col("id"), at), lookup(docs, "api_path", F.col("path"), at)])


def api_links(docs: DataFrame) -> DataFrame:
    """From (id, domain, tools, owner, agents, intent, intents): what an endpoint belongs to, and the tools it implements."""
    at = ref("api_endpoint", F.col("id"))
    tools = docs.select(F.explode("tools").alias("tool"))
    return together([
        edge(docs, "belongs_to_domain", at, ref("domain", F.col("domain"))),
        edges_to(docs, "implements_tool", at, "tool", F.col("tools")),
        lookup(tools, "tool_name", F.col("tool"), ref("tool", F.col("tool"))),
        edge(docs, "assigned_to_agent", at, ref("agent", F.col("owner")), F.lit("owner")),
        edges_to(docs, "assigned_to_agent", at, "agent", F.col("agents"), F.lit("secondary")),
        edge(docs, "has_intent", at, ref("intent", F.col("intent")), F.lit("primary")),
        edges_to(docs, "has_intent", at, "intent", F.col("intents"), F.lit("secondary")),
    ])


def api_tables(docs: DataFrame) -> DataFrame:
    """From (id, tables: array of (name, role)): writes_table where the role is write, else reads_table; the role is kept."""
    each = docs.select(ref("api_endpoint", F.col("id")).alias("at"), F.explode("tables").alias("t"))
    writes = F.coalesce(F.col("t.role") == "write", F.lit(False))
    end = ref("table", F.col("t.name"))
    return together([edge(each.filter(writes), "writes_table", F.col("at"), end, F.col("t.role")), edge(each.filter(~writes), "reads_table", F.col("at"), end, F.col("t.role"))])


def api_access(docs: DataFrame) -> DataFrame:
    """From (id, roles, params, pages): roles an endpoint asks for, lookups by parameter, pages that call it."""
    at = ref("api_endpoint", F.col("id"))
    params = docs.select(at.alias("at"), F.explode("params").alias("p"))
    pages = docs.select(at.alias("at"), F.explode("pages").alias("p"))
    return together([edges_to(docs, "requires_role", at, "role", F.col("roles")), lookup(params, "param", F.concat(F.lit("param:"), "p"), F.col("at")), edge(pages, "has_action", ref("page", F.col("p")), F.col("at"), F.lit("panel_usage"))])


def api_fields(docs: DataFrame) -> DataFrame:
    """From (id, fields: array of (name, required)): a field node for each parameter of an endpoint."""
    each = docs.select("id", F.explode("fields").alias("f")).withColumn("key", F.concat_ws(".", "id", "f.name")).filter("f.name is not null")
    at = ref("schema_field", F.col("key"))
    return together([node(each, "schema_field", F.col("key"), F.col("key")), edge(each, "has_field", ref("api_endpoint", F.col("id")), at, F.coalesce("f.required", F.lit(False))), lookup(each, "field", F.concat(F.lit("field:"), "f.name"), at)])


def tables(docs: DataFrame) -> DataFrame:
    """From (name, canonical, domain): tables by both names, and their domain."""
    at = ref("table", F.col("name"))
    return together([
        node(docs, "table", F.col("name"), F.col("name"), F.col("domain")),
        lookup(docs, "table_name", F.col("name"), at),
        lookup(docs, "table_name", F.col("canonical"), at),
        edge(docs, "belongs_to_domain", at, ref("domain", F.col("domain"))),
    ])


def connections(docs: DataFrame) -> DataFrame:
    """From (name, connection): a module for each database connection, and an edge from each table that uses it."""
    return together([node(docs, "module", F.col("connection"), F.col("connection")), edge(docs, "uses_connection", ref("table", F.col("name")), ref("module", F.col("connection")))])


def modules(docs: DataFrame) -> DataFrame:
    """From (name, domain, tables, apis)."""
    at = ref("module", F.col("name"))
    return together([node(docs, "module", F.col("name"), F.col("name"), F.col("domain")), edge(docs, "belongs_to_domain", at, ref("domain", F.col("domain"))), edges_to(docs, "reads_table", at, "table", F.col("tables")), edges_to(docs, "has_api", at, "api_endpoint", F.col("apis"))])


def pages(docs: DataFrame) -> DataFrame:
    """From (id, route, roles, apis)."""
    at = ref("page", F.col("id"))
    return together([node(docs, "page", F.col("id"), F.col("route")), lookup(docs, "page_route", F.col("route"), at), lookup(docs, "page_id", F.col("id").cast("string"), at), edges_to(docs, "requires_role", at, "role", F.col("roles")), edges_to(docs, "has_action", at, "api_endpoint", F.col("apis"))])


def actions(docs: DataFrame, workflows: DataFrame) -> DataFrame:
    """From actions (id, tables, apis, jobs) and workflows (id, actions, tables); both are found by the last part of a dotted id."""
    at, flow = ref("action", F.col("id")), ref("workflow", F.col("id"))
    short = lambda: F.element_at(F.split("id", r"\."), -1)
    return together([
        lookup(docs, "action_name", short(), at),
        edges_to(docs, "reads_table", at, "table", F.col("tables")),
        edges_to(docs, "calls_api", at, "api_endpoint", F.col("apis")),
        edges_to(docs, "dispatches_job", at, "job", F.col("jobs")),
        lookup(workflows, "workflow_name", short(), flow),
        edges_to(workflows, "uses_action", flow, "action", F.col("actions")),
        edges_to(workflows, "reads_table", flow, "table", F.col("tables")),
    ])


def agents(docs: DataFrame, skills: DataFrame, topics: DataFrame, covers: dict[str, list[str]]) -> DataFrame:
    """From agents (name, skills), skills (name, tools), topics (id, domain) and which agents cover a domain: a few entries, part
    of the plan as a map, so that topics are not shuffled."""
    cover = F.create_map(*[x for k, v in covers.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = topics.select("id", F.explode(cover[F.col("domain")]).alias("agent"))
    return together([edges_to(docs, "has_skill", ref("agent", F.col("name")), "skill", F.col("skills")), edges_to(skills, "uses_tool", ref("skill", F.col("name")), "tool", F.col("tools")), edge(asked, "covers_topic", ref("agent", F.col("agent")), ref("topic", F.col("id")))])
