"""Deterministic parts of routing, approval, processes, catalogues and document texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.positions import placed

RISK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
ROLE = {"viewer": 0, "agent": 1, "support": 2, "supervisor": 3, "admin": 4}


@dataclass
class Registry:
    """Named column or table functions of one kind: guards, strategies, embedding backends, event handlers, callbacks."""

    own: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, f: Callable) -> None:
        if name in self.own:
            raise ValueError(f"{name} is registered")
        self.own[name] = f

    def guards(self, text: Column) -> Column:
        """First name whose condition holds, else ALLOW."""
        return F.coalesce(*[F.when(f(text), name) for name, f in self.own.items()], F.lit("ALLOW"))

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(lambda x, f: f(x), self.own.values(), df)


def scoped(hits: DataFrame, query: str, item: str, score: str, scope: Column, limit: int) -> DataFrame:
    """Scoped hits first; the others only where a query has fewer than `limit`; each item once; by score."""
    x = hits.withColumn("_s", scope.cast("int"))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(query, item).orderBy(F.desc("_s"), F.desc(score)))).filter("_n = 1")
    x = x.withColumn("_have", F.sum("_s").over(Window.partitionBy(query))).filter((F.col("_s") == 1) | (F.col("_have") < limit))
    return x.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))).filter(F.col("position") <= limit).drop("_s", "_n", "_have")


def extract(hits: DataFrame, query: str, score: str, item: str, text: str) -> DataFrame:
    """Top hit of each query, its score as confidence, and the first number of four digits or more."""
    x = hits.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))).filter("_n = 1")
    return x.select(query, item, F.col(score).alias("confidence"), F.nullif(F.regexp_extract(text, r"(\d{4,})", 1), F.lit("")).alias("entity_id"))


def tool_for(df: DataFrame, key: str, intent: str, entity: str, catalogue: DataFrame, tried: DataFrame) -> DataFrame:
    """First of intent_entity, intent, search_entity, fallback_intent that the catalogue has and that was not tried."""
    names = F.array(F.concat_ws("_", intent, entity), F.col(intent), F.concat(F.lit("search_"), entity), F.concat(F.lit("fallback_"), intent))
    x = df.select(key, F.posexplode(names).alias("pos", "tool")).join(catalogue.select("tool"), "tool", "left_semi").join(tried.select(key, "tool"), [key, "tool"], "left_anti")
    return x.groupBy(key).agg(F.min_by("tool", "pos").alias("tool"))


def evaluation(df: DataFrame, key: str, success: Column) -> DataFrame:
    x = df.groupBy(key).agg(F.round(F.avg(success.cast("double")), 6).alias("rate"), F.count("*").alias("steps"))
    r = F.col("rate")
    return x.withColumn("verdict", F.when(r >= 0.8, "complete").when(r >= 0.5, "partial").when(r >= 0.3, "weak").otherwise("failed"))


def approval(role: Column, risk: Column) -> Column:
    """auto where the role's level reaches the risk's, never for agents."""
    level = lambda m, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), c), F.lit(99 if m is RISK else 0))
    return F.when(role == "agent", "manual").when(level(ROLE, role) >= level(RISK, risk), "auto").otherwise("manual")


def process_position(df: DataFrame, key: str, step: str, steps: DataFrame) -> DataFrame:
    """key, k, of, percent, next, previous for steps(step, k)."""
    n = Window.orderBy("k")
    known = steps.withColumns({"of": F.count("*").over(Window.partitionBy()), "next": F.lead("step").over(n), "previous": F.lag("step").over(n)})
    x = df.select(key, F.col(step).alias("step")).join(known, "step", "left")
    return x.select(key, "k", F.round(100.0 * F.col("k") / F.col("of"), 2).alias("percent"), "next", "previous")


def remaining_days(text: Column) -> Column:
    """N days, or the middle of a-b hours in days."""
    days, low, high = (F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("double") for p, g in ((r"(\d+)\s*days?", 1), (r"(\d+)\s*-\s*(\d+)\s*hours?", 1), (r"(\d+)\s*-\s*(\d+)\s*hours?", 2)))
    return F.coalesce(days, F.round((low + high) / 2 / 24, 4))


def trigger_route(text: Column, agents: dict[str, list[str]]) -> Column:
    """The agent with most triggers in the text (first of equals), null if none has one."""
    n = {a: sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in ts), F.lit(0)) for a, ts in agents.items()}
    top = F.greatest(*n.values(), F.lit(0))
    return F.coalesce(*[F.when((c == top) & (top > 0), a) for a, c in n.items()])


def wave_consensus(df: DataFrame, keys: list[str], error: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(~error).alias("successes"), F.count_if(error).alias("errors"), (F.count_if(error) == 0).alias("consensus"))


def tier(confidence: Column, similar: Column) -> Column:
    return F.when(confidence >= 0.75, 1).when((confidence >= 0.5) | (similar > 0.3), 2).otherwise(3)


def echo(output: Column, source: Column, size: int = 50) -> Column:
    """The output repeats a tag, or the first `size` characters of the source."""
    return output.rlike("</?(trusted|untrusted)>") | ((F.length(source) >= size) & F.contains(output, F.substring(source, 1, size)))


def jobs(df: DataFrame, job: str, at: list[str], status: str) -> DataFrame:
    return df.groupBy(job).agg(F.max_by(status, F.struct(*at)).alias(status), F.count("*").alias("changes"))


def cascade(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return children.join(removed.select(key).distinct(), key, "left_anti")


def kb_paths(changes: DataFrame, path: str, folder: str) -> DataFrame:
    x = changes.filter(F.col(path).endswith(".yaml") & F.contains(path, F.lit(f"{folder}/")))
    return x.withColumn("relative", F.substring_index(path, f"{folder}/", -1))


def appended(base: DataFrame, extra: DataFrame, key: str, text: str) -> DataFrame:
    """text with the corrections of its key behind it, in order."""
    more = extra.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("correction")), " ").alias("_m"))
    return base.join(more, key, "left").select(key, F.concat_ws(" ", text, "_m").alias(text))


def graph_rules(documents: DataFrame, key: str, prefix: str, rules: list[tuple[str, str, Column, Column | None]]) -> DataFrame:
    """Edges by rule: (edge type, target prefix, array of targets, role or null)."""
    parts = [documents.select(F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("source_id"), F.explode(a).alias("t"), (role if role is not None else F.lit(None).cast("string")).alias("role")).select("source_id", F.concat(F.lit(f"{target}:"), "t").alias("target_id"), F.lit(kind).alias("edge_type"), "role") for kind, target, a, role in rules]
    return reduce(DataFrame.unionByName, parts)


def lookups(nodes: DataFrame, entity_type: str, values: Column, node: str) -> DataFrame:
    """(entity_type, entity_value, node_id); the last segment of a dotted name is a value too."""
    every = F.array_distinct(F.flatten(F.transform(values, lambda v: F.array(v, F.element_at(F.split(v, r"\."), -1)))))
    return nodes.select(F.lit(entity_type).alias("entity_type"), F.explode(every).alias("entity_value"), F.col(node).alias("node_id")).distinct()


def table_text(name: Column, columns: Column, transitions: Column, most: int = 30, shown: int = 10) -> Column:
    """Header, the first columns as name (type), the first transitions and how many more there are."""
    listed = F.array_join(F.transform(F.slice(columns, 1, most), lambda c: F.concat(c["name"], F.lit(" ("), c["type"], F.lit(")"))), ", ")
    more = F.when(F.size(transitions) > shown, F.concat(F.lit(" (+"), (F.size(transitions) - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.lit("Table: "), name, F.lit(" | Columns: "), listed, F.when(F.size(transitions) > 0, F.concat(F.lit(" | Transitions: "), F.array_join(F.slice(transitions, 1, shown), ", "), more)).otherwise(""))


def bundled(df: DataFrame, keys: list[str], order: str, text: str, n: int = 10) -> DataFrame:
    """keys, chunk, body: n texts a chunk, joined by ---; the chunk number is part of the key."""
    x = placed(df, keys, [F.col(order)], "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / n))
    return x.groupBy(*keys, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n---\n").alias("body"))


def faq_text(question: Column, answer: Column, keywords: Column, domain: Column) -> Column:
    """Null where question or answer is empty."""
    ok = (F.trim(question) != "") & (F.trim(answer) != "")
    return F.when(ok, F.concat_ws("\n", F.concat(F.lit("Q: "), question), F.concat(F.lit("A: "), answer), F.concat(F.lit("Keywords: "), F.when(F.size(keywords) > 0, F.array_join(keywords, ", ")).otherwise(domain))))


def tool_calls(requests: DataFrame, tools: DataFrame) -> DataFrame:
    """requests(id, role, tool, params map) with a verdict against the catalogue tools(tool, roles, required): unknown, denied,
    invalid (with the parameters it lacks) or ok. A tool without roles is open to all."""
    x = requests.join(tools, "tool", "left")
    lacks = F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda p: F.coalesce(F.element_at("params", p), F.lit("")) == "")
    denied = (F.size("roles") > 0) & ~F.array_contains("roles", F.col("role"))
    verdict = F.when(F.col("required").isNull(), "unknown").when(denied, "denied").when(F.size(lacks) > 0, "invalid").otherwise("ok")
    return x.select("id", "tool", verdict.alias("verdict"), F.when(verdict == "invalid", F.array_join(lacks, ",")).alias("lacking"))


def strategies(queries: DataFrame, registry: Registry, key: str = "id") -> DataFrame:
    """key, strategy, confidence: of the registered strategies (queries to key, confidence) the surest, by name if equal."""
    parts = [f(queries).select(key, "confidence", F.lit(name).alias("strategy")) for name, f in registry.own.items()]
    best = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "strategy")).alias("b"))
    return best.select(key, "b.strategy", (-F.col("b.c")).alias("confidence"))


def field_traces(traces: DataFrame, query: str, field: str, order: str, each: int = 3, enough: int = 10) -> DataFrame:
    """At most `each` traces of a field; fields are taken in order until a query has `enough`."""
    own = traces.withColumn("_n", F.row_number().over(Window.partitionBy(query, field).orderBy(order))).filter(F.col("_n") <= each)
    size = own.groupBy(query, field).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(query).orderBy(field).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = size.withColumn("_before", before).filter(F.col("_before") < enough).select(query, field)
    return own.join(taken, [query, field]).drop("_n")


def attributed(chunks: Column, most: int = 8, size: int = 400) -> Column:
    """Context of the first chunks, array<struct<source, pillar, trust, content>>, each under a line that names its source."""
    head = lambda c, i: F.format_string("[Source %d: %s | Pillar: %s | Trust: %.1f]\n", (i + 1).cast("int"), c["source"], c["pillar"], c["trust"])
    return F.array_join(F.transform(F.slice(chunks, 1, most), lambda c, i: F.concat(head(c, i), F.substring(F.coalesce(c["content"], F.lit("")), 1, size))), "\n")


def update_history(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """One row of what an update changed: added, modified, removed, same."""
    x = old.select(key, F.col(digest).alias("_a")).join(new.select(key, F.col(digest).alias("_b")), key, "full")
    a, b = F.col("_a"), F.col("_b")
    return x.agg(F.count_if(a.isNull()).alias("added"), F.count_if(a != b).alias("modified"), F.count_if(b.isNull()).alias("removed"), F.count_if(a == b).alias("same"))


def history(versions: DataFrame, version: str, key: str, digest: str, last: int = 10) -> DataFrame:
    """version, added, modified, removed, same of the last updates, one row a version, against the version before it (numbers that
    follow each other). Each row meets itself one version later, so all updates are compared at once."""
    now = versions.select(F.col(version).alias("version"), key, F.col(digest).alias("_b"))
    top = now.agg(F.max("version").alias("_top"))  # one row
    before = now.select((F.col("version") + 1).alias("version"), key, F.col("_b").alias("_a")).join(F.broadcast(top), F.col("version") <= F.col("_top")).drop("_top")
    a, b = F.col("_a"), F.col("_b")
    x = now.join(before, ["version", key], "full").groupBy("version").agg(F.count_if(a.isNull()).alias("added"), F.count_if(a != b).alias("modified"), F.count_if(b.isNull()).alias("removed"), F.count_if(a == b).alias("same"))
    return x.join(F.broadcast(top), F.col("version") > F.col("_top") - last).drop("_top")


def lanes(df: DataFrame, lane: str, rank: str, latency: str, base: str) -> DataFrame:
    """lane, mrr, latency_ms and the lift of each lane over the base lane; a null rank is a miss."""
    x = df.groupBy(lane).agg(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"), F.avg(latency).alias("latency_ms"))
    of = x.filter(F.col(lane) == base).select(F.col("mrr").alias("_mrr"), F.col("latency_ms").alias("_ms"))  # one row
    return x.join(F.broadcast(of)).select(lane, F.round("mrr", 6).alias("mrr"), F.round("latency_ms", 4).alias("latency_ms"), F.round(F.col("mrr") - F.col("_mrr"), 6).alias("mrr_lift"), F.round(F.col("latency_ms") - F.col("_ms"), 4).alias("latency_lift"))
