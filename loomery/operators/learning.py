"""Feedback, caching and policy operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import entities
from loomery.functions.values import date_range
from loomery.operators.folds import clamped


def auto_actions(confidence: Column, tools: Column, feedback: Column) -> Column:
    """Actions a trace asks for: add knowledge (< .5), clarify (.5 to .65), fix routing (no tool), review (rated 2 or less)."""
    found = F.array(F.when(confidence < 0.5, "add_knowledge"), F.when((confidence >= 0.5) & (confidence < 0.65), "clarify"), F.when(tools == 0, "fix_routing"), F.when(feedback <= 2, "review"))
    return F.filter(found, lambda x: x.isNotNull())


def routed(df: DataFrame, actions: str, item: str, most: int = 50) -> DataFrame:
    """action, n, items: how many rows ask for each action, and the first `most` of them."""
    x = df.select(item, F.explode(actions).alias("action"))
    n = x.groupBy("action").agg(F.count("*").alias("n"))
    first = x.withColumn("rn", F.row_number().over(Window.partitionBy("action").orderBy(item))).filter(F.col("rn") <= most)
    return n.join(first.groupBy("action").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items")), "action")


#: fixed values: hundredths of trust that praise adds and blame takes, and under which trust a blamed key is of low quality
PRAISE, BLAME, LOW = 2, 5, 20


def trust(df: DataFrame, key: str, order: list[str], positive: Column, start: float = 0.5) -> DataFrame:
    """key, trust, low_quality after the key's feedback in order: -.05 not below 0 (flag under .2), +.02 not above 1 (clears).

    Clamping makes order matter; steps are counted in hundredths, so the result is exact and the same however rows are dealt.
    """
    add = F.when(positive, PRAISE).otherwise(-BLAME)
    got = clamped(df, key, order, add, F.lit(0), F.lit(100), 100 * start)
    return got.select(key, (F.col("value") / 100).alias("trust"), ((F.col("last") < 0) & (F.col("value") < LOW)).alias("low_quality"))


def weakest(df: DataFrame, keys: list[str], confidence: str, below: float, per: int, tie: str) -> DataFrame:
    return df.filter(F.col(confidence) < below).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(confidence, tie))).filter(F.col("position") <= per)


def fresh_proposals(new: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    return new.dropDuplicates(keys).join(pending.select(*keys), keys, "left_anti")


def insights(df: DataFrame, query: str, tool: str, confidence: str) -> DataFrame:
    """query, insight: tools disagree; the best is sure (.85), unsure (.5) or good enough as an example (.9)."""
    x = df.groupBy(query).agg(F.countDistinct(tool).alias("tools"), F.max(confidence).alias("best"))
    kinds = F.array(F.when(F.col("tools") > 1, "disagreement"), F.when(F.col("best") >= 0.85, "tree_sufficient"), F.when(F.col("best") < 0.5, "gap"), F.when(F.col("best") >= 0.9, "few_shot"))
    return x.select(query, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("insight"))


def cached(queries: DataFrame, exact: DataFrame, by_intent: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """key, level, answer: the first of exact text, intent and entity, and nearest neighbour that has an answer.

    exact: (key, a1), by_intent: (key, a2), similar: (key, a3), one row a key each.
    """
    x = queries.select(key).join(exact, key, "left").join(by_intent, key, "left").join(similar, key, "left")
    level = F.when(F.col("a1").isNotNull(), "exact").when(F.col("a2").isNotNull(), "intent").when(F.col("a3").isNotNull(), "similar").otherwise("miss")
    return x.select(key, level.alias("level"), F.coalesce("a1", "a2", "a3").alias("answer"))


def second_wave(df: DataFrame, query: str, confidence: str, tool: Column) -> DataFrame:
    """query, skip: the first wave was sure (.75) and used a tool."""
    return df.groupBy(query).agg(((F.max(confidence) >= 0.75) & (F.max(tool.cast("int")) == 1)).alias("skip"))


def clarification(confidence: Column, entity: Column, params: Column) -> Column:
    return F.when(entity.isNull(), "which_entity").when(params > 0, "which_param").when(confidence < 0.3, "refuse").when(confidence < 0.6, "uncertain").otherwise("confident")


def drift(new: DataFrame, old: DataFrame, key: str, drop: float = 0.1) -> DataFrame:
    """key, before, after, drifted: groups that lost more than `drop` of their rows."""
    a, b = old.groupBy(key).agg(F.count("*").alias("before")), new.groupBy(key).agg(F.count("*").alias("after"))
    x = a.join(b, key, "full").fillna(0, ["before", "after"])
    return x.withColumn("drifted", (F.col("before") > 0) & ((F.col("before") - F.col("after")) / F.col("before") > drop))


def promotion(lift: Column, p95: Column, regressions: Column) -> Column:
    return F.when((lift >= 0.02) & (p95 <= 1.2) & (regressions == 0), "promote").when(lift < 0, "reject").otherwise("hold")


def model_for(intent: Column, complexity: Column, confidence: Column) -> Column:
    return F.when((complexity > 0.7) | (confidence < 0.4), "large").when(intent.isin("purchase", "signup"), "medium").otherwise("small")


def escalations(df: DataFrame, session: str, failed: Column, confidence: str, cost: str, intent: str) -> DataFrame:
    """session, reasons: three failures, three unsure turns, cost over 1, or one intent for more than five turns."""
    x = df.groupBy(session).agg(F.count_if(failed).alias("f"), F.count_if(F.col(confidence) < 0.4).alias("l"), F.sum(cost).alias("c"), F.countDistinct(intent).alias("i"), F.count("*").alias("n"))
    found = F.filter(F.array(F.when(F.col("f") >= 3, "failures"), F.when(F.col("l") >= 3, "low_confidence"), F.when(F.col("c") > 1, "cost"), F.when((F.col("i") == 1) & (F.col("n") > 5), "stuck")), lambda r: r.isNotNull())
    return x.select(session, F.array_join(found, ",").alias("reasons"))


def matched(queries: DataFrame, query: str, words: str, registry: DataFrame, name: str, triggers: str) -> DataFrame:
    """query, name, overlap: the registry entry with most triggers among the query's words (first by name of equals)."""
    q = queries.select(query, F.explode(F.array_distinct(words)).alias("w"))
    r = registry.select(name, F.explode(F.array_distinct(triggers)).alias("w"))
    x = q.join(r, "w").groupBy(query, name).agg(F.count("*").alias("overlap"))
    return x.withColumn("rn", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("overlap"), name))).filter("rn = 1").drop("rn")


def layer(path: Column) -> Column:
    return F.when(path.rlike("(?i)/(app|web|mobile)/"), "experience").when(path.rlike("(?i)/(orders|checkout|flow)/"), "process").otherwise("system")


def breaker(df: DataFrame, key: str, order: list[str], failed: Column, most: int = 3) -> DataFrame:
    """open: the row ends `most` failures in a row of its key. (gaps and islands)"""
    w = Window.partitionBy(key).orderBy(*order)
    x = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    return x.withColumn("streak", F.sum("_f").over(Window.partitionBy(key, "_island").orderBy(*order))).withColumn("open", F.col("streak") >= most).drop("_f", "_island")


def retry_policy(error: Column) -> Column:
    return F.when(error.rlike("(?i)timeout|503|unavailable"), "retry").when(error.rlike("(?i)rate|429"), "backoff").when(error.rlike("(?i)auth|401|403"), "abort").otherwise("report")


def spikes(df: DataFrame, key: str, day: str, factor: float = 1.5, last: int = 7) -> DataFrame:
    """key, day, n, spike: days with over `factor` times the mean of the days before."""
    n = df.groupBy(key, day).agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy(key).orderBy(day).rowsBetween(-last, -1))
    return n.withColumn("spike", F.coalesce(F.col("n") > factor * mean, F.lit(False)))


def wave_trace(df: DataFrame, query: str, wave: str, item: str, score: str) -> DataFrame:
    """query, waves: a nested record of what each wave found, in order."""
    w = df.groupBy(query, wave).agg(F.count("*").alias("hits"), F.round(F.max(score), 4).alias("best"), F.min(item).alias("first"))
    return w.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(wave, "hits", "best", "first"))).alias("waves"))


def metric_probe(text: Column, metrics: dict[str, str], today: Column) -> Column:
    """struct<metric, company, since>: the first metric a keyword of which the text holds (else none), the company it names, and the
    first day of the range it names."""
    low = F.lower(text)
    metric = F.coalesce(*[F.when(F.contains(low, F.lit(w)), m) for m, w in metrics.items()], F.lit("none"))
    return F.struct(metric.alias("metric"), entities(text)["company"].alias("company"), date_range(text, today)["first"].cast("string").alias("since"))
