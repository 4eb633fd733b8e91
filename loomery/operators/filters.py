"""Predicates and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def some(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def payload(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; None asks for nothing."""
    return df.filter(every([F.col(k) == v for k, v in wanted.items() if v is not None]))


def find_nodes(nodes: DataFrame, node_type: str | None = None, domain: str | None = None, label: str | None = None, limit: int | None = None) -> DataFrame:
    out = payload(nodes, node_type=node_type, domain=domain)
    if label is not None:
        out = out.filter(F.contains(F.lower("label"), F.lit(label.lower())))
    return out.orderBy("id").limit(limit) if limit else out


def any_ilike(columns: list[str], needle: str) -> Column:
    return some([F.lower(c).contains(needle.lower()) for c in columns])


def within(df: DataFrame, column: str, frontier: DataFrame) -> DataFrame:
    """Rows whose column is among frontier's first column. (semi-join; the optimiser broadcasts it where it is small)"""
    key = frontier.columns[0]
    return df.join(frontier.select(F.col(key).alias(column)).distinct(), column, "left_semi")


STUBS = ["todo", "tbd", "n/a", "none", "null", "placeholder", "test", "stub"]


def content_ok(text: Column, least: int = 50, alnum: float = 0.2, stubs: list[str] = STUBS) -> Column:
    """At least `least` trimmed characters, that share of ASCII letters and digits, and not stub words alone."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    return (F.length(F.trim(text)) >= least) & (F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) / F.length(text) >= alnum) & ~F.forall(words, lambda w: w.isin(stubs))


def ingestible(df: DataFrame, text: str, trust: str, kind: str, spare: list[str], name: Column) -> DataFrame:
    """Rows of trust 0.1 or more with ten characters or more; shorter ones of a spared kind get a body made of their name."""
    short = F.length(F.coalesce(F.trim(text), F.lit(""))) < 10
    return df.filter(F.col(trust) >= 0.1).filter(~short | F.col(kind).isin(spare)).withColumn(text, F.when(short, F.concat(F.col(kind), F.lit(": "), name)).otherwise(F.col(text)))


def rejected(feedback: Column, confidence: Column) -> Column:
    return F.coalesce((feedback <= 2) | ((confidence <= 0.4) & feedback.isNull()), F.lit(False))


def filtered_then_fallback(hits: DataFrame, query: str, item: str, rank: str, keep: Column, least: int = 3) -> DataFrame:
    """Hits that pass keep; for queries with fewer than `least` of them the other hits follow in order."""
    x = hits.withColumn("own", F.coalesce(keep, F.lit(False)))
    n = F.sum(F.col("own").cast("int")).over(Window.partitionBy(query))
    x = x.withColumn("n", n).filter(F.col("own") | (F.col("n") < least))
    return x.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("own"), rank, item))).select(query, item, "position", F.col("own").alias("filtered"))


def overlap_share(words: Column, other: Column) -> Column:
    """Share of the distinct words of `other` that occur in words."""
    return F.when(F.size(other) > 0, F.size(F.array_intersect(words, other)) / F.size(F.array_distinct(other))).otherwise(0.0)


def expire(df: DataFrame, approved: str, at: str, cutoff: str) -> DataFrame:
    """state: pending rows older than the cutoff are expired."""
    return df.withColumn("state", F.when(F.col(approved).isNull() & (F.col(at) < F.expr(cutoff)), "expired").when(F.col(approved).isNull(), "pending").when(F.col(approved), "approved").otherwise("denied"))


def for_role(df: DataFrame, role: str, roles: str = "roles", permissions: str = "permissions") -> DataFrame:
    return df.filter(F.array_contains(roles, role) | F.coalesce(F.map_contains_key(permissions, role), F.lit(False)))
