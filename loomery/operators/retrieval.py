"""Hybrid retrieval for whole batches of queries: five legs, fusion, boosts and a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import words
from loomery.operators import lexical as index
from loomery.operators.joins import contains_text
from loomery.operators.ranking import LEG_WEIGHTS, budget_prefix, fuse
from loomery.session import forget, materialize, written

#: legs by name; a caller may add its own: (queries, documents, edges, k) -> query_id, node_id, rank
LEGS: dict[str, Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]] = {}
#: legs that start from the documents with most of a query's words; within one retrieval they share them as `best`
SEEDED = {"lexical", "pagerank", "neighbourhood"}
SEEDS = 3


def leg(name: str):
    def register(f):
        LEGS[name] = f
        return f

    return register


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "node_id", "rank")


@leg("exact")
def exact(queries: DataFrame, documents: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Documents whose text holds the query whole."""
    found = contains_text(documents.select(F.col("id").alias("node_id"), "text"), "text", queries.select("query_id", F.col("query").alias("needle")), "needle")
    return ranked(found.select("query_id", "node_id", F.lit(1.0).alias("score")).distinct(), k)


def overlap(queries: DataFrame, documents: DataFrame, k: int, indexed: bool = False) -> DataFrame:
    """query_id, node_id, rank: the documents with the largest share of a query's words. Words meet by equi-join, or, `indexed`, by an inverted
    index that reads no more of its lists than the k-th share asks for: worth its building for lists much longer than k."""
    tokens = lambda df, key, text: df.select(F.col(key), words(F.col(text)).alias("tokens"))
    if indexed:
        asked = index.overlap_queries(tokens(queries, "query_id", "query"), "query_id")
        found = index.Search(index.overlap_index(tokens(documents, "id", "text"), "id"), asked, k, digits=9).found
        return written(found.select(F.col("query").alias("query_id"), F.col("item").alias("node_id"), "rank"))
    q = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    d = documents.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("t"))
    return written(ranked(d.join(q, "t").groupBy("query_id", "node_id").agg((F.count("*") / F.first("n")).alias("score")), k))


@leg("lexical")
def lexical(queries: DataFrame, documents: DataFrame, edges: DataFrame, k: int, best: DataFrame | None = None) -> DataFrame:
    best = overlap(queries, documents, k) if best is None else best
    return best.filter(F.col("rank") <= k)


@leg("vector")
def vector(queries: DataFrame, documents: DataFrame, edges: DataFrame, k: int, dim: int = 4096) -> DataFrame:
    """Cosine of hashed term vectors, as a sparse join on slots."""

    def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
        n = df.select(F.col(key).alias("k"), F.explode(words(F.col(text))).alias("t")).groupBy("k", F.pmod(F.xxhash64("t"), F.lit(dim)).alias("slot")).agg(F.count("*").alias("n"))
        return n.withColumn("w", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("k"))))

    a = hashed(queries, "query_id", "query").select(F.col("k").alias("query_id"), "slot", "w")
    b = hashed(documents, "id", "text").select(F.col("k").alias("node_id"), "slot", F.col("w").alias("v"))
    return ranked(b.join(a, "slot").groupBy("query_id", "node_id").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("score")), k)


def seeds(queries: DataFrame, documents: DataFrame, n: int = SEEDS, best: DataFrame | None = None) -> DataFrame:
    best = overlap(queries, documents, n) if best is None else best
    return best.filter(F.col("rank") <= n).select("query_id", "node_id")


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight").unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "weight"))


def spread(start: DataFrame, edges: DataFrame, rounds: int, damping: float, keep: int | None = None) -> DataFrame:
    """query_id, node_id, score: personalised walks of all queries at once, one row a query and node reached. Only where a
    caller states `keep`, a query keeps its heaviest nodes after each round, and the scores are no longer those of the walk."""
    links = _links(edges)
    links = materialize(links.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("a"))).select("a", "b", "share"))
    jump = start.withColumn("jump", 1.0 / F.count("*").over(Window.partitionBy("query_id")))
    rank = jump.select("query_id", "node_id", F.col("jump").alias("score"))
    for _ in range(rounds):
        flow = rank.join(links, F.col("node_id") == F.col("a")).groupBy("query_id", F.col("b").alias("node_id")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        new = flow.join(jump, ["query_id", "node_id"], "full").select("query_id", "node_id", (damping * F.coalesce("in", F.lit(0.0)) + (1 - damping) * F.coalesce("jump", F.lit(0.0))).alias("score"))
        if keep is not None:
            best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
            new = new.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).drop("_n")
        rank = materialize(new)
    return rank


def push(start: DataFrame, edges: DataFrame, damping: float = 0.15, least: float = 1e-5) -> DataFrame:
    """query_id, node_id, score: the walk of `spread` without an end, from below and within least x degree of a node of it (degree: the sum
    of its weights, links going both ways).

    Each query's mass lies where it is not yet dealt on. A node deals its mass only where that is at least least x its degree, so a
    hub that gets little is one row, whatever its number of links, and a query has some 1 / (least (1 - damping)) rows at most. Rounds
    end when no node may deal.
    """
    links = _links(edges).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    links = links.withColumn("degree", F.sum("weight").over(Window.partitionBy("a")))
    degrees = links.groupBy(F.col("a").alias("b")).agg(F.first("degree").alias("far"))
    links = written(links.join(degrees, "b").select("a", "b", (F.col("weight") / F.col("degree")).alias("share"), "far"))
    known = links.groupBy(F.col("b").alias("node_id")).agg(F.first("far").alias("degree"))
    own = start.withColumn("mass", 1.0 / F.count("*").over(Window.partitionBy("query_id"))).join(known, "node_id", "left")
    state = written(own.select("query_id", "node_id", F.lit(0.0).alias("score"), "mass", "degree"))
    # a node without links keeps what it has: nothing leads on, as in `spread`
    deals = (F.col("mass") > 0) & (F.col("degree").isNull() | (F.col("mass") >= least * F.col("degree")))
    while not state.filter(deals).isEmpty():
        front = state.filter(deals).select("query_id", F.col("node_id").alias("a"), "mass")
        flow = front.join(links, "a").groupBy("query_id", F.col("b").alias("node_id")).agg(F.sum(damping * F.col("mass") * F.col("share")).alias("in"), F.first("far").alias("far"))
        x = state.join(flow, ["query_id", "node_id"], "full")
        had, score = F.coalesce("mass", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
        dealt = F.coalesce(deals, F.lit(False))
        left = F.when(dealt, 0.0).otherwise(had) + F.coalesce("in", F.lit(0.0))
        gained = score + F.when(dealt, (1 - damping) * had).otherwise(0.0)
        before, state = state, written(x.select("query_id", "node_id", gained.alias("score"), left.alias("mass"), F.coalesce("degree", "far").alias("degree")))
        forget(before)
    # what lies at a node counts at least for the share with which the walk ends there
    score = F.col("score") + (1 - damping) * F.col("mass")
    return state.select("query_id", "node_id", score.alias("score")).filter("score > 0")


@leg("pagerank")
def pagerank(queries: DataFrame, documents: DataFrame, edges: DataFrame, k: int, damping: float = 0.15, least: float = 1e-5, best: DataFrame | None = None) -> DataFrame:
    start = materialize(seeds(queries, documents, best=best))
    walked = push(start, edges, damping, least).join(start, ["query_id", "node_id"], "left_anti")
    return ranked(walked.join(documents.select(F.col("id").alias("node_id")), "node_id", "left_semi"), k)


@leg("neighbourhood")
def neighbourhood(queries: DataFrame, documents: DataFrame, edges: DataFrame, k: int, best: DataFrame | None = None) -> DataFrame:
    """Documents two links from the seeds, those with most ways first."""
    start, links = seeds(queries, documents, best=best), _links(edges)
    one = start.join(links, F.col("node_id") == F.col("a")).select("query_id", F.col("b").alias("m")).distinct()
    two = one.join(links, F.col("m") == F.col("a")).groupBy("query_id", F.col("b").alias("node_id")).agg(F.count("*").alias("score"))
    return ranked(two.join(documents.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(start, ["query_id", "node_id"], "left_anti"), k)


def retrieve(queries: DataFrame, documents: DataFrame, edges: DataFrame, k: int = 10, legs: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """query_id, node_id, score, legs, position (and used tokens, within the budget) for queries(query_id, query),
    documents(id, text) and edges(source_id, target_id, weight)."""
    names, long = list(legs or LEG_WEIGHTS), None
    best = overlap(queries, documents, max(k, SEEDS)) if SEEDED & set(names) else None
    for name in names:
        more = {"best": best} if name in SEEDED else {}
        part = LEGS[name](queries, documents, edges, k, **more).select("query_id", F.lit(name).alias("leg"), "node_id", "rank")
        long = part if long is None else long.unionByName(part)
    out = fuse(long, k)
    if budget is None:
        return out
    sized = out.join(documents.select(F.col("id").alias("node_id"), F.floor(F.length("text") / 4).alias("tokens")), "node_id")
    return budget_prefix(sized, "query_id", [F.col("position")], F.col("tokens"), budget)
