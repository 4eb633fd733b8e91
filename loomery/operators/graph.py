"""Property-graph operators over nodes(id, ..) and edges(source_id, target_id, edge_type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import forget, written


def strengthen(edges: DataFrame, mode: str = "step") -> DataFrame:
    """One edge for each (source, target, type). step: 1 + 0.1 a repeat; sum: 1 a repeat; last: 1."""
    n = F.count("*")
    weight = {"step": F.round(1.0 + 0.1 * (n - 1), 4), "sum": n.cast("double"), "last": F.lit(1.0)}[mode]
    return edges.groupBy("source_id", "target_id", "edge_type").agg(weight.alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight").unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "weight"))


def hops(edges: DataFrame, seeds: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """id, depth of every node within `most` hops; each round joins the newest nodes only and leaves out what was seen.

    Links and rounds are tables, so their sizes are known: a small front is broadcast and the links are only scanned.
    """
    links = written(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")) if directed else both_ways(edges).select("a", "b"))
    seen = written(seeds.select(F.col(seeds.columns[0]).alias("id"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, most + 1):
        reached = links.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        front = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, source: str, most: int = 6, weighted: bool = False, directed: bool = True) -> DataFrame:
    """id, cost, hops, path from one node: rounds of relaxation that extend improved nodes only (hops, or summed weights)."""
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight") if directed else both_ways(edges)
    links = written(links.groupBy("a", "b").agg(F.min("weight").alias("weight")) if weighted else links.select("a", "b", F.lit(1.0).alias("weight")))
    spark = edges.sparkSession
    best = written(spark.createDataFrame([(source, 0.0, 0, source)], "id string, cost double, hops int, path string"))
    for done in range(most):
        # a node improved in round r by a path of r edges, so the newest nodes are those whose best path is that long
        front = best.filter(F.col("hops") == done)
        if front.isEmpty():
            break
        step = front.join(links, front["id"] == links["a"]).select(F.col("b").alias("id"), F.round(F.col("cost") + F.col("weight"), 6).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat_ws(">", "path", "b").alias("path"))
        before, best = best, written(best.unionByName(step).groupBy("id").agg(F.min(F.struct("cost", "hops", "path")).alias("n")).select("id", "n.*"))
        forget(before)
    return best


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.15, rounds: int = 50, tolerance: float = 1e-6, fixed: bool = False, per_node: bool = False) -> DataFrame:
    """id, score of the personalised walk. damping: chance to follow a link (0.15: 85% of the steps go back to the seeds); rank
    moves along edges by weight, nodes without outgoing edges give theirs to the seeds.

    A round is two joins, a written table and one aggregation over it; nodes that have no rank yet send nothing. The walk stops
    once all scores together move by less than `tolerance`, whatever the number of nodes; per_node: by less than `tolerance` a
    node, which from some million nodes on is met at once. fixed: run all rounds.
    """
    own = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct()
    n_seeds, n = own.count(), nodes.count() if per_node else 0
    if not n_seeds:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    out = edges.groupBy("source_id", "target_id").agg(F.sum("weight").alias("w"))
    out = written(out.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("source_id"))).select("source_id", "target_id", "share"))
    leads = out.select(F.col("source_id").alias("id"), F.lit(True).alias("leads")).distinct()
    state = nodes.select("id").join(own.withColumn("jump", F.lit(1.0 / n_seeds)), "id", "left").fillna(0.0, ["jump"]).join(leads, "id", "left")
    state = written(state.select("id", "jump", "leads", F.col("jump").alias("score"), F.lit(0.0).alias("moved")))
    for done in range(rounds):
        moved, lost = state.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("leads").isNull(), F.col("score"))), F.lit(0.0))).first()
        if done and not fixed and moved < (n * tolerance if per_node else tolerance):
            break
        flow = state.filter("score > 0").select(F.col("id").alias("source_id"), "score").join(out, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        score = (1 - damping) * F.col("jump") + damping * (F.coalesce("in", F.lit(0.0)) + lost * F.col("jump"))
        before, state = state, written(state.join(flow, "id", "left").select("id", "jump", "leads", score.alias("score"), F.abs(score - F.col("score")).alias("moved")))
        forget(before)
    return state.select("id", "score")


def chains_from(edges: DataFrame, seeds: DataFrame, most: int = 3, limit: int | None = None) -> DataFrame:
    """path, weight, hops: directed paths of 1..most edges from the seeds that use no edge twice; heaviest first."""
    e = edges.select("source_id", "target_id", "weight", F.concat_ws("|", "source_id", "target_id", "edge_type").alias("edge"))
    now = e.join(seeds.select(F.col(seeds.columns[0]).alias("source_id")).distinct(), "source_id").select(F.array("edge").alias("used"), F.col("target_id").alias("end"), F.concat_ws(">", "source_id", "target_id").alias("path"), "weight")
    every = now.withColumn("hops", F.lit(1))
    for h in range(2, most + 1):
        now = now.withColumnRenamed("weight", "w").join(e, F.col("end") == e["source_id"]).filter(~F.array_contains("used", F.col("edge")))
        now = now.select(F.array_append("used", F.col("edge")).alias("used"), F.col("target_id").alias("end"), F.concat_ws(">", "path", "target_id").alias("path"), F.round(F.col("w") + F.col("weight"), 4).alias("weight"))
        every = every.unionByName(now.withColumn("hops", F.lit(h)))
    out = every.select("path", F.round("weight", 4).alias("weight"), "hops").distinct()
    return out.orderBy(F.desc("weight"), "hops", "path").limit(limit) if limit else out


def edge_weight(kind: Column, evidence: Column, roles: Column) -> Column:
    """Weight from what an edge means: by type, x 1.2 with evidence, x 1.1 where a role is required."""
    base = F.when(kind.isin("has_part", "calls"), 1.0).when(kind.isin("placed_by", "owns"), 0.9).when(kind.isin("in_nation", "belongs_to"), 0.7).otherwise(0.5)
    return base * F.when(evidence, 1.2).otherwise(1.0) * F.when(roles > 0, 1.1).otherwise(1.0)


def decayed(days: Column, stale: int = 180, committed: Column | None = None) -> Column:
    """max(0, 1 - days / stale), 0.05 more where there was a commit, 0.3 where the age is unknown."""
    fresh = F.greatest(F.lit(0.0), 1 - days / stale)
    fresh = F.least(F.lit(1.0), fresh + F.when(committed, 0.05).otherwise(0.0)) if committed is not None else fresh
    return F.coalesce(fresh, F.lit(0.3))


def reweight(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their weight times the source's confidence (1 where unknown)."""
    c = nodes.select(F.col("id").alias("source_id"), "confidence")
    return edges.join(c, "source_id", "left").withColumn("weight", F.round(F.col("weight") * F.coalesce("confidence", F.lit(1.0)), 6)).drop("confidence")


def build(docs: DataFrame, key: str, prefix: str, links: dict[str, tuple[str, Column]]) -> DataFrame:
    """Edges from documents: for each edge type (target prefix, array of target keys)."""
    out = None
    for kind, (target, array) in links.items():
        e = docs.select(F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("source_id"), F.explode(array).alias("t")).select("source_id", F.concat(F.lit(f"{target}:"), "t").alias("target_id"), F.lit(kind).alias("edge_type"))
        out = e if out is None else out.unionByName(e)
    return out


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, n: keys that only a, only b, or both have."""
    x = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    return x.groupBy(F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


def as_text(nodes: DataFrame, edges: DataFrame, most: int = 400) -> DataFrame:
    """id, text: label, type and outgoing edges in order, cut at `most` characters; no node gathers more edges than could show."""
    line = F.concat_ws(" ", "edge_type", "target_id")
    shown = edges.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(line))).filter(F.col("_n") <= most)
    lines = shown.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("out"))
    return nodes.join(lines, "id", "left").select("id", F.substring(F.concat(F.col("label"), F.lit(" ("), "node_type", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "out"), F.lit(""))), 1, most).alias("text"))


def merge_hits(hits: DataFrame, node: str = "id", depth: str = "depth") -> DataFrame:
    return hits.groupBy(node).agg(F.min(depth).alias(depth))
