"""Aggregations over query, cost, feedback, run and preference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import materialize


def since(df: DataFrame, asof: str, days: int, at: str = "created_at") -> DataFrame:
    """Rows of the last `days` days before asof (a SQL timestamp literal): never the wall clock, so reruns agree."""
    return df.filter(f"{at} >= {asof} - INTERVAL {days} DAYS AND {at} < {asof}")


def rate(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def nearest_rank(df: DataFrame, value: str, q: float, small: int = 100_000) -> float | None:
    """Element number int(n x q) of the sorted non-null values.

    Narrows by mergeable quantile summaries until few enough values are left to take from the top, so no task sorts them all.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).dropna()
    n = rows.count()
    if not n:
        return None
    at = min(n - 1, int(n * q))
    while n > small:
        low, high = rows.agg(F.percentile_approx("v", [max(0.0, at / n - 0.01), min(1.0, at / n + 0.01)], 1000)).first()[0]
        below, within = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if low == high or within == n or not below <= at < below + within:
            break
        rows, at, n = rows.filter(F.col("v").between(low, high)), at - below, within
    return rows.orderBy("v").offset(at).limit(1).first()[0]


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """keys, name: element int(n x q) of each group. Equal values are counted first, so groups meet as distinct values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    w = Window.partitionBy(*keys)
    upto = F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).withColumn("at", F.least(F.sum("count").over(w) - 1, F.floor(F.sum("count").over(w) * F.lit(q))))
    return ranked.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("count") <= F.col("at"))).select(*keys, F.col(value).alias(name))


def usage(df: DataFrame, *keys: str) -> DataFrame:
    """Count, mean confidence and latency, escalation rate, total and mean cost, by keys."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("queries"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.round(rate(F.col("escalated")), 4).alias("escalation_rate"), F.round(F.sum("cost_usd"), 8).alias("total_cost"), F.round(F.avg("cost_usd"), 6).alias("avg_cost"),
    )


def breakdown(df: DataFrame, dims: list[str]) -> DataFrame:
    """usage() by each dimension alone, in one pass: dim, key and the figures. (grouping sets)"""
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims])).alias("x")
    return usage(df.select("*", sets).select("*", "x.dim", "x.key"), "dim", "key")


def buckets(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """One row: how many values lie below each edge and not below the one before; nulls count nowhere, empty buckets are 0."""
    low = [None, *edges]
    high = [*edges, None]
    c = F.col(value)
    cond = lambda a, b: (c >= a if a is not None else F.lit(True)) & (c < b if b is not None else F.lit(True)) & c.isNotNull()
    return df.agg(*[F.count_if(cond(a, b)).alias(f"bucket_{i}") for i, (a, b) in enumerate(zip(low, high, strict=True))])


def histogram(df: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """keys, le, n: values at or below each bound, cumulative, and +Inf."""
    wide = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("inf"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n"))]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def cost_report(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """dim, key, queries, cost for each dimension; totals are sums of the rounded parts."""
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("key")) for d, c in dims.items()])).alias("x")
    parts = df.select("cost_usd", sets).groupBy("x.dim", "x.key").agg(F.count("*").alias("queries"), F.round(F.sum("cost_usd"), 8).alias("cost"))
    return parts.withColumn("dim_total", F.round(F.sum("cost").over(Window.partitionBy("dim")), 8))


def coverage_gaps(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Values of the enumeration that no row has."""
    every = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} string")
    return every.join(df.select(column).distinct(), column, "left_anti")


def decay_weight(at: Column, asof: str, steps: tuple[tuple[int, float], ...] = ((7, 1.0), (30, 0.9), (90, 0.8)), last: float = 0.7) -> Column:
    """Weight by whole days of age: the first step whose limit is not passed, else `last`."""
    age = F.datediff(F.expr(asof), at)
    out = F.when(age <= steps[0][0], steps[0][1])
    for limit, weight in steps[1:]:
        out = out.when(age <= limit, weight)
    return out.otherwise(last)


def preference_stats(df: DataFrame, asof: str, sufficient: int = 50, *keys: str) -> DataFrame:
    """Votes, win rates and time-decayed win rate of A."""
    w = decay_weight(F.col("created_at"), asof)
    is_ = lambda p: F.col("preference") == p
    decided = F.col("preference").isin("A", "B")
    return df.groupBy(*keys).agg(
        F.count("*").alias("votes"), *[F.count_if(is_(p)).alias(f"n_{p.lower()}") for p in ("A", "B", "both_good", "both_bad")],
        F.round(F.count_if(is_("A")) / F.nullif(F.count_if(decided), F.lit(0)), 4).alias("win_rate_a"),
        F.round(F.sum(F.when(is_("A"), w).otherwise(0.0)) / F.nullif(F.sum(F.when(decided, w).otherwise(0.0)), F.lit(0.0)), 4).alias("weighted_win_rate_a"),
        (F.count("*") >= sufficient).alias("sample_sufficient"),
    )


def agreement(df: DataFrame, key: str = "pair_id", vote: str = "preference") -> DataFrame:
    """key, annotators, agreement: the largest number of equal votes over all votes, and the vote (first by name of equals)."""
    counted = df.groupBy(key, vote).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.sum("n").alias("annotators"), F.round(F.max("n") / F.sum("n"), 4).alias("agreement"), F.min_by(vote, F.struct(-F.col("n"), F.col(vote))).alias("majority"))


def training_triples(df: DataFrame, asof: str, gate: float = 0.6) -> DataFrame:
    """pair_id, chosen, weight: decided pairs, weighted by age and by agreement (1 for all alike, 0.7 above the gate)."""
    last = df.groupBy("pair_id").agg(F.max("created_at").alias("created_at"))
    x = agreement(df).filter((F.col("agreement") >= gate) & F.col("majority").isin("A", "B")).join(last, "pair_id")
    w = F.when(F.col("agreement") >= 1.0, 1.0).when(F.col("agreement") >= gate, 0.7).otherwise(0.4)
    return x.select("pair_id", F.col("majority").alias("chosen"), F.when(F.col("majority") == "A", "B").otherwise("A").alias("rejected"), F.round(w * decay_weight(F.col("created_at"), asof), 4).alias("weight"))


def failure_report(df: DataFrame, domain: str, failed: Column, flag: float = 0.2) -> DataFrame:
    """Failures against all rows of a domain, first and last seen, and whether the rate is over the flag."""
    return df.groupBy(domain).agg(F.count("*").alias("total"), F.count_if(failed).alias("failures"), F.min(F.when(failed, F.col("created_at"))).cast("string").alias("first_seen"), F.max(F.when(failed, F.col("created_at"))).cast("string").alias("last_seen")).withColumns({"failure_rate": F.round(F.col("failures") / F.col("total"), 4), "flagged": F.col("failures") / F.col("total") > flag})


def run_metrics(df: DataFrame, key: str = "run_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("avg_score"), F.round(F.min("latency_ms"), 4).alias("min_latency"), F.round(F.max("latency_ms"), 4).alias("max_latency"), F.round(F.sum("cost_usd"), 8).alias("cost"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.round(rate(F.col("passed")), 4).alias("accuracy"))


def tool_weights(stats: DataFrame, ratings: DataFrame) -> DataFrame:
    """tool, weight = .4 success + .3 (rating-1)/4 + .2 confidence - .1 latency/largest latency, within 0..1; what is unknown
    counts 0.5. stats: tool, success, confidence, latency; ratings: tool, rating."""
    most = stats.agg(F.max("latency").alias("most"))
    x = stats.join(ratings, "tool", "full").withColumn("most", F.lit(most.first()[0]))
    half = lambda c: F.coalesce(c, F.lit(0.5))
    w = 0.4 * half(F.col("success")) + 0.3 * half((F.col("rating") - 1) / 4) + 0.2 * half(F.col("confidence")) - 0.1 * F.coalesce(F.col("latency") / F.col("most"), F.lit(0.5))
    return x.select("tool", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)), 4).alias("weight"))


def leaderboard(df: DataFrame, pattern: str, strategy: str) -> DataFrame:
    """Runs, mean confidence, cost and latency of each strategy, and its rank in the pattern."""
    x = df.groupBy(pattern, strategy).agg(F.count("*").alias("runs"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("cost_usd"), 8).alias("cost"), F.round(F.avg("latency_ms"), 6).alias("latency"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(pattern).orderBy(F.desc("confidence"), "cost", strategy)))


def idf(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """token, df, idf = ln((N+1)/(df+1)) + 1."""
    n = docs.count()
    each = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1, 6))


def centroids(vectors: DataFrame, label: str, token: str, weight: str, key: str, least: int = 3, top: int = 200) -> DataFrame:
    """label, token, weight: mean sparse vector of each label with at least `least` samples, largest weights, length 1."""
    n = vectors.select(label, key).distinct().groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    mean = vectors.groupBy(label, token).agg(F.sum(weight).alias("s")).join(n, label).select(label, token, (F.col("s") / F.col("n")).alias("w"))
    kept = mean.withColumn("at", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("w"), token))).filter(F.col("at") <= top)
    return kept.select(label, token, F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(label))), 6).alias("weight"))


def calendar(df: DataFrame, first: str, last: str, day: str, value: Column, name: str) -> DataFrame:
    """day, name for every day of the range, 0 where there is none."""
    days = df.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS day")
    return days.join(df.groupBy(F.to_date(day).alias("day")).agg(value.alias(name)), "day", "left").select(F.col("day").cast("string"), F.coalesce(name, F.lit(0)).alias(name))


def pattern_cache(df: DataFrame, key: str) -> DataFrame:
    """Successes, total, confidence, mean latency and whether the fast path is open."""
    x = df.groupBy(key).agg(F.count_if(F.col("status") == "success").alias("success_count"), F.count("*").alias("total_count"), F.round(F.avg("duration_ms"), 4).alias("avg_latency_ms"))
    return x.withColumn("confidence", F.round(F.col("success_count") / F.col("total_count"), 4)).withColumn("fast_path", (F.col("success_count") / F.col("total_count") >= 0.9) & (F.col("success_count") >= 30))


def memory(df: DataFrame, key: str, item: str, at: list[str], last: int = 10) -> DataFrame:
    """Occurrences, confidence = min(1, .3 + .1 n), and the last items in order. Only the last rows of a key are gathered."""
    n = df.groupBy(key).agg(F.count("*").alias("occurrences"))
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in at])
    recent = df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= last).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rn"), F.col(item).cast("string").alias("i")))), lambda x: x["i"]), ",").alias("recent"))
    return n.join(recent, key).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 + 0.1 * F.col("occurrences")), 4))


def bifurcate(df: DataFrame, keys: list[str], least: int, most: int, name: str) -> DataFrame:
    """tool, members: rows by domain_action_resource; groups under `least` join <domain>_misc; groups over `most` are cut in parts."""
    key = F.concat_ws("_", *keys)
    x = df.select("*", key.alias("k")).withColumn("n", F.count("*").over(Window.partitionBy("k")))
    x = x.withColumn("k", F.when(F.col("n") < least, F.concat(F.col(keys[0]), F.lit("_misc"))).otherwise(F.col("k")))
    x = x.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("k").orderBy(name)) - 1) / most)).withColumn("size", F.count("*").over(Window.partitionBy("k")))
    return x.groupBy(F.when(F.col("size") > most, F.concat_ws("_", F.col("k"), F.col("part") + 1)).otherwise(F.col("k")).alias("tool")).agg(F.count("*").alias("members"))


def best_params(df: DataFrame, key: str, name: str, value: str, confidence: str) -> DataFrame:
    """key, strategy of the highest confidence, and for each parameter the value of its most confident row."""
    return df.groupBy(key, name).agg(F.max_by(value, F.struct(confidence, value)).alias(value))


def retrieval_eval(ranks: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10), *keys: str) -> DataFrame:
    """recall at each cut and mean reciprocal rank; ranks: one row a query, `rank` null if nothing right was found."""
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_{k}") for k in cuts], F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, type, n: nodes and edges by type, and the mean degree 2E/N."""
    a = nodes.groupBy("node_type").count().select(F.lit("node").alias("what"), F.col("node_type").alias("type"), F.col("count").cast("double").alias("n"))
    b = edges.groupBy("edge_type").count().select(F.lit("edge").alias("what"), F.col("edge_type").alias("type"), F.col("count").cast("double").alias("n"))
    every = materialize(a.unionByName(b))
    degree = every.agg((2 * F.sum(F.when(F.col("what") == "edge", F.col("n"))) / F.sum(F.when(F.col("what") == "node", F.col("n")))).alias("n"))
    return every.unionByName(degree.select(F.lit("graph").alias("what"), F.lit("avg_degree").alias("type"), F.round("n", 6).alias("n")))
