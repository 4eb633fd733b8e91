"""Fusion, reranking, budgets and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.positions import placed

#: fixed values: how much each retrieval leg counts
LEG_WEIGHTS = {"exact": 2.0, "pagerank": 1.8, "neighbourhood": 1.5, "vector": 1.0, "lexical": 0.8}
RRF_K = 60


def fuse(ranks: DataFrame, top: int = 10, weights: dict[str, float] | None = LEG_WEIGHTS, penalised: Column | None = None) -> DataFrame:
    """query_id, node_id, score, legs, position from (query_id, leg, node_id, rank): sum of weight / (60 + rank), nodes under
    a negative keyword x 0.3, the top of each query. None: every leg counts 1."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("leg")), F.lit(1.0)) if weights else F.lit(1.0)
    x = ranks.groupBy("query_id", "node_id").agg(F.sum(w / (RRF_K + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("leg")), "+").alias("legs"))
    if penalised is not None:
        x = x.withColumn("score", F.when(penalised, F.col("score") * 0.3).otherwise(F.col("score")))
    x = x.withColumn("score", F.round("score", 6))
    return x.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).filter(F.col("position") <= top)


def fusion_confidence(fused: DataFrame, legs: int) -> DataFrame:
    """query_id, confidence: the top score over the highest score possible, 1 at most."""
    best = sum(1 / (RRF_K + r) for r in range(1, legs + 1))
    return fused.groupBy("query_id").agg(F.round(F.least(F.max("score") / best, F.lit(1.0)), 6).alias("confidence"))


def first_k(df: DataFrame, order: list[Column], k: int, position: str = "position") -> DataFrame:
    """The first k rows of all, numbered: each partition keeps k, so only those meet in one task."""
    return df.orderBy(*order).limit(k).withColumn(position, F.row_number().over(Window.orderBy(*order)))


def freshness(age_days: Column) -> Column:
    return F.when(age_days <= 7, 1.0).when(age_days <= 30, 0.9).when(age_days <= 90, 0.8).otherwise(0.7)


def token_cosine(queries: DataFrame, docs: DataFrame, idf: DataFrame, k: int, query: str, doc: str, tokens: str = "tokens") -> DataFrame:
    """query, doc, score, rank by cosine of TF-IDF vectors (tf augmented: .5 + .5 tf / max tf), score above 0."""

    def weighted(df: DataFrame, key: str) -> DataFrame:
        tf = df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
        w = (0.5 + 0.5 * F.col("tf") / F.max("tf").over(Window.partitionBy(key))) * F.col("idf")
        return tf.join(idf.select("token", "idf"), "token").withColumn("w", w).withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(F.col(key), "token", "w", "norm")

    a, b = weighted(queries, query), weighted(docs, doc).withColumnsRenamed({"w": "w2", "norm": "norm2"})
    s = a.join(b, "token").groupBy(query, doc).agg(F.round(F.sum(F.col("w") * F.col("w2")) / (F.first("norm") * F.first("norm2")), 6).alias("score")).filter("score > 0")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))).filter(F.col("rank") <= k)


def mmr(candidates: DataFrame, query: str, item: str, relevance: str, tokens: str, kind: str, k: int = 5, mix: float = 0.7, words: int = 50) -> DataFrame:
    """query, item, position: greedy maximal marginal relevance over the candidates of a query (a few dozen): mix x relevance -
    (1 - mix) x the largest similarity to what is chosen, similarity being Jaccard of the first words plus 0.1 for an equal kind."""

    def pick(pdf):
        pdf = pdf.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        sets, kinds, left, chosen = [set(list(t)[:words]) for t in pdf[tokens]], pdf[kind].tolist(), list(range(len(pdf))), []
        alike = lambda i, j: (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0) + 0.1 * (kinds[i] == kinds[j])
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (round(mix * pdf[relevance][i] - (1 - mix) * max((alike(i, j) for j in chosen), default=0.0), 12), -i))
            chosen.append(best)
            left.remove(best)
        return pdf.loc[chosen, [query, item]].assign(position=range(1, len(chosen) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, {item} {kinds[item]}, position long")


def keyword_score(similarity: Column, overlap: Column, entity: Column, chunk: Column, trust: Column) -> Column:
    return 0.35 * similarity + 0.25 * overlap + 0.20 * entity.cast("double") + 0.10 * chunk + 0.10 * trust


def boosted(score: Column, boosts: list[tuple[Column, float]], cap: float = 3.5) -> Column:
    """score times the product of the boosts that hold, which counts `cap` at most."""
    return score * F.least(F.lit(cap), reduce(Column.__mul__, [F.when(c, b).otherwise(1.0) for c, b in boosts], F.lit(1.0)))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def tournament_score(confidence: Column, cost: Column, latency: Column, wins: Column, runs: Column, most_cost: Column, most_latency: Column) -> Column:
    """.6 confidence + .2 cheapness + .1 speed + .1 history, which is .5 below five runs."""
    part = lambda v, m: 1 - F.coalesce(v / F.nullif(m, F.lit(0.0)), F.lit(0.0))
    return 0.6 * confidence + 0.2 * part(cost, most_cost) + 0.1 * part(latency, most_latency) + 0.1 * F.when(runs >= 5, wins / runs).otherwise(0.5)


def budget_prefix(df: DataFrame, key: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key, in order, until the first one that does not fit."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).withColumn("_over", F.max((F.col("used") > budget).cast("int")).over(w)).filter("_over = 0").drop("_over")


def loops(df: DataFrame, key: str, order: list[Column], item: str, window: int = 8, least: int = 3) -> DataFrame:
    """looping: the item stands at least `least` times among the last `window` of its key."""
    last = F.collect_list(item).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0))
    return df.withColumn("_last", last).withColumn("looping", F.size(F.filter("_last", lambda x: x == F.col(item))) >= least).drop("_last")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    n = df.count()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(n))


def split(df: DataFrame, strata: list[str], key: str, seed: int = 42, cuts: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """part: train, validation or holdout; within a stratum by seeded hash, int(n x cut) rows below each cut. A stratum of any size."""
    seeded = df.withColumn("_seeded", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    found = placed(seeded, strata, [F.col("_seeded"), F.col(key)], "_place", "_total")
    at, n = F.col("_place") - 1, F.col("_total")
    return found.withColumn("part", F.when(at < F.floor(n * cuts[0]), "train").when(at < F.floor(n * cuts[1]), "validation").otherwise("holdout")).drop("_seeded", "_place", "_total")


def first_rule(df: DataFrame, rules: DataFrame, keys: list[str], value: str, priority: str = "priority") -> DataFrame:
    """df with the priority and value of the first rule that fits each row: rules(keys, priority, value), where a null key fits anything.
    Rules with the same keys given meet the rows in one equi-join, which is as many joins as there are such kinds, whatever the number
    of rules; rows without a rule have nulls. Of rules of one priority the smaller value counts."""
    out, found = df, []
    kinds = [[k for i, k in enumerate(keys) if n >> i & 1] for n in range(1 << len(keys))]
    for n, given in enumerate(kinds):
        own = rules.filter(reduce(Column.__and__, [F.col(k).isNotNull() if k in given else F.col(k).isNull() for k in keys]))
        best = own.groupBy(*[F.col(k).alias(f"_on_{k}") for k in given]).agg(F.min(F.struct(F.col(priority), F.col(value))).alias(f"_rule_{n}"))
        if given:
            out = out.join(best, reduce(Column.__and__, [out[k] == best[f"_on_{k}"] for k in given]), "left").drop(*[f"_on_{k}" for k in given])
        else:
            out = out.withColumn("_any", F.lit(1)).join(F.broadcast(best.withColumn("_any", F.lit(1))), "_any", "left").drop("_any")  # one row
        found.append(F.col(f"_rule_{n}"))
    rule = F.least(*found) if len(found) > 1 else found[0]
    return out.withColumn("_rule", rule).select(*df.columns, F.col(f"_rule.{priority}").alias(priority), F.col(f"_rule.{value}").alias(value))


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    return df.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_n = 1").drop("_k", "_n")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def ordered_union(first: DataFrame, second: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Rows of first, then those of second that first has not, renumbered within keys[0]; both sides have the same columns."""
    x = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_s", rank))).filter("_n = 1")
    return x.withColumn("position", F.row_number().over(Window.partitionBy(keys[0]).orderBy("_s", rank, *keys[1:]))).drop("_s", "_n")
