"""The inverted index against scores of all documents."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomery.operators import lexical as X


@pytest.fixture(scope="module")
def texts():
    """Few frequent and many rare words, very short and long documents, copies, one without words."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 60, 200])) for _ in range(400)]
    docs += [docs[5]] * 3 + [[], None]
    queries = [rng.choices(vocabulary, weights, k=rng.randint(1, 12)) for _ in range(25)] + [["unknown"], [], ["w0", "unknown", "w0"]]
    return docs, queries


def frames(spark, texts):
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, tokens array<string>").repartition(3)
    return frame(texts[0], "d"), frame(texts[1], "q")


def top(scores, k, digits):
    order = sorted(((-round(s, digits), d) for d, s in scores.items() if round(s, digits) > 0))
    return [(d, pytest.approx(-s, abs=2 * 10**-digits)) for s, d in order[:k]]


def best(search):
    out = {}
    for r in sorted(search.found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append((r["item"], r["score"]))
    return out


@pytest.mark.parametrize(("block", "part"), [(128, 1 << 16), (2, 7)])
def test_overlap_equals_all_scores(spark, texts, monkeypatch, block, part):
    monkeypatch.setattr(X.build, "__defaults__", (block, part))
    docs, queries = frames(spark, texts)
    search = X.Search(X.overlap_index(docs, "d"), X.overlap_queries(queries, "q"), 5, digits=9)
    got = best(search)
    for i, q in enumerate(texts[1]):
        scores = {d: len(set(q) & set(t or [])) / len(set(q)) for d, t in enumerate(texts[0]) if q}
        assert got.get(i, []) == top(scores, 5, 9), q
    assert search.read.agg(F.sum("n")).first()[0] < search.plan.agg(F.sum("n")).first()[0]


@pytest.mark.parametrize(("block", "part", "most"), [(128, 1 << 16, 10**6), (3, 11, 10)])
def test_cosine_equals_all_scores(spark, texts, monkeypatch, block, part, most):
    monkeypatch.setattr(X.build, "__defaults__", (block, part))
    monkeypatch.setattr(X, "VOCABULARY", most)
    docs, queries = frames(spark, texts)
    index, idf = X.cosine_index(docs, "d")
    got = best(X.Search(index, X.cosine_queries(queries, "q", idf), 5))
    df = Counter(w for t in texts[0] for w in set(t or []))
    weight = {w: round(math.log((len(texts[0]) + 1) / (n + 1)) + 1, 6) for w, n in df.items()}

    def vector(t):
        tf = Counter(t or [])
        tf = {w: n for w, n in tf.items() if w in weight}
        v = {w: (0.5 + 0.5 * n / max(tf.values())) * weight[w] for w, n in tf.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / length for w, x in v.items()}

    vectors = [vector(t) for t in texts[0]]
    for i, q in enumerate(texts[1]):
        v = vector(q)
        scores = {d: sum(x * u.get(w, 0) for w, x in v.items()) for d, u in enumerate(vectors)}
        assert got.get(i, []) == top(scores, 5, 6), q


def test_faq_equals_all_scores(spark, texts):
    docs, queries = frames(spark, texts)
    kind = F.concat(F.lit("c"), F.col("d") % 3)
    index, idf, sizes = X.faq_index(docs.withColumn("kind", kind), "d", "kind")
    wanted = queries.select(F.col("q").alias("item"), F.explode(F.array(F.lit("c0"), F.concat(F.lit("c"), F.col("q") % 2 + 1))).alias("category"))
    found = X.Search(index, X.faq_queries(queries, "q", wanted, idf, sizes), 3, X.faq_score).found
    got = {}
    for r in sorted(X.best_of_categories(found, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question"], []).append((r["doc"], r["score"]))
    for i, q in enumerate(texts[1]):
        chosen = {}
        for c in (0, i % 2 + 1):
            group = {d: Counter(t or []) for d, t in enumerate(texts[0]) if d % 3 == c}
            weight = {w: math.log((len(group) + 1) / (sum(w in t for t in group.values()) + 1)) + 1 for w in set(q)}
            tf, scores = Counter(q), {}
            length = math.sqrt(sum((n * weight[w]) ** 2 for w, n in tf.items()))
            for d, t in group.items():
                own = math.sqrt(sum((n * weight.get(w, 1)) ** 2 for w, n in t.items()))
                scores[d] = sum(n * weight[w] * t[w] * weight[w] for w, n in tf.items()) / (length * own) if own and length else 0
            chosen |= {d: scores[d] for d, _ in top(scores, 3, 6)}
        assert got.get(i, []) == top(chosen, 5, 6), q


def test_faq_search_equals_its_index(spark, texts):
    """The join finds what the index finds, also for null categories and unknown ones."""
    docs, queries = frames(spark, texts)
    docs = docs.withColumn("kind", F.when(F.col("d") % 7 > 0, F.concat(F.lit("c"), F.col("d") % 3)))
    wanted = queries.select(F.col("q").alias("item"), F.explode(F.array(F.lit("c0"), F.concat(F.lit("c"), F.col("q") % 4))).alias("category")).distinct()
    index, idf, sizes = X.faq_index(docs, "d", "kind")
    rows = lambda x: sorted((*r["query"], r["item"], r["rank"], pytest.approx(r["score"], abs=2e-6)) for r in x.collect())
    want = rows(X.Search(index, X.faq_queries(queries, "q", wanted, idf, sizes), 3, X.faq_score).found)
    assert rows(X.faq_search(docs, "d", "kind", queries, "q", wanted, 3)) == want and len(want) > 100
    assert X.faq_search(docs.limit(0), "d", "kind", queries, "q", wanted, 3).collect() == []


@pytest.mark.parametrize("indexed", [True, False])
def test_faq_of_a_long_document(spark, indexed):
    """The time of a document grows with its words, not with their square."""
    words = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    docs = spark.range(1).select(F.col("id").alias("d"), F.lit("c").alias("kind"), words.alias("tokens"))
    queries = spark.createDataFrame([(1, ["w7", "w8", "x"])], "q long, tokens array<string>")
    wanted = spark.createDataFrame([(1, "c")], "item long, category string")
    began = time.monotonic()
    if indexed:
        index, idf, sizes = X.faq_index(docs, "d", "kind")
        found = X.Search(index, X.faq_queries(queries, "q", wanted, idf, sizes), 3, X.faq_score).found
    else:
        found = X.faq_search(docs, "d", "kind", queries, "q", wanted, 3)
    a, x = 1.0, math.log(2) + 1  # idf of a word of the one document, and of none
    assert [(r["item"], r["score"]) for r in found.collect()] == [(0, pytest.approx(2 * a / (math.sqrt(2 * a + x * x) * math.sqrt(60_000)), abs=1e-6))]
    assert time.monotonic() - began < 60


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "d long, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"])], "d long, tokens array<string>")
    assert X.Search(X.overlap_index(none, "d"), X.overlap_queries(some, "d"), 3).found.collect() == []
    assert X.Search(X.overlap_index(some, "d"), X.overlap_queries(none, "d"), 3).found.collect() == []
    found = X.Search(X.overlap_index(some, "d"), X.overlap_queries(some, "d"), 3).found.collect()
    assert [tuple(r) for r in found] == [(1, 1, 1.0, 1)]
