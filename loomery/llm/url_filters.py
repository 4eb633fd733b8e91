"""Exact URL lists in a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import materialize, table

MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


class Bloom:
    """A bitmap over pairs of 64-bit hashes."""

    def __init__(self, n: int, bits_per_key: int, seed: int):
        self.m = max(64, -(-n * bits_per_key // 64) * 64)
        self.k = max(1, round(bits_per_key * math.log(2)))
        self.seed, self.bits = np.uint64(seed), None

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = (b ^ (self.seed * MIX)) * MIX | np.uint64(1)
            start = (a ^ (self.seed << np.uint64(32))) * MIX
            at = start[:, None] + np.arange(self.k, dtype=np.uint64) * step[:, None]
            return (at ^ (at >> np.uint64(29))) % np.uint64(self.m)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1) if len(a) else np.zeros(0, bool)


class BloomCascade:
    """Level 0 holds the listed keys, level 1 the other keys that level 0 lets pass, level 2 the listed ones that level 1 lets
    pass, and so on until none passes wrongly. Over the keys it was built for the answer is exact."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        listed, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for i, level in enumerate(self.levels):
            open_ = open_[level.has(a[open_], b[open_])]
            listed[open_] = i % 2 == 0
        return listed


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def _pairs(x) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))


def _marks(level: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(level.m // 64, np.uint64)
        for x in batches:
            at = level.places(*_pairs(x)).ravel()
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "word"])

    return run


def _passing(level: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(level.has(*_pairs(x))))

    return run


def hashed_keys(df: DataFrame) -> DataFrame:
    """a, b: the distinct hashes of the first column (nulls are no keys), computed once."""
    own = df.select(F.col(df.columns[0]).cast("string").alias("key")).dropna()
    return materialize(own.select(*[h.alias(n) for h, n in zip(hashes(F.col("key")), "ab", strict=True)]).distinct())


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 8, most_levels: int = 64) -> BloomCascade:
    """The cascade for the keys of listed (a string column) among those of universe, which hashed_keys gives.

    Executors mark bits by partition and OR them by machine word; the driver gets the finished bitmap of each level, which
    with the smaller ones of later levels is about 1.2 bytes a listed key: the list alone bounds it, not the table. Two keys with equal 128-bit hashes, one listed and one not, can't be told
    apart and end in an error rather than a wrong answer.
    """
    inside = hashed_keys(listed)
    outside = materialize(universe.join(inside, ["a", "b"], "left_anti"))
    levels: list[Bloom] = []
    encode, against = inside, outside
    while (n := encode.count()) and len(levels) < most_levels:
        level = Bloom(n, bits_per_key, len(levels) + 1)
        words = encode.mapInArrow(_marks(level), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        level.bits = np.zeros(level.m // 64, np.uint64)
        level.bits[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
        levels.append(level)
        encode, against = materialize(against.mapInArrow(_passing(level), "a long, b long")), encode
    if n and len(levels) == most_levels:
        raise ValueError("keys that hash alike")
    return BloomCascade(levels)


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host (A-Z lower-cased), path; both empty if the url is null or has no ://."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract("rest", r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(key).alias("page_id"), rest.alias("rest")).select("page_id", host.alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def _keys(lengths: list[int], deepest: int) -> Column:
    """Every host suffix of at most so many labels with every path prefix of those lengths, longest first: no rule is deeper, so
    a host of any length costs no more than its end."""
    labels = F.split(F.substring_index("host", ".", -deepest), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    every = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.array_sort(F.array_distinct(every), lambda x, y: F.length(y) - F.length(x))


def _judge(block, allow, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys, a, b = x.column(3), x.column(4), x.column(5)
            size = np.diff(keys.offsets.to_numpy())
            a, b = (np.asarray(y.flatten(), np.int64).view(np.uint64) for y in (a, b))
            blocked, allowed = block.value.has(a, b), allow.value.has(a, b)
            rule = np.full(x.num_rows, -1)
            at = np.flatnonzero(blocked | allowed)[::-1]
            rule[np.repeat(np.arange(len(size)), size)[at]] = at  # the first of each row is written last
            verdict = np.where(rule < 0, default, np.where(blocked[rule] if len(blocked) else False, "block", "allow"))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), keys.flatten().take(pa.array(rule, mask=rule < 0)), pa.array(verdict.tolist(), pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = "allow", bits_per_key: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: (host and path prefix, allow or block), for a host and its subdomains; the longest fitting rule wins. Blocked and
    allowed prefixes are one cascade each over every prefix any url of the table could match, so no url is joined with a list
    and no list travels; a url that neither cascade lists gets the default. Null urls and urls without :// have an empty host and path and no rule; repeated rows
    return repeated rows; urls and hosts of any length cost what their length does; an empty table returns no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    lengths, deepest = sorted({len(r) - r.index("/") for r, _ in rules}), max((r[: r.index("/")].count(".") + 1 for r, _ in rules), default=1)
    rows = parsed(pages, key, url).withColumn("keys", _keys(lengths, deepest) if lengths else F.array().cast("array<string>"))
    universe = hashed_keys(rows.select(F.explode("keys").alias("key")))
    listed = {side: spark.createDataFrame([(r,) for r, v in rules if v == side], "key string") for side in ("block", "allow")}
    block, allow = (build_cascade(listed[side], universe, bits_per_key) for side in ("block", "allow"))
    block, allow = (spark.sparkContext.broadcast(x) for x in (block, allow))
    hashed = rows.withColumn("a", F.transform("keys", lambda k: hashes(k)[0])).withColumn("b", F.transform("keys", lambda k: hashes(k)[1]))
    return hashed.mapInArrow(_judge(block, allow, default), pages.select(F.col(key).alias("page_id")).schema.simpleString()[7:-1] + ", host string, path string, rule string, verdict string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


OP9_SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT b.page_id, b.host, b.path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM b LEFT JOIN r ON (b.host = r.h OR b.host LIKE '%.' || r.h) AND starts_with(b.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
