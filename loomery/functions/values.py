"""Dates, scores, vectors, arrays, JSON and state machines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSITIONS = {"O": ["P", "F"], "P": ["F"], "F": []}
RATES = {"m0": (3.0, 15.0), "m1": (0.8, 4.0), "m2": (15.0, 75.0)}  # dollars for a million tokens in, out


def date_range(text: Column, today: Column) -> Column:
    """struct<first, last, label> of the first date phrase a text holds; weeks begin on Monday. Nulls if it holds none."""
    n = F.regexp_extract(text, r"(?i)\blast\s+(\d+)\s+days?\b", 1)
    monday = F.to_date(F.date_trunc("week", today))
    first = F.to_date(F.date_trunc("month", today))
    span = lambda a, b, label: F.struct(a.cast("string").alias("first"), b.cast("string").alias("last"), label.alias("label"))
    has = lambda p: text.rlike(rf"(?i)\b{p}\b")
    return (
        F.when(n != "", span(F.date_sub(today, F.try_subtract(F.try_to_number(n, F.lit("999999")), F.lit(1)).cast("int")), today, F.concat(F.lit("last "), n, F.lit(" days"))))
        .when(has(r"last\s+week"), span(F.date_sub(monday, 7), F.date_sub(monday, 1), F.lit("last week")))
        .when(has(r"this\s+week"), span(monday, today, F.lit("this week")))
        .when(has(r"last\s+month"), span(F.add_months(first, -1), F.date_sub(first, 1), F.lit("last month")))
        .when(has(r"this\s+month"), span(first, today, F.lit("this month")))
        .when(has("yesterday"), span(F.date_sub(today, 1), F.date_sub(today, 1), F.lit("yesterday")))
        .when(has("today"), span(today, today, F.lit("today")))
    )


def local_day(at: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def since_text(text: Column, now: Column) -> Column:
    """Start of a range like 24h or 7d."""
    n = F.nullif(F.regexp_extract(text, r"^(\d+)([hdm])$", 1), F.lit("")).cast("long")
    unit = F.regexp_extract(text, r"^(\d+)([hdm])$", 2)
    return F.timestamp_micros(F.unix_micros(now) - n * F.when(unit == "h", 3_600_000_000).when(unit == "d", 86_400_000_000).otherwise(60_000_000))


def expired(at: Column, now: Column, seconds: int) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(at) > seconds


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def confidence(signals: list[tuple[Column, float]]) -> Column:
    """Weighted sum within 0..1; what is null counts 0."""
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in signals), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def leg_confidence(legs: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + 0.15 * legs)


def gate(confidence_: Column, tier: Column, escalated: Column) -> Column:
    """respond, ask or escalate by the tier's thresholds."""
    return F.when(escalated, "escalate").when(confidence_ >= F.when(tier == 1, 0.7).when(tier == 2, 0.6).otherwise(0.5), "respond").when(confidence_ < 0.3, "escalate").otherwise("ask")


def token_cost(df: DataFrame, model: str, tokens_in: str, tokens_out: str, cached: Column | None = None, rates: dict[str, tuple[float, float]] = RATES) -> DataFrame:
    """usd by a rate table; cached input tokens cost a tenth."""
    r = df.sparkSession.createDataFrame([(k, *v) for k, v in rates.items()], f"{model} string, rate_in double, rate_out double")
    share = F.when(cached, 0.1).otherwise(1.0) if cached is not None else F.lit(1.0)
    return df.join(r, model, "left").withColumn("usd", (F.col(tokens_in) * F.col("rate_in") * share + F.col(tokens_out) * F.col("rate_out")) / 1e6).drop("rate_in", "rate_out")


def label_confidence(label: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(F.lit("high"), F.lit(1.0), F.lit("med"), F.lit(0.6), F.lit("low"), F.lit(0.3)), F.lower(label)), F.lit(0.5))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector made of repeated sha512 of the text; floats that are not finite are 0."""
    import hashlib

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s.fillna(""):
                data = b"".join(hashlib.sha512(f"{i}:{t}".encode()).digest() for i in range(-(-dim * 4 // 64)))[: dim * 4]
                v = np.nan_to_num(np.frombuffer(data, "<f4").astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
                top = np.abs(v).max()
                v = v / top if top > 0 else v
                out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
            yield pd.Series(out)

    return run(text)


def feature_hashing(df: DataFrame, key: str, tokens: str, dim: int = 384) -> DataFrame:
    """key, slot, weight: term frequencies by xxhash64 of the token, length 1."""
    n = df.select(key, F.explode(tokens).alias("t")).groupBy(key, F.pmod(F.xxhash64("t"), F.lit(dim)).alias("slot")).agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).drop("n")


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def merged(a: Column, b: Column) -> Column:
    """Both maps; b's value where both have a key."""
    kept = F.map_filter(a, lambda k, v: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.map_concat(kept, b))


def checksum(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def idempotency_key(action: Column, entity: Column, params: Column) -> Column:
    return F.sha2(F.concat_ws(":", action, entity, F.array_join(F.array_sort(params), ",")), 256)


def violations(df: DataFrame, key: str, order: list[Column], status: str, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Rows whose status may not follow the one before of the same key."""
    known = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    x = df.withColumn("before", F.lag(status).over(Window.partitionBy(key).orderBy(*order)))
    return x.filter(F.col("before").isNotNull() & ~F.coalesce(F.array_contains(F.element_at(known, F.col("before")), F.col(status)), F.lit(False)))
