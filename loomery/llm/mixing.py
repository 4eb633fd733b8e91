"""Mixing sources to target weights by subset sums over exact lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm.common import fresh, word_count
from loomery.session import materialize, table

SEED, SLICE, EXACT = 17, 512, 8192
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is the largest within budget (bounded knapsack, each length counted)."""
    taken = np.zeros(len(lengths), np.int64)
    came = np.full(budget + 1, -1)  # the part that first reached this sum
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    parts = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if not 0 < length <= budget:
            continue
        left, step = min(count, budget // length), 1
        while left > 0 and not reached[budget]:
            n = min(step, left)
            size = n * length
            if size <= budget:
                new = ~reached[size:]
                new &= reached[: budget + 1 - size]
                came[size:][new] = len(parts)
                reached[size:] |= new
                parts.append((i, n, size))
            left, step = left - n, 2 * step
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n, size = parts[came[at]]
        taken[i] += n
        at -= size
    return taken


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """Documents to take of each length: in proportion first, large ones until the rest is small, then the exact sum."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= exact:
            break
        if lengths[i] > 0:
            n = min(int(counts[i] - taken[i]), (rest - exact) // int(lengths[i]))
            taken[i] += n
            rest -= n * int(lengths[i])
    return taken + subset_sum(lengths, counts - taken, rest)  # less than exact + the longest: of some length not all were taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """copies every document of the group gets, and how many of each length get one more."""
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    total = int((lengths * counts).sum())
    target = int(round(pdf["target"].iloc[0])) if total else 0
    copies, rest = divmod(target, total) if total else (0, 0)
    more = fill(lengths, counts, rest) if rest else np.zeros(len(pdf), np.int64)
    return pdf[["source", "size", "n"]].assign(copies=copies, more=more)


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target; totals has one row a source, the only table sorted as a whole.

    Sharing what capped sources leave until none is above its cap is a water level: target = min(cap, level x weight), and
    the level is the largest of those that follow from capping the sources with the lowest cap per weight.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = lambda c: F.coalesce(F.sum(c).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (share * F.sum("source_size").over(every) - before("cap")) / (F.sum("w").over(every) - before("w"))
    rows = rows.withColumn("level", F.greatest(level, F.lit(0.0)))
    return rows.select("source", "source_size", F.least("cap", F.max("level").over(every) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, row (hash of id, text and source), source, size, source_size, target, copies, taken (copies x size) for each row.

    A source's documents are counted by exact length; the group of a source holds one row a length, not a document. Every
    document gets target // total copies; the rest of the target is a subset sum over the lengths, and of each length the
    documents that come first by seeded hash are chosen. Where one length has many documents (a hot source, thousands of
    copies) they are split by hash of the row into slices of about 512, whole slices are taken, and only the last one is
    ranked; an id that repeats is dealt by its texts. Null texts have size 0; null sources are a source; documents of size 0
    are taken as often as all of their source; repeated rows count as documents of their own, and which of them is chosen
    makes no difference; an empty table returns no rows; other columns are ignored.
    """
    row = F.xxhash64(F.col(key), F.col(text).cast("string"), F.col(source).cast("string"))
    rows = materialize(docs.select(F.col(key).alias("doc_id"), row.alias("row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")))
    counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    shares = materialize(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    aimed = counted.alias("a").join(shares.alias("b"), same("a", "b", "source")).select("a.*", "b.target", "b.source_size")
    plan = aimed.groupBy("source").applyInPandas(_plan, "source string, size long, n long, copies long, more long")
    plan = materialize(plan.alias("a").join(shares.alias("b"), same("a", "b", "source")).select("a.*", "b.source_size", "b.target"))
    order = F.xxhash64(F.lit(seed), F.col("row"))
    salt = F.pmod(F.hash("row"), F.lit(16))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = rows.withColumn("salt", salt).alias("a").join(salted.alias("b"), same("a", "b", "source", "size", "salt"))
    joined = joined.select("a.doc_id", "a.row", "a.source", "a.size", "b.source_size", "b.target", "b.copies", "b.more", order.alias("at"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col("a.row")), F.greatest(F.lit(1), F.ceil(F.col("b.n") / SLICE))).alias("slice"))
    joined = materialize(joined)
    sliced = joined.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    earlier = sliced.withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("n"))
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("at", "row")))
    found = ranked.alias("a").join(earlier.alias("b"), same("a", "b", "source", "size", "slice"))
    copies: Column = F.col("copies") + (F.col("a.rank") + F.col("b.before") <= F.col("a.more")).cast("long")
    return found.select("a.doc_id", "a.row", "a.source", "a.size", "a.source_size", "a.target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; of rows with one id, text and source any may stand for another.

    Such rows get what they are given together, evenly, and one of them what is left over. Null ids, null texts and null
    sources are values like others; an empty table gives no rows; other columns stay, whatever their names. Texts meet a hash
    of the plan (24 bytes a row) and are not sorted.
    """
    row, many, copies, turn = fresh(docs, "row", "many", "copies", "turn")
    plan = mix(docs).groupBy("row").agg(F.count("*").alias(many), F.sum("copies").alias(copies)).filter(F.col(copies) > 0).withColumnRenamed("row", row)
    known = docs.join(plan.hint("shuffle_hash"), F.xxhash64(docs["doc_id"], docs["text"].cast("string"), docs["source"].cast("string")) == plan[row])
    every = lambda rows, n: rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(docs.columns)
    each_ = F.floor(F.col(copies) / F.col(many))
    left = known.filter((F.col(many) > 1) & (F.col(copies) % F.col(many) > 0)).dropDuplicates([row])
    return every(known.filter(each_ > 0), each_).unionByName(every(left, F.col(copies) % F.col(many)))
