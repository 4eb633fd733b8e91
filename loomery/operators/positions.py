"""Places of rows within groups of any size, without a group in one task.

Rows are dealt by ranges of group and order and written in that order, so a row's place in its group is its place in its task plus what
earlier tasks hold of the group: one number a group and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import written


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [a[n].eqNullSafe(b[n]) for n in names])


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "position", total: str | None = None) -> DataFrame:
    """df with the place (from 1) of each row in its group, and the size of the group. Rows that tie in the order get places as they
    come, so the order should end in a key for a defined result. Null keys are a group; an empty table stays empty."""
    part, own = F.shiftright("_at", 33), [F.col(k) for k in keys]
    rows = written(df.repartitionByRange(*own, *order).sortWithinPartitions(*own, *order).withColumn("_at", F.monotonically_increasing_id()))
    runs = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    runs = runs.withColumn("_before", F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).withColumn("_total", F.sum("_n").over(whole))
    runs = runs.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_part", "_first", "_before", "_total")
    on = reduce(Column.__and__, [rows[k].eqNullSafe(runs[f"_key_{i}"]) for i, k in enumerate(keys)], F.shiftright(rows["_at"], 33) == runs["_part"])
    found = rows.join(runs, on).withColumn(name, F.col("_at") - F.col("_first") + 1 + F.col("_before"))
    more = [F.col("_total").alias(total)] if total else []
    return found.select(*[c for c in df.columns if c != name], name, *more)


def numbered_lines(df: DataFrame) -> DataFrame:
    """Rows of text files (spark.read.text, or JSON lines read as text) with _file and _line, from 1, however many blocks a file is read
    in: the lines of each block are counted, and a line's number is its place in its block after those of earlier blocks."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    rows = written(rows)
    blocks = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")
    blocks = blocks.withColumn("_before", earlier).select("_file", "_start", "_first", "_before")
    return rows.join(blocks, ["_file", "_start"]).withColumn("_line", F.col("_at") - F.col("_first") + 1 + F.col("_before")).drop("_start", "_at", "_first", "_before")
