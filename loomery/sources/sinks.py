"""Writes: upserts as new snapshots, exports, audit rows, dead letters, metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, staged: DataFrame, key: str, digest: str) -> DataFrame:
    """The new snapshot: staged rows over current ones of the same key, unless their digests are equal; action tells which."""
    names = [c for c in staged.columns if c != key]
    a, b = current.select(key, F.struct(*names).alias("old")), staged.select(key, F.struct(*names).alias("new"))
    x = a.join(b, key, "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull() | (F.col(f"old.{digest}") == F.col(f"new.{digest}")), "keep").otherwise("update")
    row = F.when(action == "keep", F.col("old")).otherwise(F.col("new"))
    return x.withColumn("action", action).select(key, row.alias("r"), "action").select(key, "r.*", "action")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def export(df: DataFrame, path: str, kind: str = "jsonl") -> DataFrame:
    """Writes JSON lines and returns the manifest row (type, key, records, bytes, status), counted from the files themselves."""
    df.write.mode("overwrite").json(path)
    spark = df.sparkSession
    records = spark.read.text(path).agg(F.count("*").alias("records"))
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    both = records.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.select(F.lit(kind).alias("type"), F.lit(path).alias("key"), "records", "bytes", F.lit("done").alias("status"))


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """What is left when the rows of the condition go; rows for which it is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dead_letters(df: DataFrame, failed: Column, retries: str, most: int = 3) -> DataFrame:
    """route: ok, retry or dead, and the retry count of what failed."""
    return df.withColumn("route", F.when(~failed, "ok").when(F.col(retries) + 1 >= most, "dead").otherwise("retry")).withColumn(retries, F.when(failed, F.col(retries) + 1).otherwise(F.col(retries)))


def exposition(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """line: one text line of a metric for each row, labels in order."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """section, body: each section as a markdown table, rows in order of their text."""
    out = None
    for name, df in sections.items():
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
        head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
        body = df.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("body")).select(F.lit(name).alias("section"), "body")
        out = body if out is None else out.unionByName(body)
    return out


def tombstones(index: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The index with status 2 for files that are gone."""
    x = index.join(present.select(key).distinct().withColumn("_here", F.lit(True)), key, "left")
    return x.withColumn("status", F.when(F.col("_here").isNull(), 2).otherwise(F.col("status"))).drop("_here")


def buffered(df: DataFrame, path: str, size: int = 50) -> None:
    """JSON lines in files of `size` rows at most: each file is one flush of a buffer."""
    df.write.option("maxRecordsPerFile", size).json(path)
