"""Keyed snapshots that are kept in buckets, so that an upsert rewrites only what it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import forget, written
from loomery.sources.sinks import upsert


@dataclass(frozen=True)
class Snapshot:
    """Rows with a key and a digest of their content, as a Parquet table of `buckets` folders (bucket=..) by hash of the key."""

    path: str
    key: str
    digest: str
    buckets: int = 256

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame) -> None:
        # one task a bucket writes one file; only folders of buckets that df has are replaced, at the commit of the job
        rows = df.repartition(self.buckets, "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, df: DataFrame) -> None:
        self._write(self._dealt(df))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")

    def upsert(self, staged: DataFrame) -> DataFrame:
        """Puts staged rows (one a key) over those of the same key unless their digests are equal; returns key and action (insert or
        update) of what changed.

        Staged rows are compared with the digests of their own keys first, so buckets without a change are neither read whole nor
        written. The driver gets the numbers of the changed buckets. Rows of a null key are one bucket and never meet; nothing is
        written where nothing changed.
        """
        spark = staged.sparkSession
        names = [c for c in spark.read.parquet(self.path).columns if c != "bucket"]
        new = self._dealt(staged.select(*names))
        held = spark.read.parquet(self.path).select("bucket", F.col(self.key), F.col(self.digest).alias("_held"))
        own = new.join(held, ["bucket", self.key], "left")
        changed = written(own.filter(F.col("_held").isNull() | (F.col("_held") != F.col(self.digest))).withColumn("action", F.when(F.col("_held").isNull(), "insert").otherwise("update")))
        touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # `buckets` numbers at most
        if touched:
            old = spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
            merged = written(self._dealt(upsert(old, changed.select(*names), self.key, self.digest).select(*names)))
            self._write(merged)
            forget(merged)
        return changed.select(self.key, "action")
