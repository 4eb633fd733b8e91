"""Digest trees: hashes of files rolled up by folder, so that two versions are compared only where a folder differs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.session import written


@dataclass(frozen=True)
class DigestTree:
    """nodes: level, folder (of that many parts; "" for the root), name, digest, n (files below), leaf; one row a file or folder, written by
    level. A folder's digest is a sum and an exclusive or over its files, so it is a partial aggregate at every level."""

    nodes: DataFrame
    depth: int


def tree(files: DataFrame, path: str = "path", digest: str = "hash") -> DigestTree:
    """files: one row a path with the hash of its content; parts of a path are divided by /. Null paths are left out."""
    parts = F.split(F.col(path), "/")
    rows = files.filter(F.col(path).isNotNull()).select(parts.alias("parts"), F.xxhash64(path, digest).alias("a"), F.xxhash64(F.lit(1), path, digest).alias("b"))
    depth = rows.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    at = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    folder = F.array_join(F.slice("parts", 1, F.col("level") - 1), "/")
    keyed = at.select("level", folder.alias("folder"), F.element_at("parts", F.col("level")).alias("name"), (F.col("level") == F.size("parts")).alias("leaf"), "a", "b")
    sums = keyed.groupBy("level", "folder", "name", "leaf").agg(F.sum(F.col("a").cast("decimal(38,0)")).alias("s"), F.bit_xor("b").alias("x"), F.count("*").alias("n"))
    return DigestTree(written(sums.select("level", "folder", "name", "leaf", F.concat_ws(":", "s", "x").alias("digest"), "n")), depth)


class Difference:
    """`found`: path, change (added, modified, removed) between two trees; `compared`: how many nodes were looked at.

    Level by level the children of folders that differ are compared, the others are never joined; a folder that only one side has is
    taken whole without being descended into by comparison.
    """

    def __init__(self, old: DigestTree, new: DigestTree) -> None:
        self.compared, self.found = 0, None
        open_ = None  # folders that differ, of the level before
        for level in range(1, max(old.depth, new.depth) + 1):
            a, b = (t.nodes.filter(F.col("level") == level).select("folder", "name", "leaf", F.col("digest").alias(side)) for t, side in ((old, "was"), (new, "now")))
            if open_ is not None:
                a, b = (x.join(open_, "folder", "left_semi") for x in (a, b))
            met = written(a.join(b, ["folder", "name", "leaf"], "full").withColumn("path", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))))
            self.compared += met.count()
            differ = met.filter(~F.col("was").eqNullSafe(F.col("now")))
            change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified")
            files = differ.filter("leaf").select("path", change.alias("change"))
            self.found = files if self.found is None else self.found.unionByName(files)
            open_ = differ.filter("not leaf").select(F.col("path").alias("folder"))
            if open_.isEmpty():
                break
        if self.found is None:
            self.found = old.nodes.select(F.col("name").alias("path"), F.col("name").alias("change")).limit(0)
