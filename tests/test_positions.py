"""Places in groups and lines of files, against plain counting."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.operators import joins, orchestration, positions, ranking


def test_places_equal_a_window_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.randint(0, 50), i) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, j string, v long, i long").repartition(5)
    got = positions.placed(df, ["k", "j"], [F.desc("v"), F.col("i")], "place", "n")
    w = Window.partitionBy("k", "j")
    want = df.withColumn("place", F.row_number().over(w.orderBy(F.desc("v"), "i")).cast("long")).withColumn("n", F.count("*").over(w))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert positions.placed(df.limit(0), ["k"], [F.col("i")]).collect() == []


def test_split_of_one_large_stratum(spark):
    df = spark.range(5000).select("id", F.lit("s").alias("s"))
    got = {r["part"]: r["count"] for r in ranking.split(df, ["s"], "id").groupBy("part").count().collect()}
    assert got == {"train": 3500, "validation": 750, "holdout": 750}


def test_leftovers_are_paired_within_the_wider_key(spark):
    good = spark.createDataFrame([("i", "a", 1), ("i", "a", 2), ("i", "b", 3), ("j", "a", 4)], "i string, e string, id long")
    bad = spark.createDataFrame([("i", "a", 11), ("i", "c", 12), ("i", "c", 13), ("k", "a", 14)], "i string, e string, id long")
    got = joins.kth_pairs(good, bad, ["i", "e"], [F.col("id")], [F.col("id")], "id", ["i"]).collect()
    assert sorted((r["i"], r["e"], r["k"], r["chosen"], r["rejected"], r["pass"]) for r in got) == [("i", "a", 1, 1, 11, "key"), ("i", "a", 1, 2, 12, "wider"), ("i", "b", 2, 3, 13, "wider")]


def test_lines_of_files_read_in_many_blocks(spark, tmp_path):
    rng = random.Random(2)
    for name, n in (("a", 3000), ("b", 1), ("c", 0), ("d", 500)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}:{i} {'x' * rng.randint(0, 60)}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        df = spark.read.text(str(tmp_path))
        assert df.rdd.getNumPartitions() > 20
        got = [(r["value"].split(" ")[0], r["_file"].rsplit("/", 1)[-1][0], r["_line"]) for r in positions.numbered_lines(df).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == 3501 and all(v == f"{f}:{n}" for v, f, n in got)


def test_history_compares_each_version_with_the_one_before(spark):
    rows = [(1, "a", 1), (1, "b", 1), (2, "a", 2), (2, "c", 1), (3, "a", 2), (5, "a", 2)]
    got = {r["version"]: (r["added"], r["modified"], r["removed"], r["same"]) for r in orchestration.history(spark.createDataFrame(rows, "v int, k string, h long"), "v", "k", "h", 4).collect()}
    assert got == {2: (1, 1, 1, 0), 3: (0, 0, 1, 1), 4: (0, 0, 1, 0), 5: (1, 0, 0, 0)}
