"""Joins of chunks, entities, edges, runs and records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.operators.positions import placed
from loomery.session import written


def co_members(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct (left target, right target) that share a source: edges joined with edges on source_id."""
    a = edges.filter(F.col("edge_type") == left).select("source_id", F.col("target_id").alias("left_id"))
    b = edges.filter(F.col("edge_type") == right).select("source_id", F.col("target_id").alias("right_id"))
    return a.join(b, "source_id").select("left_id", "right_id").distinct()


def first_match(rows: DataFrame, key: str, candidates: Column, lookup: DataFrame, value: str, node: str, keep: bool = False) -> DataFrame:
    """For each key the node of the first candidate that the lookup knows (candidates: an array in order of preference)."""
    tried = rows.select(key, F.posexplode(candidates).alias("pos", value)).join(lookup.select(value, node), value)
    best = tried.groupBy(key).agg(F.min_by(node, F.struct("pos", node)).alias(node), F.min("pos").alias("pos"))
    return rows.select(key).join(best, key, "left") if keep else best


def changed(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of new whose (key, digest) old does not have."""
    return new.join(old.select(key, digest).distinct(), [key, digest], "left_anti")


def snapshot_diff(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: new, modified, deleted or unchanged."""
    a, b = new.select(key, F.col(digest).alias("after")), old.select(key, F.col(digest).alias("before"))
    return a.join(b, key, "full").select(key, F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged").alias("change"))


def contains_part(labels: DataFrame, label: str, names: DataFrame, name: str, separator: str = r"\.") -> DataFrame:
    """label, name where the name is one of the label's parts, each pair once however often the label or the name comes: parts are
    exploded, so this is an equi-join."""
    parts = labels.select(label, F.explode(F.array_distinct(F.split(label, separator))).alias(name))
    return parts.join(names.select(name), name).select(label, name).distinct()


def _matcher(needles: list[str], at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle in needles:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        for x in batches:
            found = [sorted({n for _, n in automaton.iter(t)}) if t else [] for t in x.column(at).to_pylist()]
            rows = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in x.columns), pa.array([n for own in found for n in own], pa.string())], [*x.schema.names, name])

    return run


def contains_text(long: DataFrame, text: str, short: DataFrame, needle: str, block: int = 50_000) -> DataFrame:
    """Rows of long, with the rows of short whose needle their text contains.

    short is a query set: its distinct needles go to the executors in blocks of stated size, each an automaton that reads a
    text once whatever the number of needles, so no pair is tried. Null and empty needles match nothing.
    """
    distinct = short.select(needle).filter(F.length(needle) > 0).distinct()
    blocks: list[list[str]] = [[]]
    for row in distinct.toLocalIterator():
        if len(blocks[-1]) >= block:
            blocks.append([])
        blocks[-1].append(row[0])
    at = long.columns.index(text)
    parts = [long.mapInArrow(_matcher(b, at, "_needle"), T.StructType([*long.schema.fields, T.StructField("_needle", T.StringType())])) for b in blocks]
    return reduce(DataFrame.unionByName, parts).join(short.withColumnRenamed(needle, "_needle"), "_needle").withColumn(needle, F.col("_needle")).drop("_needle")


def bridge(tables: DataFrame, apis: DataFrame, domain: str, name: str, body: str, cap: int = 5) -> DataFrame:
    """name, apis: up to `cap` apis of the same domain, else up to `cap` whose text holds the name."""
    own = tables.select(name, domain).join(apis.select(F.col(name).alias("api"), domain), domain).select(name, "api")
    rest = tables.join(own.select(name).distinct(), name, "left_anti")
    other = contains_text(apis.select(F.col(name).alias("api"), F.col(body).alias("_text")), "_text", rest.select(name), name).select(name, "api")
    x = own.unionByName(other).withColumn("rn", F.row_number().over(Window.partitionBy(name).orderBy("api"))).filter(F.col("rn") <= cap)
    return x.groupBy(name).agg(F.array_join(F.array_sort(F.collect_list("api")), ",").alias("apis"))


def kth_pairs(good: DataFrame, bad: DataFrame, keys: list[str], order_good: list[Column], order_bad: list[Column], payload: str, wider: list[str] | None = None) -> DataFrame:
    """keys, k, chosen, rejected: the k-th best good row with the k-th worst bad row of each key, unless they are equal.

    With `wider` keys, what either side has left over is paired once more within those; the keys are then those of the good row. Rows are
    numbered by position, so a key may hold any share of them. The payload is a key of its rows.
    """

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a = placed(a, on, order_good, "k").withColumn("chosen", F.col(payload)).select(*keys, "k", "chosen")
        b = placed(b, on, order_bad, "k").select(*on, "k", F.col(payload).alias("rejected"))
        return a.join(b, [*on, "k"]).select(*keys, "k", "chosen", "rejected")

    found = met(good, bad, keys)
    if wider:
        found = written(found)
        left = good.join(found.select(F.col("chosen").alias(payload)), payload, "left_anti")
        right = bad.join(found.select(F.col("rejected").alias(payload)), payload, "left_anti")
        found = found.withColumn("pass", F.lit("key")).unionByName(met(left, right, wider).withColumn("pass", F.lit("wider")))
    return found.filter(F.col("chosen") != F.col("rejected"))


def compare_runs(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """change of each common test case: improved, regressed, or neither."""
    a, b = base.select(key, F.col("passed").alias("before")), other.select(key, F.col("passed").alias("after"))
    return a.join(b, key).select(key, F.when(~F.col("before") & F.col("after"), "improved").when(F.col("before") & ~F.col("after"), "regressed").otherwise("same").alias("change"))


def latest_before(events: DataFrame, records: DataFrame, key: str, event: str, at: str, record: str) -> DataFrame:
    """event, record: the latest record of the key not after the event (as-of join): both sides are put in one order and the
    last record seen is carried on, so a key's records are never paired with all its events."""
    a = events.select(key, F.col(at).alias("t"), F.col(event).alias("e"), F.lit(None).cast(records.schema[record].dataType).alias("r"), F.lit(1).alias("o"))
    b = records.select(key, F.col(at).alias("t"), F.lit(None).cast(events.schema[event].dataType).alias("e"), F.col(record).alias("r"), F.lit(0).alias("o"))
    w = Window.partitionBy(key).orderBy("t", "o", F.col("r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("last", F.last("r", ignorenulls=True).over(w)).filter("o = 1").select(F.col("e").alias(event), F.col("last").alias(record))


def neighbours(hits: DataFrame, chunks: DataFrame, parent: str, index: str, item: str, window: int = 2, parents: int = 5, most: int = 10) -> DataFrame:
    """parent, index, item of chunks within `window` of a hit, without the hits, for the best parents of a query.

    The range becomes an equi-join: each hit names the indexes around it.
    """
    near = hits.filter(F.col("parent_rank") <= parents).select(parent, F.explode(F.sequence(F.col(index) - window, F.col(index) + window)).alias(index)).distinct()
    near = near.join(hits.select(parent, index), [parent, index], "left_anti")
    found = chunks.select(parent, index, item).join(near, [parent, index])
    return found.withColumn("rn", F.row_number().over(Window.partitionBy(parent).orderBy(index, item))).filter(F.col("rn") <= most).drop("rn")


def parents_of(hits: DataFrame, chunks: DataFrame, query: str, rank: str, item: str, parent: str, most: int = 3) -> DataFrame:
    """query, parent: parents of the hits, best first, not hits themselves, at most `most` a query."""
    x = hits.join(chunks.select(item, parent), item).groupBy(query, parent).agg(F.min(rank).alias(rank))
    x = x.join(hits.select(query, F.col(item).alias(parent)), [query, parent], "left_anti")
    return x.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(rank, parent))).filter(F.col("position") <= most).select(query, parent, "position")


def chains(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """source, middle, target: ranked -> unranked -> ranked in two steps, and ranked -> ranked in one (middle null)."""
    r = ranked.select(F.col(ranked.columns[0]).alias("n")).distinct()
    e = edges.select("source_id", "target_id").distinct()
    out = e.join(r.select(F.col("n").alias("source_id")), "source_id", "left_semi")
    into = e.join(r.select(F.col("n").alias("target_id")), "target_id", "left_semi")
    direct = out.join(r.select(F.col("n").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("source"), F.lit(None).cast(edges.schema["target_id"].dataType).alias("middle"), F.col("target_id").alias("target"))
    first = out.join(r.select(F.col("n").alias("target_id")), "target_id", "left_anti").select(F.col("source_id").alias("source"), F.col("target_id").alias("middle"))
    two = first.join(into.select(F.col("source_id").alias("middle"), F.col("target_id").alias("target")), "middle").filter("source <> target")
    return direct.unionByName(two.select("source", "middle", "target")).distinct()


def either_end(edges: DataFrame, key: str = "id") -> DataFrame:
    """Each edge once from either end: an OR-join on two columns becomes one equi-join on this."""
    return edges.select(F.col("source_id").alias(key), F.col("target_id").alias("other"), "edge_type").unionByName(edges.select(F.col("target_id").alias(key), F.col("source_id").alias("other"), "edge_type"))


def hub(base: DataFrame, key: str, sections: dict[str, DataFrame]) -> DataFrame:
    """key, body: the sections' texts of each key in order, empty ones left out."""
    out = base.select(key).distinct()
    for name, df in sections.items():
        out = out.join(df.select(key, F.concat(F.lit(f"{name}: "), F.nullif(F.col("text"), F.lit(""))).alias(name)), key, "left")
    return out.select(key, F.concat_ws("\n", *sections).alias("body"))


def last_of_array(df: DataFrame, key: str, array: str, n: int, lookup: DataFrame, value: str) -> DataFrame:
    """key and lookup row for each of the last n items of an array."""
    tail = F.slice(array, F.greatest(F.lit(1), F.size(array) - (n - 1)), n)
    return df.filter(F.size(array) > 0).select(key, F.explode(tail).alias(value)).join(lookup, value)
