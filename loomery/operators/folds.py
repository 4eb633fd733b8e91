"""Ordered folds of clamped steps, as partial aggregates.

A step x -> min(high, max(low, x + add)) followed by another is a step of the same kind, so any run of steps is three numbers. Rows are dealt
by ranges of key and order; a task turns each run of a key into one step, and the few steps of a key are applied in order. No history
comes together in an array or a task, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = tuple[float, float, float]


def then(first: Step, second: Step) -> Step:
    """(add, low, high) of the first step followed by the second."""
    (a, low, high), (b, least, most) = first, second
    clamp = lambda x: min(most, max(least, x))
    return a + b, clamp(low + b), clamp(high + b)


def applied(step: Step, value: float) -> float:
    return min(step[2], max(step[1], value + step[0]))


def _runs(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "at", "add", "low", "high", "last"]
        part, held, step, last = TaskContext.get().partitionId(), None, None, None

        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [kind, pa.int32(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for x in batches:
            out = []
            for key, *own in zip(*(x.column(i).to_pylist() for i in range(4)), strict=True):
                own = tuple(own)
                if step is not None and key == held:
                    step, last = then(step, own), own[0]
                else:
                    if step is not None:
                        out.append((held, part, *step, last))
                    held, step, last = key, own, own[0]
            if out:
                yield batch(out)
        if step is not None:
            yield batch([(held, part, *step, last)])

    return run


def clamped(df: DataFrame, key: str, order: list[str], add: Column, low: Column, high: Column, start: float) -> DataFrame:
    """key, value, last (what the last step adds) after the key's steps in order, from `start`. Rows that tie in the order must be equal
    steps for a defined result; a null key is a key; an empty table gives no rows."""
    numbers = [c.cast("double").alias(n) for c, n in ((add, "add"), (low, "low"), (high, "high"))]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(order)], *numbers)
    by = ["key", *[f"by_{i}" for i in range(len(order))]]
    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "add", "low", "high")
    from pyspark.sql.pandas.types import to_arrow_type

    runs = dealt.mapInArrow(_runs(to_arrow_type(rows.schema["key"].dataType)), f"key {kind}, at int, add double, low double, high double, last double")
    steps = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "add", "low", "high", "last"))).alias("steps"))
    value = F.aggregate("steps", F.lit(float(start)), lambda v, s: F.least(s["high"], F.greatest(s["low"], v + s["add"])))
    return steps.select(F.col("key").alias(key), value.alias("value"), F.element_at("steps", -1)["last"].alias("last"))
