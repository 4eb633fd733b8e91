"""Stream operators; each takes and returns a streaming DataFrame, or writes one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomery.operators.folds import applied, then
from loomery.session import shared_dir


def run_to_end(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs the stream over what its source holds and returns the rows it wrote. complete and update modes keep the last batch
    that wrote each row set (complete) or all updates (update). A batch that runs again overwrites its own folder; a stream without
    a batch returns no rows."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    wrote: set[str] = set()

    def write(batch: DataFrame, number: int) -> None:
        at = out if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        wrote.add(at)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}.state").trigger(availableNow=True).foreachBatch(each or write).start()
    q.awaitTermination()
    if each:
        return spark.range(0)
    return spark.read.schema(df.schema).parquet(*sorted(wrote)) if wrote else spark.createDataFrame([], df.schema)


def counts(df: DataFrame, at: str, width: str, *keys: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows in tumbling (or sliding) windows; windows close when the watermark passes them."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return df.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def fan_out(sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one micro-batch as several tables. A batch that is run again overwrites its own folder, so each
    table holds every event once."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, shape in sinks.items():
            shape(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return write


def with_dead_letters(failed: Column, retries: str, folder: str, most: int = 3) -> Callable[[DataFrame, int], None]:
    from loomery.sources.sinks import dead_letters

    def write(batch: DataFrame, number: int) -> None:
        dead_letters(batch, failed, retries, most).write.mode("overwrite").partitionBy("route").parquet(f"{folder}/batch={number}")

    return write


def joined(feedback: DataFrame, records: DataFrame, key: str, at: str, within: str = "1 hour") -> DataFrame:
    """Feedback with the records of its session at most `within` before it; both sides are forgotten past the watermark."""
    a = feedback.withWatermark(at, within).alias("a")
    b = records.withWatermark(at, within).alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{at}") <= F.col(f"a.{at}")) & (F.col(f"b.{at}") >= F.col(f"a.{at}") - F.expr(f"INTERVAL {within}")))


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Newest row of each key. (update or complete mode)"""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("r")).select(key, "r.*")


def rate_limit(df: DataFrame, key: str, item: str, at: str, most: int = 60, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """key, item, allowed: sliding log of the allowed requests of a key; what was blocked does not count. State: at most `most`
    times a key, and none once the watermark has passed the key's last time by the window, when nothing of it can count any more."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, item])
        out = []
        for t, i in zip(rows[at].astype("int64") // 1000, rows[item], strict=True):
            log = [x for x in log if x > t - seconds * 1_000_000]
            ok = len(log) < most
            if ok:
                log.append(int(t))
            out.append((keys[0], i, ok))
        state.update((log,))
        state.setTimeoutTimestamp(max(int(max(log, default=0)) // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, item, "allowed"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    own = df.select(key, item, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    return own.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {item} {kinds[item]}, allowed boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def released(df: DataFrame, shard: str, item: str, most: int = 50, gap: float = 20.0) -> DataFrame:
    """shard, batch, item: a queue for each shard that lets at most `most` items go each `gap` seconds, in the order they came (within a
    micro-batch by item). What waits is state; a timer lets it go, without new rows coming. An empty queue keeps its batch number only."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, batch, last = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, -1)
        if not state.hasTimedOut:
            queue += sorted(int(i) for b in batches for i in b[item])
        now = state.getCurrentProcessingTimeMs()
        wait = 0 if last < 0 else max(0, int(last + 1000 * gap) - now)
        gone = []
        if queue and not wait:
            gone, queue, wait = queue[:most], queue[most:], int(1000 * gap)
            batch, last = batch + 1, now
        state.update((queue, batch, last))
        if queue:
            state.setTimeoutDuration(max(1, wait))
        yield pd.DataFrame({shard: keys[0], "batch": batch, item: gone})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    own = df.select(shard, item)
    return own.groupBy(shard).applyInPandasWithState(run, f"{shard} {kinds[shard]}, batch long, {item} long", "queue array<long>, batch long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_until(df: DataFrame, rows: int, every: str = "200 milliseconds", seconds: float = 120.0, partitions: int | None = None) -> DataFrame:
    """Runs a stream whose timers still have work once its source is read, until it wrote so many rows, however long that takes, and returns
    them. Raises if the stream fails, or writes nothing for so many seconds. A batch that runs again overwrites its own folder. A round costs
    as much as its partitions of state, so a stream of few keys takes as many `partitions` as it has keys."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    wrote: dict[int, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        at = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        wrote[number] = spark.read.schema(df.schema).parquet(at).count()

    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or held))
    try:  # the stream keeps the settings it is started with
        q = df.writeStream.option("checkpointLocation", f"{out}.state").trigger(processingTime=every).foreachBatch(write).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    done, since = 0, time.monotonic()
    try:
        while done < rows:
            q.awaitTermination(0.2)
            if (now := sum(dict(wrote).values())) > done:
                done, since = now, time.monotonic()
            elif not q.isActive or time.monotonic() > since + seconds:
                raise TimeoutError(f"{done} of {rows} rows, and none for {time.monotonic() - since:.0f} s")
    finally:
        q.stop()
    found = [f"{out}/batch={n}" for n in sorted(wrote) if wrote[n]]
    return spark.read.schema(df.schema).parquet(*found) if found else spark.createDataFrame([], df.schema)


def sessions(df: DataFrame, key: str, order: str, text: str, compress: int = 10, keep: int = 4) -> DataFrame:
    """key, turns, summary, kept: past `compress` turns only the last `keep` stay whole, older ones are counted."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, folded, last = state.get if state.exists else (0, 0, [])
        last = list(last)
        for _, row in pd.concat(list(batches)).sort_values(order).iterrows():
            n += 1
            last.append(str(row[text]))
            if len(last) > compress:
                folded += len(last) - keep
                last = last[-keep:]
        state.update((n, folded, last))
        yield pd.DataFrame([(keys[0], n, folded, len(last))], columns=[key, "turns", "folded", "kept"])

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, turns long, folded long, kept long", "n long, folded long, last array<string>", "update", GroupStateTimeout.NoTimeout)


def trust_updates(df: DataFrame, key: str, order: str, positive: str, start: float = 0.5) -> DataFrame:
    """key, trust, low_quality after each batch: the clamped fold of learning.trust, carried on between batches. State: two numbers a
    key; the rows of a batch are one step, put together from the steps of its pieces."""
    from loomery.operators.learning import BLAME, LOW, PRAISE

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[[order, positive]] for b in batches]).sort_values(order)
        step = reduce(then, ((PRAISE if up else -BLAME, 0, 100) for up in rows[positive].to_numpy()))
        value = applied(step, state.get[0] if state.exists else 100 * start)
        low = bool(not rows[positive].iloc[-1] and value < LOW)
        state.update((float(value), low))
        yield pd.DataFrame([(keys[0], value / 100, low)], columns=[key, "trust", "low_quality"])

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, trust double, low_quality boolean", "t double, f boolean", "update", GroupStateTimeout.NoTimeout)


def circuit(df: DataFrame, key: str, order: str, failed: str, most: int = 3) -> DataFrame:
    """key, state after each batch: open once `most` failures came in a row, else closed."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for bad in pd.concat(list(batches)).sort_values(order)[failed]:
            streak = streak + 1 if bad else 0
        state.update((int(streak),))
        yield pd.DataFrame([(keys[0], "open" if streak >= most else "closed")], columns=[key, "state"])

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string", "n long", "update", GroupStateTimeout.NoTimeout)


def debounced(df: DataFrame, keys: list[str], at: str, quiet: str) -> DataFrame:
    return df.withWatermark(at, quiet).dropDuplicatesWithinWatermark(keys)


def latest_record(df: DataFrame, key: str, at: str, item: str, feedback: str) -> DataFrame:
    """key, feedback, record: each feedback row (column `feedback` holds) with the newest record of its key before it, null if
    none came yet. df holds records and feedback alike; rows of a batch are put in order of time and item. State: one item a key."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([at, item])
        seen = rows[item].where(~rows[feedback]).astype("Int64").ffill()
        if state.exists:
            seen = seen.fillna(state.get[0])
        if seen.notna().any():
            state.update((int(seen.dropna().iloc[-1]),))
        told = rows[feedback]
        yield pd.DataFrame({key: keys[0], "feedback": rows[item][told], "record": seen[told]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    own = df.select(key, item, F.col(at).cast("timestamp").alias(at), feedback)
    return own.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, feedback {kinds[item]}, record long", "r long", "append", GroupStateTimeout.NoTimeout)


def newest(df: DataFrame, key: str, at: str, item: str, most: int = 10_000) -> DataFrame:
    """version, key, at, item: after each batch what a cache of `most` keys holds, the newest row of each; the key that was renewed
    least lately goes first (ties: the larger key). State: `most` rows in one group, to which a task of the source sends its `most` newest keys only."""

    def latest_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, item]).drop_duplicates(key, keep="last")
        return rows.sort_values([at, key], ascending=[False, True]).head(most)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = latest_of(b if held is None else pd.concat([held, b]))
        if held is not None:
            yield held

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = None, 1
        if state.exists:
            *columns, version = state.get
            held, version = pd.DataFrame(dict(zip((key, at, item), map(list, columns), strict=True))), version + 1
        for b in batches:
            b = b.drop(columns="_all")
            held = latest_of(b if held is None else pd.concat([held, b]))
        held = held.sort_values([at, key], ascending=[False, True])
        state.update((held[key].tolist(), held[at].tolist(), held[item].tolist(), version))
        yield held.assign(version=version)[["version", key, at, item]]

    kind = df.schema[key].dataType.simpleString()
    own = df.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias(at), F.col(item).cast("long").alias(item))
    small = own.mapInPandas(reduced, own.schema).withColumn("_all", F.lit(0))
    return small.groupBy("_all").applyInPandasWithState(run, f"version long, {key} {kind}, {at} long, {item} long", f"k array<{kind}>, t array<long>, i array<long>, version long", "append", GroupStateTimeout.NoTimeout)


def micro_batches(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of JSON files, `files` a batch; with buffered files of 50 rows and a trigger of 20 seconds, 50 rows each 20 s."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def dispatch(handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str, folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of each kind go to its handler's table, those of no handler to `unhandled`."""
    own = {name: lambda b, name=name, f=f: f(b.filter(F.col(kind) == name)) for name, f in handlers.items()}
    rest = lambda b: b.filter(~F.coalesce(F.col(kind).isin(list(handlers)), F.lit(False)))
    return fan_out({**own, "unhandled": rest}, folder)
