"""Streams of receipts, probes, downloads and log entries: daily windows, late data, deduplication, keyed state, incremental views."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunklake.common import scratch

#: How long a day stays open, the gap between probes, what a batch of receipts may hold.
DAY_OPEN, PROBE_GAP, BATCH = "2 days", 60, 100


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder (or one file) of Parquet as a stream; the schema is read from it once."""
    now = spark.read.parquet(path)
    r = spark.readStream.schema(now.schema)
    parent, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in now.inputFiles()[:1]):  # one file: its folder, filtered to it
        path, r = parent, r.option("pathGlobFilter", name)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def event_time(df: DataFrame, seconds: str, delay: str = DAY_OPEN) -> DataFrame:
    return df.withColumn("at", F.timestamp_seconds(F.col(seconds))).withWatermark("at", delay)


def daily(df: DataFrame, by: list[str], **aggs: F.Column) -> DataFrame:
    """Tumbling windows of one UTC day; a day is final when the watermark has passed it by two days."""
    return df.groupBy(F.window("at", "1 day"), *by).agg(*[c.alias(k) for k, c in aggs.items()]).withColumn("day", F.to_date("window.start")).drop("window")


def hourly(df: DataFrame, by: list[str], **aggs: F.Column) -> DataFrame:
    return df.groupBy(F.window("at", "1 hour"), *by).agg(*[c.alias(k) for k, c in aggs.items()]).withColumn("hour", F.col("window.start")).drop("window")


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key among those within the watermark of each other."""
    return df.dropDuplicatesWithinWatermark(keys)


def once_a_day(df: DataFrame, keys: list[str], seconds: str, open_for: str = DAY_OPEN) -> DataFrame:
    """One row per key and day: downloads count once per name, network and day. Only the keys are kept, and only while their day is open."""
    day = F.timestamp_seconds(F.col(seconds) - F.pmod(F.col(seconds), F.lit(86400)))
    return df.withColumn("day_at", day).withWatermark("day_at", open_for).dropDuplicates([*keys, "day_at"])


def latest(df: DataFrame, keys: list[str], order: str, values: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Keyed upserts: the latest values per key, emitted whenever they change; state is dropped after ttl_ms without a row."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join(f"{c} {fields[c]}" for c in [*keys, order, *values])
    shape = ", ".join(f"{c} {fields[c]}" for c in [order, *values])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        changed = False
        for f in frames:
            for row in f[[order, *values]].itertuples(index=False, name=None):
                if best is None or row[0] > best[0]:
                    best, changed = row, True
        if changed:
            state.update(tuple(None if pd.isna(x) else x for x in best))
            yield pd.DataFrame([[*key, *best]], columns=[*keys, order, *values])
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(step, out, shape, "update", timeout)


def min_gap(df: DataFrame, keys: list[str], t: str, gap: int = PROBE_GAP, order: str | None = None, at: str = "at") -> DataFrame:
    """Rows at least `gap` seconds after the last accepted row of their keys, in order of event time, however the rows are batched.

    df: with a watermark on `at`. Rows wait in the state until the watermark has passed them, as an earlier one may still come; then
    they are judged in order of time (ties by `order`). Rows behind the watermark when they come are too late and are dropped. The state of a
    pair is its waiting rows and its last accepted time, and goes when nothing waits and the gap is over."""
    cols = [c for c in df.columns if c != at]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join(f"{c} {fields[c]}" for c in cols)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = None, pd.DataFrame(columns=cols)
        if state.exists:
            last, held = state.get
            waiting = pd.DataFrame(json.loads(held), columns=cols)
        passed = state.getCurrentWatermarkMs() / 1000
        if not state.hasTimedOut:
            came = pd.concat([f[cols] for f in frames])
            came = came[came[t].notna() & (came[t] >= passed)]
            waiting = pd.concat([waiting, came]) if len(waiting) else came
        waiting = waiting.sort_values([t, order] if order else [t])
        ready, waiting = waiting[waiting[t] < passed], waiting[waiting[t] >= passed]
        keep = []
        for x in ready[t]:
            ok = last is None or x - last >= gap
            last = int(x) if ok else last
            keep.append(ok)
        if len(waiting) or last is not None and last + gap > passed:
            state.update((last, json.dumps(waiting.astype(object).where(waiting.notna(), None).values.tolist(), default=int)))
            due = waiting[t].iloc[0] if len(waiting) else last + gap
            state.setTimeoutTimestamp(max(int(due * 1000), int(passed * 1000) + 1))
        elif state.exists:
            state.remove()
        if any(keep):
            yield ready[keep][cols].astype({c: "int64" for c in cols if fields[c] in ("bigint", "int") and ready[c].notna().all()})

    return df.groupBy(*keys).applyInPandasWithState(step, out, "last long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def follow(entries: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch goes to `apply` (a view's incremental step) exactly once per checkpoint."""
    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; an error of the file system is an error, not an absence."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def with_retry(send: Callable[[DataFrame], DataFrame], keep_seconds: int, queue: str) -> Callable[[DataFrame, int], None]:
    """A batch function that sends rows together with those that failed before and are younger than keep_seconds; what fails again waits in `queue`.

    send gives the rows that failed. The queue of batch n is a table of its own, so a repeated batch finds what it found first."""

    def batch(df: DataFrame, n: int) -> None:
        spark, before = df.sparkSession, f"{queue}/{n - 1}"
        waiting = spark.read.schema(df.schema).parquet(before) if n and _there(spark, before) else df.limit(0)
        newest = df.agg(F.max("time")).first()[0]
        all_rows = df.unionByName(waiting.filter(F.col("time") > (newest or 0) - keep_seconds))
        send(all_rows).write.mode("overwrite").parquet(f"{queue}/{n}")

    return batch


def run(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all there is now into a table in the shared folder, and give that table."""
    spark = df.sparkSession
    out = scratch(spark, name)
    schema = df.schema
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out) if mode == "append" else spark.read.option("basePath", out).parquet(out)
