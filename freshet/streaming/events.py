"""Operators on event streams: rates, histograms, rolling means, throttled warnings, scoring, alerts, progress and outcomes.

Each takes and returns a streaming DataFrame with event time ``ts``; watermarks
bound the state. ``drained`` runs one over slices of a table that arrive in turn.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.scratch import shared_folder

LATE = "10 minutes"


def drained(spark: SparkSession, slices: list[DataFrame], operator: Callable[..., DataFrame], mode: str = "append", others: list[list[DataFrame]] | None = None) -> DataFrame:
    """All rows that ``operator`` puts out, with their ``batch``, when slices arrive one after the other and each is worked off.

    A batch's rows go to a folder of its own, so a batch that is run again
    replaces what it wrote. ``others``: slices of further input streams. State is
    kept by RocksDB, so it may outgrow an executor's memory.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = shared_folder(spark, "stream")
    inputs = [slices, *(others or [])]

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    streams = []
    for k, parts in enumerate(inputs):
        parts[0].limit(0).write.mode("append").parquet(f"{folder}/in{k}")
        streams.append(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in{k}"))
    for n in range(len(slices)):
        for k, parts in enumerate(inputs):
            parts[n].write.mode("append").parquet(f"{folder}/in{k}")
        made = operator(*streams)
        query = made.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of update-mode batches the last of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return got.select(*keys, *[f"x.{c}" for c in rest])


def request_rate(events: DataFrame, key: str) -> DataFrame:
    """Requests a second over five minutes, every minute: key, start, rate."""
    w = F.window("ts", "5 minutes", "1 minute")
    got = events.withWatermark("ts", LATE).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("window.start").alias("start"), (F.col("n") / 300).alias("rate"))


def predictions_per_hour(scored: DataFrame) -> DataFrame:
    """Predictions of each hour by risk level: level, start, n."""
    got = scored.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), "level").agg(F.count(F.lit(1)).alias("n"))
    return got.select("level", F.col("window.start").alias("start"), "n")


def duration_histogram(events: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """Counts up to each bound, all, and the sum, by key and hour."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    got = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), key).agg(*buckets, F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(key, F.col("window.start").alias("start"), *[f"le_{i}" for i in range(len(bounds))], "n", "total")


class _Rolling(StatefulProcessor):
    """The last ``n`` values by time of each key of a bucket, packed as one state value; no more than a frame is held besides."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "packed binary")

    def _last(self, x: pd.DataFrame) -> pd.DataFrame:
        """Rows that stay, each key's together and by time and value."""
        codes = pd.factorize(x["k"], use_na_sentinel=False)[0]
        order = np.lexsort((x["v"], x["at"], codes))
        ends = np.cumsum(np.bincount(codes))
        return x.iloc[order[ends[codes[order]] - np.arange(len(x)) <= self.n]]

    def handleInputRows(self, key, rows, timerValues):
        import pyarrow as pa

        fields = pa.schema([("k", pa.string()), ("at", pa.int64()), ("v", pa.float64())])
        kept = pa.ipc.open_stream(self.kept.get()[0]).read_pandas() if self.kept.exists() else None
        came = set()
        for frame in rows:
            came.update(None if pd.isna(k) else k for k in frame["k"].unique())
            new = frame[["k", "at", "v"]]
            kept = self._last(new if kept is None else pd.concat([kept, new], ignore_index=True))
        if not came:
            return
        packed = pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, fields) as out:
            out.write_table(pa.Table.from_pandas(kept, fields, preserve_index=False))
        self.kept.update((packed.getvalue().to_pybytes(),))
        codes, keys = pd.factorize(kept["k"], use_na_sentinel=False)
        seen = np.bincount(codes)
        means = np.bincount(codes, kept["v"]) / seen
        got = [(k, n, m) for k, n, m in zip((None if pd.isna(k) else k for k in keys), seen.tolist(), means.tolist(), strict=True) if k in came]
        if got:
            yield pd.DataFrame(got, columns=["k", "seen", "mean"])


class _Throttle(StatefulProcessor):
    """Times of a kind wait until the watermark has passed them, so that late ones take their place; then those that fire go out.

    They wait by the hour, packed: a task holds ``TOGETHER`` new times of a kind
    at most, and those of one hour, whatever number waits.
    """

    HOUR, TOGETHER = 3_600_000_000, 1 << 18

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getMapState("waiting", "hour long", "times binary")

    def _wait(self, parts: list[np.ndarray]) -> None:
        times = np.unique(np.concatenate(parts))
        hours = times // self.HOUR
        for hour, own in zip(np.unique(hours).tolist(), np.split(times, np.flatnonzero(np.diff(hours)) + 1), strict=True):
            if self.waiting.containsKey((hour,)):
                own = np.union1d(np.frombuffer(self.waiting.getValue((hour,))[0], np.int64), own)
            self.waiting.updateValue((hour,), (own.tobytes(),))

    def handleInputRows(self, key, rows, timerValues):
        parts, held, first = [], 0, None
        for frame in rows:
            if frame.empty:
                continue
            parts.append(_micros(frame["ts"]))
            held += len(parts[-1])
            low = int(parts[-1].min())
            first = low if first is None else min(first, low)
            if held >= self.TOGETHER:
                self._wait(parts)
                parts, held = [], 0
        if parts:
            self._wait(parts)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last, next_one = (int(self.last.get()[0]) if self.last.exists() else None), None
        for hour in sorted(int(h) for (h,) in self.waiting.keys()):
            if hour * self.HOUR >= passed:
                next_one = int(np.frombuffer(self.waiting.getValue((hour,))[0], np.int64)[0])
                break
            times = np.frombuffer(self.waiting.getValue((hour,))[0], np.int64)
            times, rest = np.split(times, [np.searchsorted(times, passed)])
            fired, at = [], 0 if last is None else int(np.searchsorted(times, last + self.quiet))
            while at < len(times):
                last = int(times[at])
                fired.append(last)
                at = int(np.searchsorted(times, last + self.quiet))
            if len(rest):
                self.waiting.updateValue((hour,), (rest.tobytes(),))
            else:
                self.waiting.removeKey((hour,))
            if fired:
                yield pd.DataFrame({"kind": [key[0]] * len(fired), "at": fired})
            if len(rest):
                next_one = int(rest[0])
                break
        if last is not None and (next_one is not None or passed < last + self.quiet):
            self.last.update((last,))
        else:
            self.last.clear()  # a quiet kind leaves nothing
        if next_one is not None:
            self.handle.registerTimer(next_one // 1000 + 1)
        elif self.last.exists():
            self.handle.registerTimer((last + self.quiet) // 1000 + 1)


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def rolling_mean(events: DataFrame, key: str, value: str, n: int = 1000, buckets: int = 1024) -> DataFrame:
    """After each batch the mean of a key's last ``n`` values by time: key, seen, mean. A key's state is ``n`` values.

    Keys are dealt to so many ``buckets``, each with one state: a call costs some milliseconds, whatever number of keys
    it serves. A task holds the state of one bucket. Keys go through text and back.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col("ts").isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col(value).cast("double").alias("v"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets))).groupBy("bucket")
    got = dealt.transformWithStateInPandas(_Rolling(n), "k string, seen int, mean double", "update", "none")
    return got.select(F.col("k").cast(kind).alias(key), "seen", "mean")


def throttled_warnings(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Warnings (kind, ts) that fire: the first, and those ``minutes`` or more after the last of their kind that fired.

    They fire once the watermark has passed them, in the order of their times,
    whatever order they came in. A kind's state is its waiting times by the hour and the
    last that fired; it goes once the watermark has passed that by the quiet time.
    """
    rows = events.select("kind", "ts").withWatermark("ts", LATE).groupBy("kind")
    return rows.transformWithStateInPandas(_Throttle(minutes * 60_000_000), "kind string, at long", "append", "eventtime")


def score_stream(requests: DataFrame, score, enrich: Callable[[DataFrame], DataFrame], lookup: DataFrame, key: str) -> DataFrame:
    """Requests with their score (a Column), what ``enrich`` adds, and a static table's row of their key."""
    return enrich(requests.withColumn("score", score)).join(lookup, key, "left")


def alert_stream(scores: DataFrame) -> DataFrame:
    """Alerts of check results (component, ts, score), once for each component and time within the watermark."""
    severity = F.when(F.col("score") < 0.6, "critical").when(F.col("score") < 0.8, "warning")
    alerts = scores.withWatermark("ts", LATE).withColumn("severity", severity).where("severity is not null")
    return alerts.dropDuplicatesWithinWatermark(["component", "ts"]).select("component", "ts", "severity")


def batch_progress(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Jobs done of each batch (batch_id) against its total, as results arrive."""
    done = results.groupBy("batch_id").agg(F.count(F.lit(1)).alias("completed"))
    return done.join(totals, "batch_id").select("batch_id", "completed", "total", (F.col("completed") / F.col("total")).alias("share"))


def prediction_outcomes(predictions: DataFrame, actuals: DataFrame, within: str = "1 hour") -> DataFrame:
    """Predictions (id, ts, predicted) with the actual value (id, ts, actual) that came within a time, null where none did."""
    p = predictions.withWatermark("ts", LATE)
    a = actuals.select(F.col("id").alias("a_id"), F.col("ts").alias("a_ts"), "actual").withWatermark("a_ts", LATE)
    on = F.expr(f"id = a_id and a_ts >= ts and a_ts <= ts + interval {within}")
    return p.join(a, on, "left_outer").select("id", "ts", "predicted", "actual")
