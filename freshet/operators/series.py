"""Histories, trends, roll-ups and provenance. Windows are partitioned by a run, a component or a host."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Rounds
from .ranges import with_quantiles


def _slope(y: Column, x: Column, w) -> Column:
    """Least-squares slope within a window; 0 for a single x."""
    spread = F.var_pop(x).over(w)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y).over(w), spread)).otherwise(0.0)


def training_trend(history: DataFrame, last: int = 5, flat: float = 0.01) -> DataFrame:
    """``run_id, epoch, converged, overfit`` of (run_id, epoch, train_loss, val_loss), over the last epochs up to each.

    converged: the validation losses spread less than ``flat``; overfit: they
    rise while training losses fall. False before there are ``last`` epochs.
    """
    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(1 - last, 0)
    full = F.count(F.lit(1)).over(w) == last
    x = F.col("epoch").cast("double")
    flat_ = F.stddev_pop("val_loss").over(w) < flat
    worse = (_slope(F.col("val_loss"), x, w) > 0) & (_slope(F.col("train_loss"), x, w) < 0)
    return history.select("run_id", "epoch", (full & flat_).alias("converged"), (full & worse).alias("overfit"))


def convergence(residuals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``run_id, rate, final, converged`` of (run_id, step, residual); the rate, of log10 residuals, needs more than five points."""
    y, x = F.log10(F.col("residual") + 1e-15), F.col("step").cast("double")
    got = residuals.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.max_by("residual", "step").alias("final")
    )
    rate = F.when((F.col("n") > 5) & (F.col("v") > 0), F.try_divide("c", "v"))
    return got.select("run_id", rate.alias("rate"), "final", (F.col("final") < tolerance).alias("converged"))


def recent_decline(scores: DataFrame, days: int = 7, fall: float = 0.1) -> DataFrame:
    """Keys whose last three scores within ``days`` of their newest all fall, by more than ``fall`` together: component, ts, score, fall."""
    newest = Window.partitionBy("component")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("ts")))
    near = scores.withColumn("top", F.max("ts").over(newest)).where(F.col("ts") >= F.col("top") - F.expr(f"INTERVAL {days} DAYS"))
    last = near.withColumn("rank", rank).where("rank <= 3").groupBy("component")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    got = last.agg(F.max("ts").alias("ts"), at(1).alias("score"), at(2).alias("before"), at(3).alias("first"))
    down = F.round(F.col("first") - F.col("score"), 9)
    return got.where((F.col("score") < F.col("before")) & (F.col("before") < F.col("first")) & (down > fall)).select("component", "ts", "score", down.alias("fall"))


def retention(records: DataFrame, keep: int, days: int, now: Column) -> DataFrame:
    """Records (pipeline, ts, size) with ``rank`` and whether they go: older than ``days`` before ``now``, else past the newest max(keep, 2)."""
    rank = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("ts"), "size"))
    old = F.col("ts") < now - F.expr(f"INTERVAL {days} DAYS")
    return records.withColumn("rank", rank).withColumn("dropped", old | (F.col("rank") > max(keep, 2)))


def recovery_options(points: DataFrame, stages: list[str]) -> DataFrame:
    """Each pipeline's newest point of each stage (pipeline, stage, ts): its place from the furthest, remaining stages, share saved."""
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")).cast("int")
    got = points.where(F.col("stage").isin(stages)).groupBy("pipeline", "stage").agg(F.max("ts").alias("ts"))
    got = got.withColumn("order", order)
    place = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("order"), F.desc("ts")))
    rest = F.array_join(F.slice(F.array(*[F.lit(s) for s in stages]), F.col("order") + 1, F.lit(len(stages))), ",")
    return got.select("pipeline", "stage", "ts", place.alias("place"), rest.alias("remaining"), (F.col("order") / len(stages) * 100).alias("saved_percent"))


def resource_trend(samples: DataFrame, minutes: int, now: Column) -> DataFrame:
    """Samples (host, ts, ...) of the last ``minutes`` before ``now``; of a host without any, the last one."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("ts")))
    recent = F.col("ts") >= now - F.expr(f"INTERVAL {minutes} MINUTES")
    return samples.withColumn("rank", rank).where(recent | (F.col("rank") == 1)).drop("rank")


_FAN = 64


def _ends(at: np.ndarray, following: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Where the chains from ``starts`` (places in ``at``) first leave the group's time, -1 where they break off."""
    to, out = np.searchsorted(at, following), np.empty(len(starts), np.int64)
    now, open_ = starts.copy(), np.arange(len(starts))
    while len(open_):
        there = following[now[open_]]
        gone = (there < 0) | (there >= end)
        out[open_[gone]] = there[gone]
        now[open_] = to[now[open_]]
        open_ = open_[~gone]
    return out


def _chains(times: DataFrame, gap: int) -> DataFrame:
    """``kind, at, next, root`` of distinct times (kind, at from 0): the first time ``gap`` or more later, and whether a time fires whatever fired before.

    Buckets are as long as the gap, so what follows a time stands in the next
    bucket or is the first of the one after; a first time behind an empty bucket
    fires in any case.
    """
    same = lambda x, y, *on: x["kind"].eqNullSafe(y["k2"]) & on[0]
    bucket = lambda c: F.floor(F.col(c) / gap)
    firsts = times.groupBy("kind", bucket("at").alias("bucket")).agg(F.min("at").alias("first"))
    asked = times.select("kind", F.col("at").alias("asks"), (F.col("at") + gap).alias("key")).unionByName(times.select("kind", F.lit(None).cast("long").alias("asks"), F.col("at").alias("key")))
    asked = asked.withColumn("bucket", bucket("key"))
    w = Window.partitionBy("kind", "bucket").orderBy(F.desc("key"), F.asc_nulls_first("asks")).rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("next", F.last_value(F.when(F.col("asks").isNull(), F.col("key")), ignoreNulls=True).over(w)).where("asks is not null")
    after = firsts.select(F.col("kind").alias("k2"), (F.col("bucket") - 1).alias("b2"), F.col("first").alias("later"))
    found = asked.join(after, same(asked, after, asked["bucket"] == after["b2"]), "left").select("kind", F.col("asks").alias("at"), F.coalesce("next", "later", F.lit(-1)).alias("next"))
    before = firsts.select(F.col("kind").alias("k2"), (F.col("bucket") + 1).alias("b2"))
    roots = firsts.join(before, same(firsts, before, firsts["bucket"] == before["b2"]), "left_anti").select(F.col("kind").alias("k2"), F.col("first").alias("at2"))
    return found.join(roots, same(found, roots, found["at"] == roots["at2"]), "left").select("kind", "at", "next", F.col("at2").isNotNull().alias("root"))


def throttled(warnings: DataFrame, minutes: int = 5) -> DataFrame:
    """``kind, ts`` of warnings that fire: the first of a kind, and each that comes ``minutes`` or more after the last that fired.

    What fires depends on what fired before, so times point to their successors,
    and the chains are followed in levels: blocks of 64 buckets, of 64 blocks and
    so on. Going up, only times at which a chain may enter a block keep a pointer,
    to where it leaves; going down, each block is told where it was entered. A
    task holds one block of one kind; all levels together are little more than
    the times themselves. Null times fire nothing.
    """
    gap = minutes * 60_000_000
    rounds = Rounds(warnings.sparkSession, "throttle")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    times = rounds.keep(warnings.select("kind", at.alias("at")).where("at is not null").distinct())
    ends = times.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    base = (ends["a"] or 0) // gap * gap
    kind = f"kind {times.schema['kind'].dataType.simpleString()}"
    now = rounds.keep(_chains(times.withColumn("at", F.col("at") - base), gap))
    spans = [gap * _FAN]
    while spans[-1] <= (ends["b"] or 0) - base:
        spans.append(spans[-1] * _FAN)
    block = lambda span: F.floor(F.col("at") / span).alias("block")

    def upward(span: int):
        def up(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at", ignore_index=True)
            start = int(frame["block"].iloc[0]) * span
            keeps = np.flatnonzero((frame["at"] < start + 2 * gap) | frame["root"])
            out = frame.iloc[keeps][["kind", "at", "next", "root"]]
            return out.assign(next=_ends(frame["at"].to_numpy(), frame["next"].to_numpy(), keeps, start + span))

        return up

    levels = [now]
    for span in spans[:-1]:
        levels.append(rounds.keep(levels[-1].select("*", block(span)).groupBy("kind", "block").applyInPandas(upward(span), f"{kind}, at long, next long, root boolean")))

    def down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("at", ignore_index=True)
        at, to, fires = left["at"].to_numpy(), left["next"].to_numpy(), np.zeros(len(left), bool)
        place = np.searchsorted(at, to)
        for k in np.flatnonzero(left["root"].to_numpy() | np.isin(at, right["entry"].to_numpy())):
            while k < len(at) and not fires[k]:
                fires[k] = True
                k = place[k] if to[k] >= 0 else len(at)
        return left.loc[fires, ["kind", "at"]]

    fired = levels[-1].select("kind", "at").where("false")
    for level, span in zip(reversed(levels), reversed(spans), strict=True):
        entries = fired.select(F.col("kind").alias("of"), F.col("at").alias("entry"), block(span).alias("in"))
        both = level.select("*", block(span)).groupBy("kind", "block").cogroup(entries.groupBy("of", "in"))
        fired = rounds.keep(both.applyInPandas(down, f"{kind}, at long"))
    return fired.select("kind", F.timestamp_micros(F.col("at") + base).alias("ts"))


def series_validation(both: DataFrame, key: str = "series_id") -> DataFrame:
    """Correlation, RMSE, MAE and the observed mean with a band of one spread, of (key, ts, pred, obs)."""
    p, o = F.col("pred"), F.col("obs")
    spread = F.stddev_pop(p) * F.stddev_pop(o)
    got = both.groupBy(key).agg(
        F.when(spread > 0, F.try_divide(F.covar_pop(p, o), spread)).alias("correlation"), F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"), F.avg(F.abs(p - o)).alias("mae"),
        F.avg(o).alias("mean"), F.stddev_pop(o).alias("sd"),
    )
    return got.select(key, "correlation", "rmse", "mae", "mean", (F.col("mean") - F.col("sd")).alias("low"), (F.col("mean") + F.col("sd")).alias("high"))


def temporal_consistency(steps: DataFrame) -> DataFrame:
    """``case_id, consistency, flagged`` of (case_id, step, value): 1 - spread over mean of the steps' means, flagged below a half."""
    means = steps.groupBy("case_id", "step").agg(F.avg("value").alias("m"))
    got = means.groupBy("case_id").agg((1 - F.try_divide(F.stddev_pop("m"), F.avg("m"))).alias("consistency"))
    return got.select("case_id", "consistency", F.coalesce(F.col("consistency") < 0.5, F.lit(True)).alias("flagged"))


def batch_summary(results: DataFrame, key: str = "batch_id") -> DataFrame:
    """Outcome of each batch of (key, job_id, ok, seconds): counts, rate, failed ids, runtime and jobs an hour."""
    ok = F.col("ok")
    got = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"),
        F.array_sort(F.collect_list(F.when(~ok, F.col("job_id")))).alias("failed_ids"),
    )
    return got.withColumns({"success_rate": F.col("succeeded") / F.col("jobs"), "per_hour": F.try_divide(F.col("jobs") * 3600.0, F.col("seconds"))})


def progress_summary(stages: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run of (run, stage, seconds, share done): finished stages and their durations, overall progress, and the time left once a tenth is done."""
    done = F.when(F.col("share") >= 1, F.col("seconds"))
    got = stages.groupBy(key).agg(
        F.count(done).alias("finished"), F.avg(done).alias("mean_seconds"), F.min(done).alias("min_seconds"), F.max(done).alias("max_seconds"), F.sum(done).alias("total_seconds"),
        F.avg("share").alias("progress"), F.sum("seconds").alias("elapsed"),
    )
    left = F.when(F.col("progress") >= 0.1, F.col("elapsed") / F.col("progress") - F.col("elapsed"))
    return got.withColumn("seconds_left", left)


def issue_frequency(issues: DataFrame) -> DataFrame:
    """``severity, check, n``: how often each check, the text before a colon, has an issue; most frequent first."""
    rows = issues.select("severity", F.explode("issues").alias("text"))
    return rows.groupBy("severity", F.split_part("text", F.lit(":"), F.lit(1)).alias("check")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "severity", "check")


def lineage(runs: DataFrame) -> DataFrame:
    """Per run with maps of file sizes by name (inputs, outputs) and times: counts, MB, distinct types, seconds, whether it warned."""
    size = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, b: a + b) / 1e6
    kind = F.array_sort(F.array_distinct(F.transform(F.concat(F.map_keys("inputs"), F.map_keys("outputs")), lambda n: F.regexp_extract(n, r"\.([a-z0-9]+)$", 1))))
    return runs.select(
        "run_id", F.size("inputs").alias("n_inputs"), size("inputs").alias("input_mb"), F.size("outputs").alias("n_outputs"), size("outputs").alias("output_mb"),
        F.array_join(kind, ",").alias("types"), (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))).alias("micros"), (F.size("warnings") > 0).alias("has_warnings"),
    )


def compare_models(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row for each model with a column for each metric's mean."""
    return metrics.groupBy("model").agg(*[F.avg(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and spread of each metric over folds; folds without a number left out."""
    good = folds.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds"))


def checkpoint_summary(points: DataFrame) -> DataFrame:
    """Count, valid, MB, oldest and newest of each pipeline, and of all (null)."""
    return points.rollup("pipeline").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), (F.sum("size") / 1e6).alias("mb"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )


def output_inventory(files: DataFrame) -> DataFrame:
    """Count and MB by extension, and of all (null), of (path, length)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select(ext.alias("extension"), "length").rollup("extension").agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / 1e6).alias("mb"))


def feature_correlations(wide: DataFrame, names: list[str], least: int = 100, key: str = "grid_id") -> DataFrame:
    """``key, a, b, r`` of every pair of features with more than ``least`` valid cells each; null for a constant one."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def r(a, b):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        value = F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))
        return F.when((F.count(a) > least) & (F.count(b) > least), value)

    got = wide.groupBy(key).agg(*[r(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = got.unpivot(key, [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(key, F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def flood_statistics(cells: DataFrame, threshold: float, cell_km2: float, key: str = "grid_id") -> DataFrame:
    """Counts, flooded share and area, largest and mean depths, and quantiles of flooded depths."""
    v = F.col("value")
    wet = F.when(v >= threshold, v)
    got = cells.groupBy(key).agg(
        F.count(v).alias("cells"), F.count(wet).alias("flooded"), F.max(v).alias("max_depth"), F.avg(v).alias("mean_depth"), F.avg(wet).alias("mean_flooded")
    )
    got = with_quantiles(got, cells.where(v >= threshold), [key], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return got.withColumns({"share": F.col("flooded") / F.col("cells"), "area_km2": F.col("flooded") * cell_km2})


def precipitation_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Ends, mean, spread, quantiles, shape and members of each grid of rain."""
    v = F.col("value")
    got = cells.groupBy(*keys).agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        (F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"), F.count_distinct("member").alias("members"),
    )
    return with_quantiles(got, cells, keys, "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def bootstrap(pairs: DataFrame, metric, replicates: int, level: float = 0.95, seed: int = 11, key: str = "case_id", row: list[str] | None = None) -> DataFrame:
    """``key, low, mid, high`` of ``metric(weight)``, a Column of weighted sums, over replicates with Poisson(1) weights.

    A row's weight in a replicate follows from its keys (``row``) alone. Weights are
    inverted from a uniform number; partial sums combine map-side.
    """
    from .rain import uniform_of

    u = uniform_of(seed, "replicate", *(row or [key, "row", "col"]))
    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        p /= k
        steps.append(total)
    weight = sum((F.when(u > s, 1.0).otherwise(0.0) for s in steps), F.lit(0.0))
    rows = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    got = rows.groupBy(key, "replicate").agg(metric(F.col("w")).alias("value"))
    q = F.percentile("value", [(1 - level) / 2, 0.5, (1 + level) / 2])
    got = got.groupBy(key).agg(q.alias("q"))
    return got.select(key, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(["low", "mid", "high"])])


def provenance_search(runs: DataFrame, flags: list[str], start: Column, end: Column, periods: list[int]) -> DataFrame:
    """Runs that have all flags, were made in the closed range, and are of one of the periods."""
    has = F.forall(F.array(*[F.lit(f) for f in flags]), lambda f: F.array_contains("flags", f)) if flags else F.lit(True)
    return runs.where(has & F.col("created").between(start, end) & F.col("return_period").isin(periods))


def provenance_rows(runs: DataFrame) -> DataFrame:
    """Provenance flat: ten plain columns, flags joined by ``;``."""
    return runs.select(
        "run_id", "created", "return_period", "pattern", "duration_hours", F.size("inputs").alias("input_files"), F.size("outputs").alias("output_files"),
        "seconds", "status", F.array_join(F.array_sort("flags"), ";").alias("flags"),
    )


def history(runs: DataFrame, since: Column) -> DataFrame:
    """Runs since a time, the newest first."""
    return runs.where(F.col("ts") >= since).orderBy(F.desc("ts"))


def component_trend(results: DataFrame, runs: DataFrame, component: str, since: Column) -> DataFrame:
    """Scores of one component since a time, the newest first."""
    return results.where(F.col("component") == component).join(runs.where(F.col("ts") >= since), "run_id").orderBy(F.desc("ts"))


def top_stages(stages: DataFrame, k: int) -> DataFrame:
    """The k longest, ties by name."""
    return stages.orderBy(F.desc("seconds"), "stage").limit(k)
