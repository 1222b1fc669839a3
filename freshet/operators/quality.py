"""Quality checks: each gives ``key, score, status, issues``; a score is 1 less the penalties of what it finds, 0 at least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..sources.versions import Versions
from . import grid as g
from .ranges import with_quantiles


def judged(df: DataFrame, key: str, found: list[tuple[str, Column, float]]) -> DataFrame:
    """The result of penalties (issue, condition, weight); a null condition is no issue."""
    conditions = [(name, F.coalesce(cond, F.lit(False)), p) for name, cond, p in found]
    score = F.round(rules.penalised([(cond, p) for _, cond, p in conditions]), 9)
    issues = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in conditions]))
    return df.select(key, score.alias("score"), rules.status_of(score).alias("status"), issues.alias("issues"))


def check_elevation(cells: DataFrame, meta: DataFrame, low: float, high: float, size: float = 1.0) -> DataFrame:
    """Range (0.2 each end), voids over 5 % (0.3), gradients over 100 (0.2), no reference system (0.3). ``meta``: grid_id, nrows, ncols, crs."""
    steep = g.gradient(cells, size).select("grid_id", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("rise"))
    rise = steep.groupBy("grid_id").agg(F.max("rise").alias("rise"))
    stats = cells.groupBy("grid_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    x = meta.join(stats, "grid_id", "left").join(rise, "grid_id", "left")
    voids = 1 - F.coalesce("n", F.lit(0)) / (F.col("nrows") * F.col("ncols"))
    found = [("below range", F.col("lo") < low, 0.2), ("above range", F.col("hi") > high, 0.2), ("voids", voids > 0.05, 0.3), ("steep", F.col("rise") > 100, 0.2), ("no crs", F.col("crs").isNull(), 0.3)]
    return judged(x, "grid_id", found)


def check_rainfall(steps: DataFrame) -> DataFrame:
    """Negative (0.2), over 500 (0.2), missing over 10 % (0.3), temporal consistency under a half (0.2), of (case_id, step, value)."""
    from .series import temporal_consistency

    v = F.col("value")
    stats = steps.groupBy("case_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), (1 - F.count(v) / F.count(F.lit(1))).alias("missing"))
    x = stats.join(temporal_consistency(steps), "case_id")
    found = [("negative", F.col("lo") < 0, 0.2), ("too much", F.col("hi") > 500, 0.2), ("missing", F.col("missing") > 0.1, 0.3), ("inconsistent", F.col("consistency") < 0.5, 0.2)]
    return judged(x, "case_id", found)


def check_spatial(layers: DataFrame, reference: str = "elevation", tolerance: float = 1e-6) -> DataFrame:
    """Per case of layers (case_id, layer, crs, size, box): systems unlike the reference layer's (0.4 each), least overlap under 0.95 (0.3), resolutions (0.2)."""
    base = layers.where(F.col("layer") == reference).select("case_id", *[F.col(c).alias(f"ref_{c}") for c in ("crs", "size", "west", "south", "east", "north")])
    x = layers.where(F.col("layer") != reference).join(base, "case_id")
    common = F.greatest(F.least("east", "ref_east") - F.greatest("west", "ref_west"), F.lit(0.0)) * F.greatest(F.least("north", "ref_north") - F.greatest("south", "ref_south"), F.lit(0.0))
    area = F.greatest((F.col("ref_east") - F.col("ref_west")) * (F.col("ref_north") - F.col("ref_south")), F.lit(1e-12))
    got = x.groupBy("case_id").agg(F.count_if(~F.col("crs").eqNullSafe(F.col("ref_crs"))).alias("other"), F.min(common / area).alias("overlap"), F.max(F.abs(F.col("size") - F.col("ref_size"))).alias("off"))
    score = F.greatest(1 - F.col("other") * 0.4 - F.when(F.col("overlap") < 0.95, 0.3).otherwise(0.0) - F.when(F.col("off") > tolerance, 0.2).otherwise(0.0), F.lit(0.0))
    issues = F.array_compact(F.array(F.when(F.col("other") > 0, F.lit("crs")), F.when(F.col("overlap") < 0.95, F.lit("overlap")), F.when(F.col("off") > tolerance, F.lit("resolution"))))
    return got.select("case_id", F.round(score, 9).alias("score"), rules.status_of(F.round(score, 9)).alias("status"), issues.alias("issues"))


def check_simulation(runs: DataFrame) -> DataFrame:
    """Of runs (run_id, low, high, steep_share, mass_error, converged, iterations, max_iterations, velocity)."""
    c = F.col
    found = [
        ("negative depth", c("low") < 0, 0.3), ("too deep", c("high") > 50, 0.2), ("steep", c("steep_share") > 0.01, 0.2), ("mass", c("mass_error") > 0.05, 0.3),
        ("not converged", ~c("converged"), 0.4), ("near the last iteration", c("iterations") > 0.9 * c("max_iterations"), 0.1), ("too fast", c("velocity") > 20, 0.2),
    ]
    return judged(runs, "run_id", found)


def check_tiles(tiles: DataFrame, least_tiles: int, low: float, high: float, key: str = "set_id") -> DataFrame:
    """Per set of tiles (set_id, tile_id, size, share, mean, edge_share): few (0.2), in range under 70 % (0.3), all dry or wet over 30 % (0.2), mixed sizes (0.1), edge-heavy over 10 % (0.2)."""
    inside = F.avg(F.col("mean").between(low, high).cast("int"))
    flat = F.avg(((F.col("share") == 0) | (F.col("share") == 1)).cast("int"))
    got = tiles.groupBy(key).agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), flat.alias("flat"), F.count_distinct("size").alias("sizes"), F.avg((F.col("edge_share") > 0.5).cast("int")).alias("edgy"))
    found = [("few", F.col("n") < least_tiles, 0.2), ("out of range", F.col("inside") < 0.7, 0.3), ("one-sided", F.col("flat") > 0.3, 0.2), ("mixed sizes", F.col("sizes") > 1, 0.1), ("edge-heavy", F.col("edgy") > 0.1, 0.2)]
    return judged(got, key, found)


def check_labels(cells: DataFrame) -> DataFrame:
    """Per grid of 0/1 labels: rarer class under 1 % (0.3), wet cells without a wet neighbour over 5 % (0.2), agreement with neighbours under 0.8 (0.2), noise over 10 % (0.2), values beyond 0 and 1 (0.3)."""
    names = [g._name(s) for s in g.D8]
    x = g.neighbours(cells)
    wet = sum((F.coalesce((F.col(n) > 0).cast("int"), F.lit(0)) for n in names), F.lit(0))
    there = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    same = sum((F.coalesce((F.col(n) == F.col("value")).cast("int"), F.lit(0)) for n in names), F.lit(0))
    x = x.select("grid_id", "value", wet.alias("wet"), there.alias("there"), same.alias("same"))
    v = F.col("value")
    got = x.groupBy("grid_id").agg(
        F.least(F.avg((v > 0).cast("int")), F.avg((v == 0).cast("int"))).alias("rare"), F.try_divide(F.count_if((v > 0) & (F.col("wet") == 0)), F.count_if(v > 0)).alias("alone"),
        (F.sum("same") / F.greatest(F.sum("there"), F.lit(1))).alias("coherence"), F.count_if(~v.isin(0.0, 1.0)).alias("odd"),
    )
    found = [("imbalanced", F.col("rare") < 0.01, 0.3), ("isolated", F.col("alone") > 0.05, 0.2), ("incoherent", F.col("coherence") < 0.8, 0.2), ("noisy", F.col("noise") > 0.1, 0.2), ("values", F.col("odd") > 0, 0.3)]
    return judged(got.join(label_noise(cells), "grid_id", "left"), "grid_id", found)


def label_noise(cells: DataFrame, classes: int = 10) -> DataFrame:
    """``grid_id, noise``: the share of doubtful labels. Of at most ``classes`` values, those that differ from their 3 x 3 median, borders mirrored; of more, those beyond 1.5 quartile ranges."""
    kinds = cells.groupBy("grid_id").agg(F.count_distinct("value").alias("kinds"))
    whole = g.with_reflection(cells.where("value is not null").select(*g.CELL, "value"), 1)
    x = whole.withColumn("near", F.collect_list("value").over(Window.partitionBy("grid_id", "row").orderBy("col").rangeBetween(-1, 1)))
    x = x.withColumn("near", F.sort_array(F.flatten(F.collect_list("near").over(Window.partitionBy("grid_id", "col").orderBy("row").rangeBetween(-1, 1)))))
    x = x.where("row >= 0 and row < rows and col >= 0 and col < cols")
    median = F.get("near", F.floor(F.size("near") / 2).cast("int"))
    odd = x.groupBy("grid_id").agg(F.avg((F.col("value") != median).cast("double")).alias("discrete"))
    ends = with_quantiles(kinds, cells, ["grid_id"], "value", {"q1": 0.25, "q3": 0.75})
    v, q1, q3 = F.col("value"), F.col("q1"), F.col("q3")
    beyond = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
    off = cells.join(ends, "grid_id").groupBy("grid_id", "kinds").agg(F.avg(beyond.cast("double")).alias("continuous"))
    return off.join(odd, "grid_id").select("grid_id", F.when(F.col("kinds") > classes, F.col("continuous")).otherwise(F.col("discrete")).alias("noise"))


def check_model(models: DataFrame) -> DataFrame:
    """Of models (model, converged, overfit, accuracy, real_score, dummy_score, seconds, megabytes)."""
    c = F.col
    gap = c("real_score") - c("dummy_score")
    found = [
        ("not converged", ~c("converged"), 0.4), ("overfit", c("overfit"), 0.2), ("inaccurate", c("accuracy") < 0.7, 0.3), ("no better than a dummy", gap <= 0, 0.3),
        ("hardly better than a dummy", (gap > 0) & (gap < 0.1), 0.1), ("slow", c("seconds") > 1, 0.1), ("large", c("megabytes") > 500, 0.05),
    ]
    return judged(models, "model", found)


def result_checks(runs: DataFrame) -> DataFrame:
    """``run_id, check, status`` of runs (run_id, max_depth, flood_fraction, area, seconds, nan_share): passed, warning, failed or skipped."""
    c = F.col
    status = lambda v, lo, hi: F.when(v.isNull(), "skipped").otherwise(rules.range_status(v, lo, hi))
    checks = {
        "depth_range": status(c("max_depth"), 0.01, 20.0),
        "flood_fraction": status(c("flood_fraction"), 0.001, 0.5),
        "flood_area": status(c("area"), 1000.0, 1e9),
        "run_time": F.when(c("seconds").isNull(), "skipped").when(c("seconds") > 3600, "warning").otherwise("passed"),
        "data_integrity": F.when(c("nan_share").isNull(), "skipped").when(c("nan_share") > 0.01, "failed").otherwise("passed"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status")) for n, s in checks.items()]))
    return runs.select("run_id", rows.alias("x")).select("run_id", "x.check", "x.status")


def result_scores(checks: DataFrame) -> DataFrame:
    """``run_id, score, status``: (passed + half of warnings) / all checks x 100, skipped ones among all; failed outranks warning."""
    s = F.col("status")
    got = checks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "passed").alias("p"), F.count_if(s == "warning").alias("w"), F.count_if(s == "failed").alias("f")
    )
    status = F.when(F.col("f") > 0, "failed").when(F.col("w") > 0, "warning").otherwise("passed")
    return got.select("run_id", ((F.col("p") + 0.5 * F.col("w")) / F.col("n") * 100).alias("score"), status.alias("status"))


def validation_summary(scores: DataFrame, target: float = 0.9) -> DataFrame:
    """One row: runs by status, success rate, mean score, whether the rate meets the target."""
    s = F.col("status")
    got = scores.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(s == "passed").alias("passed"), F.count_if(s == "warning").alias("warned"), F.count_if(s == "failed").alias("failed"), F.avg("score").alias("mean_score")
    )
    rate = F.coalesce(F.try_divide("passed", "runs"), F.lit(0.0))
    return got.withColumns({"success_rate": rate, "meets_target": rate >= target})


def quality_gate(runs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``run_id, passed, issues`` of (run_id, flood_fraction, max_depth, min_depth, nan_cells)."""
    c = F.col
    found = {
        "flood fraction": ~c("flood_fraction").between(0.0001, 0.8), "too deep": c("max_depth") > 50, "too shallow": c("max_depth") < 2 * threshold,
        "nan": c("nan_cells") > 0, "negative": c("min_depth") < 0,
    }
    issues = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in found.items()]))
    return runs.select("run_id", (F.size(issues) == 0).alias("passed"), issues.alias("issues"))


def preprocessing_qa(wide: DataFrame, ranges: dict[str, tuple[float, float]], key: str = "grid_id") -> DataFrame:
    """``key, feature, status``: fail for values out of their range, warn for no-data over 10 % or a spread over 100 means, else pass."""
    names = list(ranges)
    long = wide.unpivot(key, names, "feature", "value")
    bounds = F.create_map(*[x for n, (lo, hi) in ranges.items() for x in (F.lit(n), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])
    v = F.col("value")
    got = long.groupBy(key, "feature").agg(F.count(v).alias("n"), F.count(F.lit(1)).alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"))
    b = F.element_at(bounds, F.col("feature"))
    out = (F.col("lo") < b["lo"]) | (F.col("hi") > b["hi"])
    odd = (1 - F.col("n") / F.col("m") > 0.1) | (F.abs(F.try_divide("sd", "mu")) > 100)
    return got.select(key, "feature", F.when(F.coalesce(out, F.lit(True)), "fail").when(F.coalesce(odd, F.lit(False)), "warning").otherwise("pass").alias("status"))


def feature_consistency(cells: DataFrame, given: DataFrame, key: str = "grid_id") -> DataFrame:
    """Per grid: correlation of a given slope with the elevation's own, mean flow in streams and outside, heights in 0..1000. ``given``: cell, slope, flow, stream, height."""
    own = g.slope(cells).withColumnRenamed("slope", "own")
    x = own.join(given, g.CELL)
    spread = F.stddev_pop("own") * F.stddev_pop("slope")
    r = F.when(spread > 0, F.try_divide(F.covar_pop("own", "slope"), spread))
    inside, outside = F.avg(F.when(F.col("stream"), F.col("flow"))), F.avg(F.when(~F.col("stream"), F.col("flow")))
    return x.groupBy(key).agg((r > 0.1).alias("slope_ok"), (inside > outside).alias("flow_ok"), F.bool_and(F.col("height").between(0, 1000)).alias("height_ok"))


def check_alignment(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """``grid_id, aligned``: both have the same cells, at the same x and y within a tolerance."""
    left, right = (t.select(*g.CELL, F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, t in ((1, a), (2, b)))
    near = (F.abs(F.col("x1") - F.col("x2")) <= tolerance) & (F.abs(F.col("y1") - F.col("y2")) <= tolerance)
    return left.join(right, g.CELL, "full_outer").groupBy("grid_id").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("aligned"))


def terrain_rules(wide: DataFrame, key: str = "grid_id") -> DataFrame:
    """Per grid whether products keep their rules, of slope, aspect, twi, height, filled, value, accumulation; nulls keep them."""
    c = F.col
    rule = {
        "slope_ok": c("slope").between(0, 90), "aspect_ok": c("aspect").between(0, 360), "twi_ok": c("twi").between(-20, 30), "height_ok": c("height") >= 0,
        "fill_ok": c("filled") >= c("value"), "accumulation_ok": c("accumulation").between(1, c("n_cells")),
    }
    n = wide.groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"))
    return wide.join(n, key).groupBy(key).agg(*[F.bool_and(F.coalesce(cond, F.lit(True))).alias(name) for name, cond in rule.items()])


def check_ddf(rows: DataFrame, key: str = "station_id") -> DataFrame:
    """Per file of (period, depth) as text: rows, bad numbers, nulls; errors for periods beyond 1..1000, negative depths and few rows, warnings for depths over 50."""
    p, v = F.col("period").try_cast("double"), F.col("depth").try_cast("double")
    got = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth").isNotNull() & v.isNull()).alias("not_numbers"), F.count_if(F.col("depth").isNull()).alias("nulls"),
        F.count_if(~p.between(1, 1000)).alias("bad_periods"), F.count_if(v < 0).alias("negative"), F.count_if(v > 50).alias("large"),
    )
    bad = (F.col("not_numbers") > 0) | (F.col("bad_periods") > 0) | (F.col("negative") > 0) | (F.col("n") < 5)
    status = F.when(bad, "error").when((F.col("large") > 0) | (F.col("nulls") > 0), "warning").otherwise("ok")
    return got.withColumn("status", status)


#: Advice by status, with the component's name, and by component where its score is under 0.8.
ADVICE = {
    "FAIL": "CRITICAL: Address issues in {} before proceeding",
    "WARN": "WARNING: Review and potentially fix issues in {}",
}
COMPONENT_ADVICE = {
    "DEM_Quality": "Consider DEM preprocessing: void filling, smoothing, or elevation correction",
    "Rainfall_Quality": "Review rainfall data quality: check for missing values, extreme outliers",
    "Spatial_Consistency": "Ensure all datasets use consistent CRS and spatial extents",
    "Simulation_Quality": "Check simulation convergence and physical plausibility of results",
    "Tile_Quality": "Review tile generation: balance flood/dry ratios, check for edge effects",
}
ALL_PASSED = "All validation checks passed successfully - pipeline ready for ML training"
#: Metric, condition, priority, category, issue, advice, and how the value is told.
METRIC_ADVICE = [
    ("iou", "value < 0.5", "High", "Model Accuracy", "Poor flood extent prediction", "Review model parameters, topographic data quality, and boundary conditions. Consider recalibration with local flood events.", "IoU Score: %.3f"),
    ("iou", "value > 0.85", "Low", "Model Performance", "Excellent flood extent prediction", "Model performs well for flood extent prediction. Consider operational deployment with regular monitoring.", "IoU Score: %.3f"),
    ("rmse", "value > 1.0", "High", "Depth Accuracy", "High depth prediction errors", "Investigate bathymetric data accuracy, friction parameters, and model resolution. Consider ensemble modeling approaches.", "RMSE: %.3fm"),
    ("far", "value > 0.3", "Medium", "False Alarms", "High false alarm rate", "Review threshold settings and consider post-processing filters to reduce false positives. Validate against local knowledge.", "False Alarm Rate: %.3f"),
    ("nse", "value < 0", "Critical", "Model Performance", "Model performs worse than mean", "Model shows poor performance. Complete model review recommended including data quality, physical processes, and parameterization.", "Nash-Sutcliffe Efficiency: %.3f"),
]


def recommendations(results: DataFrame, key: str = "run_id") -> DataFrame:
    """``run_id, advice``: a run's distinct advice, sorted, of results (run_id, component, status, score); one line if nothing is to be advised."""
    status = F.col("status")
    texts = [F.when(status == s, F.replace(F.lit(t), F.lit("{}"), F.col("component"))) for s, t in ADVICE.items()]
    texts += [F.when((F.col("component") == c) & (F.col("score") < 0.8), F.lit(t)) for c, t in COMPONENT_ADVICE.items()]
    told = results.select(key, F.explode_outer(F.array_compact(F.array(*texts))).alias("text"))
    found = told.groupBy(key).agg(F.array_sort(F.collect_set("text")).alias("advice"))
    return found.withColumn("advice", F.when(F.size("advice") > 0, F.col("advice")).otherwise(F.array(F.lit(ALL_PASSED))))


def metric_recommendations(metrics: DataFrame, key: str = "case_id") -> DataFrame:
    """``key, priority, category, issue, recommendation, metric`` of metrics in long form (key, metric, value): a row for each rule that holds."""
    x = metrics.where("value is not null and not isnan(value)")
    rules_ = [
        F.when((F.col("metric") == m) & F.expr(when), F.struct(*[F.lit(v).alias(n) for n, v in (("priority", p), ("category", c), ("issue", i), ("recommendation", r))], F.replace(F.lit(told), F.lit("%.3f"), rules.told(F.col("value"), 3)).alias("metric")))
        for m, when, p, c, i, r, told in METRIC_ADVICE
    ]
    return x.select(key, F.explode(F.array_compact(F.array(*rules_))).alias("r")).select(key, "r.*")


def spatial_extents(layers: DataFrame) -> DataFrame:
    """``case_id`` with the union and the intersection of its layers' boxes (west, south, east, north); null where they do not meet."""
    low, high = ("west", "south"), ("east", "north")
    got = layers.groupBy("case_id").agg(
        *[F.min(c).alias(f"union_{c}") for c in low], *[F.max(c).alias(f"union_{c}") for c in high], *[F.max(c).alias(f"i_{c}") for c in low], *[F.min(c).alias(f"i_{c}") for c in high]
    )
    meets = (F.col("i_west") < F.col("i_east")) & (F.col("i_south") < F.col("i_north"))
    return got.select("case_id", *[f"union_{c}" for c in (*low, *high)], *[F.when(meets, F.col(f"i_{c}")).alias(f"common_{c}") for c in (*low, *high)])


def append_run(run: DataFrame, results: DataFrame, folder: str, name: str) -> bool:
    """Add runs (name, ts) and results (name, ts, component, score) to the tables below ``folder`` as the commit ``name``; once, however often it is called.

    The id of a run is a hash of its name and time. False if the commit is there already.
    """
    key = F.sha2(F.concat_ws("|", "name", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")), 256).alias("run_id")
    return Versions(run.sparkSession, folder).commit(name, {"runs": run.select(key, "*"), "results": results.select(key, "*")})


def retain_runs(spark, folder: str, cutoff: Column) -> int:
    """Drop runs before ``cutoff`` and their results from the tables of ``append_run``; the new version's number. A second call changes no row."""

    def kept(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        runs = tables["runs"].where(F.col("ts") >= cutoff)
        return {"runs": runs, "results": tables["results"].join(runs.select("run_id").distinct(), "run_id", "left_semi")}

    return Versions(spark, folder).rewrite(kept)
