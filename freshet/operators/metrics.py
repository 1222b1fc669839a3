"""Prediction against observation: one grouped pass for each family of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Rounds
from .ranges import running

INF = float("inf")


def _ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a, b))


def iou(pairs: DataFrame, thr: float = 0.5, key: str = "case_id") -> DataFrame:
    """Intersection, union and their ratio (1 for an empty union).

    A side is cut at ``thr`` only if its largest value exceeds 1; else what is
    not 0 counts.
    """
    tops = pairs.groupBy(key).agg(F.max("pred").alias("top_p"), F.max("obs").alias("top_o"))
    on = lambda v, top: F.when(F.col(top) > 1, F.col(v) > thr).otherwise(F.col(v) != 0)
    both = pairs.join(tops, key).select(key, on("pred", "top_p").alias("p"), on("obs", "top_o").alias("o"))
    out = both.groupBy(key).agg(F.count_if(F.expr("p and o")).alias("intersection"), F.count_if(F.expr("p or o")).alias("union_cells"))
    return out.withColumn("iou", _ratio(F.col("intersection"), F.col("union_cells"), 1.0))


def regression(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    """MAE, RMSE, bias, R2, NSE, MAPE, PBIAS, KGE and n; pairs with a null are left out."""
    p, o = F.col("pred"), F.col("obs")
    err = p - o
    got = pairs.where(p.isNotNull() & o.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"),
        F.sum(err * err).alias("ss_res"),
        (F.var_pop(o) * F.count(F.lit(1))).alias("ss_tot"),
        F.avg(F.when(o != 0, F.abs(err / F.when(o != 0, o)))).alias("ape"),
        F.sum(err).alias("err"),
        F.sum(o).alias("obs"),
        F.covar_pop(p, o).alias("cov"),
        F.stddev_pop(p).alias("sp"),
        F.stddev_pop(o).alias("so"),
        F.avg(p).alias("mp"),
        F.avg(o).alias("mo"),
    )
    c = F.col
    exact = F.when(c("ss_res") == 0, 1.0)
    r = F.when((c("sp") == 0) | (c("so") == 0), 0.0).otherwise(F.try_divide(c("cov"), c("sp") * c("so")))
    alpha, beta = _ratio(c("sp"), c("so"), 1.0), _ratio(c("mp"), c("mo"), 1.0)
    return got.select(
        key,
        "n",
        "mae",
        "rmse",
        "bias",
        F.when(c("ss_tot") == 0, exact.otherwise(0.0)).otherwise(1 - F.try_divide(c("ss_res"), c("ss_tot"))).alias("r2"),
        F.when(c("ss_tot") == 0, exact.otherwise(-INF)).otherwise(1 - F.try_divide(c("ss_res"), c("ss_tot"))).alias("nse"),
        F.coalesce(c("ape") * 100, F.lit(INF)).alias("mape"),
        F.when(c("obs") == 0, F.when(c("err") == 0, 0.0).otherwise(INF)).otherwise(100 * F.try_divide(c("err"), c("obs"))).alias("pbias"),
        (1 - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2))).alias("kge"),
    )


def confusion(pairs: DataFrame, thr: float = 0.5, key: str = "case_id") -> DataFrame:
    p, o = F.col("pred") > thr, F.col("obs") > thr
    return pairs.groupBy(key).agg(
        F.count_if(p & o).alias("tp"), F.count_if(p & ~o).alias("fp"), F.count_if(~p & ~o).alias("tn"), F.count_if(~p & o).alias("fn")
    )


def classification(pairs: DataFrame, thr: float = 0.5, key: str = "case_id") -> DataFrame:
    """Counts and rates of a binary cut; 0 where a rate has no cases. ``far`` is FP/(TP+FP), ``fpr`` FP/(FP+TN)."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp, 0.0), _ratio(tp, tp + fn, 0.0)
    specificity = _ratio(tn, tn + fp, 0.0)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return confusion(pairs, thr, key).select(
        key,
        "tp",
        "fp",
        "tn",
        "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        _ratio(tp + tn, tp + fp + tn + fn, 0.0).alias("accuracy"),
        specificity.alias("specificity"),
        _ratio(fp, tp + fp, 0.0).alias("far"),
        _ratio(fp, fp + tn, 0.0).alias("fpr"),
        recall.alias("pod"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        _ratio((tp * tn - fp * fn).cast("double"), root, 0.0).alias("mcc"),
    )


def csi(pairs: DataFrame, thr: float = 0.5, key: str = "case_id") -> DataFrame:
    """Critical success index (1 if nothing is wet) and frequency bias (infinite without observed wet cells)."""
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    bias = F.when(tp + fn == 0, F.when(tp + fp == 0, 1.0).otherwise(INF)).otherwise(F.try_divide(tp + fp, tp + fn))
    return confusion(pairs, thr, key).select(key, _ratio(tp, tp + fp + fn, 1.0).alias("csi"), bias.alias("frequency_bias"))


def extent_metrics(pairs: DataFrame, thr: float = 0.01, key: str = "case_id") -> DataFrame:
    """Overlap and rates of both sides cut at a wet depth."""
    wet = pairs.select(key, (F.col("pred") > thr).cast("double").alias("pred"), (F.col("obs") > thr).cast("double").alias("obs"))
    rates = classification(wet, 0.5, key).select(key, "precision", "recall", "f1", "accuracy")
    return iou(wet, 0.5, key).select(key, "iou").join(rates, key).join(csi(wet, 0.5, key), key)


def long_form(wide: DataFrame, key: str, category: str) -> DataFrame:
    """``key, category, metric, value`` of a wide table of metrics."""
    names = [c for c in wide.columns if c != key]
    rows = wide.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    return rows.unpivot(key, names, "metric", "value").select(key, F.lit(category).alias("category"), "metric", "value")


def depth_difference(pairs: DataFrame, cell_area: float = 1.0, key: str = "case_id") -> DataFrame:
    d = F.col("pred") - F.col("obs")
    got = pairs.groupBy(key).agg(
        F.avg(d).alias("mean_difference"),
        F.stddev_pop(d).alias("std_difference"),
        F.min(d).alias("min_difference"),
        F.max(d).alias("max_difference"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.sum("pred") * cell_area).alias("pred_volume"),
        (F.sum("obs") * cell_area).alias("obs_volume"),
    )
    bias = 100 * (F.col("pred_volume") - F.col("obs_volume"))
    return got.withColumn("volume_bias", _ratio(bias, F.col("obs_volume"), 0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def spatial_correlation(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    valid = F.col("pred").isNotNull() & F.col("obs").isNotNull()
    p, o = F.when(valid, F.col("pred")), F.when(valid, F.col("obs"))
    got = pairs.groupBy(key).agg(pearson(p, o).alias("r"), F.count_if(valid).alias("valid_cells"), F.count(F.lit(1)).alias("total_cells"))
    return got.select(key, F.when(F.col("valid_cells") > 1, F.col("r")).alias("correlation"), "valid_cells", "total_cells")


def depth_band_accuracy(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    """1 - MAE / mean observed depth, for shallow (0.1, 1] and deep cells, and the share of volume missed."""
    p, o = F.col("pred"), F.col("obs")
    band = lambda ok: 1 - F.try_divide(F.avg(F.when(ok, F.abs(p - o))), F.avg(F.when(ok, o)))
    return pairs.groupBy(key).agg(
        band((o > 0.1) & (o <= 1)).alias("shallow_accuracy"),
        band(o > 1).alias("deep_accuracy"),
        F.try_divide(F.abs(F.sum(p) - F.sum(o)), F.sum(o)).alias("volume_error"),
    )


def js_distance(pairs: DataFrame, bins: int = 50, key: str = "case_id") -> DataFrame:
    """Jensen-Shannon distance of the two value histograms, each over its own range."""
    long = pairs.unpivot(key, ["pred", "obs"], "side", "v").where("v is not null")
    ends = long.groupBy(key, "side").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)
    counted = long.join(ends, [key, "side"]).groupBy(key, F.least(place, F.lit(bins - 1)).alias("bin"))
    share = lambda s: F.sum(F.when(F.col("side") == s, 1.0 / F.col("n")).otherwise(0.0))
    both = counted.agg(share("pred").alias("p"), share("obs").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    return both.groupBy(key).agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("js_distance"))


def spearman(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    """Correlation of average ranks within each case. Equal values share a rank; pairs alike in both are one row with a weight."""
    both = Rounds(pairs.sparkSession, "spearman").keep(pairs.groupBy(key, "pred", "obs").agg(F.count(F.lit(1)).alias("w")))
    sides = both
    for side, name in (("pred", "rp"), ("obs", "ro")):
        each = running(sides.groupBy(key, side).agg(F.sum("w").alias("m")), [key], side, ["m"])
        rank = each.select(F.col(key).alias("_key"), F.col(side).alias("_side"), (F.col("m_before") + (F.col("m") + 1) / 2).alias(name))
        both = both.join(rank, F.col(key).eqNullSafe(F.col("_key")) & F.col(side).eqNullSafe(F.col("_side"))).drop("_key", "_side")
    w, x, y = (F.col(c) for c in ("w", "rp", "ro"))
    mean = both.groupBy(key).agg(F.sum("w").alias("n")).select(F.col(key).alias("_key"), ((F.col("n") + 1) / 2).alias("mid"))  # ranks' mean, ties or not
    off = both.join(mean, F.col(key).eqNullSafe(F.col("_key"))).select(key, "w", (x - F.col("mid")).alias("rp"), (y - F.col("mid")).alias("ro"))
    got = off.groupBy(key).agg(F.sum(w * x * y).alias("xy"), (F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))).alias("spread"))
    return got.select(key, F.when(F.col("spread") > 0, F.try_divide("xy", "spread")).alias("spearman"))


def map_statistics(pairs: DataFrame, thr: float = 0.01, cell_area: float = 1.0, key: str = "case_id") -> DataFrame:
    p, o = F.col("pred") > thr, F.col("obs") > thr
    return pairs.groupBy(key).agg(
        (F.count_if(p) * cell_area).alias("predicted_area"),
        (F.count_if(o) * cell_area).alias("observed_area"),
        (F.count_if(p & o) * cell_area).alias("overlap_area"),
        F.max("pred").alias("max_predicted"),
        F.max("obs").alias("max_observed"),
    )


def roc_points(scored: DataFrame, key: str = "case_id") -> DataFrame:
    """``key, score, t, f, tp, fp, pos, neg``: counts at each distinct score and running ones from the highest down; ``_key`` and ``_range`` as ``running`` has them."""
    by = scored.groupBy(key, "score").agg(F.sum("target").alias("t"), F.sum(1 - F.col("target")).alias("f"))
    x = running(by, [key], "score", ["t", "f"], down=True)
    run = {"tp": F.col("t_before") + F.col("t"), "fp": F.col("f_before") + F.col("f"), "pos": F.col("t_whole"), "neg": F.col("f_whole")}
    return x.select("_key", "_range", key, "score", "t", "f", *[c.alias(n) for n, c in run.items()])


def roc_auc(scored: DataFrame, key: str = "case_id") -> DataFrame:
    """Area under the ROC curve by trapezoids, and average precision; null without both classes."""
    points = roc_points(scored, key).where("pos > 0 and neg > 0")
    t, f, tp, fp, pos, neg = (F.col(c) for c in ("t", "f", "tp", "fp", "pos", "neg"))
    # a point's step back is its own counts, so no row needs the one before it
    steps = points.select(key, (f / neg * (2 * tp - t) / pos / 2).alias("area"), (t / pos * tp / (tp + fp)).alias("step"))
    return steps.groupBy(key).agg(F.sum("area").alias("auc"), F.sum("step").alias("average_precision"))


def best_threshold(scored: DataFrame, key: str = "case_id") -> DataFrame:
    """The score with the largest precision + recall - 1, the higher of equal ones."""
    gain = F.col("tp") / (F.col("tp") + F.col("fp")) + F.col("tp") / F.col("pos") - 1
    points = roc_points(scored, key).where("pos > 0").withColumn("gain", F.round(gain, 12))
    best = points.groupBy("_key", "_range").agg(F.max(F.struct("gain", "score")).alias("best"))  # by key alone, a task would sort all its points
    got = best.groupBy("_key").agg(F.max("best").alias("best"))
    return got.select(F.col(f"_key.{key}").alias(key), F.col("best.score").alias("threshold"), F.col("best.gain").alias("gain"))


def calibration(scored: DataFrame, bins: int = 10, key: str = "case_id") -> DataFrame:
    """Reliability by equal-width score bins."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")
    return scored.groupBy(key, place).agg(F.avg("score").alias("mean_score"), F.avg("target").alias("observed"), F.count(F.lit(1)).alias("n"))


def loss_metrics(scored: DataFrame, pos_weight: float = 2.0, alpha: float = 0.25, gamma: float = 2.0, smooth: float = 1.0, key: str = "case_id") -> DataFrame:
    """Losses of a logit (``score``) against a 0/1 target: BCE, weighted BCE, focal, Dice, Tversky (0.3 / 0.7)."""
    z, y = F.col("score"), F.col("target").cast("double")
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    p = F.lit(1.0) / (1 + F.exp(-z))
    bce = y * soft(-z) + (1 - y) * soft(z)
    pt = y * p + (1 - y) * (1 - p)
    at = y * alpha + (1 - y) * (1 - alpha)
    hit, fp, fn = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
    return scored.groupBy(key).agg(
        F.avg(bce).alias("bce"),
        F.avg(pos_weight * y * soft(-z) + (1 - y) * soft(z)).alias("weighted_bce"),
        F.avg(at * F.pow(1 - pt, gamma) * bce).alias("focal"),
        (1 - (2 * hit + smooth) / (F.sum(p) + F.sum(y) + smooth)).alias("dice"),
        (1 - (hit + smooth) / (hit + 0.3 * fp + 0.7 * fn + smooth)).alias("tversky"),
        F.avg(F.pow(p - y, 2)).alias("brier"),
    )


def loss_mixes(scored: DataFrame, weights: dict[str, dict[str, float]], key: str = "case_id") -> DataFrame:
    """Weighted sums of the losses of ``loss_metrics``, by name."""
    losses = loss_metrics(scored, key=key)
    return losses.select(key, *[sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0)).alias(n) for n, parts in weights.items()])


def status_values(results: DataFrame, key: str, category: str) -> DataFrame:
    """``key, category, metric, value`` of check results (key, check, status): passed 1, warning a half, failed 0, else null."""
    s = F.lower("status")
    value = F.when(s.isin("pass", "passed"), 1.0).when(s.isin("warn", "warning"), 0.5).when(s.isin("fail", "failed"), 0.0)
    return results.select(key, F.lit(category).alias("category"), F.col("check").alias("metric"), value.alias("value"))


def batch_compare(pairs: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """A row for each of ``cases``: rmse, r2, accuracy and mean difference, or why there are none."""
    m = regression(pairs, key).select(key, "n", "rmse", "r2")
    m = m.join(classification(pairs, key=key).select(key, "accuracy"), key).join(depth_difference(pairs, key=key).select(key, "mean_difference"), key)
    return cases.join(m, key, "left").withColumn("error", F.when(F.col("n").isNull(), "no pairs"))
