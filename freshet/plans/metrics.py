"""Queries of the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import metrics as m
from ..sources import fixtures as fx
from .registry import query, rounded


def sq(inner: str, same: str, doubles: str, digits: int = 6) -> str:
    """SQL that passes some columns on and rounds others like ``rounded``."""
    names = [*same.split(), *[f"round({c}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split()]]
    return f"SELECT {', '.join(names)} FROM ({inner})"


P = fx.SQL_PAIRS
S = fx.SQL_SCORED
_IOU = f"""WITH p AS ({P}), t AS (SELECT *, max(pred) OVER (PARTITION BY case_id) AS tp, max(obs) OVER (PARTITION BY case_id) AS tob FROM p),
b AS (SELECT case_id, CASE WHEN tp > 1 THEN pred > 0.5 ELSE pred <> 0 END AS p, CASE WHEN tob > 1 THEN obs > 0.5 ELSE obs <> 0 END AS o FROM t)
SELECT case_id, count(*) FILTER (p AND o) AS intersection, count(*) FILTER (p OR o) AS union_cells,
  CASE WHEN count(*) FILTER (p OR o) = 0 THEN 1 ELSE count(*) FILTER (p AND o) / count(*) FILTER (p OR o) END AS iou FROM b GROUP BY 1"""
_REG = f"""WITH g AS (SELECT case_id, count(*) AS n, avg(abs(pred - obs)) AS mae, sqrt(avg((pred - obs) ** 2)) AS rmse, avg(pred - obs) AS bias,
  sum((pred - obs) ** 2) AS sr, var_pop(obs) * count(*) AS st, 100 * avg(CASE WHEN obs <> 0 THEN abs((pred - obs) / obs) END) AS mape,
  100 * sum(pred - obs) / sum(obs) AS pbias, covar_pop(pred, obs) / (stddev_pop(pred) * stddev_pop(obs)) AS r,
  stddev_pop(pred) / stddev_pop(obs) AS a, avg(pred) / avg(obs) AS b FROM ({P}) GROUP BY 1)
SELECT case_id, n, mae, rmse, bias, 1 - sr / st AS r2, 1 - sr / st AS nse, mape, pbias, 1 - sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2) AS kge FROM g"""
_CONF = """SELECT case_id, count(*) FILTER (pred > {t} AND obs > {t}) AS tp, count(*) FILTER (pred > {t} AND NOT obs > {t}) AS fp,
  count(*) FILTER (NOT pred > {t} AND NOT obs > {t}) AS tn, count(*) FILTER (NOT pred > {t} AND obs > {t}) AS fn FROM ({src}) GROUP BY 1"""
_CLASS = """SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
  tn / (tn + fp) AS specificity, fp / (tp + fp) AS far, fp / (fp + tn) AS fpr, tp / (tp + fn) AS pod, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
  (tp * tn - fp * fn)::DOUBLE / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM ({c})"""
_ROC = f"""WITH b AS (SELECT case_id, score, sum(target) AS t, sum(1 - target) AS f FROM ({S}) GROUP BY 1, 2),
r AS (SELECT case_id, score, (sum(t) OVER w)::BIGINT AS tp, (sum(f) OVER w)::BIGINT AS fp, (sum(t) OVER (PARTITION BY case_id))::BIGINT AS pos,
  (sum(f) OVER (PARTITION BY case_id))::BIGINT AS neg FROM b WINDOW w AS (PARTITION BY case_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_CLASS_COLS = "precision recall f1 accuracy specificity far fpr pod balanced_accuracy mcc"


@query("agg_iou", sq(_IOU, "case_id intersection union_cells", "iou"))
def agg_iou(spark, d):
    return rounded(m.iou(fx.depth_pairs(spark, d)))


@query("agg_regression", sq(_REG, "case_id n", "mae rmse bias r2 nse mape pbias kge"))
def agg_regression(spark, d):
    return rounded(m.regression(fx.depth_pairs(spark, d)))


@query("agg_classification", sq(_CLASS.format(c=_CONF.format(t=0.5, src=P)), "case_id tp fp tn fn", _CLASS_COLS))
def agg_classification(spark, d):
    return rounded(m.classification(fx.depth_pairs(spark, d)))


_CSI = "SELECT case_id, tp / (tp + fp + fn) AS csi, (tp + fp) / (tp + fn) AS frequency_bias FROM ({c})"


@query("agg_csi", sq(_CSI.format(c=_CONF.format(t=0.5, src=P)), "case_id", "csi frequency_bias"))
def agg_csi(spark, d):
    return rounded(m.csi(fx.depth_pairs(spark, d)))


_EXT = f"""SELECT case_id, tp / (tp + fp + fn) AS iou, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
  (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fp + fn) AS csi, (tp + fp) / (tp + fn) AS frequency_bias FROM ({_CONF.format(t=0.01, src=P)})"""


@query("agg_extent_metrics", sq(_EXT, "case_id", "iou precision recall f1 accuracy csi frequency_bias"))
def agg_extent_metrics(spark, d):
    return rounded(m.extent_metrics(fx.depth_pairs(spark, d)))


@query(
    "agg_flood_metrics",
    f"""WITH i AS ({_IOU}), r AS ({_REG}), k AS ({_CLASS.format(c=_CONF.format(t=0.5, src=P))})
SELECT case_id, round(iou, 6) + 0.0::DOUBLE AS iou, round(rmse, 6) + 0.0::DOUBLE AS rmse, round(nse, 6) + 0.0::DOUBLE AS nse, round(f1, 6) + 0.0::DOUBLE AS f1,
  CASE WHEN f1 >= 0.9 THEN 'A' WHEN f1 >= 0.8 THEN 'B' WHEN f1 >= 0.7 THEN 'C' WHEN f1 >= 0.6 THEN 'D' ELSE 'F' END AS grade
FROM i JOIN r USING (case_id) JOIN k USING (case_id)""",
)
def agg_flood_metrics(spark, d):
    """The flagship: cleaned depth pairs to overlap, regression, classification and a grade."""
    pairs = fx.depth_pairs(spark, d)
    pairs = pairs.withColumns({c: rules.clean_depth(F.col(c)) for c in ("pred", "obs")})
    rates = m.classification(pairs).select("case_id", "f1")
    both = m.iou(pairs).select("case_id", "iou").join(m.regression(pairs).select("case_id", "rmse", "nse"), "case_id").join(rates, "case_id")
    return rounded(both.withColumn("grade", rules.grade(F.col("f1"))))


@query(
    "agg_metric_summary",
    sq(f"SELECT case_id, 'regression' AS category, metric, value FROM (UNPIVOT (SELECT case_id, n::DOUBLE AS n, mae, rmse, bias, r2, nse, mape, pbias, kge FROM ({_REG})) ON n, mae, rmse, bias, r2, nse, mape, pbias, kge INTO NAME metric VALUE value)", "case_id category metric", "value"),
)
def agg_metric_summary(spark, d):
    return rounded(m.long_form(m.regression(fx.depth_pairs(spark, d)), "case_id", "regression"))


_DIFF = f"""SELECT case_id, avg(pred - obs) AS mean_difference, stddev_pop(pred - obs) AS std_difference, min(pred - obs) AS min_difference, max(pred - obs) AS max_difference,
  sqrt(avg((pred - obs) ** 2)) AS rmse, sum(pred) AS pred_volume, sum(obs) AS obs_volume, 100 * (sum(pred) - sum(obs)) / sum(obs) AS volume_bias FROM ({P}) GROUP BY 1"""


@query("agg_depth_difference", sq(_DIFF, "case_id", "mean_difference std_difference min_difference max_difference rmse pred_volume obs_volume volume_bias"))
def agg_depth_difference(spark, d):
    return rounded(m.depth_difference(fx.depth_pairs(spark, d)))


@query("agg_spatial_correlation", sq(f"SELECT case_id, corr(pred, obs) AS correlation, count(*) AS valid_cells, count(*) AS total_cells FROM ({P}) GROUP BY 1", "case_id valid_cells total_cells", "correlation"))
def agg_spatial_correlation(spark, d):
    return rounded(m.spatial_correlation(fx.depth_pairs(spark, d)))


_BAND = f"""SELECT case_id, 1 - avg(abs(pred - obs)) FILTER (obs > 0.1 AND obs <= 1) / avg(obs) FILTER (obs > 0.1 AND obs <= 1) AS shallow_accuracy,
  1 - avg(abs(pred - obs)) FILTER (obs > 1) / avg(obs) FILTER (obs > 1) AS deep_accuracy, abs(sum(pred) - sum(obs)) / sum(obs) AS volume_error FROM ({P}) GROUP BY 1"""


@query("agg_depth_band_accuracy", sq(_BAND, "case_id", "shallow_accuracy deep_accuracy volume_error"))
def agg_depth_band_accuracy(spark, d):
    return rounded(m.depth_band_accuracy(fx.depth_pairs(spark, d)))


_JS = f"""WITH l AS (SELECT case_id, 'p' AS s, pred AS v FROM ({P}) UNION ALL SELECT case_id, 'o', obs FROM ({P})),
e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY case_id, s)),
b AS (SELECT case_id, least(floor((v - lo) / (hi - lo) * 50), 49) AS bin, sum(CASE WHEN s = 'p' THEN 1.0::DOUBLE / n ELSE 0 END) AS p, sum(CASE WHEN s = 'o' THEN 1.0::DOUBLE / n ELSE 0 END) AS q FROM e GROUP BY 1, 2)
SELECT case_id, sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js_distance FROM b GROUP BY 1"""


@query("agg_js_distance", sq(_JS, "case_id", "js_distance"))
def agg_js_distance(spark, d):
    return rounded(m.js_distance(fx.depth_pairs(spark, d)))


_SPEAR = f"""WITH r AS (SELECT case_id, rank() OVER (PARTITION BY case_id ORDER BY pred) + (count(*) OVER (PARTITION BY case_id, pred) - 1) / 2 AS rp,
  rank() OVER (PARTITION BY case_id ORDER BY obs) + (count(*) OVER (PARTITION BY case_id, obs) - 1) / 2 AS ro FROM ({P}))
SELECT case_id, corr(rp, ro) AS spearman FROM r GROUP BY 1"""


@query("agg_spearman", sq(_SPEAR, "case_id", "spearman"))
def agg_spearman(spark, d):
    return rounded(m.spearman(fx.depth_pairs(spark, d)))


_MAP = f"""SELECT case_id, count(*) FILTER (pred > 0.01)::DOUBLE AS predicted_area, count(*) FILTER (obs > 0.01)::DOUBLE AS observed_area,
  count(*) FILTER (pred > 0.01 AND obs > 0.01)::DOUBLE AS overlap_area, max(pred) AS max_predicted, max(obs) AS max_observed FROM ({P}) GROUP BY 1"""


@query("agg_map_statistics", sq(_MAP, "case_id", "predicted_area observed_area overlap_area max_predicted max_observed"))
def agg_map_statistics(spark, d):
    return rounded(m.map_statistics(fx.depth_pairs(spark, d)))


_AUC = f"""{_ROC}, s AS (SELECT case_id, tp, fp, tp / pos AS tpr, fp / neg AS fpr, coalesce(lag(tp / pos) OVER w, 0) AS t0, coalesce(lag(fp / neg) OVER w, 0) AS f0 FROM r
  WHERE pos > 0 AND neg > 0 WINDOW w AS (PARTITION BY case_id ORDER BY score DESC))
SELECT case_id, sum((fpr - f0) * (tpr + t0) / 2) AS auc, sum((tpr - t0) * tp / (tp + fp)) AS average_precision FROM s GROUP BY 1"""


@query("agg_roc_auc", sq(_AUC, "case_id", "auc average_precision"))
def agg_roc_auc(spark, d):
    return rounded(m.roc_auc(fx.scored(spark, d)))


_BEST = f"""{_ROC}, g AS (SELECT case_id, score, round(tp / (tp + fp) + tp / pos - 1, 12) AS gain FROM r WHERE pos > 0)
SELECT case_id, arg_max(score, (gain, score)) AS threshold, max(gain) AS gain FROM g GROUP BY 1"""


@query("agg_best_threshold", sq(_BEST, "case_id", "threshold gain"))
def agg_best_threshold(spark, d):
    return rounded(m.best_threshold(fx.scored(spark, d)))


_CAL = f"SELECT case_id, least(floor(score * 10), 9)::BIGINT AS bin, avg(score) AS mean_score, avg(target) AS observed, count(*) AS n FROM ({S}) GROUP BY 1, 2"


@query("agg_calibration", sq(_CAL, "case_id bin n", "mean_score observed"))
def agg_calibration(spark, d):
    return rounded(m.calibration(fx.scored(spark, d)))


_LOSS = f"""WITH z AS (SELECT case_id, score AS z, target::DOUBLE AS y, 1 / (1 + exp(-score)) AS p, greatest(score, 0) + ln(1 + exp(-abs(score))) AS sp,
  greatest(-score, 0) + ln(1 + exp(-abs(score))) AS sn FROM ({S})), b AS (SELECT *, y * sn + (1 - y) * sp AS bce, y * p + (1 - y) * (1 - p) AS pt FROM z)
SELECT case_id, avg(bce) AS bce, avg(2 * y * sn + (1 - y) * sp) AS weighted_bce, avg((y * 0.25 + (1 - y) * 0.75) * (1 - pt) ** 2 * bce) AS focal,
  1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1) AS dice, 1 - (sum(p * y) + 1) / (sum(p * y) + 0.3 * sum(p * (1 - y)) + 0.7 * sum((1 - p) * y) + 1) AS tversky,
  avg((p - y) ** 2) AS brier FROM b GROUP BY 1"""


@query("agg_loss_metrics", sq(_LOSS, "case_id", "bce weighted_bce focal dice tversky brier"))
def agg_loss_metrics(spark, d):
    return rounded(m.loss_metrics(fx.scored(spark, d)))
