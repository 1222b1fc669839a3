"""Queries of operators whose groups may be large, over one group that holds a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import metrics as m
from ..sources import fixtures as fx
from .grids import _MAD, _MM, _Q, _STAT, _out
from .metrics import _AUC, _BEST, _SPEAR, P, S, sq
from .registry import query, rounded

KEY = "grid_id row col"
#: All vectors as one grid of a long tail: nearly all values lie in a small part of their range.
SKEWED = f"SELECT grid_id, row, col, exp(value * 20) AS value FROM ({fx.SQL_CELLS})"
_one = lambda sql, src: sql.replace(fx.SQL_GRIDS, src)


def _skewed(spark, d):
    return fx.cells(spark, d).withColumn("value", F.exp(F.col("value") * 20))


@query("agg_grid_statistics_whole", sq(_one(_STAT, SKEWED), "grid_id n", "mean std low high median q25 q75 skew kurtosis"))
def agg_grid_statistics_whole(spark, d):
    return rounded(g.statistics(_skewed(spark, d)))


@query("norm_zscore_robust_whole", sq(_one(_MAD, SKEWED), KEY, "z"))
def norm_zscore_robust_whole(spark, d):
    return rounded(g.zscore_robust(_skewed(spark, d)).select(_out("z")))


@query("norm_minmax_whole", sq(_one(_MM, SKEWED), KEY, "scaled"))
def norm_minmax_whole(spark, d):
    return rounded(g.minmax(_skewed(spark, d), -1.0, 1.0, (0.02, 0.98)).select(_out("scaled")))


@query("norm_quantile_whole", sq(_one(_Q, SKEWED), KEY, "quantile"))
def norm_quantile_whole(spark, d):
    return rounded(g.quantile_rank(_skewed(spark, d), 20).select(_out("quantile")))


#: Depth pairs as one case, half of the predictions alike.
_PAIRS = f"SELECT 0 AS case_id, CASE WHEN row % 2 = 0 THEN 1.0::DOUBLE ELSE pred END AS pred, obs FROM ({P})"


@query("agg_spearman_whole", sq(_SPEAR.replace(P, _PAIRS), "case_id", "spearman"))
def agg_spearman_whole(spark, d):
    pairs = fx.depth_pairs(spark, d)
    pred = F.when(F.col("row") % 2 == 0, 1.0).otherwise(F.col("pred"))
    return rounded(m.spearman(pairs.select(F.lit(0).alias("case_id"), pred.alias("pred"), "obs")))


#: Every line item scored by its price, a third of them alike.
_ITEMS = """SELECT 'all' AS case_id, CASE WHEN l_linenumber % 3 = 0 THEN 30000.0::DOUBLE ELSE l_extendedprice::DOUBLE END AS score, (l_returnflag = 'R')::INT AS target FROM lineitem"""


def _items(spark, d):
    score = F.when(F.col("l_linenumber") % 3 == 0, 30000.0).otherwise(F.col("l_extendedprice").cast("double"))
    return fx.table(spark, d, "lineitem").select(F.lit("all").alias("case_id"), score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("target"))


@query("agg_roc_auc_whole", sq(_AUC.replace(S, _ITEMS), "case_id", "auc average_precision"))
def agg_roc_auc_whole(spark, d):
    return rounded(m.roc_auc(_items(spark, d)))


@query("agg_best_threshold_whole", sq(_BEST.replace(S, _ITEMS), "case_id", "threshold gain"))
def agg_best_threshold_whole(spark, d):
    return rounded(m.best_threshold(_items(spark, d)))
