"""Queries of further forms of grid, metric, status and alert operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import grid as g
from ..operators import metrics as m
from ..operators import quality as q
from ..sources import fixtures as fx
from .checks import _CHK, _sruns
from .metrics import P, S, sq
from .registry import query, rounded

G, HI = fx.SQL_GRIDS, fx.SQL_HISTORY


def _meta(spark, d):
    ends = fx.cells(spark, d, 50).groupBy("grid_id").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))
    return ends.withColumns({"xll": F.col("grid_id") * 7.0, "yll": F.lit(-20.0), "cellsize": F.lit(2.0)})


_M = f"SELECT grid_id, max(row) + 1 AS nrows, max(col) + 1 AS ncols, grid_id * 7.0::DOUBLE AS xll, -20.0::DOUBLE AS yll, 2.0::DOUBLE AS cellsize FROM ({G}) GROUP BY 1"
_CUT = f"""SELECT grid_id, nrows, ncols, xll, yll, least(greatest(trunc((yll + nrows * 2 - 61.5) / 2)::INT, 0), nrows)::INT AS r0, least(greatest(trunc((yll + nrows * 2 - 3) / 2)::INT, 0), nrows)::INT AS r1,
  least(greatest(trunc((25.3 - xll) / 2)::INT, 0), ncols)::INT AS c0, least(greatest(trunc((111 - xll) / 2)::INT, 0), ncols)::INT AS c1 FROM ({_M})"""
_BOX = (25.3, 3.0, 111.0, 61.5)


@query("prj_clip_box", f"SELECT grid_id, (row - r0)::INT AS row, (col - c0)::INT AS col, value FROM ({G}) JOIN ({_CUT}) USING (grid_id) WHERE row >= r0 AND row < r1 AND col >= c0 AND col < c1")
def prj_clip_box(spark, d):
    return g.clip_box(fx.cells(spark, d, 50), _meta(spark, d), _BOX)[0]


@query("prj_clip_box_meta", f"SELECT grid_id, (r1 - r0)::INT AS nrows, (c1 - c0)::INT AS ncols, xll + c0 * 2 AS xll, yll + nrows * 2 - r1 * 2 AS yll, 2.0::DOUBLE AS cellsize FROM ({_CUT})")
def prj_clip_box_meta(spark, d):
    return g.clip_box(fx.cells(spark, d, 50), _meta(spark, d), _BOX)[1]


_WC = f"""SELECT grid_id, count(v) AS valid, count(v) / count(*) AS share, min(west) FILTER (v IS NOT NULL) AS west, min(north - 2) FILTER (v IS NOT NULL) AS south, max(west + 2) FILTER (v IS NOT NULL) AS east, max(north) FILTER (v IS NOT NULL) AS north
  FROM (SELECT grid_id, CASE WHEN value > 0.1 THEN value END AS v, xll + col * 2 AS west, yll + (nrows - row) * 2 AS north FROM ({G}) JOIN ({_M}) USING (grid_id)) WHERE west + 1 BETWEEN 25.3 AND 111 AND north - 1 BETWEEN 3 AND 61.5 GROUP BY 1"""


@query("agg_world_coverage", sq(_WC, "grid_id valid west south east north", "share"))
def agg_world_coverage(spark, d):
    cells = fx.cells(spark, d, 50).withColumn("value", F.when(F.col("value") > 0.1, F.col("value")))
    return rounded(g.world_coverage(cells, _meta(spark, d), _BOX))


@query("agg_dropout_spread", sq(f"SELECT row, col, avg(value) AS mean, stddev_samp(value) AS spread, count(*) FILTER (value > 0.05) / count(value) AS exceedance, count(value) AS members FROM ({G}) GROUP BY 1, 2", "row col members", "mean spread exceedance"))
def agg_dropout_spread(spark, d):
    return rounded(g.ensemble(fx.cells(spark, d, 50), 0.05, sample=True))


_SOFT = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"
_LOSS = f"""SELECT case_id, 0.5 * avg(b) + 0.5 * (1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1)) AS bce_dice, 0.7 * avg((y * 0.25 + (1 - y) * 0.75) * (1 - (y * p + (1 - y) * (1 - p))) ** 2 * b) + 0.3 * (1 - (sum(p * y) + 1) / (sum(p * y) + 0.3 * sum(p * (1 - y)) + 0.7 * sum((1 - p) * y) + 1)) AS focal_tversky
  FROM (SELECT case_id, y, 1 / (1 + exp(-z)) AS p, y * {_SOFT.format('(-z)')} + (1 - y) * {_SOFT.format('z')} AS b FROM (SELECT case_id, score AS z, target::DOUBLE AS y FROM ({S}))) GROUP BY 1"""


@query("agg_loss_mixes", sq(_LOSS, "case_id", "bce_dice focal_tversky"))
def agg_loss_mixes(spark, d):
    return rounded(m.loss_mixes(fx.scored(spark, d), {"bce_dice": {"bce": 0.5, "dice": 0.5}, "focal_tversky": {"focal": 0.7, "tversky": 0.3}}))


@query("agg_status_values", f"SELECT run_id, 'simulation' AS category, \"check\" AS metric, CASE status WHEN 'passed' THEN 1 WHEN 'warning' THEN 0.5 WHEN 'failed' THEN 0 END::DOUBLE AS value FROM ({_CHK})")
def agg_status_values(spark, d):
    return m.status_values(q.result_checks(_sruns(spark, d)), "run_id", "simulation")


@query("agg_worst_status", f"SELECT c_custkey AS component, CASE WHEN bool_or(s < 0.6) THEN 'FAIL' WHEN bool_or(s < 0.8) THEN 'WARN' WHEN count(s) > 0 THEN 'PASS' ELSE 'UNKNOWN' END AS worst FROM customer LEFT JOIN (SELECT user_id, value / 200 AS s FROM events) ON user_id = c_custkey GROUP BY 1")
def agg_worst_status(spark, d):
    """FAIL before WARN before PASS; UNKNOWN where nothing was checked."""
    checks = fx.table(spark, d, "events").select(F.col("user_id").alias("component"), rules.status_of(F.col("value") / 200).alias("status"))
    rank = F.max(F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "WARN", 2).when(F.col("status") == "PASS", 1))
    by = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("component")).join(checks, "component", "left").groupBy("component").agg(rank.alias("k"))
    worst = F.when(F.col("k") == 3, "FAIL").when(F.col("k") == 2, "WARN").when(F.col("k") == 1, "PASS").otherwise("UNKNOWN")
    return by.select("component", worst.alias("worst"))


_AL = "SELECT user_id AS component, s, n, CASE WHEN s < 0.6 THEN 'critical' WHEN s < 0.8 THEN 'warning' END AS low, CASE WHEN n > 5 THEN 'warning' END AS many FROM (SELECT user_id, max(value) / 500 AS s, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)"


@query("qc_alert_rules", f"SELECT component, unnest([CASE WHEN low IS NOT NULL THEN 'score:' || low END, CASE WHEN many IS NOT NULL THEN 'issues:' || many END]) AS alert FROM ({_AL})".replace("SELECT component, unnest", "SELECT * FROM (SELECT component, unnest") + ") WHERE alert IS NOT NULL")
def qc_alert_rules(spark, d):
    """A low score, and more than five issues, each make an alert."""
    by = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("component")).agg((F.max("value") / 500).alias("s"), F.count_if(F.col("event_type") == "error").alias("n"))
    low = F.when(F.col("s") < 0.6, "score:critical").when(F.col("s") < 0.8, "score:warning")
    return by.select("component", F.explode(F.array_compact(F.array(low, F.when(F.col("n") > 5, "issues:warning")))).alias("alert"))


_BC = f"""WITH p AS ({P}), c AS (SELECT DISTINCT case_id FROM ({P}) UNION SELECT DISTINCT -1 - case_id FROM ({P})),
a AS (SELECT case_id, count(*) AS n, sqrt(avg((pred - obs) ** 2)) AS rmse, 1 - sum((pred - obs) ** 2) / (var_pop(obs) * count(*)) AS r2, avg(((pred > 0.5) = (obs > 0.5))::INT) AS accuracy, avg(pred - obs) AS mean_difference FROM p GROUP BY 1)
SELECT case_id, n, rmse, r2, accuracy, mean_difference, CASE WHEN n IS NULL THEN 'no pairs' END AS error FROM c LEFT JOIN a USING (case_id)"""


@query("agg_batch_compare", sq(_BC, "case_id n error", "rmse r2 accuracy mean_difference"))
def agg_batch_compare(spark, d):
    """All cases, and as many without pairs, which stay with their error."""
    pairs = fx.depth_pairs(spark, d)
    cases = pairs.select("case_id").distinct()
    return rounded(m.batch_compare(pairs, cases.unionByName(cases.select((-1 - F.col("case_id")).alias("case_id")))))
