"""Queries of claim, rule, history and run operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..operators.ranges import with_quantiles
from ..sources import fixtures as fx
from .metrics import sq
from .registry import query, rounded

CL, RU, HI = fx.SQL_CLAIMS, fx.SQL_RUNS, fx.SQL_HISTORY
_CAT = "CASE WHEN amount_paid IS NULL OR amount_paid < 0 THEN 'unknown' WHEN amount_paid < 10000 THEN 'minimal' WHEN amount_paid < 50000 THEN 'moderate' WHEN amount_paid < 100000 THEN 'substantial' ELSE 'severe' END"


@query("prj_damage_category", f"SELECT claim_id, {_CAT} AS damage_category FROM ({CL})")
def prj_damage_category(spark, d):
    return fx.claims(spark, d).select("claim_id", rules.damage_category(F.col("amount_paid")).alias("damage_category"))


@query("prj_exclude_causes", f"SELECT claim_id FROM ({CL}) WHERE NOT coalesce(regexp_matches(lower(cause_of_damage), 'urgent|high'), false)")
def prj_exclude_causes(spark, d):
    return fx.claims(spark, d).where(~rules.has_keyword(F.col("cause_of_damage"), ["urgent", "high"])).select("claim_id")


_HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(sin(radians(36.16 - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(36.16)) * sin(radians(-86.78 - longitude) / 2) ** 2, 1)))"


@query("prj_haversine", sq(f"SELECT claim_id, {_HAV} AS km FROM ({CL})", "claim_id", "km"))
def prj_haversine(spark, d):
    km = rules.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(36.16), F.lit(-86.78))
    return rounded(fx.claims(spark, d).select("claim_id", km.alias("km")))


@query("agg_by_category", sq(f"SELECT {_CAT} AS category, count(*) AS claims, avg(amount_paid) AS mean_amount, count(*) / sum(count(*)) OVER () AS share FROM ({CL}) GROUP BY 1", "category claims", "mean_amount share"))
def agg_by_category(spark, d):
    by = fx.claims(spark, d).groupBy(rules.damage_category(F.col("amount_paid")).alias("category"))
    by = by.agg(F.count(F.lit(1)).alias("claims"), F.avg("amount_paid").alias("mean_amount"))
    total = by.agg(F.sum("claims").alias("total"))  # one row
    return rounded(by.crossJoin(F.broadcast(total)).select("category", "claims", "mean_amount", (F.col("claims") / F.col("total")).alias("share")))


@query("agg_claim_extent", f"SELECT count(*) AS claims, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north, min(date_of_loss) AS first_loss, max(date_of_loss) AS last_loss, CASE WHEN count(*) > 10 THEN 'good' ELSE 'limited' END AS coverage FROM ({CL})")
def agg_claim_extent(spark, d):
    lon, lat, day = "longitude", "latitude", "date_of_loss"
    got = fx.claims(spark, d).agg(
        F.count(F.lit(1)).alias("claims"), F.min(lon).alias("west"), F.max(lon).alias("east"), F.min(lat).alias("south"),
        F.max(lat).alias("north"), F.min(day).alias("first_loss"), F.max(day).alias("last_loss"),
    )
    return got.withColumn("coverage", F.when(F.col("claims") > 10, "good").otherwise("limited"))


@query("prj_range_status", f"SELECT simulation_id, CASE WHEN max_depth < 20 THEN 'warning' WHEN max_depth > 45 THEN 'failed' ELSE 'passed' END AS status FROM ({RU})")
def prj_range_status(spark, d):
    return fx.runs(spark, d).select("simulation_id", rules.range_status(F.col("max_depth"), 20, 45).alias("status"))


_BATCH = f"SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high, quantile_cont(value, 0.5) AS median, sum(value) AS total FROM (UNPIVOT (SELECT max_depth, mean_depth, cells::DOUBLE AS cells FROM ({RU})) ON max_depth, mean_depth, cells INTO NAME metric VALUE value) GROUP BY 1"


@query("agg_batch_statistics", sq(_BATCH, "metric", "mean std low high median total"))
def agg_batch_statistics(spark, d):
    wide = fx.runs(spark, d).select("max_depth", "mean_depth", F.col("cells").cast("double").alias("cells"))
    v = F.col("value")
    long = wide.unpivot([], ["max_depth", "mean_depth", "cells"], "metric", "value")
    got = long.groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))
    return rounded(with_quantiles(got, long, ["metric"], "value", {"median": 0.5}))


@query("win_latest_record", f"SELECT component, max(ts) AS ts, arg_max(score, ts) AS score FROM ({HI}) GROUP BY 1")
def win_latest_record(spark, d):
    """The newest row of each component: a map-side maximum, no sort."""
    return fx.history(spark, d).groupBy("component").agg(F.max("ts").alias("ts"), F.max_by("score", "ts").alias("score"))


_TREND = f"""SELECT component, ts, score FROM (SELECT *, lag(score, 1) OVER w AS s1, lag(score, 2) OVER w AS s2 FROM ({HI}) WINDOW w AS (PARTITION BY component ORDER BY ts))
  WHERE score < s1 AND s1 < s2 AND round(s2 - score, 9) > 0.1"""


@query("win_trend_alerts", _TREND)
def win_trend_alerts(spark, d):
    """Three scores in a row that fall, by more than 0.1 together, oldest to newest."""
    w = Window.partitionBy("component").orderBy("ts")
    x = fx.history(spark, d).withColumn("s1", F.lag("score", 1).over(w)).withColumn("s2", F.lag("score", 2).over(w))
    falls = (F.col("score") < F.col("s1")) & (F.col("s1") < F.col("s2")) & (F.round(F.col("s2") - F.col("score"), 9) > 0.1)
    return x.where(falls).select("component", "ts", "score")


_ALERT = f"SELECT component, ts, CASE WHEN score < 0.6 THEN 'critical' ELSE 'warning' END AS severity FROM ({HI}) WHERE score < 0.8"


@query("qc_alerts", _ALERT)
def qc_alerts(spark, d):
    low = F.when(F.col("score") < 0.6, "critical").otherwise("warning").alias("severity")
    return fx.history(spark, d).where("score < 0.8").select("component", "ts", low)


@query("agg_alert_summary", f"SELECT severity, component, count(*) AS alerts, max(ts) AS latest FROM ({_ALERT}) GROUP BY GROUPING SETS ((severity), (component), ())")
def agg_alert_summary(spark, d):
    sets = [["severity"], ["component"], []]
    cols = lambda names: [F.col(n) for n in names]
    return qc_alerts(spark, d).groupingSets([cols(s) for s in sets], F.col("severity"), F.col("component")).agg(F.count(F.lit(1)).alias("alerts"), F.max("ts").alias("latest"))


_LV = "CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'moderate' WHEN score < 0.75 THEN 'high' ELSE 'extreme' END"


@query("prj_risk_level", f"SELECT component, ts, {_LV} AS level, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM ({HI})")
def prj_risk_level(spark, d):
    return fx.history(spark, d).select("component", "ts", rules.risk_level(F.col("score")).alias("level"), rules.grade(F.col("score")).alias("grade"))


_CUM = f"SELECT component, ts, sum(score) OVER (PARTITION BY component ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cumulative, score - coalesce(lag(score) OVER (PARTITION BY component ORDER BY ts), 0) AS increment FROM ({HI})"


# the scores have nine digits, so their sums do
@query("win_cumulative", f"SELECT component, ts, round(cumulative, 9) + 0.0::DOUBLE AS cumulative, round(increment, 9) + 0.0::DOUBLE AS increment FROM ({_CUM})")
def win_cumulative(spark, d):
    w = Window.partitionBy("component").orderBy("ts")
    total = F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = F.col("score") - F.coalesce(F.lag("score").over(w), F.lit(0.0))
    return rounded(fx.history(spark, d).select("component", "ts", total.alias("cumulative"), step.alias("increment")), 9)
