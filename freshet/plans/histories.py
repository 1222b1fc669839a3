"""Queries of event windows, retention, outliers and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranges import quantiles
from ..sources import fixtures as fx
from .metrics import sq
from .registry import query, rounded

CL, HI = fx.SQL_CLAIMS, fx.SQL_HISTORY
_DAYS = 30
_EV = f"SELECT year(date_of_loss) AS event_id, max(date_of_loss) AS event_date FROM ({CL}) GROUP BY 1"


@query("join_event_window", f"SELECT event_id, claim_id, abs(date_of_loss - event_date)::INT AS days FROM ({CL}) JOIN ({_EV}) ON abs(date_of_loss - event_date) <= {_DAYS}")
def join_event_window(spark, d):
    """Claims at most 30 days from an event, both ends included: an equi join on the buckets that a window touches."""
    claims = fx.claims(spark, d).select("claim_id", "date_of_loss")
    events = claims.groupBy(F.year("date_of_loss").alias("event_id")).agg(F.max("date_of_loss").alias("event_date"))
    bucket = lambda day: F.floor(day / _DAYS)
    at = F.unix_date("event_date")
    events = events.withColumn("bucket", F.explode(F.sequence(bucket(at - _DAYS), bucket(at + _DAYS))))
    claims = claims.withColumn("bucket", bucket(F.unix_date("date_of_loss")))
    days = F.abs(F.datediff("date_of_loss", "event_date"))
    return claims.join(events, "bucket").where(days <= _DAYS).select("event_id", "claim_id", days.alias("days"))


_KEEP, _OLD = 3, "INTERVAL 7 DAY"


@query("win_retention", f"SELECT component, ts, rank, rank > {_KEEP} OR ts < newest - {_OLD} AS dropped FROM (SELECT component, ts, row_number() OVER (PARTITION BY component ORDER BY ts DESC)::INT AS rank, max(ts) OVER () AS newest FROM ({HI}))")
def win_retention(spark, d):
    """Records that go: older than a week before the newest of all, or not among a component's three newest."""
    history = fx.history(spark, d).select("component", "ts")
    newest = history.agg(F.max("ts").alias("newest"))  # one row
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("ts")))
    gone = (F.col("rank") > _KEEP) | (F.col("ts") < F.col("newest") - F.expr("INTERVAL 7 DAYS"))
    return history.withColumn("rank", rank).crossJoin(F.broadcast(newest)).select("component", "ts", "rank", gone.alias("dropped"))


_Q = f"SELECT quantile_cont(amount_paid, 0.25) AS q1, quantile_cont(amount_paid, 0.75) AS q3 FROM ({CL})"


@query("qc_outliers_iqr", f"SELECT claim_id FROM ({CL}), ({_Q}) WHERE amount_paid < q1 - 1.5 * (q3 - q1) OR amount_paid > q3 + 1.5 * (q3 - q1)")
def qc_outliers_iqr(spark, d):
    return _outside(fx.claims(spark, d).select("claim_id", "amount_paid"), 1.5)


@query("qc_outliers_iqr_near", f"SELECT claim_id FROM ({CL}), ({_Q}) WHERE amount_paid < q1 - 0.4 * (q3 - q1) OR amount_paid > q3 + 0.4 * (q3 - q1)")
def qc_outliers_iqr_near(spark, d):
    """With a shorter reach, which some claims are beyond."""
    return _outside(fx.claims(spark, d).select("claim_id", "amount_paid"), 0.4)


def _outside(claims, k):
    """Claims beyond the quartiles by ``k`` of their range; quartiles by value ranges, one row each."""
    ends = quantiles(claims, [], ["amount_paid"], [0.25, 0.75]).select(*[F.get("amount_paid_q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * k
    out = (F.col("amount_paid") < F.col("q1") - reach) | (F.col("amount_paid") > F.col("q3") + reach)
    return claims.crossJoin(F.broadcast(ends)).where(out).select("claim_id")


@query("agg_usage_summary", sq(f"SELECT component, arg_max(score, ts) AS current, avg(score) AS average, max(score) AS peak, min(score) AS minimum FROM ({HI}) GROUP BY 1", "component", "current average peak minimum"))
def agg_usage_summary(spark, d):
    s = F.col("score")
    by = fx.history(spark, d).groupBy("component")
    return rounded(by.agg(F.max_by(s, "ts").alias("current"), F.avg(s).alias("average"), F.max(s).alias("peak"), F.min(s).alias("minimum")))


_ST = "CASE WHEN score < 0.6 THEN 'FAIL' WHEN score < 0.8 THEN 'WARN' ELSE 'PASS' END"
_RU = f"""SELECT component, avg(score) AS mean_score, count_if(status = 'FAIL') AS failed, count_if(status = 'WARN') AS warned, count_if(status = 'PASS') AS passed,
  CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS worst FROM (SELECT *, {_ST} AS status FROM ({HI})) GROUP BY 1"""


@query("agg_report_rollup", sq(_RU.replace("count_if(status = 'FAIL')", "count_if(status = 'FAIL')::BIGINT").replace("count_if(status = 'WARN')", "count_if(status = 'WARN')::BIGINT").replace("count_if(status = 'PASS')", "count_if(status = 'PASS')::BIGINT"), "component failed warned passed worst", "mean_score"))
def agg_report_rollup(spark, d):
    """Mean score, counts by status and the worst status of each component."""
    status = F.when(F.col("score") < 0.6, "FAIL").when(F.col("score") < 0.8, "WARN").otherwise("PASS")
    by = fx.history(spark, d).withColumn("status", status).groupBy("component")
    n = lambda s: F.count_if(F.col("status") == s)
    got = by.agg(F.avg("score").alias("mean_score"), n("FAIL").alias("failed"), n("WARN").alias("warned"), n("PASS").alias("passed"))
    worst = F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").otherwise("PASS")
    return rounded(got.withColumn("worst", worst))
