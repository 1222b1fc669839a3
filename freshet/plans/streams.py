"""Queries of the streaming operators: events arrive in two slices by time; what comes out is held against the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import scoring
from ..sources import fixtures as fx
from ..streaming import events as e
from .claims import _ALERT
from .metrics import sq
from .registry import query, rounded
from .scores import _ENR, asked

_CUT = "2024-01-16 00:00:00"


def _slices(df):
    """What came before the middle of the month, and the rest."""
    cut = F.lit(_CUT).cast("timestamp")
    return [df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)]


def _events(spark, d):
    """Event time must be a timestamp with a zone; the session's is UTC."""
    return fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("str_request_rate", sq("SELECT event_type, start, count(*) / 300 AS rate FROM (SELECT event_type, date_trunc('minute', ts) - INTERVAL 1 MINUTE * k AS start FROM events, (SELECT unnest(range(0, 5)) AS k)) GROUP BY 1, 2", "event_type start", "rate"))
def str_request_rate(spark, d):
    rows = e.drained(spark, _slices(_events(spark, d)), lambda s: e.request_rate(s, "event_type"), "update")
    return rounded(e.latest(rows, ["event_type", "start"]))


@query("str_predictions_per_hour", "SELECT CASE WHEN value < 125 THEN 'low' WHEN value < 250 THEN 'moderate' WHEN value < 375 THEN 'high' ELSE 'extreme' END AS level, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def str_predictions_per_hour(spark, d):
    scored = _events(spark, d).withColumn("level", rules.risk_level(F.col("value") / 500))
    return e.latest(e.drained(spark, _slices(scored), e.predictions_per_hour, "update"), ["level", "start"])


_LE = [5.0, 10.0, 25.0, 50.0, 100.0]


@query("str_duration_histogram", sq(f"SELECT event_type, date_trunc('hour', ts) AS start, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{i}' for i, b in enumerate(_LE))}, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "event_type start le_0 le_1 le_2 le_3 le_4 n", "total"))
def str_duration_histogram(spark, d):
    rows = e.drained(spark, _slices(_events(spark, d)), lambda s: e.duration_histogram(s, "event_type", "value", _LE), "update")
    return rounded(e.latest(rows, ["event_type", "start"]))


@query("str_rolling_mean", sq("SELECT user_id, count(*)::INT AS seen, avg(value) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS k FROM events) WHERE k <= 20 GROUP BY 1", "user_id seen", "mean"))
def str_rolling_mean(spark, d):
    rows = e.drained(spark, _slices(_events(spark, d)), lambda s: e.rolling_mean(s, "user_id", "value", 20), "update")
    return rounded(e.latest(rows, ["user_id"]))


@query("str_throttled_warnings")
def str_throttled_warnings(spark, d):
    kinds = _events(spark, d).select(F.col("event_type").alias("kind"), "ts")
    # a last row, long after all others, lets the watermark pass them
    close = kinds.limit(1).select(F.lit("end").alias("kind"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("ts"))
    rows = e.drained(spark, [*_slices(kinds), close], e.throttled_warnings).where("kind <> 'end'")
    return rows.select("kind", F.timestamp_micros("at").alias("ts"))


_SCO = f"SELECT request_id, level, confidence, factors, water_level, n_customers FROM ({_ENR}) JOIN (SELECT event_id, user_id FROM events) ON event_id = request_id LEFT JOIN (SELECT c_custkey, c_nationkey AS n_customers FROM customer) ON c_custkey = user_id"


@query("str_score_stream", sq(_SCO, "request_id level factors n_customers", "confidence water_level"))
def str_score_stream(spark, d):
    requests = asked(spark, d).join(_events(spark, d).select(F.col("event_id").alias("request_id"), "ts", "user_id"), "request_id")
    lookup = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_customers"))
    score = rules.to_digits((F.coalesce("current_rainfall", F.lit(0.0)) / 500 + F.col("soil_moisture") / 120) / 2, 9)
    rows = e.drained(spark, _slices(requests), lambda s: e.score_stream(s, score, scoring.enrich, lookup, "user_id"))
    return rounded(rows.select("request_id", "level", "confidence", F.array_join("factors", ",").alias("factors"), "water_level", "n_customers"))


@query("str_alert_stream", _ALERT)
def str_alert_stream(spark, d):
    """Scores that arrive twice give one alert."""
    scores = fx.history(spark, d)
    return e.drained(spark, _slices(scores.unionByName(scores)), e.alert_stream).select("component", "ts", "severity")


@query("str_batch_progress", sq("SELECT user_id AS batch_id, count(*) FILTER (event_type <> 'error') AS completed, count(*) AS total, count(*) FILTER (event_type <> 'error') / count(*) AS share FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') > 0", "batch_id completed total", "share"))
def str_batch_progress(spark, d):
    x = _events(spark, d)
    totals = x.groupBy(F.col("user_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("total"))
    done = x.where("event_type <> 'error'").select(F.col("user_id").alias("batch_id"), "ts")
    return rounded(e.latest(e.drained(spark, _slices(done), lambda s: e.batch_progress(s, totals), "update"), ["batch_id"]))


@query("str_prediction_outcomes", "SELECT event_id AS id, ts, value AS predicted, CASE WHEN event_id % 3 <> 0 AND event_id % 100 <= 60 THEN value + 1 END AS actual FROM events")
def str_prediction_outcomes(spark, d):
    """Two of three predictions get an actual value, after as many minutes as their id's last two digits; past an hour it counts for nothing."""
    x = _events(spark, d)
    i = F.col("event_id")
    predictions = x.select(i.alias("id"), "ts", F.col("value").alias("predicted"))
    actuals = x.where("event_id % 3 <> 0").select(i.alias("id"), F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id % 100 as int), 0)").alias("ts"), (F.col("value") + 1).alias("actual"))
    # a last row of either stream, long after all others, lets the watermark pass them
    end = F.lit("2030-01-01 00:00:00").cast("timestamp")
    close = lambda df, c: df.limit(1).select(F.lit(-1).cast("long").alias("id"), end.alias("ts"), F.lit(0.0).alias(c))
    p, a = [*_slices(predictions), close(predictions, "predicted")], [*_slices(actuals), close(actuals, "actual")]
    return e.drained(spark, p, e.prediction_outcomes, others=[a]).where("id >= 0").drop("batch")
