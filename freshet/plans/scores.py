"""Queries of the scoring operators; events stand for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import scoring as s
from ..sources import fixtures as fx
from .metrics import sq
from .registry import query, rounded

_K = "regexp_extract(props, '[0-9]+')::DOUBLE"
ASKED = f"""SELECT event_id AS request_id, (user_id * 7 % 200 - 100)::DOUBLE AS latitude, CASE WHEN event_type = 'error' THEN NULL ELSE (user_id * 11 % 370 - 185)::DOUBLE END AS longitude,
  CASE WHEN event_type <> 'click' THEN value END AS current_rainfall, CASE WHEN value < 200 THEN (user_id % 50 - 5)::DOUBLE END AS elevation, {_K} * 1.2 AS soil_moisture, CASE WHEN value > 5 THEN value / 4 END AS drainage_capacity,
  {_K} * 1.1 AS building_density, (user_id * 20.37)::DOUBLE AS population_density, CASE WHEN value > 3 THEN [value / 10, value / 20, value / 40] ELSE [] END AS forecast_rainfall, CASE WHEN value > 50 THEN [value, 1] END AS historical_rainfall,
  [{_K}]::DOUBLE[] AS historical_water_levels FROM events"""


def asked(spark, d):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    v, u = F.col("value"), F.col("user_id")
    none = F.array().cast("array<double>")
    return fx.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"),
        (u * 7 % 200 - 100).cast("double").alias("latitude"),
        F.when(F.col("event_type") != "error", (u * 11 % 370 - 185).cast("double")).alias("longitude"),
        F.when(F.col("event_type") != "click", v).alias("current_rainfall"),
        F.when(v < 200, (u % 50 - 5).cast("double")).alias("elevation"),
        (k * 1.2).alias("soil_moisture"),
        F.when(v > 5, v / 4).alias("drainage_capacity"),
        (k * 1.1).alias("building_density"),
        (u * 2037 / 100).alias("population_density"),
        F.when(v > 3, F.array(v / 10, v / 20, v / 40)).otherwise(none).alias("forecast_rainfall"),
        F.when(v > 50, F.array(v, F.lit(1.0))).alias("historical_rainfall"),
        F.array(k).alias("historical_water_levels"),
    )


_BAD = [
    ("Latitude and longitude are required", "latitude IS NULL OR longitude IS NULL"),
    ("Invalid coordinates provided", "latitude IS NOT NULL AND longitude IS NOT NULL AND (latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180)"),
    ("Soil moisture must be between 0 and 100", "soil_moisture NOT BETWEEN 0 AND 100"),
    ("Building density must be between 0 and 100", "building_density NOT BETWEEN 0 AND 100"),
]
_ERR = "list_filter([" + ", ".join(f"CASE WHEN {b} THEN '{t}' END" for t, b in _BAD) + "], lambda x: x IS NOT NULL)"


@query("score_input_errors", f"SELECT request_id, array_to_string({_ERR}, '; ') AS errors FROM ({ASKED})")
def score_input_errors(spark, d):
    return s.input_errors(asked(spark, d)).select("request_id", F.array_join("errors", "; ").alias("errors"))


_FEAT = f"""SELECT request_id, {', '.join(f'coalesce({n}, {v}) AS {n}' if n != 'current_water_level' else '0.0 AS current_water_level' for n, v in s.DEFAULTS.items())},
  coalesce(list_sum(forecast_rainfall), 0) AS forecast_rainfall_sum, coalesce(list_max(forecast_rainfall), 0) AS forecast_rainfall_max,
  coalesce(list_avg(historical_rainfall), 10) AS historical_rainfall_mean, coalesce(list_avg(historical_water_levels), 1) AS historical_water_level_mean FROM ({ASKED})"""
_NAMES = [*s.DEFAULTS, "forecast_rainfall_sum", "forecast_rainfall_max", "historical_rainfall_mean", "historical_water_level_mean"]


@query("score_features", sq(_FEAT, "request_id", " ".join(_NAMES)))
def score_features(spark, d):
    return rounded(s.features(asked(spark, d)))


@query("score_bulk")
def score_bulk(spark, d):
    """Scores of all valid requests by a forest trained on the share of the day's largest value."""
    requests = asked(spark, d)
    top = requests.agg(F.max("current_rainfall").alias("top"))  # one row
    training = s.features(requests).crossJoin(F.broadcast(top)).withColumn("label", F.coalesce(F.try_divide("current_rainfall", "top"), F.lit(0.0)))
    return s.score(requests, s.fit_scorer(training, _NAMES))


_SCORE = f"SELECT *, round((coalesce(current_rainfall, 0) / 500 + soil_moisture / 120) / 2, 9) AS score FROM ({ASKED})"
_FAC = """list_filter([CASE WHEN current_rainfall > 20 THEN 'heavy_rainfall' END, CASE WHEN coalesce(list_sum(forecast_rainfall), 0) > 50 THEN 'forecast_heavy_rainfall' END, CASE WHEN elevation < 5 THEN 'low_elevation' END,
  CASE WHEN drainage_capacity < 30 THEN 'poor_drainage' END, CASE WHEN building_density > 70 THEN 'high_urban_density' END, CASE WHEN soil_moisture > 80 THEN 'saturated_soil' END], lambda x: x IS NOT NULL)"""
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ENR = f"""SELECT request_id, level, confidence, array_to_string(factors, ',') AS factors, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN level IN ('high', 'extreme') THEN {_LIST(s._ACT)} ELSE [] END,
  CASE WHEN level <> 'low' THEN {_LIST(s._WATCH)} ELSE [] END, CASE WHEN list_contains(factors, 'poor_drainage') THEN ['{s._DRAIN}'] ELSE [] END, CASE WHEN list_contains(factors, 'heavy_rainfall') THEN ['{s._RAIN}'] ELSE [] END))), '|') AS recommendations,
  score * 3 AS water_level, CASE WHEN coalesce(current_rainfall, 0) = 0 THEN NULL WHEN current_rainfall > 50 THEN 2 WHEN current_rainfall > 20 THEN 4 WHEN current_rainfall > 10 THEN 8 ELSE 12 END AS hours_to_peak,
  round(score * 2 * CASE WHEN population_density = 0 THEN 1 ELSE least(population_density / 1000, 2) END, 2) AS affected_km2
FROM (SELECT *, {_FAC} AS factors, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'moderate' WHEN score < 0.75 THEN 'high' ELSE 'extreme' END AS level,
  greatest(1 - (current_rainfall IS NULL)::INT * 0.1 - (elevation IS NULL)::INT * 0.1 - (drainage_capacity IS NULL)::INT * 0.1 - CASE WHEN current_rainfall > 100 THEN 0.1 ELSE 0 END - CASE WHEN elevation < 0 THEN 0.05 ELSE 0 END, 0.1) AS confidence FROM ({_SCORE}))"""


@query("score_enrich", sq(_ENR, "request_id level factors recommendations hours_to_peak", "confidence water_level affected_km2"))
def score_enrich(spark, d):
    x = asked(spark, d)
    x = x.withColumn("score", rules.to_digits((F.coalesce("current_rainfall", F.lit(0.0)) / 500 + F.col("soil_moisture") / 120) / 2, 9))
    got = s.enrich(x)
    return rounded(got.select("request_id", "level", "confidence", F.array_join("factors", ",").alias("factors"), F.array_join("recommendations", "|").alias("recommendations"), "water_level", "hours_to_peak", "affected_km2"))


_PROX = """SELECT point_id, probability, depth, CASE WHEN depth > 1 THEN 'extreme' WHEN depth > 0.3 THEN 'high' WHEN depth > 0.1 THEN 'moderate' ELSE 'low' END AS level, greatest(depth * 0.8, 0) AS depth_lower, depth * 1.3 AS depth_upper,
  greatest(probability - 0.1, 0) AS probability_lower, least(probability + 0.1, 1) AS probability_upper FROM (SELECT point_id, least(CASE WHEN distance < 0.05 THEN 0.6 + (0.05 - distance) * 4 ELSE 0.1 + 0.5 * 0.2 END * 1.5, 0.95) AS probability,
  CASE WHEN distance < 0.05 THEN (0.5 + 0.5 * 1.5) * 1.5 ELSE 0.5 * 0.3 * 1.5 END AS depth FROM (SELECT event_id AS point_id, sqrt((36.1 + user_id % 97 / 1000.0::DOUBLE - 36.1566) ** 2 + (-86.84 + user_id % 89 / 1000.0::DOUBLE + 86.7842) ** 2) AS distance FROM events))"""


@query("score_proximity", sq(_PROX, "point_id level", "probability depth depth_lower depth_upper probability_lower probability_upper"))
def score_proximity(spark, d):
    """Near and far points under the five-hundred-year scenario, without noise."""
    u = F.col("user_id")
    points = fx.table(spark, d, "events").select(F.col("event_id").alias("point_id"), (36.1 + u % 97 / 1000).alias("latitude"), (-86.84 + u % 89 / 1000).alias("longitude"))
    return rounded(s.proximity_score(points, s.MULTIPLIERS["500yr"], noise=0.0))


_WIDE = _PROX.replace("36.1 + user_id % 97 / 1000.0::DOUBLE", "35.8 + user_id % 97 / 140.0::DOUBLE").replace("-86.84 + user_id % 89 / 1000.0::DOUBLE", "-87.2 + user_id % 89 / 100.0::DOUBLE").replace(
    "FROM events))", "FROM events WHERE 35.8 + user_id % 97 / 140.0::DOUBLE > 35.9 AND 35.8 + user_id % 97 / 140.0::DOUBLE < 36.4 AND -87.2 + user_id % 89 / 100.0::DOUBLE > -87.1 AND -87.2 + user_id % 89 / 100.0::DOUBLE < -86.5))"
)


@query("score_proximity_region", sq(_WIDE, "point_id level", "probability depth depth_lower depth_upper probability_lower probability_upper"))
def score_proximity_region(spark, d):
    """Points on all sides of the region; those outside have no score."""
    u = F.col("user_id")
    points = fx.table(spark, d, "events").select(F.col("event_id").alias("point_id"), (35.8 + u % 97 / 140).alias("latitude"), (-87.2 + u % 89 / 100).alias("longitude"))
    return rounded(s.proximity_score(s.within_region(points), s.MULTIPLIERS["500yr"], noise=0.0))


_TXT = "trim(replace(replace(text, ';', ''), '--', ''))"


@query("prj_sanitize", f"SELECT doc_id, {_TXT} AS clean, array_to_string(list_transform(string_split(text, ' '), lambda w: trim(replace(replace(w, ';', ''), '--', ''))), ' ') AS clean_words FROM documents")
def prj_sanitize(spark, d):
    """Texts without ``;`` and ``--``, and the same inside their lists of words."""
    docs = fx.table(spark, d, "documents")
    words = F.transform(F.split("text", " "), rules.sanitize)
    return docs.select("doc_id", rules.sanitize(F.col("text")).alias("clean"), F.array_join(words, " ").alias("clean_words"))


@query("set_distinct_texts", "SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') AS words FROM documents WHERE text IS NOT NULL")
def set_distinct_texts(spark, d):
    docs = fx.table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(s.distinct_texts(F.split("text", " ")), " ").alias("words"))
