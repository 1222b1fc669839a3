"""Risk scores of requests: validation, features, model, enrichment and proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .rain import uniform_of

#: The features in order, with what a missing one counts as.
DEFAULTS = {
    "latitude": 0.0, "longitude": 0.0, "elevation": 0.0, "current_rainfall": 0.0, "current_water_level": 0.0, "soil_moisture": 50.0,
    "drainage_capacity": 25.0, "population_density": 1000.0, "building_density": 30.0,
}


def input_errors(requests: DataFrame) -> DataFrame:
    """``requests`` with ``errors``, an array of what is out of range; missing values are no error but for coordinates."""
    c = F.col
    # fixed values: the messages
    outside = lambda name, lo, hi: c(name).isNotNull() & ~c(name).between(lo, hi)
    found = {
        "Latitude and longitude are required": c("latitude").isNull() | c("longitude").isNull(),
        "Invalid coordinates provided": c("latitude").isNotNull() & c("longitude").isNotNull() & (outside("latitude", -90, 90) | outside("longitude", -180, 180)),
        "Soil moisture must be between 0 and 100": outside("soil_moisture", 0, 100),
        "Building density must be between 0 and 100": outside("building_density", 0, 100),
    }
    return requests.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in found.items()])))


def features(requests: DataFrame) -> DataFrame:
    """``request_id`` and the thirteen features: defaults for what is missing, sums, maxima and means of the lists."""
    known = [F.coalesce(F.col(n).cast("double"), F.lit(v)).alias(n) if n in requests.columns else F.lit(v).alias(n) for n, v in DEFAULTS.items()]
    add = lambda name: F.aggregate(F.coalesce(F.col(name), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    some = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    mean = lambda name, empty: F.when(some(name), add(name) / F.size(name)).otherwise(empty)
    return requests.select(
        "request_id",
        *known,
        add("forecast_rainfall").alias("forecast_rainfall_sum"),
        F.when(some("forecast_rainfall"), F.array_max("forecast_rainfall")).otherwise(0.0).alias("forecast_rainfall_max"),
        mean("historical_rainfall", 10.0).alias("historical_rainfall_mean"),
        mean("historical_water_levels", 1.0).alias("historical_water_level_mean"),
    )


def risk_factors(r: DataFrame) -> Column:
    c = lambda n: F.col(n) if n in r.columns else F.lit(None).cast("double")
    forecast = F.aggregate(F.coalesce(F.col("forecast_rainfall"), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    rules_ = [
        ("heavy_rainfall", c("current_rainfall") > 20),
        ("forecast_heavy_rainfall", forecast > 50),
        ("low_elevation", c("elevation") < 5),
        ("poor_drainage", c("drainage_capacity") < 30),
        ("high_urban_density", c("building_density") > 70),
        ("saturated_soil", c("soil_moisture") > 80),
    ]
    return F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in rules_]))


#: Advice by level and by factor.
_ACT = ["Consider immediate evacuation if advised by authorities", "Move to higher ground if possible", "Avoid driving through flooded areas"]
_WATCH = ["Monitor local weather alerts", "Prepare emergency supplies", "Identify safe evacuation routes"]
_DRAIN, _RAIN = "Report drainage issues to local authorities", "Avoid outdoor activities during heavy rain"


def enrich(requests: DataFrame, score: str = "score") -> DataFrame:
    """Level, confidence, factors, advice (sorted, without repeats), water level, hours to the peak and area of scored requests."""
    c = lambda n: F.col(n) if n in requests.columns else F.lit(None).cast("double")
    missing = sum((c(n).isNull().cast("int") for n in ("current_rainfall", "elevation", "drainage_capacity")), F.lit(0))
    extreme = F.when(c("current_rainfall") > 100, 0.1).otherwise(0.0) + F.when(c("elevation") < 0, 0.05).otherwise(0.0)
    confidence = F.least(F.greatest(1 - missing * 0.1 - extreme, F.lit(0.1)), F.lit(1.0))
    level, rain, density = rules.risk_level(F.col(score)), c("current_rainfall"), c("population_density")
    x = requests.withColumns({"level": level, "confidence": confidence, "factors": risk_factors(requests)})
    texts = lambda ok, words: F.when(ok, F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>"))
    has = lambda f: F.array_contains("factors", f)
    advice = F.concat(
        texts(F.col("level").isin("high", "extreme"), _ACT),
        texts(F.col("level").isin("moderate", "high", "extreme"), _WATCH),
        texts(has("poor_drainage"), [_DRAIN]),
        texts(has("heavy_rainfall"), [_RAIN]),
    )
    hours = F.when(rain.isNull() | (rain == 0), None).when(rain > 50, 2).when(rain > 20, 4).when(rain > 10, 8).otherwise(12)
    area = F.col(score) * 2 * F.when(density.isNull() | (density == 0), 1.0).otherwise(F.least(density / 1000, F.lit(2.0)))
    return x.withColumns(
        {"recommendations": distinct_texts(advice), "water_level": F.col(score) * 3, "hours_to_peak": hours.cast("int"), "affected_km2": rules.to_digits(area, 2)}
    )


def distinct_texts(texts: Column) -> Column:
    """Texts once each, in order of the alphabet."""
    return F.array_sort(F.array_distinct(texts))


def fit_scorer(training: DataFrame, names: list[str], label: str = "label", trees: int = 10, seed: int = 42):
    """A pipeline of Spark ML: assembled, standardised, a forest of regression trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    stages = [
        VectorAssembler(inputCols=names, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        RandomForestRegressor(featuresCol="scaled", labelCol=label, predictionCol="predicted", numTrees=trees, maxDepth=5, seed=seed),
    ]
    return Pipeline(stages=stages).fit(training)


def score(requests: DataFrame, model) -> DataFrame:
    """``request_id, score`` of valid requests by a fitted pipeline, within 0..1; invalid ones have no row."""
    valid = input_errors(requests).where(F.size("errors") == 0).drop("errors")
    made = model.transform(features(valid))
    return made.select("request_id", F.least(F.greatest(F.col("predicted"), F.lit(0.0)), F.lit(1.0)).alias("score"))


#: Factors by scenario, and the river point.
MULTIPLIERS = {"10yr": 0.3, "25yr": 0.5, "50yr": 0.7, "100yr": 1.0, "500yr": 1.5}
RIVER = (36.1566, -86.7842)


#: Latitudes and longitudes within which the proximity score holds, ends excluded.
REGION = (35.9, 36.4, -87.1, -86.5)


def within_region(points: DataFrame, region: tuple[float, float, float, float] = REGION) -> DataFrame:
    """Points strictly inside a region (latitudes, longitudes); others, and those without coordinates, can't be scored and go."""
    south, north, west, east = region
    return points.where((F.col("latitude") > south) & (F.col("latitude") < north) & (F.col("longitude") > west) & (F.col("longitude") < east))


def proximity_score(points: DataFrame, multiplier: float = 1.0, noise: float = 1.0, seed: int = 5) -> DataFrame:
    """Probability (0.95 at most), depth, level and bounds by the distance of (latitude, longitude) to a river point.

    ``noise`` 0 takes the middle of each random range, else numbers that follow
    from the point's id.
    """
    u = lambda k: (0.5 + noise * (uniform_of(seed + k, "point_id") - 0.5))
    distance = F.sqrt(F.pow(F.col("latitude") - RIVER[0], 2) + F.pow(F.col("longitude") - RIVER[1], 2))
    x = points.withColumn("distance", distance)
    near = F.col("distance") < 0.05
    probability = F.least(F.when(near, 0.6 + (0.05 - F.col("distance")) * 4).otherwise(0.1 + u(0) * 0.2) * multiplier, F.lit(0.95))
    x = x.withColumns({"probability": probability, "depth": F.when(near, (0.5 + u(1) * 1.5) * multiplier).otherwise(u(1) * 0.3 * multiplier)})
    level = F.when(F.col("depth") > 1, "extreme").when(F.col("depth") > 0.3, "high").when(F.col("depth") > 0.1, "moderate").otherwise("low")
    p, dep = F.col("probability"), F.col("depth")
    return x.select(
        "point_id", "probability", "depth", level.alias("level"), F.greatest(dep * 0.8, F.lit(0.0)).alias("depth_lower"), (dep * 1.3).alias("depth_upper"),
        F.greatest(p - 0.1, F.lit(0.0)).alias("probability_lower"), F.least(p + 0.1, F.lit(1.0)).alias("probability_upper"),
    )
