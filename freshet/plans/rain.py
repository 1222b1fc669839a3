"""Queries of the rainfall, storm and lookup operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..operators import rain as r
from ..sources import fixtures as fx
from .metrics import sq
from .registry import query, rounded

D, Q, ST, G = fx.SQL_DDF, fx.SQL_REQUESTS, fx.SQL_STATIONS, fx.SQL_GRIDS


@query("join_ddf_lookup", f"SELECT request_id, station_id, duration_minutes, return_period_years, depth_in FROM ({Q}) LEFT JOIN ({D}) USING (station_id, duration_minutes, return_period_years)")
def join_ddf_lookup(spark, d):
    return r.lookup(fx.requests(spark, d), fx.ddf(spark, d))


_BOUNDS = f"SELECT station_id, duration_minutes, return_period_years, confidence, round(depth_in * share, 9) AS depth_in FROM ({D}), (VALUES ('estimates', 1.0::DOUBLE), ('upper_bound', 1.2::DOUBLE), ('lower_bound', 0.8::DOUBLE)) c(confidence, share) WHERE confidence = 'estimates' OR station_id % 4 <> 0"
_ASKS = f"SELECT request_id, station_id, duration_minutes, return_period_years, coalesce([NULL, 'upper_bound', 'lower_bound', 'estimates'][request_id % 4 + 1], 'estimates') AS confidence FROM ({Q})"
_SURE = f"""SELECT q.*, b.depth_in, CASE WHEN b.depth_in IS NULL THEN CASE WHEN c.station_id IS NULL THEN 'confidence' WHEN u.station_id IS NULL THEN 'duration' ELSE 'return period' END END AS missing FROM ({_ASKS}) q
  LEFT JOIN ({_BOUNDS}) b USING (station_id, confidence, duration_minutes, return_period_years) LEFT JOIN (SELECT DISTINCT station_id, confidence FROM ({_BOUNDS})) c ON c.station_id = q.station_id AND c.confidence = q.confidence
  LEFT JOIN (SELECT DISTINCT station_id, confidence, duration_minutes FROM ({_BOUNDS})) u ON u.station_id = q.station_id AND u.confidence = q.confidence AND u.duration_minutes = q.duration_minutes"""


@query("join_ddf_confidence", _SURE)
def join_ddf_confidence(spark, d):
    """Estimates and bounds; a quarter of the stations have estimates alone."""
    share = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).alias("x")) for c, x in zip(r.CONFIDENCE, (1.0, 1.2, 0.8), strict=True)]))
    bounds = fx.ddf(spark, d).withColumn("s", share).where("s.c = 'estimates' or station_id % 4 <> 0")
    bounds = bounds.select("station_id", "duration_minutes", "return_period_years", F.col("s.c").alias("confidence"), rules.to_digits(F.col("depth_in") * F.col("s.x"), 9).alias("depth_in"))
    asks = F.get(F.array(F.lit(None), F.lit("upper_bound"), F.lit("lower_bound"), F.lit("estimates")), (F.col("request_id") % 4).cast("int"))
    return r.lookup_by_confidence(fx.requests(spark, d).withColumn("confidence", asks), bounds)


_DAY = f"SELECT station_id, return_period_years, depth_in FROM ({D}) WHERE duration_minutes = 1440"
_KNOWN = f"SELECT * FROM ({_DAY}) JOIN ({ST}) USING (station_id)"
_PLACES = f"""SELECT 'nation ' || nation AS location, return_period_years, avg(depth_in) AS depth_in FROM ({_KNOWN}) WHERE value < 0 GROUP BY 1, 2
  UNION ALL SELECT 'default', return_period_years, avg(depth_in) FROM ({_KNOWN}) GROUP BY 1, 2"""
_FALL = f"""WITH q AS (SELECT request_id, q.station_id, return_period_years, 'nation ' || nation AS location FROM ({Q}) q JOIN ({ST}) s ON s.station_id = q.station_id),
p AS ({_PLACES}), o AS (SELECT * FROM ({_KNOWN}) WHERE value > 5000)
SELECT request_id, q.return_period_years, coalesce(o.depth_in, p.depth_in, e.depth_in) AS depth_in FROM q LEFT JOIN o ON o.station_id = q.station_id AND o.return_period_years = q.return_period_years
  LEFT JOIN p ON p.location = q.location AND p.return_period_years = q.return_period_years LEFT JOIN p e ON e.location = 'default' AND e.return_period_years = q.return_period_years"""


@query("join_depth_default", sq(_FALL, "request_id return_period_years", "depth_in"))
def join_depth_default(spark, d):
    """Depths of stations with a large balance, else of nations (from stations in debt), else of all."""
    place = F.concat(F.lit("nation "), F.col("nation").cast("string"))
    stations = fx.stations(spark, d)
    known = fx.ddf(spark, d).where("duration_minutes = 1440").join(stations, "station_id")
    mean = F.avg("depth_in").alias("depth_in")
    places = known.where("value < 0").groupBy(place.alias("location"), "return_period_years").agg(mean)
    places = places.unionByName(known.groupBy("return_period_years").agg(mean).withColumn("location", F.lit("default")))
    asked = fx.requests(spark, d).join(stations.select("station_id", place.alias("location")), "station_id")
    got = r.depth_with_default(asked, known.where("value > 5000"), places)
    return rounded(got.select("request_id", "return_period_years", "depth_in"))


def _piece(x: str, knots: dict, f: str, below: str, above: str) -> str:
    at = sorted(knots)
    out = f"CASE WHEN {x} < {at[0]} THEN {below} WHEN {x} > {at[-1]} THEN {above}"
    for a, b in zip(at, at[1:], strict=False):
        t = f"(({f.format(x)} - {f.format(a)}) / ({f.format(b)} - {f.format(a)}))"
        out += f" WHEN {x} <= {b} THEN {knots[a]}::DOUBLE * (1 - {t}) + {knots[b]}::DOUBLE * {t}"
    return out + " END"


_INT = f"""SELECT request_id, p, m, {_piece('p', r.DEPTHS_24H, 'ln({}::DOUBLE)', '4.5::DOUBLE * 0.9', '7.8::DOUBLE * ln(p) / ln(500)')} * {_piece('m', r.DURATION_SHARES, '{}::DOUBLE', '0.35::DOUBLE * 0.8', '1.0::DOUBLE * 1.1')} AS v
  FROM (SELECT o_orderkey AS request_id, 2 + o_orderkey % 900 AS p, 30 + o_custkey % 2000 AS m FROM orders)"""


@query("join_ddf_interpolate", f"SELECT request_id, p AS return_period_years, m AS duration_minutes, round(v, 10) AS depth_in, round(v * 0.85, 10) AS lower_bound, round(v * 1.15, 10) AS upper_bound FROM ({_INT})")
def join_ddf_interpolate(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), (2 + F.col("o_orderkey") % 900).alias("return_period_years"), (30 + F.col("o_custkey") % 2000).alias("duration_minutes"))
    v = r.interpolated_depth(F.col("return_period_years"), F.col("duration_minutes"))
    return o.withColumns({"depth_in": rules.to_digits(v, 10), "lower_bound": rules.to_digits(v * 0.85, 10), "upper_bound": rules.to_digits(v * 1.15, 10)})


#: Areas in square miles with factors for a day's rain.
_ARF = [(0, 1.0), (10, 1.0), (25, 0.99), (50, 0.98), (100, 0.97), (200, 0.96), (500, 0.94), (1000, 0.92)]
_ARF_SQL = f"""WITH k AS (SELECT a::DOUBLE AS a, f::DOUBLE AS f, lead(a) OVER (ORDER BY a)::DOUBLE AS b, lead(f) OVER (ORDER BY a)::DOUBLE AS g FROM (VALUES {', '.join(map(str, _ARF))}) v(a, f))
SELECT p_partkey AS request_id, area, depth_in, coalesce(f + (area - a) / (b - a) * (g - f), f) AS factor FROM (SELECT p_partkey, p_size * 10.37::DOUBLE AS area, p_retailprice / 100 AS depth_in FROM part) JOIN k ON area >= a AND (b IS NULL OR area < b)"""


@query("join_area_reduce", sq(f"SELECT *, depth_in * factor AS reduced_in FROM ({_ARF_SQL})", "request_id", "area depth_in factor reduced_in"))
def join_area_reduce(spark, d):
    asked = fx.table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), (F.col("p_size") * 10.37).alias("area"), (F.col("p_retailprice") / 100).alias("depth_in"))
    return rounded(r.area_reduced(asked, spark.createDataFrame([(float(a), f) for a, f in _ARF], "area double, factor double")))


_IDW = f"""WITH s AS (SELECT x, y, value FROM ({ST})), p AS (SELECT s_suppkey AS point_id, (s_suppkey % 360 - 180)::DOUBLE + 0.25 AS x, (s_suppkey * 7 % 180 - 90)::DOUBLE + 0.5 AS y FROM supplier),
j AS (SELECT point_id, value, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 AS d2 FROM p LEFT JOIN s ON (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 225)
SELECT point_id, sum(value / (d2 + 1e-12)) / sum(1 / (d2 + 1e-12)) AS value FROM j GROUP BY 1"""


@query("join_idw", sq(_IDW, "point_id", "value"))
def join_idw(spark, d):
    return rounded(r.idw(_idw_points(spark, d), fx.stations(spark, d), 15.0))


_IDW_ALL = f"""WITH s AS (SELECT x, y, value FROM ({ST})), p AS (SELECT s_suppkey AS point_id, (s_suppkey % 360 - 180)::DOUBLE + 0.25 AS x, (s_suppkey * 7 % 180 - 90)::DOUBLE + 0.5 AS y FROM supplier)
SELECT point_id, sum(value / ((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + 1e-12)) / sum(1 / ((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + 1e-12)) AS value FROM p, s GROUP BY 1"""


def _idw_points(spark, d):
    x, y = (F.col("s_suppkey") % 360 - 180).cast("double") + 0.25, (F.col("s_suppkey") * 7 % 180 - 90).cast("double") + 0.5
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), x.alias("x"), y.alias("y"))


@query("join_idw_all", sq(_IDW_ALL, "point_id", "value"))
def join_idw_all(spark, d):
    return rounded(r.idw_exact(_idw_points(spark, d), fx.stations(spark, d)))


@query("join_idw_hierarchical")
def join_idw_hierarchical(spark, d):
    return r.idw_hierarchical(_idw_points(spark, d), fx.stations(spark, d))


_P = [10, 25, 100, 500]


@query("rain_wide_table", f"SELECT station_id, duration_minutes, {', '.join(f'max(depth_in) FILTER (return_period_years = {p}) AS rp{p}' for p in _P)} FROM ({D}) GROUP BY 1, 2")
def rain_wide_table(spark, d):
    return r.wide_table(fx.ddf(spark, d), _P)


@query("rain_depths_24h", sq(f"SELECT station_id, return_period_years, depth_in * 25.4 AS depth_mm FROM ({_DAY}) WHERE return_period_years IN (10, 100, 1000)", "station_id return_period_years", "depth_mm"))
def rain_depths_24h(spark, d):
    return rounded(r.depths_24h(fx.ddf(spark, d), [10, 100, 1000]))


@query("set_last_wins", f"SELECT station_id, duration_minutes, return_period_years, arg_max(depth_in, line) AS depth_in FROM (SELECT *, 1 AS line FROM ({D}) UNION ALL SELECT station_id, duration_minutes, return_period_years, depth_in * 2, 2 FROM ({D}) WHERE depth_in > 3) GROUP BY 1, 2, 3")
def set_last_wins(spark, d):
    first = fx.ddf(spark, d).withColumn("line", F.lit(1))
    again = first.where("depth_in > 3").withColumns({"depth_in": F.col("depth_in") * 2, "line": F.lit(2)})
    return r.last_wins(first.unionByName(again), "line")


_BOX = f"SELECT station_id AS region_id, x AS west, y AS south, x + 1 + station_id % 3 AS east, y + 0.5 * (station_id % 4) AS north FROM ({ST})"
_PTS = f"""SELECT region_id, i::INT AS i, j::INT AS j, west + i * 0.25 AS lon, south + j * 0.25 AS lat FROM ({_BOX}) b, LATERAL (SELECT unnest(range(0, floor((east - west) / 0.25)::INT + 1)) AS i) a, LATERAL (SELECT unnest(range(0, floor((north - south) / 0.25)::INT + 1)) AS j) c"""


def _boxes(spark, d):
    s = fx.stations(spark, d)
    return s.select(F.col("station_id").alias("region_id"), F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + 1 + F.col("station_id") % 3).alias("east"), (F.col("y") + 0.5 * (F.col("station_id") % 4)).alias("north"))


@query("rain_region_points", sq(_PTS, "region_id i j", "lon lat"))
def rain_region_points(spark, d):
    return rounded(r.region_points(_boxes(spark, d), 0.25))


@query("rain_region_points_beyond", sq(_PTS.replace("floor((east - west) / 0.25)::INT + 1", "ceil((east + 0.4 - west) / 0.4)::INT").replace("floor((north - south) / 0.25)::INT + 1", "ceil((north + 0.4 - south) / 0.4)::INT").replace("0.25", "0.4"), "region_id i j", "lon lat"))
def rain_region_points_beyond(spark, d):
    """The stepping that goes on past the far edge, by a step that does not divide the boxes."""
    return rounded(r.region_points(_boxes(spark, d), 0.4, beyond=True))


@query("top_limit_points", sq(f"SELECT * FROM ({_PTS}) ORDER BY lon, lat, region_id LIMIT 50", "region_id i j", "lon lat"))
def top_limit_points(spark, d):
    """The first fifty points, as a region's point limit does; the limit is the feature."""
    return rounded(r.region_points(_boxes(spark, d), 0.25).orderBy("lon", "lat", "region_id").limit(50))


_FACT = f"SELECT region_id, i, j, p AS return_period_years, 1 + 0.1 * sin(lon * 0.1) * cos(lat * 0.1) AS factor FROM ({_PTS}), (VALUES (10), (100)) v(p)"


@query("rain_spatial_factor", sq(_FACT, "region_id i j return_period_years", "factor"))
def rain_spatial_factor(spark, d):
    points = r.region_points(_boxes(spark, d), 0.25).withColumn("return_period_years", F.explode(F.array(F.lit(10), F.lit(100))))
    return rounded(points.select("region_id", "i", "j", "return_period_years", r.spatial_factor(F.col("lon"), F.col("lat")).alias("factor")))


_EST = f"""SELECT request_id, return_period_years, duration_minutes, (CASE return_period_years WHEN 10 THEN 100 WHEN 25 THEN 125 WHEN 50 THEN 150 WHEN 100 THEN 175 WHEN 500 THEN 225 WHEN 1000 THEN 250 ELSE 100 + (return_period_years - 10) * 1.5 END)::DOUBLE
  * sqrt(duration_minutes / 1440::DOUBLE) AS depth_mm FROM ({Q})"""


@query("rain_estimate", sq(_EST, "request_id return_period_years duration_minutes", "depth_mm"))
def rain_estimate(spark, d):
    v = rules.estimate_depth(F.col("return_period_years"), F.col("duration_minutes"))
    return rounded(fx.requests(spark, d).select("request_id", "return_period_years", "duration_minutes", v.alias("depth_mm")))


_KINDS = [*r.DISTRIBUTIONS, "chicago"]


def _storm_requests(spark, d):
    day = fx.ddf(spark, d).where("duration_minutes = 1440")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), ((F.col("station_id") + F.col("return_period_years")) % len(_KINDS)).cast("int"))
    return day.select(F.concat_ws("_", "station_id", "return_period_years").alias("scenario_id"), kind.alias("kind"), (F.col("depth_in") * 25.4).alias("total"), F.lit(24.0).alias("duration_hours"))


_SR = f"SELECT station_id || '_' || return_period_years AS scenario_id, [{', '.join(repr(k) for k in _KINDS)}][(station_id + return_period_years) % {len(_KINDS)} + 1] AS kind, depth_in * 25.4 AS total, 24 AS hours FROM ({_DAY})"


def _share(k: str, n: str) -> str:
    """The cumulative share after ``k`` of ``n`` steps."""
    out = "CASE"
    for name, shares in r.DISTRIBUTIONS.items():
        last, a = len(shares) - 1, f"least(floor({k} / ({n})::DOUBLE * {len(shares) - 1})::INT, {len(shares) - 2})"
        knots = f"([{', '.join(map(str, shares))}]::DOUBLE[])"
        out += f" WHEN kind = '{name}' THEN {knots}[{a} + 1] + ({knots}[{a} + 2] - {knots}[{a} + 1]) * ({k} / ({n})::DOUBLE * {last} - {a})"
    t = f"({k} / ({n})::DOUBLE)"
    return out + f" WHEN {t} <= 0.3 THEN 0.3 * (1 - greatest((0.3 - {t}) / 0.3, 0) ** 0.4) ELSE 0.3 + 0.7 * greatest(({t} - 0.3) / 0.7, 0) ** 0.4 END"


_STORM = f"""SELECT scenario_id, k::INT AS step, k::DOUBLE AS t_hours, ({_share('k', 'hours')} - ({_share('(k - 1)', 'hours')})) * total AS intensity, {_share('k', 'hours')} * total AS cumulative
  FROM ({_SR}), (SELECT unnest(range(1, 25)) AS k)"""


@query("rain_design_storm", sq(_STORM, "scenario_id step t_hours", "intensity cumulative", 3))
def rain_design_storm(spark, d):
    """A day's storm of every station and period, its type by both."""
    return rounded(r.design_storm(_storm_requests(spark, d), 60), 3)


_SC = f"""SELECT format('{{}}_rp{{}}_d{{}}h_{{}}', station_id, return_period_years, duration_minutes // 60, kind) AS scenario_id, kind, depth_in * 25.4 AS total, (duration_minutes // 60)::BIGINT AS hours FROM ({D}), (VALUES ('II'), ('I'), ('uniform')) v(kind)"""
_SCEN = f"""SELECT scenario_id, count(*) AS steps, max(x) AS peak, sum(x) AS total FROM (SELECT scenario_id, ({_share('k', 'hours')} - ({_share('(k - 1)', 'hours')})) * total AS x FROM ({_SC}), LATERAL (SELECT unnest(range(1, hours + 1)) AS k)) GROUP BY 1"""


@query("rain_scenarios", sq(_SCEN, "scenario_id steps", "peak total", 3))
def rain_scenarios(spark, d):
    """Every station, period, duration and three storm types: the steps, peak and total of each storm."""
    storms = r.design_storm(r.storm_scenarios(fx.ddf(spark, d), ["II", "I", "uniform"]), 60)
    x = F.col("intensity")
    return rounded(storms.groupBy("scenario_id").agg(F.count(x).alias("steps"), F.max(x).alias("peak"), F.sum(x).alias("total")), 3)


_TRI = f"""SELECT scenario_id, step, raw * mean * 12 / sum(raw) OVER (PARTITION BY scenario_id) AS intensity FROM (SELECT station_id || '_' || return_period_years AS scenario_id, depth_in AS mean, step::INT AS step,
  greatest((CASE WHEN step / 11 <= 0.4 THEN step / 11 / 0.4 ELSE (1 - step / 11) / (1 - 0.4) END) * 2 * depth_in, 0.1) AS raw FROM ({_DAY}), (SELECT unnest(range(0, 12))::DOUBLE AS step))"""


@query("rain_triangular_storm", sq(_TRI, "scenario_id step", "intensity", 4))
def rain_triangular_storm(spark, d):
    day = fx.ddf(spark, d).where("duration_minutes = 1440")
    asked = day.select(F.concat_ws("_", "station_id", "return_period_years").alias("scenario_id"), F.col("depth_in").alias("mean"), F.lit(12.0).alias("duration_hours"))
    return rounded(r.triangular_storm(asked, 60), 4)


_PAT = ["uniform", "front", "back", "centre"]
_HY = f"""SELECT scenario_id, hour, raw * total / sum(raw) OVER (PARTITION BY scenario_id) AS depth FROM (SELECT station_id || '_' || return_period_years || '_' || pattern AS scenario_id, depth_in * 25.4 AS total, hour::INT AS hour,
  CASE WHEN pattern = 'front' AND hour < 6 THEN 2 WHEN pattern = 'back' AND hour >= 18 THEN 2 WHEN pattern = 'centre' THEN 0.2 + exp(-pow((hour - 11.5) / 4, 2) / 2) ELSE 1 END::DOUBLE AS raw
  FROM ({_DAY}), (VALUES ('uniform'), ('front'), ('back'), ('centre')) v(pattern), (SELECT unnest(range(0, 24)) AS hour))"""


def _patterns(spark, d):
    day = fx.ddf(spark, d).where("duration_minutes = 1440").withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in _PAT])))
    name = F.concat_ws("_", "station_id", "return_period_years", "pattern")
    return day.select(name.alias("scenario_id"), "pattern", (F.col("depth_in") * 25.4).alias("total"), F.lit(24).alias("hours"))


def _hyeto(spark, d):
    return r.hyetographs(_patterns(spark, d))


@query("rain_hyetographs", sq(_HY, "scenario_id hour", "depth", 3))
def rain_hyetographs(spark, d):
    return rounded(_hyeto(spark, d), 3)


@query("join_scenario_product", f"SELECT station_id || '_' || return_period_years || '_' || pattern AS scenario_id, pattern, return_period_years FROM ({_DAY}), (VALUES ('uniform'), ('front'), ('back'), ('centre')) v(pattern)")
def join_scenario_product(spark, d):
    """Every period with every pattern."""
    day = fx.ddf(spark, d).where("duration_minutes = 1440").withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in _PAT])))
    return day.select(F.concat_ws("_", "station_id", "return_period_years", "pattern").alias("scenario_id"), "pattern", "return_period_years")


_NEST = " UNION ALL ".join(f"SELECT scenario_id, {n} AS steps, max(s) AS peak FROM (SELECT scenario_id, sum(depth) OVER (PARTITION BY scenario_id ORDER BY hour RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s FROM h) GROUP BY 1" for n in (1, 3, 6, 12))


@query("rain_nested_windows", sq(f"WITH h AS ({_HY}) {_NEST}", "scenario_id steps", "peak", 3))
def rain_nested_windows(spark, d):
    return rounded(r.nested_windows(_hyeto(spark, d).withColumnRenamed("hour", "step"), [1, 3, 6, 12]), 3)


_REG = f"""SELECT grid_id, row, col, greatest(50 * (1 - 0.08 * y) * (1 + 0.05 * x) * (1 - 0.06 * exp(-(((x - 0.5) / 0.15) ** 2 + ((y - 0.5) / 0.15) ** 2) / 2)), 0.1) AS value
  FROM (SELECT *, col / max(col) OVER (PARTITION BY grid_id)::DOUBLE AS x, 1 - row / max(row) OVER (PARTITION BY grid_id)::DOUBLE AS y FROM ({G}))"""


@query("rain_regional_field", sq(_REG, "grid_id row col", "value"))
def rain_regional_field(spark, d):
    return rounded(r.regional_field(fx.cells(spark, d, 50), 50.0))


@query("rain_ensemble")
def rain_ensemble(spark, d):
    return r.rain_ensemble(r.regional_field(fx.cells(spark, d, 50), 50.0, 0.05), 5, 0.1)


@query("rain_storm_ensemble")
def rain_storm_ensemble(spark, d):
    return r.curve_ensemble(r.hyetograph_curves(_patterns(spark, d)), 3)


def _tiles(spark, d):
    cells = fx.cells(spark, d, 50).withColumn("value", F.abs("value") * 100)
    at = lambda c: F.floor(F.col(c) / 16)
    return cells.select(F.concat_ws("_", "grid_id", at("row"), at("col")).alias("tile_id"), (F.col("row") % 16).alias("r"), (F.col("col") % 16).alias("c"), "value")


@query("rain_augment")
def rain_augment(spark, d):
    return r.augment_rain(_tiles(spark, d))


@query("rain_raster", sq(f"SELECT grid_id || '_' || return_period_years AS scenario_id, grid_id, row, col, depth_in * 25.4 AS value FROM ({G}) JOIN ({_DAY}) ON station_id = grid_id + 1", "scenario_id grid_id row col", "value"))
def rain_raster(spark, d):
    """Every grid under the depths of the station that has its number."""
    day = fx.ddf(spark, d).where("duration_minutes = 1440").withColumn("grid_id", F.col("station_id") - 1)
    depths = day.select(F.concat_ws("_", "grid_id", "return_period_years").alias("scenario_id"), "grid_id", (F.col("depth_in") * 25.4).alias("depth"))
    return rounded(r.rain_raster(depths, fx.cells(spark, d, 50)))


_CHK = f"""WITH h AS (SELECT *, sum(depth) OVER w * (CASE WHEN scenario_id LIKE '%back' THEN 1 + hour / 100::DOUBLE ELSE 1 END) AS cumulative, sum(depth) OVER w AS running,
  CASE WHEN scenario_id LIKE '%front' THEN abs(hour - 3) ELSE hour END AS t FROM ({_HY}) WINDOW w AS (PARTITION BY scenario_id ORDER BY hour)),
x AS (SELECT *, lag(t) OVER w AS t0, lag(cumulative) OVER w AS c0, first_value(cumulative) OVER w - first_value(depth) OVER w AS start FROM h WINDOW w AS (PARTITION BY scenario_id ORDER BY hour))
SELECT scenario_id, bool_and(coalesce(t >= t0, true)) AS time_ordered, bool_and(coalesce(cumulative >= c0 - 1e-12, true)) AS cumulative_ordered, bool_and(depth >= 0) AS not_negative,
  bool_and(abs(cumulative - running - start) <= 1e-6 * greatest(abs(cumulative), 1e-9)) AS balanced FROM x GROUP BY 1"""


@query("win_check_storms", _CHK)
def win_check_storms(spark, d):
    """Storms of which those at the front run back in time and those at the back gain water."""
    w = Window.partitionBy("scenario_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    front, back = (F.col("scenario_id").endswith(x) for x in ("front", "back"))
    total = F.sum("depth").over(w) * F.when(back, 1 + F.col("hour") / 100).otherwise(1.0)
    t = F.when(front, F.abs(F.col("hour") - 3)).otherwise(F.col("hour"))
    storm = _hyeto(spark, d).select("scenario_id", F.col("hour").alias("step"), t.alias("t_hours"), "depth", total.alias("cumulative"))
    return r.check_storms(storm)
