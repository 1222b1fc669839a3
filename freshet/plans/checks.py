"""Queries of the quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import grid as g
from ..operators import quality as q
from ..sources import fixtures as fx
from ..sources.scratch import shared_folder
from ..sources.versions import Versions
from .grids import _REFLECT, _gap, _grad, _near
from .metrics import sq
from .registry import query, rounded

G, HI, D = fx.SQL_GRIDS, fx.SQL_HISTORY, fx.SQL_DDF


def judged_sql(src: str, key: str, found: list[tuple[str, str, float]]) -> str:
    """The result of penalties over a subquery, its issues as text."""
    score = "round(greatest(1 - (" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END::DOUBLE" for _, c, p in found) + "), 0), 9)"
    issues = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in found)
    status = f"CASE WHEN {score} >= 0.8 THEN 'PASS' WHEN {score} >= 0.6 THEN 'WARN' ELSE 'FAIL' END"
    return f"SELECT {key}, {score} AS score, {status} AS status, array_to_string(list_filter([{issues}], lambda x: x IS NOT NULL), ',') AS issues FROM ({src})"


def flat(df):
    return rounded(df.withColumn("issues", F.array_join("issues", ",")))


_HOLE = f"SELECT * FROM ({G}) WHERE value > -0.18"
_EL = f"""SELECT m.grid_id, nr, nc, crs, lo, hi, n, rise FROM (SELECT grid_id, max(row) + 1 AS nr, max(col) + 1 AS nc, CASE WHEN grid_id % 2 = 0 THEN 'local' END AS crs FROM ({G}) GROUP BY 1) m
  LEFT JOIN (SELECT grid_id, min(value) * 1000 AS lo, max(value) * 1000 AS hi, count(*) AS n FROM ({_HOLE}) GROUP BY 1) s USING (grid_id)
  LEFT JOIN (SELECT grid_id, max(sqrt(dx * dx + dy * dy)) AS rise FROM ({_gap(f'SELECT grid_id, row, col, value * 1000 AS value FROM ({_HOLE})')}) GROUP BY 1) r USING (grid_id)"""
_ELF = [("below range", "lo < -170", 0.2), ("above range", "hi > 420", 0.2), ("voids", "1 - coalesce(n, 0) / (nr * nc) > 0.05", 0.3), ("steep", "rise > 100", 0.2), ("no crs", "crs IS NULL", 0.3)]


@query("qc_elevation", judged_sql(_EL, "grid_id", _ELF))
def qc_elevation(spark, d):
    cells = fx.cells(spark, d, 50)
    meta = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols")).withColumn("crs", F.when(F.col("grid_id") % 2 == 0, "local"))
    return flat(q.check_elevation(cells.where("value > -0.18").withColumn("value", F.col("value") * 1000), meta, -170, 420))


_RS = "SELECT user_id AS case_id, ts::DATE AS step, CASE WHEN event_type <> 'error' THEN value * 3 - 1 END AS value FROM events"
_RF = f"""SELECT case_id, lo, hi, missing, consistency FROM (SELECT case_id, min(value) AS lo, max(value) AS hi, 1 - count(value) / count(*) AS missing FROM ({_RS}) GROUP BY 1)
  JOIN (SELECT case_id, 1 - stddev_pop(m) / avg(m) AS consistency FROM (SELECT case_id, step, avg(value) AS m FROM ({_RS}) GROUP BY 1, 2) GROUP BY 1) USING (case_id)"""


@query("qc_rainfall", judged_sql(_RF, "case_id", [("negative", "lo < 0", 0.2), ("too much", "hi > 500", 0.2), ("missing", "missing > 0.1", 0.3), ("inconsistent", "consistency < 0.5", 0.2)]))
def qc_rainfall(spark, d):
    e = fx.table(spark, d, "events")
    value = F.when(F.col("event_type") != "error", F.col("value") * 3 - 1)
    return flat(q.check_rainfall(e.select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("step"), value.alias("value"))))


_LY = """SELECT c_custkey AS case_id, ['elevation', 'rain', 'labels'][k] AS layer, CASE WHEN k = 2 AND c_custkey % 5 = 0 THEN 'other' ELSE 'local' END AS crs, 10 + CASE WHEN k = 3 AND c_custkey % 7 = 0 THEN 1 ELSE 0 END AS size,
  0.0 AS west, 0.0 AS south, 100 - (k - 1) * (c_custkey % 6) AS east, 100.0 AS north FROM customer, (SELECT unnest([1, 2, 3]) AS k)"""
_LS = f"""SELECT case_id, count(*) FILTER (a.crs <> b.crs) AS other, min(greatest(least(a.east, b.east) - greatest(a.west, b.west), 0) * (least(a.north, b.north) - greatest(a.south, b.south)) / ((b.east - b.west) * (b.north - b.south))) AS overlap, max(abs(a.size - b.size)) AS off
  FROM ({_LY}) a JOIN (SELECT * FROM ({_LY}) WHERE layer = 'elevation') b USING (case_id) WHERE a.layer <> 'elevation' GROUP BY 1"""
_LO = f"""SELECT case_id, score, CASE WHEN score >= 0.8 THEN 'PASS' WHEN score >= 0.6 THEN 'WARN' ELSE 'FAIL' END AS status, issues FROM (SELECT case_id, round(greatest(1 - other * 0.4::DOUBLE - CASE WHEN overlap < 0.95 THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN off > 1e-6 THEN 0.2 ELSE 0 END::DOUBLE, 0), 9) AS score,
  array_to_string(list_filter([CASE WHEN other > 0 THEN 'crs' END, CASE WHEN overlap < 0.95 THEN 'overlap' END, CASE WHEN off > 1e-6 THEN 'resolution' END], lambda x: x IS NOT NULL), ',') AS issues FROM ({_LS}))"""


_EXT = f"""SELECT case_id, min(west)::DOUBLE AS union_west, min(south)::DOUBLE AS union_south, max(east)::DOUBLE AS union_east, max(north)::DOUBLE AS union_north,
  max(west)::DOUBLE AS common_west, max(south)::DOUBLE AS common_south, min(east)::DOUBLE AS common_east, min(north)::DOUBLE AS common_north FROM ({_LY}) GROUP BY 1"""


@query("qc_spatial_extents", _EXT)
def qc_spatial_extents(spark, d):
    return q.spatial_extents(_layers(spark, d))


@query("qc_spatial", _LO)
def qc_spatial(spark, d):
    return flat(q.check_spatial(_layers(spark, d)))


def _layers(spark, d):
    i, k = F.col("c_custkey"), F.col("k")
    c = fx.table(spark, d, "customer").select("c_custkey", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)])).alias("k"))
    return c.select(
        i.alias("case_id"), F.get(F.array(F.lit("elevation"), F.lit("rain"), F.lit("labels")), k - 1).alias("layer"), F.when((k == 2) & (i % 5 == 0), "other").otherwise("local").alias("crs"),
        (10.0 + F.when((k == 3) & (i % 7 == 0), 1).otherwise(0)).alias("size"), F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), (100 - (k - 1) * (i % 6)).cast("double").alias("east"), F.lit(100.0).alias("north"),
    )


_SIM = """SELECT l_orderkey AS run_id, min(l_quantity) - 2 AS low, max(l_quantity) * 1.05 AS high, avg(l_discount) / 5 AS steep_share, avg(l_tax) AS mass_error, min(l_returnflag) <> 'A' AS converged, count(*) AS iterations, 5 AS max_iterations, max(l_quantity) / 2 AS velocity FROM lineitem GROUP BY 1"""
_SIF = [("negative depth", "low < 0", 0.3), ("too deep", "high > 50", 0.2), ("steep", "steep_share > 0.01", 0.2), ("mass", "mass_error > 0.05", 0.3), ("not converged", "NOT converged", 0.4), ("near the last iteration", "iterations > 0.9 * max_iterations", 0.1), ("too fast", "velocity > 20", 0.2)]


@query("qc_simulation", judged_sql(_SIM.replace("avg(l_discount) / 5", "round(avg(l_discount) / 5, 9)").replace("avg(l_tax)", "round(avg(l_tax), 9)"), "run_id", _SIF))
def qc_simulation(spark, d):
    qty = F.col("l_quantity")
    runs = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        (F.min(qty) - 2).alias("low"), (F.max(qty) * 1.05).alias("high"), F.round(F.avg("l_discount") / 5, 9).alias("steep_share"), F.round(F.avg("l_tax"), 9).alias("mass_error"), (F.min("l_returnflag") != "A").alias("converged"),
        F.count(F.lit(1)).alias("iterations"), F.lit(5).alias("max_iterations"), (F.max(qty) / 2).alias("velocity"),
    )
    return flat(q.check_simulation(runs))


_TL = f"SELECT grid_id AS set_id, row // 10 AS i, col // 16 AS j, count(*) AS size, avg((value > 0.1)::INT) AS share, avg(value) AS mean, avg(((row % 10 IN (0, 9) OR col % 16 IN (0, 15)) AND value > 0.1)::INT) * 4 AS edge_share FROM ({G}) GROUP BY 1, 2, 3"
_TS = f"SELECT set_id, count(*) AS n, avg((round(mean, 9) BETWEEN -0.01 AND 0.01)::INT) AS inside, avg((share IN (0, 1))::INT) AS flat, count(DISTINCT size) AS sizes, avg((edge_share > 0.5)::INT) AS edgy FROM ({_TL}) GROUP BY 1"


@query("qc_tiles", judged_sql(_TS, "set_id", [("few", "n < 30", 0.2), ("out of range", "inside < 0.7", 0.3), ("one-sided", "flat > 0.3", 0.2), ("mixed sizes", "sizes > 1", 0.1), ("edge-heavy", "edgy > 0.1", 0.2)]))
def qc_tiles(spark, d):
    edge = (F.col("row") % 10).isin(0, 9) | (F.col("col") % 16).isin(0, 15)
    wet = F.col("value") > 0.1
    by = fx.cells(spark, d, 50).groupBy(F.col("grid_id").alias("set_id"), F.floor(F.col("row") / 10).alias("i"), F.floor(F.col("col") / 16).alias("j"))
    tiles = by.agg(F.count(F.lit(1)).alias("size"), F.avg(wet.cast("int")).alias("share"), F.round(F.avg("value"), 9).alias("mean"), (F.avg((edge & wet).cast("int")) * 4).alias("edge_share"))
    return flat(q.check_tiles(tiles, 30, -0.01, 0.01))


_LB = f"SELECT grid_id, row, col, CASE WHEN value > 0.12 THEN 1 ELSE 0 END::DOUBLE AS value FROM ({G})"
_NN = [g._name(s) for s in g.D8]
_LBS = f"""SELECT grid_id, least(avg((value > 0)::INT), avg((value = 0)::INT)) AS rare, count(*) FILTER (value > 0 AND ({' + '.join(f'coalesce({n}, 0)' for n in _NN)}) = 0) / count(*) FILTER (value > 0) AS alone,
  sum({' + '.join(f'coalesce(({n} = value)::INT, 0)' for n in _NN)}) / sum({' + '.join(f'({n} IS NOT NULL)::INT' for n in _NN)}) AS coherence, count(*) FILTER (value NOT IN (0, 1)) AS odd FROM ({_near(_LB)}) GROUP BY 1"""


def _noise(src: str) -> str:
    """The share of labels that differ from the median of nine, borders mirrored."""
    return f"""WITH src AS ({src}), r AS ({_REFLECT.format(src=src, k=1)}), m AS (SELECT a.grid_id, a.row, a.col, a.value, list_sort(list(b.value))[5] AS med
      FROM src a JOIN r b ON b.grid_id = a.grid_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3, 4)
    SELECT grid_id, avg((value <> med)::INT) AS noise FROM m GROUP BY 1"""


_LBN = f"SELECT * FROM ({_LBS}) JOIN ({_noise(_LB)}) USING (grid_id)"
_BEYOND = f"""WITH q AS (SELECT grid_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({G}) GROUP BY 1)
SELECT grid_id, avg((value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT) AS noise FROM ({G}) JOIN q USING (grid_id) GROUP BY 1"""


@query("qc_label_noise", sq(f"SELECT 'classes' AS kind, * FROM ({_noise(_LB)}) UNION ALL SELECT 'values', * FROM ({_BEYOND})", "kind grid_id", "noise"))
def qc_label_noise(spark, d):
    """Of wet and dry labels by the median about each, of depths by quartile ranges."""
    cells = fx.cells(spark, d, 50)
    wet = q.label_noise(cells.withColumn("value", (F.col("value") > 0.12).cast("double"))).withColumn("kind", F.lit("classes"))
    return rounded(wet.unionByName(q.label_noise(cells).withColumn("kind", F.lit("values"))))


@query("qc_labels", judged_sql(_LBN, "grid_id", [("imbalanced", "rare < 0.01", 0.3), ("isolated", "alone > 0.05", 0.2), ("incoherent", "coherence < 0.8", 0.2), ("noisy", "noise > 0.1", 0.2), ("values", "odd > 0", 0.3)]))
def qc_labels(spark, d):
    return flat(q.check_labels(fx.cells(spark, d, 50).withColumn("value", (F.col("value") > 0.12).cast("double"))))


_MD = """SELECT user_id AS model, count(*) % 3 <> 0 AS converged, count(*) % 4 = 0 AS overfit, avg((value < 80)::INT) AS accuracy, avg((value < 60)::INT) AS real_score, avg((value < 50)::INT) AS dummy_score, max(value) / 200 AS seconds, max(value) * 2 AS megabytes FROM events GROUP BY 1"""
_MDF = [("not converged", "NOT converged", 0.4), ("overfit", "overfit", 0.2), ("inaccurate", "accuracy < 0.7", 0.3), ("no better than a dummy", "real_score - dummy_score <= 0", 0.3), ("hardly better than a dummy", "real_score - dummy_score > 0 AND real_score - dummy_score < 0.1", 0.1), ("slow", "seconds > 1", 0.1), ("large", "megabytes > 500", 0.05)]


@query("qc_model", judged_sql(_MD, "model", _MDF))
def qc_model(spark, d):
    v, n = F.col("value"), F.count(F.lit(1))
    share = lambda x: F.avg((v < x).cast("int"))
    models = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("model")).agg(
        (n % 3 != 0).alias("converged"), (n % 4 == 0).alias("overfit"), share(80).alias("accuracy"), share(60).alias("real_score"), share(50).alias("dummy_score"), (F.max(v) / 200).alias("seconds"), (F.max(v) * 2).alias("megabytes")
    )
    return flat(q.check_model(models))


_SRUN = "SELECT event_id AS run_id, CASE WHEN event_type <> 'click' THEN value / 10 END AS max_depth, value / 500 AS flood_fraction, value * value * 100 AS area, value * 10 AS seconds, CASE WHEN event_type <> 'error' THEN value / 30000 END AS nan_share FROM events"


def _sruns(spark, d):
    v, t = F.col("value"), F.col("event_type")
    return fx.table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.when(t != "click", v / 10).alias("max_depth"), (v / 500).alias("flood_fraction"), (v * v * 100).alias("area"), (v * 10).alias("seconds"), F.when(t != "error", v / 30000).alias("nan_share")
    )


def _band(v: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'skipped' WHEN {v} < {lo} THEN 'warning' WHEN {v} > {hi} THEN 'failed' ELSE 'passed' END"


_CHK = " UNION ALL ".join(
    f"SELECT run_id, '{n}' AS \"check\", {s} AS status FROM ({_SRUN})"
    for n, s in {
        "depth_range": _band("max_depth", "0.01", "20"), "flood_fraction": _band("flood_fraction", "0.001", "0.5"), "flood_area": _band("area", "1000", "1e9"),
        "run_time": "CASE WHEN seconds IS NULL THEN 'skipped' WHEN seconds > 3600 THEN 'warning' ELSE 'passed' END", "data_integrity": "CASE WHEN nan_share IS NULL THEN 'skipped' WHEN nan_share > 0.01 THEN 'failed' ELSE 'passed' END",
    }.items()
)


@query("qc_result_checks", _CHK)
def qc_result_checks(spark, d):
    return q.result_checks(_sruns(spark, d))


_SCO = f"SELECT run_id, (count(*) FILTER (status = 'passed') + 0.5 * count(*) FILTER (status = 'warning')) / count(*) * 100 AS score, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'passed' END AS status FROM ({_CHK}) GROUP BY 1"


@query("qc_result_scores", sq(_SCO, "run_id status", "score"))
def qc_result_scores(spark, d):
    return rounded(q.result_scores(q.result_checks(_sruns(spark, d))))


@query("qc_validation_summary", sq(f"SELECT count(*) AS runs, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'warning') AS warned, count(*) FILTER (status = 'failed') AS failed, avg(score) AS mean_score, count(*) FILTER (status = 'passed') / count(*) AS success_rate, count(*) FILTER (status = 'passed') / count(*) >= 0.9 AS meets_target FROM ({_SCO})", "runs passed warned failed meets_target", "mean_score success_rate"))
def qc_validation_summary(spark, d):
    return rounded(q.validation_summary(q.result_scores(q.result_checks(_sruns(spark, d)))))


_GATE = f"""SELECT run_id, issues = '' AS passed, issues FROM (SELECT run_id, array_to_string(list_filter([CASE WHEN flood_fraction NOT BETWEEN 0.0001 AND 0.8 THEN 'flood fraction' END, CASE WHEN max_depth > 50 THEN 'too deep' END, CASE WHEN max_depth < 0.1 THEN 'too shallow' END,
  CASE WHEN area > 1e6 THEN 'nan' END, CASE WHEN max_depth - 0.5 < 0 THEN 'negative' END], lambda x: x IS NOT NULL), ',') AS issues FROM ({_SRUN}))"""


@query("qc_quality_gate", _GATE)
def qc_quality_gate(spark, d):
    runs = _sruns(spark, d).select("run_id", "flood_fraction", "max_depth", (F.col("max_depth") - 0.5).alias("min_depth"), (F.col("area") > 1e6).cast("int").alias("nan_cells"))
    return q.quality_gate(runs).withColumn("issues", F.array_join("issues", ","))


_PQ = " UNION ALL ".join(
    f"SELECT grid_id, '{f}' AS feature, CASE WHEN min(v) < {lo} OR max(v) > {hi} OR count(v) = 0 THEN 'fail' WHEN 1 - count(v) / count(*) > 0.1 OR abs(stddev_pop(v) / avg(v)) > 100 THEN 'warning' ELSE 'pass' END AS status FROM (SELECT grid_id, {e} AS v FROM ({G})) GROUP BY 1"
    for f, e, lo, hi in (("elevation", "CASE WHEN value > -0.15 THEN value END", -1, 1), ("depth", "abs(value)", 0, 0.42), ("rain", "CASE WHEN value > -0.3 THEN value + 1 END", 0, 2))
)


@query("qc_preprocessing", _PQ)
def qc_preprocessing(spark, d):
    v = F.col("value")
    wide = fx.cells(spark, d, 50).select("grid_id", F.when(v > -0.15, v).alias("elevation"), F.abs(v).alias("depth"), F.when(v > -0.3, v + 1).alias("rain"))
    return q.preprocessing_qa(wide, {"elevation": (-1, 1), "depth": (0, 0.42), "rain": (0, 2)})


_FCO = f"""SELECT grid_id, covar_pop(own, slope) / (stddev_pop(own) * stddev_pop(slope)) > 0.1 AS slope_ok, avg(flow) FILTER (stream) > avg(flow) FILTER (NOT stream) AS flow_ok, bool_and(height BETWEEN 0 AND 1000) AS height_ok
  FROM (SELECT grid_id, degrees(atan(sqrt(dx * dx + dy * dy))) AS own, degrees(atan(sqrt(dx * dx + dy * dy))) + value * 20 AS slope, abs(value) AS flow, value > 0.2 AS stream, value * 1000 + 400 AS height FROM ({_grad(G)})) GROUP BY 1"""


@query("qc_feature_consistency", _FCO)
def qc_feature_consistency(spark, d):
    cells = fx.cells(spark, d, 50)
    v = F.col("value")
    given = g.slope(cells).join(cells, g.CELL).select(*g.CELL, (F.col("slope") + v * 20).alias("slope"), F.abs(v).alias("flow"), (v > 0.2).alias("stream"), (v * 1000 + 400).alias("height"))
    return q.feature_consistency(cells, given)


@query("qc_alignment", f"SELECT grid_id, grid_id % 3 <> 0 AND grid_id % 4 <> 1 AS aligned FROM (SELECT DISTINCT grid_id FROM ({G}))")
def qc_alignment(spark, d):
    """Grids of which every third is shifted and every fourth lacks a column."""
    i = F.col("grid_id")
    a = fx.cells(spark, d, 50).select(*g.CELL, (F.col("col") * 10.0).alias("x"), (F.col("row") * -10.0).alias("y"))
    b = a.where(~((i % 4 == 1) & (F.col("col") == 0))).withColumn("x", F.col("x") + F.when(i % 3 == 0, 0.5).otherwise(1e-9))
    return q.check_alignment(a, b, 1e-6)


_TER = f"""SELECT grid_id, bool_and(value * 100 + 45 BETWEEN 0 AND 90) AS slope_ok, bool_and(col * 5.7 BETWEEN 0 AND 360) AS aspect_ok, bool_and(value * 60 BETWEEN -20 AND 30) AS twi_ok, bool_and(value + 0.45 >= 0) AS height_ok, bool_and(value + 0.001 >= value) AS fill_ok,
  bool_and(row * 100 BETWEEN 1 AND n) AS accumulation_ok FROM (SELECT *, count(*) OVER (PARTITION BY grid_id) AS n FROM ({G})) GROUP BY 1"""


@query("qc_terrain_rules", _TER)
def qc_terrain_rules(spark, d):
    v = F.col("value")
    wide = fx.cells(spark, d, 50).select("grid_id", "value", (v * 100 + 45).alias("slope"), (F.col("col") * 5.7).alias("aspect"), (v * 60).alias("twi"), (v + 0.45).alias("height"), (v + 0.001).alias("filled"), (F.col("row") * 100).alias("accumulation"))
    return q.terrain_rules(wide)


_DT = f"SELECT station_id, (return_period_years * CASE WHEN station_id % 9 = 0 THEN 3 ELSE 1 END)::VARCHAR AS period, CASE WHEN station_id % 7 = 0 AND duration_minutes = 60 THEN 'none' WHEN station_id % 5 = 0 AND duration_minutes = 60 THEN NULL ELSE depth_in::VARCHAR END AS depth FROM ({D})"
_DC = f"""SELECT *, CASE WHEN not_numbers > 0 OR bad_periods > 0 OR negative > 0 OR n < 5 THEN 'error' WHEN large > 0 OR nulls > 0 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT station_id, count(*) AS n, count(*) FILTER (depth IS NOT NULL AND try_cast(depth AS DOUBLE) IS NULL) AS not_numbers,
  count(*) FILTER (depth IS NULL) AS nulls, count(*) FILTER (period::DOUBLE NOT BETWEEN 1 AND 1000) AS bad_periods, count(*) FILTER (try_cast(depth AS DOUBLE) < 0) AS negative, count(*) FILTER (try_cast(depth AS DOUBLE) > 50) AS large FROM ({_DT}) GROUP BY 1)"""


@query("qc_ddf", _DC)
def qc_ddf(spark, d):
    i, m = F.col("station_id"), F.col("duration_minutes")
    period = (F.col("return_period_years") * F.when(i % 9 == 0, 3).otherwise(1)).cast("string")
    depth = F.when((i % 7 == 0) & (m == 60), "none").when((i % 5 == 0) & (m == 60), F.lit(None)).otherwise(F.col("depth_in").cast("string"))
    return q.check_ddf(fx.ddf(spark, d).select("station_id", period.alias("period"), depth.alias("depth")))


#: Each hour of an event type's history is a result of one of the five components.
_NAMED = list(q.COMPONENT_ADVICE)
_RS = f"""SELECT component AS run_id, [{', '.join(repr(c) for c in _NAMED)}][hour(ts) % 5 + 1] AS component, score, CASE WHEN score < 0.6 THEN 'FAIL' WHEN score < 0.8 THEN 'WARN' ELSE 'PASS' END AS status FROM ({HI})
  UNION ALL SELECT 'calm', 'DEM_Quality', 0.9, 'PASS'"""
_REC = f"""SELECT run_id, coalesce(array_to_string(list_sort(list_filter(list_distinct(flatten(list(t))), lambda x: x IS NOT NULL)), '|'), '') AS advice FROM (SELECT run_id,
  [CASE status WHEN 'FAIL' THEN 'CRITICAL: Address issues in ' || component || ' before proceeding' WHEN 'WARN' THEN 'WARNING: Review and potentially fix issues in ' || component END,
   CASE WHEN score < 0.8 THEN CASE component {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in q.COMPONENT_ADVICE.items())} END END] AS t FROM ({_RS})) GROUP BY 1"""


@query("qc_recommendations", f"SELECT run_id, CASE WHEN advice = '' THEN '{q.ALL_PASSED}' ELSE advice END AS advice FROM ({_REC})")
def qc_recommendations(spark, d):
    h = fx.history(spark, d)
    component = F.get(F.array(*[F.lit(c) for c in _NAMED]), F.hour("ts") % 5)
    results = h.select(F.col("component").alias("run_id"), component.alias("component"), "score", rules.status_of(F.col("score")).alias("status"))
    calm = h.limit(1).select(F.lit("calm").alias("run_id"), F.lit("DEM_Quality").alias("component"), F.lit(0.9).alias("score"), F.lit("PASS").alias("status"))
    return q.recommendations(results.unionByName(calm)).withColumn("advice", F.array_join("advice", "|"))


_LONG = """SELECT l_orderkey AS case_id, unnest([{'metric': 'iou', 'value': avg(l_discount) * 12}, {'metric': 'rmse', 'value': max(l_quantity) / 40}, {'metric': 'far', 'value': avg(l_tax) * 8}, {'metric': 'nse', 'value': 0.6 - max(l_discount) * 7}], recursive := true) FROM lineitem GROUP BY 1"""
_WHENS = " UNION ALL ".join(f"SELECT case_id, '{p}' AS priority, '{c}' AS category, '{i}' AS issue, '{r}' AS recommendation, format('{t.replace('%.3f', '{:.3f}')}', round(value, 9)::DOUBLE) AS metric FROM l WHERE metric = '{m}' AND {w}" for m, w, p, c, i, r, t in q.METRIC_ADVICE)


@query("qc_metric_recommendations", f"WITH l AS (SELECT case_id, metric, round(value::DOUBLE, 9) AS value FROM ({_LONG})) {_WHENS}")
def qc_metric_recommendations(spark, d):
    from ..operators.metrics import long_form

    n = lambda c: F.col(c).cast("double")
    by = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"))
    wide = by.agg((F.avg(n("l_discount")) * 12).alias("iou"), (F.max(n("l_quantity")) / 40).alias("rmse"), (F.avg(n("l_tax")) * 8).alias("far"), (0.6 - F.max(n("l_discount")) * 7).alias("nse"))
    return q.metric_recommendations(rounded(long_form(wide, "case_id", "standard"), 9))


_KEPT = "TIMESTAMP '2024-01-12 00:00:00'"


@query("qc_append_run", f"SELECT component, count(*) AS n, sum(score) AS total FROM (SELECT component, round(score, 6) AS score FROM ({HI})) GROUP BY 1".replace("sum(score)", "round(sum(score), 4)"))
def qc_append_run(spark, d):
    """Scores stored as runs with their results, each half twice, read back."""
    folder = _stored(spark, d)
    return _totals(spark, folder)


@query("qc_retain_runs", f"SELECT component, count(*) AS n, round(sum(round(score, 6)), 4) AS total FROM ({HI}) WHERE ts >= {_KEPT} GROUP BY 1")
def qc_retain_runs(spark, d):
    """The same tables after old runs and their results have been deleted, twice."""
    folder = _stored(spark, d)
    for _ in range(2):
        q.retain_runs(spark, folder, F.lit("2024-01-12 00:00:00").cast("timestamp"))
    return _totals(spark, folder)


def _stored(spark, d) -> str:
    h = fx.history(spark, d).select(F.col("component").alias("name"), "ts", "component", F.round("score", 6).alias("score"))
    folder = shared_folder(spark, "runs")
    for name, half in (("early", "day(ts) < 15"), ("late", "day(ts) >= 15"), ("early", "day(ts) < 15"), ("late", "day(ts) >= 15")):
        q.append_run(h.where(half).select("name", "ts"), h.where(half), folder, name)
    return folder


def _totals(spark, folder: str):
    store = Versions(spark, folder)
    back = store.read("runs").select("run_id").join(store.read("results"), "run_id")
    return back.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))
