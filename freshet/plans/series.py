"""Queries of histories, trends, roll-ups, provenance, extents and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as b
from ..operators import series as s
from ..sources import fixtures as fx
from .metrics import sq
from .registry import query, rounded

HI, G, ST = fx.SQL_HISTORY, fx.SQL_GRIDS, fx.SQL_STATIONS


def _events(spark, d):
    return fx.table(spark, d, "events")


def _ts(text: str):
    return F.lit(text).cast("timestamp")


_RUN = "SELECT user_id AS run_id, event_id AS epoch, (event_id * 37 % 100) / 100.0::DOUBLE AS train_loss, value / 500 AS val_loss FROM events"
_SL = "regr_slope({}, epoch) OVER w"
_TRN = f"""SELECT run_id, epoch, n = 5 AND sd < 0.05 AS converged, n = 5 AND vs > 0 AND ts < 0 AS overfit FROM (SELECT *, count(*) OVER w AS n, stddev_pop(val_loss) OVER w AS sd, {_SL.format('val_loss')} AS vs, {_SL.format('train_loss')} AS ts
  FROM ({_RUN}) WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query("win_training_trend", _TRN)
def win_training_trend(spark, d):
    e = _events(spark, d)
    runs = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), (F.col("event_id") * 37 % 100 / 100.0).alias("train_loss"), (F.col("value") / 500).alias("val_loss"))
    return s.training_trend(runs, flat=0.05)


_CON = "SELECT run_id, CASE WHEN n > 5 THEN rate END AS rate, final, final < 1e-6 AS converged FROM (SELECT user_id AS run_id, count(*) AS n, regr_slope(log10(value * 1e-8 + 1e-15), event_id) * 1000 AS rate, arg_max(value, event_id) * 1e-8 AS final FROM events GROUP BY 1)"


@query("win_convergence", f"SELECT run_id, round(rate, 6) + 0.0::DOUBLE AS rate, round(final * 1e6, 6) + 0.0::DOUBLE AS final_millionths, converged FROM ({_CON})")
def win_convergence(spark, d):
    got = s.convergence(_events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), (F.col("value") * 1e-8).alias("residual")))
    return rounded(got.select("run_id", (F.col("rate") * 1000).alias("rate"), (F.col("final") * 1e6).alias("final_millionths"), "converged"))


_KEYED = "SELECT user_id AS component, ts, round(value / 500, 9) AS score FROM events"
_DEC = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC) AS k FROM (SELECT *, max(ts) OVER (PARTITION BY component) AS top FROM ({_KEYED})) WHERE ts >= top - INTERVAL 7 DAY),
g AS (SELECT component, max(ts) AS ts, max(score) FILTER (k = 1) AS a, max(score) FILTER (k = 2) AS b, max(score) FILTER (k = 3) AS c FROM r WHERE k <= 3 GROUP BY 1)
SELECT component, ts, a AS score, round(c - a, 9) AS fall FROM g WHERE a < b AND b < c AND round(c - a, 9) > 0.01"""


@query("win_recent_decline", sq(_DEC, "component ts", "score fall"))
def win_recent_decline(spark, d):
    """The last three scores of a user's newest week."""
    scores = _events(spark, d).select(F.col("user_id").alias("component"), "ts", F.round(F.col("value") / 500, 9).alias("score"))
    return rounded(s.recent_decline(scores, fall=0.01))


_RET = "SELECT pipeline, ts, size, rank::INT AS rank, ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY OR rank > 40 AS dropped FROM (SELECT user_id AS pipeline, ts, event_id AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events)"


def _retention(spark, d):
    records = _events(spark, d).select(F.col("user_id").alias("pipeline"), "ts", F.col("event_id").alias("size"))
    return s.retention(records, 40, 20, _ts("2024-01-31 00:00:00"))


@query("win_retention_rule", _RET)
def win_retention_rule(spark, d):
    return _retention(spark, d)


@query("agg_freed_bytes", f"SELECT pipeline, count(*) AS dropped, sum(size)::BIGINT AS freed FROM ({_RET}) WHERE dropped GROUP BY 1")
def agg_freed_bytes(spark, d):
    return _retention(spark, d).where("dropped").groupBy("pipeline").agg(F.count(F.lit(1)).alias("dropped"), F.sum("size").alias("freed"))


_STG = ["prepare", "simulate", "train", "report"]
_PTS = f"SELECT user_id AS pipeline, [{', '.join(repr(x) for x in _STG)}][event_id % 4 + 1] AS stage, ts FROM events"
_REC = f"""SELECT pipeline, stage, ts, row_number() OVER (PARTITION BY pipeline ORDER BY o DESC, ts DESC)::INT AS place, array_to_string([{', '.join(repr(x) for x in _STG)}][o + 1:], ',') AS remaining, o / 4 * 100 AS saved_percent
  FROM (SELECT pipeline, stage, max(ts) AS ts, list_position([{', '.join(repr(x) for x in _STG)}], stage) AS o FROM ({_PTS}) GROUP BY 1, 2)"""


@query("win_recovery_options", sq(_REC, "pipeline stage ts place remaining", "saved_percent"))
def win_recovery_options(spark, d):
    stage = F.get(F.array(*[F.lit(x) for x in _STG]), (F.col("event_id") % 4).cast("int"))
    return rounded(s.recovery_options(_events(spark, d).select(F.col("user_id").alias("pipeline"), stage.alias("stage"), "ts"), _STG))


@query("win_resource_trend", "SELECT host, event_id, ts, value FROM (SELECT user_id AS host, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 720 MINUTE OR k = 1")
def win_resource_trend(spark, d):
    return s.resource_trend(_events(spark, d).select(F.col("user_id").alias("host"), "event_id", "ts", "value"), 720, _ts("2024-01-30 12:00:00"))


@query("win_throttle")
def win_throttle(spark, d):
    return s.throttled(_events(spark, d).select(F.col("event_type").alias("kind"), "ts"), 5)


_SER = f"""SELECT component AS series_id, covar_pop(p, o) / (stddev_pop(p) * stddev_pop(o)) AS correlation, sqrt(avg((p - o) ** 2)) AS rmse, avg(abs(p - o)) AS mae, avg(o) AS mean, avg(o) - stddev_pop(o) AS low, avg(o) + stddev_pop(o) AS high
  FROM (SELECT a.component, a.score AS p, b.score AS o FROM ({HI}) a JOIN ({HI}) b ON a.component = b.component AND b.ts = a.ts + INTERVAL 1 HOUR) GROUP BY 1"""


@query("win_series_validation", sq(_SER, "series_id", "correlation rmse mae mean low high"))
def win_series_validation(spark, d):
    """Each hour's score as a forecast of the next."""
    x = fx.history(spark, d)
    later = x.select("component", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("score").alias("obs"))
    return rounded(s.series_validation(x.withColumnRenamed("score", "pred").join(later, ["component", "ts"]).withColumnRenamed("component", "series_id")))


@query("win_temporal_consistency", sq("SELECT case_id, 1 - stddev_pop(m) / avg(m) AS consistency, coalesce(1 - stddev_pop(m) / avg(m) < 0.5, true) AS flagged FROM (SELECT user_id AS case_id, ts::DATE AS step, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1", "case_id flagged", "consistency"))
def win_temporal_consistency(spark, d):
    return rounded(s.temporal_consistency(_events(spark, d).select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("step"), "value")))


_BAT = """SELECT user_id AS batch_id, count(*) AS jobs, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, sum(value) AS seconds, avg(value) AS mean_seconds,
  coalesce(array_to_string(list_sort(list(event_id) FILTER (event_type = 'error')), ','), '') AS failed_ids, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate, count(*) * 3600 / sum(value) AS per_hour FROM events GROUP BY 1"""


@query("agg_batch_summary", sq(_BAT, "batch_id jobs succeeded failed failed_ids", "seconds mean_seconds success_rate per_hour"))
def agg_batch_summary(spark, d):
    e = _events(spark, d)
    got = s.batch_summary(e.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("job_id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds")))
    return rounded(got.withColumn("failed_ids", F.array_join(F.transform("failed_ids", lambda x: x.cast("string")), ",")))


_PRG = """SELECT run_id, finished, mean_seconds, min_seconds, max_seconds, total_seconds, progress, elapsed, CASE WHEN progress >= 0.1 THEN elapsed / progress - elapsed END AS seconds_left FROM (SELECT user_id AS run_id, count(*) FILTER (value >= 50) AS finished,
  avg(value) FILTER (value >= 50) AS mean_seconds, min(value) FILTER (value >= 50) AS min_seconds, max(value) FILTER (value >= 50) AS max_seconds, sum(value) FILTER (value >= 50) AS total_seconds, avg(least(value / 50, 1)) AS progress, sum(value) AS elapsed FROM events GROUP BY 1)"""


@query("agg_progress_summary", sq(_PRG, "run_id finished", "mean_seconds min_seconds max_seconds total_seconds progress elapsed seconds_left"))
def agg_progress_summary(spark, d):
    share = F.least(F.col("value") / 50, F.lit(1.0))
    return rounded(s.progress_summary(_events(spark, d).select(F.col("user_id").alias("run_id"), F.col("value").alias("seconds"), share.alias("share"))))


_ISS = "SELECT severity, check_ AS \"check\", count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, unnest([event_type, CASE WHEN value > 100 THEN 'depth' END]) AS check_ FROM events) WHERE check_ IS NOT NULL GROUP BY 1, 2"


@query("agg_issue_frequency", _ISS)
def agg_issue_frequency(spark, d):
    text = lambda c: F.concat(c, F.lit(": "), F.col("value").cast("string"))
    issues = F.array_compact(F.array(text(F.col("event_type")), F.when(F.col("value") > 100, text(F.lit("depth")))))
    severity = F.when(F.col("event_type") == "error", "error").otherwise("warning")
    return s.issue_frequency(_events(spark, d).select(severity.alias("severity"), issues.alias("issues")))




def _provenance(spark, d):
    i, v = F.col("event_id"), F.col("value")
    flags = F.array_compact(F.array(F.when(v > 20, F.lit("validated")), F.when(i % 2 == 0, F.lit("calibrated")), F.when(i % 3 == 0, F.lit("archived"))))
    return _events(spark, d).select(
        i.alias("run_id"), F.col("ts").alias("created"), F.get(F.array(F.lit(10), F.lit(100), F.lit(500)), (i % 3).cast("int")).alias("return_period"), F.col("event_type").alias("pattern"), (i % 24 + 1).alias("duration_hours"),
        F.create_map(F.lit("dem.tif"), i * 100, F.lit("rain.csv"), F.lit(5000).cast("long")).alias("inputs"), F.create_map(F.lit("depth.tif"), i * 10).alias("outputs"),
        v.alias("seconds"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), flags.alias("flags"), F.col("ts").alias("started"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ended"),
        F.when(v > 100, F.array(F.lit("deep"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


@query("agg_lineage", "SELECT event_id AS run_id, 2 AS n_inputs, (event_id * 100 + 5000) / 1e6 AS input_mb, 1 AS n_outputs, event_id * 10 / 1e6 AS output_mb, 'csv,tif' AS types, 90000000::BIGINT AS micros, value > 100 AS has_warnings FROM events")
def agg_lineage(spark, d):
    return s.lineage(_provenance(spark, d))


@query("prj_provenance_search", "SELECT event_id AS run_id, ts AS created FROM events WHERE value > 20 AND event_id % 2 = 0 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND event_id % 3 IN (1, 2)")
def prj_provenance_search(spark, d):
    return s.provenance_search(_provenance(spark, d), ["validated", "calibrated"], _ts("2024-01-05 00:00:00"), _ts("2024-01-20 00:00:00"), [100, 500]).select("run_id", "created")


_FLAT = """SELECT event_id AS run_id, ts AS created, [10, 100, 500][event_id % 3 + 1] AS return_period, event_type AS pattern, event_id % 24 + 1 AS duration_hours, 2 AS input_files, 1 AS output_files, value AS seconds,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'archived' END, CASE WHEN event_id % 2 = 0 THEN 'calibrated' END, CASE WHEN value > 20 THEN 'validated' END], x -> x IS NOT NULL), ';') AS flags FROM events"""


@query("snk_provenance_rows", _FLAT.replace("x ->", "lambda x:"))
def snk_provenance_rows(spark, d):
    return s.provenance_rows(_provenance(spark, d))


@query("agg_compare_models", sq("SELECT event_type AS model, avg(value) FILTER (event_id % 3 = 0) AS mae, avg(value) FILTER (event_id % 3 = 1) AS rmse, avg(value) FILTER (event_id % 3 = 2) AS r2 FROM events GROUP BY 1", "model", "mae rmse r2"))
def agg_compare_models(spark, d):
    metric = F.get(F.array(F.lit("mae"), F.lit("rmse"), F.lit("r2")), (F.col("event_id") % 3).cast("int"))
    return rounded(s.compare_models(_events(spark, d).select(F.col("event_type").alias("model"), metric.alias("metric"), "value"), ["mae", "rmse", "r2"]))


@query("agg_cv_summary", sq("SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS folds FROM (SELECT 'm' || user_id AS metric, value FROM events WHERE event_type <> 'error' AND value <= 100) GROUP BY 1", "metric folds", "mean std"))
def agg_cv_summary(spark, d):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("value") <= 100, F.col("value"))
    return rounded(s.cv_summary(_events(spark, d).select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("metric"), value.alias("value"))))


@query("agg_checkpoint_summary", sq("SELECT event_type AS pipeline, count(*) AS n, count(*) FILTER (value > 5) AS valid, sum(event_id) / 1e6 AS mb, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY ROLLUP (event_type)", "pipeline n valid oldest newest", "mb"))
def agg_checkpoint_summary(spark, d):
    return rounded(s.checkpoint_summary(_events(spark, d).select(F.col("event_type").alias("pipeline"), "ts", (F.col("value") > 5).alias("valid"), F.col("event_id").alias("size"))))


@query("agg_output_inventory", sq("SELECT lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS files, sum(strlen(html)) / 1e6 AS mb FROM pages GROUP BY ROLLUP (1)", "extension files", "mb"))
def agg_output_inventory(spark, d):
    """Pages as files, by the ending of their address."""
    return rounded(s.output_inventory(fx.table(spark, d, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"))))


_FC = " UNION ALL ".join(f"SELECT grid_id, '{x}' AS a, '{y}' AS b, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) AS r FROM w GROUP BY 1" for x, y in (("height", "depth"), ("height", "east"), ("depth", "east")))


@query("agg_feature_correlations", sq(f"WITH w AS (SELECT grid_id, value AS height, abs(value) AS depth, col::DOUBLE AS east FROM ({G})) {_FC}", "grid_id a b", "r"))
def agg_feature_correlations(spark, d):
    v = F.col("value")
    return rounded(s.feature_correlations(fx.cells(spark, d, 50).select("grid_id", v.alias("height"), F.abs(v).alias("depth"), F.col("col").cast("double").alias("east")), ["height", "depth", "east"]))


_FS = f"""SELECT grid_id, count(*) AS cells, count(*) FILTER (v >= 0.5) AS flooded, max(v) AS max_depth, avg(v) AS mean_depth, avg(v) FILTER (v >= 0.5) AS mean_flooded, {', '.join(f'quantile_cont(v, {q}) FILTER (v >= 0.5) AS p{n}' for q, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))},
  count(*) FILTER (v >= 0.5) / count(*) AS share, count(*) FILTER (v >= 0.5) * 0.0001 AS area_km2 FROM (SELECT grid_id, abs(value) * 8 AS v FROM ({G})) GROUP BY 1"""


@query("agg_flood_statistics", sq(_FS, "grid_id cells flooded", "max_depth mean_depth mean_flooded p50 p90 p95 p99 share area_km2"))
def agg_flood_statistics(spark, d):
    return rounded(s.flood_statistics(fx.cells(spark, d, 50).withColumn("value", F.abs("value") * 8), 0.5, 0.0001))


_PS = f"""SELECT period, min(v) AS low, max(v) AS high, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, max(row) + 1 AS nrows, max(col) + 1 AS ncols, count(DISTINCT member) AS members
  FROM (SELECT grid_id // 5 AS period, grid_id % 5 AS member, row, col, abs(value) * 100 AS v FROM ({G})) GROUP BY 1"""


@query("agg_precipitation_summary", sq(_PS, "period nrows ncols members", "low high mean std p10 p50 p90"))
def agg_precipitation_summary(spark, d):
    g = F.col("grid_id")
    cells = fx.cells(spark, d, 50).select(F.floor(g / 5).alias("period"), (g % 5).alias("member"), "row", "col", (F.abs("value") * 100).alias("value"))
    return rounded(s.precipitation_summary(cells, ["period"]))


@query("agg_bootstrap")
def agg_bootstrap(spark, d):
    """An interval of a weighted mean absolute error, the caller's own column."""
    metric = lambda w: F.sum(w * F.abs(F.col("pred") - F.col("obs"))) / F.sum(w)
    return s.bootstrap(fx.depth_pairs(spark, d), metric, 50)


@query("top_history", f"SELECT component, ts, score FROM ({HI}) WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def top_history(spark, d):
    return s.history(fx.history(spark, d), _ts("2024-01-20 00:00:00"))


@query("join_component_trend", "SELECT event_id AS run_id, ts, value AS score FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00'")
def join_component_trend(spark, d):
    e = _events(spark, d)
    results = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("component"), F.col("value").alias("score"))
    runs = e.select(F.col("event_id").alias("run_id"), "ts")
    return s.component_trend(results, runs, "error", _ts("2024-01-20 00:00:00")).select("run_id", "ts", "score")


@query("top_stages", "SELECT 'stage ' || event_id AS stage, value AS seconds FROM events ORDER BY value DESC, 'stage ' || event_id LIMIT 10")
def top_stages(spark, d):
    """The ten longest; the limit is the feature."""
    return s.top_stages(_events(spark, d).select(F.concat(F.lit("stage "), F.col("event_id").cast("string")).alias("stage"), F.col("value").alias("seconds")), 10)


@query("top_warnings", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def top_warnings(spark, d):
    """The last ten warnings; the limit is the feature."""
    return _events(spark, d).where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "ts")


_BOX = f"SELECT station_id AS id, x AS west, y AS south, x + 1 + station_id % 3 AS east, y + 1 + station_id % 4 AS north FROM ({ST})"
_OV = f"""SELECT id, id2, c / ((e1 - w1) * (n1 - s1)) AS of_first, c / ((e2 - w2) * (n2 - s2)) AS of_second, least(c / ((e1 - w1) * (n1 - s1)), c / ((e2 - w2) * (n2 - s2))) AS mutual FROM (SELECT a.id, b.id AS id2, a.west AS w1, a.east AS e1, a.south AS s1, a.north AS n1, b.west AS w2, b.east AS e2, b.south AS s2, b.north AS n2,
  (least(a.east, b.east) - greatest(a.west, b.west)) * (least(a.north, b.north) - greatest(a.south, b.south)) AS c FROM ({_BOX}) a JOIN ({_BOX}) b ON a.id < b.id AND a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north)"""


def _boxes(spark, d):
    x = fx.stations(spark, d)
    i = F.col("station_id")
    return x.select(i.alias("id"), F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + 1 + i % 3).alias("east"), (F.col("y") + 1 + i % 4).alias("north"))


@query("join_pairwise_overlap", sq(_OV, "id id2", "of_first of_second mutual"))
def join_pairwise_overlap(spark, d):
    return b.pairwise_overlap(_boxes(spark, d), 4.0, 6)


_QB = "SELECT s_suppkey AS query_id, (s_suppkey % 300 - 150)::DOUBLE AS west, (s_suppkey * 7 % 150 - 75)::DOUBLE AS south FROM supplier"


@query("join_catalog_search", f"SELECT query_id, id AS item_id FROM ({_BOX}) a JOIN ({_QB}) q ON a.west <= q.west + 10 AND q.west <= a.east AND a.south <= q.south + 5 AND q.south <= a.north")
def join_catalog_search(spark, d):
    k = F.col("s_suppkey")
    w, so = (k % 300 - 150).cast("double"), (k * 7 % 150 - 75).cast("double")
    asked = fx.table(spark, d, "supplier").select(k.alias("query_id"), w.alias("west"), so.alias("south"), (w + 10).alias("east"), (so + 5).alias("north"))
    return b.catalog_search(_boxes(spark, d).withColumnRenamed("id", "item_id"), asked, 8.0)


@query("join_zip_tiles", f"SELECT grid_id AS tile_id, row AS r, col AS c, value AS elevation, abs(value) * 10 AS rain, CASE WHEN value > 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM ({G}) WHERE abs(value) > 0.01")
def join_zip_tiles(spark, d):
    t = fx.cells(spark, d, 50).select(F.col("grid_id").alias("tile_id"), F.col("row").alias("r"), F.col("col").alias("c"), "value")
    rain = t.where("abs(value) > 0.01").withColumn("value", F.abs("value") * 10)
    return b.zip_tiles(elevation=t, rain=rain, label=t.withColumn("value", (F.col("value") > 0.1).cast("double")))


@query("set_combine", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def set_combine(spark, d):
    sup = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return b.combine([sup, fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))])


@query("set_stack_periods", f"SELECT grid_id // 3 AS duration, row, col, max(value) FILTER (grid_id % 3 = 0) AS rp10, max(value) FILTER (grid_id % 3 = 1) AS rp100, max(value) FILTER (grid_id % 3 = 2) AS rp500 FROM ({G}) GROUP BY 1, 2, 3")
def set_stack_periods(spark, d):
    g = F.col("grid_id")
    period = F.get(F.array(F.lit(10), F.lit(100), F.lit(500)), (g % 3).cast("int"))
    return b.stack_periods(fx.cells(spark, d, 50).select(F.floor(g / 3).alias("duration"), period.alias("period"), "row", "col", "value"), [500, 10, 100])


@query("set_completeness", "SELECT user_id AS run_id, array_to_string(list_filter(['click', 'error', 'refund'], lambda x: NOT list_contains(names, x)), ',') AS missing, list_has_all(names, ['click', 'error', 'refund']) AS complete FROM (SELECT user_id, list(DISTINCT CASE WHEN value > 40 THEN event_type ELSE 'other' END) AS names FROM events GROUP BY 1)")
def set_completeness(spark, d):
    names = _events(spark, d).groupBy(F.col("user_id").alias("run_id")).agg(F.collect_set(F.when(F.col("value") > 40, F.col("event_type")).otherwise("other")).alias("names"))
    got = b.completeness(names, ["click", "error", "refund"])
    return got.select("run_id", F.array_join("missing", ",").alias("missing"), "complete")
