"""Operators that SQL does not state, against brute force and their own rules."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import boxes, claims, grid, hydrology, quality, rain, scoring, series, tiles
from freshet.plans import registry

SF = "/root/testdata/sf0.001"
CELLS = "grid_id long, row int, col int, value double"
registry.load()


def run(spark, name):
    return registry.QUERIES[name](spark, SF)


def table(spark, z, grid_id=1):
    rows = [(grid_id, i, j, float(v)) for (i, j), v in np.ndenumerate(z) if not np.isnan(v)]
    return spark.createDataFrame(rows, CELLS)


def brute_fill(z):
    out = np.full(z.shape, np.nan)
    ok, queue = ~np.isnan(z), []
    around = lambda i, j: [(i + a, j + b) for a, b in grid.D8 if 0 <= i + a < z.shape[0] and 0 <= j + b < z.shape[1]]
    for i, j in zip(*np.nonzero(ok), strict=True):
        if len(around(i, j)) < 8 or any(not ok[p] for p in around(i, j)):
            heapq.heappush(queue, (z[i, j], i, j))
    while queue:
        w, i, j = heapq.heappop(queue)
        if np.isnan(out[i, j]):
            out[i, j] = w
            for p in around(i, j):
                if ok[p] and np.isnan(out[p]):
                    heapq.heappush(queue, (max(z[p], w), *p))
    return out


@pytest.mark.parametrize("block", [5, 64])
def test_fill_depressions(spark, block):
    rng = np.random.default_rng(3)
    z = rng.random((17, 13)).cumsum(0).round(3) + rng.random((17, 13)).round(3) * 4
    z[8, 6] = np.nan
    got = {(r["row"], r["col"]): r["value"] for r in hydrology.fill_depressions(table(spark, z), block).collect()}
    want = brute_fill(z)
    assert got == {(i, j): want[i, j] for i, j in zip(*np.nonzero(~np.isnan(z)), strict=True)}


def test_components_of_long_snakes(spark):
    """A spiral is one component, whatever its length; diagonal cells are not together."""
    wet, r, c, d = {(0, 0)}, 0, 0, 0
    for n in (40, 40, 40, 38, 38, 36, 36, 34, 34):
        for _ in range(n):
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
            wet.add((r, c))
        d = (d + 1) % 4
    rows = [(1, a, b, 1.0) for a, b in wet] + [(2, 0, 0, 1.0), (2, 1, 1, 1.0)]
    got = hydrology.components(spark.createDataFrame(rows, CELLS)).groupBy("grid_id").agg(F.count_distinct("component").alias("n"), F.min("component").alias("first")).collect()
    assert {(r["grid_id"], r["n"], r["first"]) for r in got} == {(1, 1, 0), (2, 2, 0)}


def test_empty_grids(spark):
    none = spark.createDataFrame([], CELLS)
    for f in (hydrology.components, lambda x: hydrology.fill_depressions(x, 8), lambda x: hydrology.flow_accumulation(grid.d8(x)), lambda x: hydrology.stream_distance(x, x)):
        assert f(none).count() == 0


def test_gradient_jumps_no_hole(spark):
    z = np.array([[float(i * i) for i in (0, 1, 2, np.nan, 4, 5)]])
    got = {r["col"]: r["dx"] for r in grid.gradient(table(spark, z)).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 4: 9.0, 5: 9.0}


def test_throttle(spark):
    rng = np.random.default_rng(5)
    seconds = [(k, int(t)) for k in "ab" for t in rng.integers(0, 20_000, 400)]
    frame = spark.createDataFrame(seconds, "kind string, s long").select("kind", F.timestamp_seconds("s").alias("ts"))
    want = set()
    for k in "ab":
        last = None
        for t in sorted({t for x, t in seconds if x == k}):
            if last is None or t - last >= 300:
                want.add((k, t))
                last = t
    got = series.throttled(frame, 5).select("kind", F.unix_seconds("ts")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_streamed_warnings_equal_the_batch(spark):
    got, want = (sorted(map(tuple, run(spark, n).select("kind", "ts").collect())) for n in ("str_throttled_warnings", "win_throttle"))
    assert got == want and got


def test_median_by_ranges(spark):
    rng = np.random.default_rng(2)
    for values in (rng.random(1001), np.repeat([1.0, 5.0], 50), np.array([3.0]), rng.integers(0, 4, 200).astype(float)):
        frame = spark.createDataFrame([(float(v),) for v in values], "v double").unionByName(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
        for q in (0.5, 0.25, 0.9):
            assert claims.median_by_ranges(frame, "v", q).first()["value"] == pytest.approx(np.quantile(values, q))


def test_split_and_balance_have_exact_counts(spark):
    frame = spark.range(1000).select(F.col("id").alias("tile_id"), (F.when(F.col("id") % 10 == 0, 0.5).otherwise(0.0)).alias("share"))
    split = {r["split"]: r["count"] for r in tiles.split_tiles(frame).groupBy("split").count().collect()}
    assert split == {"train": 800, "val": 100, "test": 100}
    again = tiles.split_tiles(frame.repartition(7))
    assert again.exceptAll(tiles.split_tiles(frame)).isEmpty()
    kept = tiles.balanced_tiles(frame, 0.02, 0.4)
    assert kept.where("wet").count() == 100 and kept.where("not wet").count() == 150


def test_periods_follow_weights(spark):
    frame = spark.range(20_000).select(F.col("id").alias("tile_id"))
    got = tiles.assign_periods(frame, [(10, 0.4, 1.0), (25, 0.4, 2.0), (100, 0.1, 3.0), (500, 0.1, 4.0)]).groupBy("period", "depth").count().collect()
    share = {(r["period"], r["depth"]): r["count"] / 20_000 for r in got}
    assert share.keys() == {(10, 1.0), (25, 2.0), (100, 3.0), (500, 4.0)} and all(abs(share[k] - w) < 0.02 for k, w in zip(sorted(share), (0.4, 0.4, 0.1, 0.1), strict=True))


def test_sample_of_pairs_is_the_same_at_any_partitioning(spark):
    frame = spark.range(9000)
    a, b = tiles.sample_pairs(frame, 500), tiles.sample_pairs(frame.repartition(5), 500)
    assert a.count() == 500 and a.exceptAll(b).isEmpty()


def test_bootstrap_interval_covers_the_value(spark):
    rows = [(1, i // 50, i % 50, float(i % 7), float(i % 5)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "case_id long, row int, col int, pred double, obs double")
    mae = lambda w: F.sum(w * F.abs(F.col("pred") - F.col("obs"))) / F.sum(w)
    r = series.bootstrap(frame, mae, 200).first()
    true = np.mean([abs(i % 7 - i % 5) for i in range(2000)])
    assert r["low"] < true < r["high"] and r["high"] - r["low"] < 0.3 and abs(r["mid"] - true) < 0.05


def test_storms_keep_their_total(spark):
    storm = spark.createDataFrame([("s", k, float(k % 5)) for k in range(24)], "scenario_id string, step int, depth double")
    got = rain.storm_ensemble(storm, 20).groupBy("member").agg(F.sum("depth").alias("t"), F.min("depth").alias("lo")).collect()
    assert len(got) == 20 and all(abs(r["t"] - sum(k % 5 for k in range(24))) < 1e-9 and r["lo"] >= 0 for r in got)


def test_rain_ensemble_spread(spark):
    flat = spark.range(40_000).select(F.lit(1).cast("long").alias("grid_id"), (F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), F.lit(50.0).alias("value"))
    r = rain.rain_ensemble(flat, 2, 0.1).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo")).first()
    assert abs(r["m"] - 50) < 0.4 and abs(r["s"] - 5) < 0.4 and r["lo"] >= 0.1  # smooth noise: fewer independent cells


def test_augmented_rain_is_not_negative(spark):
    assert run(spark, "rain_augment").where("value < 0 or value is null").isEmpty()


def test_scores_lie_in_range_and_invalid_requests_go(spark):
    got = run(spark, "score_bulk")
    bad = run(spark, "score_input_errors").where("errors <> ''").select("request_id")
    assert got.where("score < 0 or score > 1 or score is null").isEmpty() and got.join(bad, "request_id").isEmpty() and got.count() > 100


def test_overlaps_are_found_across_squares(spark):
    rng = np.random.default_rng(8)
    b = [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(*(rng.uniform(*r, 60) for r in ((0, 30), (0, 30), (0.1, 9), (0.1, 9))), strict=True))]
    frame = spark.createDataFrame(b, "id long, west double, south double, east double, north double")
    want = {(i[0], j[0]) for i in b for j in b if i[0] < j[0] and min(i[3], j[3]) > max(i[1], j[1]) and min(i[4], j[4]) > max(i[2], j[2])}
    got = [tuple(r) for r in boxes.pairwise_overlap(frame, 4.0).select("id", "id2").collect()]
    assert set(got) == want and len(got) == len(want)


def test_checks_take_nulls(spark):
    models = spark.createDataFrame([("m", None, None, None, None, None, None, None)], "model string, converged boolean, overfit boolean, accuracy double, real_score double, dummy_score double, seconds double, megabytes double")
    r = quality.check_model(models).first()
    assert (r["score"], r["status"], r["issues"]) == (1.0, "PASS", [])


def test_proximity_noise_follows_from_the_point(spark):
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(36.0).alias("latitude"), F.lit(-86.0).alias("longitude"))
    a, b = (scoring.proximity_score(p) for p in (points, points.repartition(6)))
    assert a.exceptAll(b).isEmpty() and a.where("probability not between 0.1 and 0.3").isEmpty()


def test_files_that_fail_are_rows(spark):
    got = run(spark, "src_process_files")
    assert got.count() == 50 and got.where("(error is null) = (words is null)").isEmpty()


def test_fill_never_lowers(spark):
    both = run(spark, "grid_fill_depressions").withColumnRenamed("value", "filled")
    from freshet.sources import fixtures as fx

    assert fx.cells(spark, SF, 50).join(both, grid.CELL).where("filled < value - 1e-6").isEmpty()  # the query rounds
