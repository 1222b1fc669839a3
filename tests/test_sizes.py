"""What large tables need: no exploded table at the driver, no key with all rows in one task, ties as the SQL has them."""

import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import rules
from freshet.operators import boxes, hydrology, metrics, rain, ranges
from freshet.sources import fixtures
from freshet.streaming import events


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_never_broadcast_an_exploded_table(spark):
    """The planner takes an exploded table for as small as what it came from."""
    several = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    ddf = spark.range(4).select(F.col("id").alias("station_id"), several(60, 1440).alias("duration_minutes"))
    ddf = ddf.select("*", several(10, 25).alias("return_period_years")).withColumn("depth_in", F.col("station_id") + 0.5)
    asked = spark.createDataFrame([(1, 2, 60, 25), (2, 9, 60, 25)], "request_id long, station_id long, duration_minutes int, return_period_years int")
    got = rain.lookup(asked, ddf)
    assert "Broadcast" not in _plan(got)
    assert {r["request_id"]: r["depth_in"] for r in got.collect()} == {1: 2.5, 2: None}
    sure = rain.lookup_by_confidence(asked.withColumn("confidence", F.lit(None).cast("string")), ddf.withColumn("confidence", F.lit("estimates")))
    assert "Broadcast" not in _plan(sure)
    assert {r["request_id"]: r["missing"] for r in sure.collect()} == {1: None, 2: "confidence"}


def test_digits_are_those_of_the_double(spark):
    """1.005 and 0.285 are a little less than they look; 0.0625 and 0.1875 are exact halves."""
    numbers = [1.005, 0.285, 2.675, 0.125, -0.125, 0.0625, 0.1875, 0.5005, 0.0125, 7.0, -0.0001, -0.0625, float("nan")]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = df.select("x", rules.to_digits(F.col("x"), 2).alias("d"), rules.told(F.col("x"), 3).alias("t")).collect()
    con = duckdb.connect()
    for r in got[:-1]:
        assert (r["d"], r["t"]) == con.execute("SELECT round(?::DOUBLE, 2), format('{:.3f}', ?::DOUBLE)", [r["x"], r["x"]]).fetchone()
        assert r["t"] == f"{r['x']:.3f}"
    assert got[-1]["d"] != got[-1]["d"]


def test_cut_points_of_a_large_group_are_drawn_once(spark):
    """A sketch that is drawn again gives other cut points, and counts by range no longer fit the ranges."""
    df = spark.range(100).select(ranges._key([]).alias("_key"), (F.col("id") % 37).cast("double").alias("v"))
    plan = _plan(ranges.ranged(df, "v", small=10, levels=3))
    assert "percentile_approx" not in plan and "SortMergeJoin" not in plan
    got = ranges.quantiles(df, [], ["v"], [0.0, 0.3, 0.5, 1.0], small=10, levels=3).first()["v_q"]
    values = sorted(float(i % 37) for i in range(100))
    assert got == [values[0], pytest.approx(values[29] * 0.3 + values[30] * 0.7), (values[49] + values[50]) / 2, values[99]]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_best_threshold_of_a_large_case_is_sorted_once(spark, monkeypatch, small):
    """Ranges go to tasks by the number of rows, and the best of each is found in the order that its running sums need."""
    monkeypatch.setattr(ranges.running, "__defaults__", (False, small, 6))
    monkeypatch.setattr(ranges, "TASK_ROWS", 50, raising=False)
    rng = np.random.default_rng(3)
    cases = {k: [(float(x), int(rng.random() < x)) for x in np.round(rng.random(400), 2)] for k in ("a", None)}
    cases |= {"tie": [(4.0, 1), (3.0, 0), (2.0, 0), (1.0, 1)], "none": [(1.0, 0), (2.0, 0)]}
    scored = spark.createDataFrame([(k, x, y) for k, v in cases.items() for x, y in v], "case_id string, score double, target int")
    df = metrics.best_threshold(scored)
    plan = _plan(df)
    got, want = {r["case_id"]: (r["threshold"], r["gain"]) for r in df.collect()}, {}
    for k, v in cases.items():
        pos = sum(y for _, y in v)
        above = {x: [y for s, y in v if s >= x] for x, _ in v}
        if pos:
            gain, at = max((round(sum(ys) / len(ys) + sum(ys) / pos - 1, 12), x) for x, ys in above.items())
            want[k] = (at, pytest.approx(gain))
    assert got == want and got["tie"] == (4.0, 0.5)
    if small == 0:
        rows = sum(len({x for x, _ in v}) for v in cases.values())
        assert re.search(rf"hashpartitioning\(_key#\d+, _range#\d+, {-(-rows // 50)}\)", plan)
        assert plan.count("Sort [") == 2 and "lambda" not in plan  # the ranges, and a row for each task and case
        monkeypatch.setattr(ranges, "UNSORTED", 2, raising=False)
        assert re.search(r"hashpartitioning\(_key#\d+, _range#\d+, 2\)", _plan(metrics.best_threshold(scored)))


def test_rows_are_not_moved_to_find_wanted_ranks(spark):
    """Where the planner knows how few ranges hold a wanted rank, only their rows are shuffled."""
    df = spark.range(50_000).select(ranges._key([]).alias("_key"), (F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64KB")  # the rows are more than that by the planner's count, as of a large table
    try:
        got = ranges._large_quantiles(df, [0.02, 0.98], 10, 5)
        assert "SortMergeJoin" not in _plan(got)
        assert got.first()["q"] == pytest.approx([49_999 * 0.02, 49_999 * 0.98])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_boxes_alike_are_compared_once_and_all_told(spark):
    rows = [(i, float(i % 3), 0.0, i % 3 + 1.5, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, west double, south double, east double, north double")
    got = {(r["id"], r["id2"]): r["mutual"] for r in boxes.pairwise_overlap(df, 1.0).collect()}
    want = {}
    for a in rows:
        for b in rows:
            share = (min(a[3], b[3]) - max(a[1], b[1])) / 1.5
            if a[0] < b[0] and share > 0:
                want[a[0], b[0]] = pytest.approx(share)
    assert got == want
    assert "aggregate" in _plan(boxes.pairwise_overlap(df, 1.0)).lower()


def test_pairs_of_boxes_that_are_all_alike_are_many_tasks(spark, monkeypatch):
    """One box that all rows have is not one task's work, and its rows are told in packs."""
    monkeypatch.setattr(boxes, "PACK", 7, raising=False)
    monkeypatch.setattr(boxes, "PAIRS_A_TASK", 300, raising=False)
    rows = [(i % 97 if i else None, 0.0, 0.0, 2.0, 3.0) for i in range(100)] + [(200, 1.0, 0.0, 2.0, 3.0), (201, 2.0, 0.0, 3.0, 3.0), (202, None, 0.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, west double, south double, east double, north double")
    got = boxes.pairwise_overlap(df, 4.0)
    ids = [r[0] for r in rows[:100] if r[0] is not None]
    want = sorted([(a, b, 1.0, 1.0, 1.0) for a in ids for b in ids if a < b] + [(a, 200, 0.5, 1.0, 0.5) for a in ids])
    assert sorted(map(tuple, got.collect())) == want
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 8 and max(shares) < len(want) / 4
    thirds = boxes.pairwise_overlap(spark.createDataFrame([(1, 0.0, 0.0, 3.0, 1.0), (2, 2.0, 0.0, 4.0, 1.0)], df.schema), 4.0, 2).first()
    assert (thirds["of_first"], thirds["of_second"], thirds["mutual"]) == (0.33, 0.5, 0.33)
    asked = spark.createDataFrame([(k, 2.0, 3.0, 5.0, 4.0) for k in (None, 5, 5)], "query_id long, west double, south double, east double, north double")
    found = boxes.catalog_search(df.withColumnRenamed("id", "item_id"), asked, 8.0)
    assert found.groupBy("query_id").count().orderBy("query_id").collect() == [(None, 102), (5, 204)] and found.where("item_id is null").count() == 3


def _moved_by_hand(points, z, weights, timing):
    """A storm's line moved by ``z`` and read at whole steps, stretch by stretch: step to depth."""
    ends = [t for t, _ in points if t is not None]
    first, last = min(ends), max(ends)
    move = max(min(timing * (last - first) * z, (last - first) / 4), -(last - first) / 4)
    line = [(t + move, None if d is None else d * w) for (t, d), w in zip(points, weights, strict=True) if t is not None]
    out = {t: 0.0 for t, _ in points}
    for (s, a), (s2, b) in zip(line, [*line[1:], (float("inf"), None)], strict=True):
        if first <= s <= last:
            for to in range(int(np.ceil(s)), int(np.ceil(s2)) if s2 <= last else int(np.floor(s)) + 1):
                depth = a if to == s else None if a is None or b is None else a + (b - a) * (to - s) / (s2 - s)
                out[to] = max(depth or 0.0, 0.0)
    total, fell = sum(d or 0.0 for _, d in points), sum(out.values())
    return {t: d * total / fell if fell else 0.0 for t, d in out.items()}


@pytest.mark.parametrize("kind", ["int", "long"])
def test_members_of_storms_with_gaps_and_nulls_need_no_window(spark, monkeypatch, kind):
    """A storm is a row, and blocks of storms are worked out at once."""
    monkeypatch.setattr(rain, "STEPS_AT_ONCE", 20, raising=False)
    monkeypatch.setattr(rain, "STEPS_OUT", 60, raising=False)
    storms = {"gaps": [(0, 1.0), (2, 4.0), (5, 2.0), (6, None), (9, 3.0), (10, 1.0)], "one": [(4, 2.0)], "dry": [(0, 0.0), (1, 0.0), (2, 0.0)], None: [(None, 5.0), (-2, 2.0), (-1, 1.0), (0, 6.0)], "unknown": [(1, None), (2, None)]}
    storms |= {f"s{i}": [(t - i, float((t * 7 + i) % 5)) for t in range(3 + i % 17)] for i in range(40)}
    storm = spark.createDataFrame([(k, t, d) for k, v in reversed(storms.items()) for t, d in reversed(v)], f"scenario_id string, step {kind}, depth double")
    made = rain.storm_ensemble(storm, 4, 0.2, 0.3)
    assert "Window" not in _plan(made)
    drawn = storm.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("scenario_id", "member", "step", F.exp(0.2 * rain.normal_of(8, "scenario_id", "member", "step")).alias("w"), rain.normal_of(7, "scenario_id", "member").alias("z"))
    draws = {(r["scenario_id"], r["member"], r["step"]): (r["w"], r["z"]) for r in drawn.collect()}
    want = {}
    for k, points in storms.items():
        for m in range(4):
            weights, moves = zip(*(draws[k, m, t] for t, _ in points), strict=True)
            want |= {(k, m, t): pytest.approx(d) for t, d in _moved_by_hand(points, moves[0], weights, 0.3).items()}
    rows = made.collect()
    assert {(r["scenario_id"], r["member"], r["step"]): r["depth"] for r in rows} == want and len(rows) == len(want)
    curves = storm.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("step", "depth"))).alias("curve"))
    assert made.exceptAll(rain.curve_ensemble(curves.repartition(3), 4, 0.2, 0.3)).isEmpty()


def test_curves_are_hyetographs_and_hashes_go_on_as_in_spark(spark):
    asked = spark.createDataFrame([(f"{p}{h}", p, 30.0 + h, h) for p in ("front", "back", "centre", None) for h in (1, 9)], "scenario_id string, pattern string, total double, hours int")
    curves = rain.hyetograph_curves(asked)
    assert curves.select("scenario_id", F.inline("curve")).exceptAll(rain.hyetographs(asked)).isEmpty() and curves.count() == 8
    assert all([c["step"] for c in r["curve"]] == list(range(len(r["curve"]))) for r in curves.collect())
    for kind in ("int", "long", "double"):
        x = spark.range(-40, 40).select(F.xxhash64(F.lit(3), F.col("id").cast("string")).alias("h"), (F.col("id") * 1_234_567).cast(kind).alias("v"), F.col("id").cast("string").alias("s"))
        got = x.select("h", "v", F.xxhash64(F.lit(3), "s", "v").alias("want")).toPandas()
        assert (rain._hash_on(got["h"].to_numpy().view(np.uint64), got["v"].to_numpy()).view(np.int64) == got["want"].to_numpy()).all()


def test_exploded_stations_are_many_tasks(spark):
    df = spark.range(1000, numPartitions=1).withColumnRenamed("id", "k")
    assert fixtures.spread(df, "k", 100).rdd.getNumPartitions() == 10
    assert fixtures.spread(df, "k", 1000).rdd.getNumPartitions() == 1


def test_boxes_of_noise_are_many_tasks_and_narrow_ones_have_noise(spark, monkeypatch):
    """One row a grid is exploded into its box; a box narrower than the kernel is mirrored again."""
    cells = spark.range(60 * 40).select(F.expr("id - id % 1 - id + 1").alias("grid_id"), F.expr("int(id div 40)").alias("row"), F.expr("int(id % 40)").alias("col"), F.lit(1.0).alias("value"))
    whole = rain.smooth_noise(cells, 5, 1.0).select("row", "col", "noise")
    monkeypatch.setattr(rain, "CELLS_A_TASK", 250)
    dealt = rain.smooth_noise(cells, 5, 1.0).select("row", "col", "noise")
    assert dealt.rdd.getNumPartitions() == -(-68 * 48 // 250)  # more than the session has, so that the planner keeps them
    assert dealt.count() == 2400 and dealt.exceptAll(whole).isEmpty()
    narrow = rain.smooth_noise(cells.where("row < 2"), 5, 1.0)
    assert narrow.count() == 80 and narrow.where("noise is null").isEmpty()


def test_storms_stay_in_the_task_they_are_dealt_to(spark, monkeypatch):
    """Storms are moved before they are exploded into hours, and not again for windows, members or peaks."""
    monkeypatch.setattr(rain, "STORMS_A_TASK", 5)
    asked = spark.createDataFrame([(f"s{i}", ["front", "back", "centre", None][i % 4], 10.0 + i, 24) for i in range(20)], "scenario_id string, pattern string, total double, hours int")
    storm = rain.hyetographs(asked).withColumnRenamed("hour", "step")
    for got in (storm, rain.nested_windows(storm, [1, 3]), rain.storm_ensemble(storm, 3)):
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    sums = {r["scenario_id"]: (r["n"], r["t"]) for r in storm.groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("depth").alias("t")).collect()}
    assert sums == {f"s{i}": (24, pytest.approx(10.0 + i)) for i in range(20)}
    kept = rain.storm_ensemble(storm, 3).groupBy("scenario_id", "member").agg(F.count("*").alias("n"), F.sum("depth").alias("t")).collect()
    assert len(kept) == 60 and all(r["n"] == 24 and r["t"] == pytest.approx(10.0 + int(r["scenario_id"][1:])) for r in kept)


def test_strips_of_a_tall_grid_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hydrology, "_STRIP_CELLS", 200)
    cells = spark.range(400 * 8).select((F.col("id") % 1).alias("grid_id"), F.expr("int(id div 8)").alias("row"), F.expr("int(id % 8)").alias("col"), F.lit(1.0).alias("value"))
    wet = [(3, 1), (150, 6), (151, 0), (390, 7)]
    stream = cells.where(" or ".join(f"row = {r} and col = {c}" for r, c in wet))
    found = hydrology.stream_distance(cells, stream)
    assert found.rdd.getNumPartitions() == 16
    got = {(r["row"], r["col"]): r["distance"] for r in found.collect()}
    assert len(got) == 3200 and all(d == pytest.approx(min(np.hypot(r - i, c - j) for i, j in wet)) for (r, c), d in got.items())


def test_waiting_warnings_are_packed_by_the_hour(monkeypatch):
    """Times of a kind are never held all at once: a few frames are, and the hours that they fall in."""
    state, timers = {}, []
    waiting = SimpleNamespace(containsKey=state.__contains__, getValue=state.__getitem__, updateValue=state.__setitem__, removeKey=state.pop, keys=lambda: iter(list(state)))
    last = SimpleNamespace(exists=lambda: False, clear=lambda: None, update=lambda v: None)
    throttle = events._Throttle(300_000_000)
    monkeypatch.setattr(throttle, "TOGETHER", 100, raising=False)
    throttle.init(SimpleNamespace(getValueState=lambda *a: last, getMapState=lambda *a: waiting, getListState=lambda *a: None, registerTimer=timers.append))
    seconds = np.random.default_rng(1).permutation(np.arange(0, 36_000, 7))
    frames = (pd.DataFrame({"ts": pd.to_datetime(seconds[i : i + 50], unit="s")}) for i in range(0, len(seconds), 50))
    throttle.handleInputRows(("a",), frames, None)
    assert len(state) == 10 and max(len(v[0]) for v in state.values()) <= 8 * 515 and timers == [1]
    fired = pd.concat(throttle.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 36_000_000), None))
    assert not state and (fired["at"] // 1_000_000).tolist() == list(range(0, 36_000, 301))
