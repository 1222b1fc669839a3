"""Small tables by hand: streams out of order, versions of tables, random forms, holes."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import grid, hydrology, quality, rain, series, tiles
from freshet.sources.files import read_rain_sections
from freshet.sources.versions import Versions
from freshet.streaming import events
from tests.test_large_groups import fires, holes
from tests.test_methods import CELLS, table


def warned(spark, rows):
    return spark.createDataFrame(rows, "kind string, s long").select("kind", F.timestamp_seconds("s").alias("ts"))


def test_late_and_repeated_warnings(spark):
    """Rows up to the watermark's delay late, and rows that come twice, give what the whole table gives; a quiet kind leaves no state."""
    rng = np.random.default_rng(3)
    rows = [(k, int(t)) for k in "ab" for t in rng.integers(0, 20_000, 150)]
    came = sorted(rows, key=lambda r: r[1] + int(rng.integers(0, 500)))  # 500 s late at most
    cut = [0, 80, 200, 300]
    slices = [warned(spark, came[max(0, a - 20) : b]) for a, b in zip(cut, cut[1:], strict=False)]  # 20 rows come again
    end = warned(spark, [("end", 2_000_000_000)])
    got = events.drained(spark, [*slices, end], events.throttled_warnings).where("kind <> 'end'")
    got = [(r["kind"], r["at"] // 1_000_000) for r in got.collect()]
    want = {(k, t) for k in "ab" for t in fires([t for x, t in rows if x == k], 300)}
    assert set(got) == want and len(got) == len(want)
    batch = series.throttled(warned(spark, rows), 5).select("kind", F.unix_seconds("ts").alias("s")).collect()
    assert {tuple(r) for r in batch} == want


def test_rolling_means_take_late_rows(spark):
    rows = [("k", 100 - i, float(i)) for i in range(30)] + [(None, 5, 1.0), (None, None, 9.0), ("k", 3, None)]
    frame = spark.createDataFrame(rows, "kind string, s long, value double").select("kind", F.timestamp_seconds("s").alias("ts"), "value")
    parts = [frame.where("value < 12 or kind is null"), frame.where("value >= 12 and kind = 'k'")]
    got = events.latest(events.drained(spark, parts, lambda s: events.rolling_mean(s, "kind", "value", 20), "update"), ["kind"])
    assert {r["kind"]: (r["seen"], r["mean"]) for r in got.collect()} == {"k": (20, np.mean(range(20))), None: (1, 1.0)}


def test_rolling_means_call_python_by_bucket(spark, monkeypatch):
    """Many keys, null and large ones among them, in two batches: a call serves all keys of a bucket."""
    rng = np.random.default_rng(4)
    rows = [(None if k == 0 else (1 << 60) + int(k), int(s), float(v)) for k, s, v in zip(rng.integers(0, 300, 6000), rng.integers(0, 4000, 6000), rng.integers(0, 99, 6000), strict=True)]
    calls = spark.sparkContext.accumulator(0)
    own = events._Rolling.handleInputRows

    class Counted(events._Rolling):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from own(self, key, rows, timerValues)

    monkeypatch.setattr(events, "_Rolling", Counted)
    frame = lambda part: spark.createDataFrame(part, "kind long, s long, value double").select("kind", F.timestamp_seconds("s").alias("ts"), "value")
    got = events.drained(spark, [frame(rows[:4000]), frame(rows[4000:])], lambda s: events.rolling_mean(s, "kind", "value", 7), "update")
    assert got.schema["kind"].dataType.simpleString() == "bigint"
    by = {k: sorted((s, v) for x, s, v in rows if x == k)[-7:] for k in {r[0] for r in rows}}
    want = {k: (len(x), round(sum(v for _, v in x) / len(x), 9)) for k, x in by.items()}
    assert {r["kind"]: (r["seen"], round(r["mean"], 9)) for r in events.latest(got, ["kind"]).collect()} == want
    before = calls.value
    few = events.drained(spark, [frame(rows)], lambda s: events.rolling_mean(s, "kind", "value", 7, buckets=4), "update")
    assert {r["kind"]: (r["seen"], round(r["mean"], 9)) for r in few.collect()} == want and before <= 2 * len(by) and 0 < calls.value - before <= 8


def test_commits_are_there_once(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert store.commit("first", {"rows": one, "other": one.limit(1)}) and not store.commit("first", {"rows": one})
    assert store.commit("second", {"rows": one.withColumn("id", F.col("id") + 10)})
    assert sorted(r["id"] for r in store.read("rows").collect()) == [1, 2, 11, 12] and store.read("other").count() == 1
    kept = lambda t: {"rows": t["rows"].where("id > 1")}
    assert (store.rewrite(kept), store.rewrite(kept)) == (3, 4)
    assert sorted(r["id"] for r in store.read("rows").collect()) == [2, 11, 12] == sorted(r["id"] for r in store.read("rows", 3).collect())
    assert not store.commit("first", {"rows": one}) and store.read("rows", 2).count() == 4  # names and old versions stay known


def test_a_commit_that_is_overtaken_starts_from_the_newest(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/store"
    a, b, row = Versions(spark, folder), Versions(spark, folder), spark.createDataFrame([(1,)], "id long")
    publish, turns = a._publish, iter([True, False, False])

    def late(number, manifest):
        if next(turns):
            assert b.commit("other", {"rows": row})
        return publish(number, manifest)

    monkeypatch.setattr(a, "_publish", late)
    assert a.commit("mine", {"rows": row}) and a.read("rows").count() == 2
    assert set(json.loads((tmp_path / "store/versions/0000000002.json").read_text())["rows"]) == {"mine", "other"}


def test_data_of_failed_jobs_are_not_read(spark, tmp_path):
    store, row = Versions(spark, f"file://{tmp_path}/store"), spark.createDataFrame([(1,)], "id long")
    store._write(row)
    assert store.commit("only", {"rows": row}) and store.read("rows").count() == 1


def test_sections_of_more_than_a_thousand_values(spark, tmp_path):
    periods = list(range(1, 1501))
    lines = ["Station: far", "ESTIMATES", "by duration for ARI:, " + ", ".join(map(str, periods)), "60-min:, " + ", ".join(str(p / 10) for p in periods)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    got = {r["period"]: r["depth"] for r in read_rain_sections(spark, f"file://{tmp_path}/s.csv").collect()}
    assert got == {p: p / 10 for p in periods}


def test_focal_windows_see_past_holes(spark):
    z = holes(np.random.default_rng(4), (9, 8), 0.3)
    got = {(r["row"], r["col"]): r["f_sum"] for r in grid.focal(table(spark, z), 1, holes=True).where("value is not null").collect()}
    assert got == {(i, j): np.nansum(z[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]) for (i, j), v in np.ndenumerate(z) if not np.isnan(v)}


def test_label_noise_by_hand(spark):
    z = np.zeros((6, 7))
    z[2, 3] = z[5, 6] = 1  # single cells; the corner's mirror makes it four of nine
    z[0:2, 0:2] = 1
    got = quality.label_noise(table(spark, z)).first()["noise"]
    pad = np.pad(z, 1, "symmetric")
    median = np.array([[np.median(pad[i : i + 3, j : j + 3]) for j in range(7)] for i in range(6)])
    assert got == pytest.approx((median != z).mean()) and got > 0
    v = np.r_[np.arange(40.0), 1000.0, -900.0].reshape(6, 7)
    assert quality.label_noise(table(spark, v)).first()["noise"] == pytest.approx(2 / 42)


def test_advice_by_status_component_and_metric(spark):
    rows = [("a", "DEM_Quality", "FAIL", 0.3), ("a", "DEM_Quality", "FAIL", 0.2), ("a", "Model", "WARN", 0.7), ("b", "Model", "PASS", 0.9), ("c", None, None, None)]
    got = {r["run_id"]: r["advice"] for r in quality.recommendations(spark.createDataFrame(rows, "run_id string, component string, status string, score double")).collect()}
    dem = ["CRITICAL: Address issues in DEM_Quality before proceeding", "Consider DEM preprocessing: void filling, smoothing, or elevation correction"]
    assert got == {"a": [*dem, "WARNING: Review and potentially fix issues in Model"], "b": [quality.ALL_PASSED], "c": [quality.ALL_PASSED]}
    metrics = [(1, "iou", 0.4), (1, "rmse", 0.5), (2, "iou", 0.9), (2, "nse", -0.25), (3, "far", None), (3, "iou", 0.6)]
    told = {(r["case_id"], r["priority"], r["metric"]) for r in quality.metric_recommendations(spark.createDataFrame(metrics, "case_id int, metric string, value double")).collect()}
    assert told == {(1, "High", "IoU Score: 0.400"), (2, "Low", "IoU Score: 0.900"), (2, "Critical", "Nash-Sutcliffe Efficiency: -0.250")}


def test_extents_that_do_not_meet(spark):
    rows = [("a", 0.0, 0.0, 2.0, 2.0), ("a", 1.0, -1.0, 3.0, 1.0), ("b", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0)]
    got = {r["case_id"]: tuple(r)[1:] for r in quality.spatial_extents(spark.createDataFrame(rows, "case_id string, west double, south double, east double, north double")).collect()}
    assert got == {"a": (0.0, -1.0, 3.0, 2.0, 1.0, 0.0, 2.0, 1.0), "b": (0.0, 0.0, 2.0, 1.0, None, None, None, None)}


def test_points_beyond_the_far_edge(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.5)], "region_id int, west double, south double, east double, north double")
    for step, beyond in ((0.4, False), (0.4, True), (0.25, False), (0.25, True)):
        got = rain.region_points(box, step, beyond)
        lon = sorted({round(r["lon"], 9) for r in got.collect()})
        want = np.arange(0.0, 1.0 + step, step) if beyond else [k * step for k in range(int(1 / step + 1e-9) + 1)]
        assert lon == pytest.approx(list(want))


def test_augmented_rain_by_hand(spark):
    rows = [(t, r, c, float(10 + t + r + c)) for t in (1, 2) for r in range(8) for c in range(6)]
    frame = spark.createDataFrame(rows, "tile_id long, r int, c int, value double")
    got = {(r["tile_id"], r["r"], r["c"]): r["value"] for r in rain.augment_rain(frame).collect()}
    drawn = frame.select("tile_id").distinct().select("tile_id", *[rain.uniform_of(3 + k, "tile_id").alias(f"u{k}") for k in range(5)])
    u = {r["tile_id"]: [r[f"u{k}"] for k in range(5)] for r in drawn.collect()}
    noise = {(r["tile_id"], r["r"], r["c"]): r["noise"] for r in rain.smooth_noise(frame, 8, 1.0, ["tile_id"], "r", "c").collect()}
    assert len(got) == len(rows) == len(noise)
    for t, r, c, v in rows:
        s, a, b, strength, rough = u[t]
        slope = 1 + 0.1 * strength * ((2 * a - 1) * (2 * r / 7 - 1) + (2 * b - 1) * (2 * c / 5 - 1))
        assert got[t, r, c] == pytest.approx(max(0, v * (1 + 0.15 * (2 * s - 1)) * slope * (1 + 0.05 * rough * noise[t, r, c])))


def test_synthetic_extent_by_hand(spark):
    """Low ground in the middle is wet, its rim is not, and small hollows go."""
    z = np.full((24, 24), 10.0)
    z[6:16, 6:16] = 0.0
    z[2, 20] = 0.0
    wet = {(r["row"], r["col"]) for r in hydrology.synthetic_extent(table(spark, z), 0.9).collect()}
    assert {(i, j) for i in range(8, 14) for j in range(8, 14)} <= wet <= {(i, j) for i in range(5, 17) for j in range(5, 17)}
    assert hydrology.synthetic_extent(table(spark, z), 0.1).count() == 0


def test_scenario_copies_of_tiles(spark):
    frame = spark.range(500).select(F.col("id").alias("tile_id"))
    periods = [(10, 0.5, 1.0), (100, 0.5, 2.0)]
    got = tiles.tile_scenarios(frame, 3, periods)
    assert got.count() == 1500 and got.select("tile_id").distinct().count() == 1500
    assert got.groupBy(F.split_part("tile_id", F.lit("#"), F.lit(1)).alias("of")).count().where("count <> 3").isEmpty()
    assert got.exceptAll(tiles.tile_scenarios(frame.repartition(6), 3, periods)).isEmpty()
    shares = {(r["period"], r["depth"]): r["count"] / 1500 for r in got.groupBy("period", "depth").count().collect()}
    assert shares.keys() == {(10, 1.0), (100, 2.0)} and all(abs(s - 0.5) < 0.06 for s in shares.values())


def test_frames_of_one_kind_only(spark):
    """Pandas' own times keep their microseconds."""
    assert events._micros(pd.Series(pd.to_datetime(["1969-12-31 23:59:59.999999", "2024-01-01 00:00:00.000001"]))) == [-1, 1704067200000001]
    assert hydrology.hand_least(spark.createDataFrame([(1, 0, 0, 2.0)], CELLS), spark.createDataFrame([(1, 0, 0)], "grid_id long, row int, col int"), 3).first()["hand"] == 0.0
