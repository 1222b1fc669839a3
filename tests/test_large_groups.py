"""Operators that spread what would be one task: ranges of values, blocks of cells, levels of squares and of time."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import grid, hydrology, metrics, rain, ranges, series
from tests.test_methods import CELLS, brute_fill, table


def skewed(rng, n):
    return np.concatenate([np.exp(rng.normal(size=n) * 3), np.full(n // 2, 7.0), -rng.random(n // 4)])


@pytest.mark.parametrize("small", [0, 100, 100_000])
def test_quantiles_of_skewed_groups(spark, small):
    rng = np.random.default_rng(small)
    groups = {"a": skewed(rng, 800), None: skewed(rng, 90), "c": np.array([5.0]), "d": np.full(400, 2.0)}
    rows = [(k, float(v), float(-v)) for k, vs in groups.items() for v in vs]
    rows += [("a", None, float("nan")), ("c", float("nan"), None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {r["k"]: r for r in ranges.quantiles(df, ["k"], ["x", "y"], probabilities, small, 5).collect()}
    for k, vs in groups.items():
        assert got[k]["x_q"] == pytest.approx(np.quantile(vs, probabilities)) and got[k]["y_q"] == pytest.approx(np.quantile(-vs, probabilities))
    assert got["none"]["x_q"] is None and len(got) == 5


def test_skewed_values_are_spread(spark):
    """Ranges of a long tail hold about equal shares, whatever their width."""
    df = spark.range(50_000).select(F.struct(F.lit(1)).alias("_key"), F.exp(rain.normal_of(4, "id") * 4).alias("v"))
    sizes = [r["count"] for r in ranges.ranged(df, "v", 0, 8).groupBy("_range").count().collect()]
    assert len(sizes) > 250 and max(sizes) < 4 * 50_000 / 256


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("down", [False, True])
def test_running_sums(spark, small, down):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(rng.integers(1, 9))) for k in ("a", None) for v in np.unique(np.round(np.exp(rng.normal(size=700) * 2), 3))]
    got = ranges.running(spark.createDataFrame(rows, "k string, v double, w long").repartition(4), ["k"], "v", ["w"], down, small, 5).collect()
    assert len(got) == len(rows)
    for k in ("a", None):
        own, total, whole = sorted((r for r in got if r["k"] == k), key=lambda r: -r["v"] if down else r["v"]), 0, sum(w for x, _, w in rows if x == k)
        for r in own:
            assert (r["w_before"], r["w_whole"]) == (total, whole)
            total += r["w"]


def test_ranks_and_curves_of_one_large_case(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p, o = np.round(rng.random(1500), 2), np.round(rng.random(1500) ** 2, 3)
    p[:500] = 0.5  # a third alike
    pairs = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(p, o, strict=True)], "case_id string, pred double, obs double")
    scored = pairs.select("case_id", F.col("pred").alias("score"), (F.col("obs") > 0.3).cast("int").alias("target"))
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    whole = ranges.running.__defaults__
    for small in (0, 1 << 20):
        monkeypatch.setattr(ranges.running, "__defaults__", (whole[0], small, 6))
        assert metrics.spearman(pairs).first()["spearman"] == pytest.approx(np.corrcoef(rank(p), rank(o))[0, 1])
        y = o > 0.3
        auc = np.mean([(a > b) + (a == b) / 2 for a in p[y] for b in p[~y]])
        assert metrics.roc_auc(scored).first()["auc"] == pytest.approx(auc)


def holes(rng, shape, share):
    z = np.round(rng.random(shape) * 30)
    z[rng.random(shape) < share] = np.nan
    return z


def cells_of(z):
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(~np.isnan(z)), strict=True)}


@pytest.mark.parametrize(("share", "wet_share"), [(0.0, 0.02), (0.15, 0.3), (0.1, 1.0), (0.1, 0.0)])
def test_distances_and_heights_with_holes(spark, share, wet_share):
    rng = np.random.default_rng(int(100 * wet_share))
    z = holes(rng, (43, 71), share)
    wet = {p for p in cells_of(z) if rng.random() < wet_share}
    cells = table(spark, z)
    stream = spark.createDataFrame([(1, i, j) for i, j in wet], "grid_id long, row int, col int")
    far = {(r["row"], r["col"]): r["distance"] for r in hydrology.stream_distance(cells, stream, 10.0).collect()}
    near = {(r["row"], r["col"]): r["hand"] for r in hydrology.hand_nearest(cells, stream, 5).collect()}
    least = {(r["row"], r["col"]): r["hand"] for r in hydrology.hand_least(cells, stream, 5, 16).collect()}
    assert far.keys() == near.keys() == least.keys() == cells_of(z)
    at = np.array(sorted(wet), int).reshape(-1, 2)
    for i, j in cells_of(z):
        d2 = ((at - (i, j)) ** 2).sum(1)
        assert far[i, j] == (pytest.approx(10 * np.sqrt(d2.min())) if len(at) else None)
        over = z[i, j] - z[at[:, 0], at[:, 1]]
        ok = (d2 <= 25) & (over >= 0)
        assert least[i, j] == (over[ok].min() if ok.any() else None)
        ring = np.abs(at - (i, j)).max(1) if len(at) else np.empty(0)
        ranked = sorted((k, d, r, c, v) for k, d, (r, c), v in zip(ring, d2, at.tolist(), over, strict=True) if 0 < k <= 5)
        assert near[i, j] == (max(ranked[0][4], 0) if ranked else None)


def test_distance_rows_follow_the_cells(spark):
    """What is moved depends on the cells, not on how many of them are stream."""
    z = np.zeros((40, 50))
    every = table(spark, z).select(*grid.CELL, "value")
    for stream, rows in ((every, 2000), (every.where("row = 0 and col = 0"), 50)):
        assert hydrology._stream_lines(every, stream).count() == rows


@pytest.mark.parametrize("seed", range(3))
def test_fill_over_many_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    z = holes(rng, (40, 37), 0.02 * seed) / (1 if seed % 2 else 7)
    got = {(r["row"], r["col"]): r["value"] for r in hydrology.fill_depressions(table(spark, z), 6).collect()}
    want = brute_fill(z)
    assert got == {p: want[p] for p in cells_of(z)}


def test_fill_of_a_winding_valley(spark):
    """Water of the innermost block leaves through every block, over a path that falls and rises."""
    n = 96
    z = np.full((n, n), 100.0)
    for k in range(n // 8):
        z[8 * k + 4, 1 : n - 1] = 10 + np.arange(1, n - 1) % 7 + k
        if k:
            z[8 * k - 4 : 8 * k + 4, n - 2 if k % 2 else 1] = 5
    z[4, 0] = 1
    got = {(r["row"], r["col"]): r["value"] for r in hydrology.fill_depressions(table(spark, z), 16).collect()}
    want = brute_fill(z)
    assert got == {p: want[p] for p in cells_of(z)} and (want > z).sum() > n


def test_lowest_passes_equal_a_search(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 12, 150), strict=True) if a != b]
    edges += [(0, None, 3.0), (17, None, 9.0)]
    level = {0: 3.0, 17: 9.0}
    while True:
        before = dict(level)
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if y in level:
                    level[x] = min(level.get(x, np.inf), max(w, level[y])) if x is not None else 0
        level.pop(None, None)
        if level == before:
            break
    got = {r["node"]: r["level"] for r in hydrology.lowest_passes(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    assert got == level


def fires(times, gap):
    last, out = None, []
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize(("n", "span"), [(3000, 3_000_000), (4000, 300_000), (20, 100_000_000), (1, 9)])
def test_throttled_chains_over_levels(spark, n, span):
    rng = np.random.default_rng(n)
    times = {k: rng.integers(-span, span, n).tolist() for k in ("a", None)}
    rows = [(k, int(t)) for k, ts in times.items() for t in ts] + [("a", None)]
    frame = spark.createDataFrame(rows, "kind string, s long").select("kind", F.timestamp_seconds("s").alias("ts"))
    got = [(r["kind"], r["s"]) for r in series.throttled(frame, 5).select("kind", F.unix_seconds("ts").alias("s")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, t) for k, ts in times.items() for t in fires(ts, 300)}


def test_throttle_of_exact_gaps_and_of_nothing(spark):
    frame = spark.range(500).select(F.lit("k").alias("kind"), F.timestamp_seconds(F.col("id") * 150).alias("ts"))
    assert series.throttled(frame, 5).count() == 250
    assert series.throttled(frame.where("false"), 5).count() == 0


@pytest.mark.parametrize(("reach", "most"), [(2, 1e-2), (6, 1e-3)])
def test_idw_by_squares_is_near_the_exact_mean(spark, reach, most):
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.uniform(-50, 50, (1200, 2)), rng.normal(10, 0.01, (600, 2))])  # a third in one spot
    v = rng.uniform(0, 10, len(at)) + at[:, 0] / 10
    points = np.concatenate([rng.uniform(-60, 60, (60, 2)), rng.normal(10, 0.05, (20, 2)), at[:3]])
    d2 = ((points[:, None] - at[None]) ** 2).sum(2) + 1e-12
    want = (v / d2).sum(1) / (1 / d2).sum(1)
    stations = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(at, v, strict=True)] + [(0.0, 0.0, None)], "x double, y double, value double")
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "point_id long, x double, y double")
    got = {r["point_id"]: r["value"] for r in rain.idw_hierarchical(asked, stations, reach, 16).collect()}
    assert len(got) == len(points) and max(abs(got[i] - w) for i, w in enumerate(want)) < most * np.ptp(v)
    exact = {r["point_id"]: r["value"] for r in rain.idw_exact(asked, stations).collect()}
    assert all(exact[i] == pytest.approx(w) for i, w in enumerate(want))
    with pytest.raises(ValueError, match="too many"):
        rain.idw_exact(asked, stations, 100)
    assert all(r["value"] is None for r in rain.idw_hierarchical(asked, stations.where("false")).collect())


def test_noise_is_smooth_and_keeps_its_spread(spark):
    box = spark.range(150 * 150).select(F.lit(1).cast("long").alias("grid_id"), (F.col("id") / 150).cast("int").alias("row"), (F.col("id") % 150).cast("int").alias("col"), F.lit(50.0).alias("value"))
    for sigma in (1.0, 2.0):
        rows = rain.smooth_noise(box, 5, sigma).select("row", "col", "noise")
        z = np.zeros((150, 150))
        for r in rows.collect():
            z[r["row"], r["col"]] = r["noise"]
        inner = z[10:-10, 10:-10]
        assert abs(inner.std() - 1) < 0.12 and abs(inner.mean()) < 0.2
        for lag in (1, 2):
            assert np.corrcoef(inner[:, lag:].ravel(), inner[:, :-lag].ravel())[0, 1] == pytest.approx(np.exp(-(lag**2) / (4 * sigma**2)), abs=0.06)
        assert rows.exceptAll(rain.smooth_noise(box.repartition(7), 5, sigma).select("row", "col", "noise")).isEmpty()
    members = rain.rain_ensemble(box, 3, 0.1)
    both = members.where("member = 0").join(members.where("member = 1").withColumnRenamed("value", "other"), grid.CELL)
    r = both.agg(F.corr("value", "other").alias("r"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo")).first()
    assert abs(r["r"]) < 0.1 and abs(r["s"] - 5) < 0.5 and r["lo"] >= 0.1
    assert rain.rain_ensemble(box.withColumn("value", F.lit(0.01)), 2, 40.0, floor=0.0).agg(F.min("value")).first()[0] == 0.0


def test_field_noise_is_added_to_the_field(spark):
    box = spark.range(400).select(F.lit(1).cast("long").alias("grid_id"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    plain, rough = (rain.regional_field(box, 50.0, noise).withColumnRenamed("value", f"v{i}") for i, noise in enumerate((0.0, 0.02)))
    off = plain.join(rough, grid.CELL).join(rain.smooth_noise(box, 42, 1.5), grid.CELL)
    assert off.where("abs(v1 - v0 - noise) > 1e-9").isEmpty() and off.count() == 400


def test_storms_are_read_again_at_old_steps(spark):
    depth = np.array([0, 1, 4, 9, 3, 2, 0, 5, 5, 1, 0, 2], float)
    storm = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(depth)], "scenario_id string, step int, depth double")
    drawn = storm.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("member", "step", F.exp(0.2 * rain.normal_of(8, "scenario_id", "member", "step")).alias("w"), rain.normal_of(7, "scenario_id", "member").alias("m"))
    weights, moves = np.ones((30, 12)), np.zeros(30)
    for r in drawn.collect():
        weights[r["member"], r["step"]], moves[r["member"]] = r["w"], r["m"]
    got = np.zeros((30, 12))
    for r in rain.storm_ensemble(storm, 30, 0.2, 0.3).collect():
        got[r["member"], r["step"]] = r["depth"]
    step = np.arange(12.0)
    for k in range(30):
        at = step + np.clip(0.3 * 11 * moves[k], -11 / 4, 11 / 4)
        ok = (at >= 0) & (at <= 11)
        want = np.interp(step, at[ok], (depth * weights[k])[ok], left=0, right=0)
        assert got[k] == pytest.approx(want * depth.sum() / want.sum())
    assert len(set(np.round(moves, 6))) == 30
    still = rain.storm_ensemble(storm, 1, 0.0, 0.0).orderBy("step").collect()
    assert [r["depth"] for r in still] == pytest.approx(depth.tolist())


def test_ruggedness_window_with_holes(spark):
    z = holes(np.random.default_rng(4), (9, 8), 0.3)
    got = {(r["row"], r["col"]): r["tri"] for r in grid.ruggedness_mean(table(spark, z), 2).collect()}
    for i, j in itertools.product(range(9), range(8)):
        near = z[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].ravel()
        near = near[~np.isnan(near)]
        if not np.isnan(z[i, j]):
            assert got[i, j] == (pytest.approx(np.abs(near - z[i, j]).mean()) if len(near) > 1 else None)


@pytest.mark.parametrize("block", [4, 7, 256])
def test_components_across_blocks(spark, block):
    rng = np.random.default_rng(block)
    wet = {(int(i), int(j)) for i, j in zip(*np.nonzero(rng.random((31, 26)) < 0.6), strict=True)}
    wet |= {(-i - 1, j) for i, j in wet if i < 9}  # indices below 0 too
    got = {(r["row"], r["col"]): r["component"] for r in hydrology.components(spark.createDataFrame([(1, i, j) for i, j in wet], "grid_id long, row int, col int"), block).collect()}
    left, want = set(wet), {}
    while left:
        queue, piece = [left.pop()], []
        while queue:
            i, j = queue.pop()
            piece.append((i, j))
            for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if p in left:
                    left.remove(p)
                    queue.append(p)
        i, j = min(piece)
        want |= dict.fromkeys(piece, i * (1 << 31) + j)
    assert got == want


def test_no_cells(spark):
    none = spark.createDataFrame([], CELLS)
    for f in (lambda x: hydrology.hand_least(x, x, 3), lambda x: hydrology.hand_nearest(x, x, 3), lambda x: hydrology.stream_distance(x, x), lambda x: hydrology.fill_depressions(x, 8), grid.statistics):
        assert f(none).count() == 0
