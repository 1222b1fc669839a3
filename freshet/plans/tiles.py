"""Queries of tile grids, samples, splits and fitted normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles as t
from ..sources import fixtures as fx
from ..sources.scratch import shared_folder
from .grids import _META, _PATCH
from .metrics import sq
from .registry import query, rounded

G = fx.SQL_GRIDS


def _meta(spark, d):
    return fx.cells(spark, d, 50).groupBy("grid_id").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))


_CL = f"SELECT grid_id, i::INT AS i, j::INT AS j, greatest(least(i * 12, nrows - 16), 0)::INT AS row0, greatest(least(j * 12, ncols - 16), 0)::INT AS col0 FROM ({_META}), LATERAL (SELECT unnest(range(0, (nrows - 4) // 12 + 1)) AS i) a, LATERAL (SELECT unnest(range(0, (ncols - 4) // 12 + 1)) AS j) b"


@query("tile_clamped", _CL)
def tile_clamped(spark, d):
    return t.tiles_clamped(_meta(spark, d), 16, 4)


@query("udf_tile_grid", f"SELECT grid_id, row0, col0 FROM ({_PATCH}) WHERE size = 16")
def udf_tile_grid(spark, d):
    """Tiles by a table function in SQL, joined laterally."""
    spark.udtf.register("tile_grid", t.TileGrid)
    return spark.sql("SELECT grid_id, g.row0, g.col0 FROM {meta}, LATERAL tile_grid(nrows, ncols, 16, 0.25D) g", meta=_meta(spark, d))


_T = f"SELECT grid_id || '_' || row // 10 || '_' || col // 16 AS tile_id, grid_id, (row // 10 * 10)::INT AS row0, (col // 16 * 16)::INT AS col0, (row % 10)::INT AS r, (col % 16)::INT AS c, CASE WHEN value > -0.2 THEN value END AS value FROM ({G})"


def _tiles(spark, d):
    at = lambda c, n: F.floor(F.col(c) / n).cast("int")
    i, j = at("row", 10), at("col", 16)
    return fx.cells(spark, d, 50).select(
        F.concat_ws("_", "grid_id", i, j).alias("tile_id"), "grid_id", (i * 10).alias("row0"), (j * 16).alias("col0"), (F.col("row") % 10).alias("r"), (F.col("col") % 16).alias("c"), F.when(F.col("value") > -0.2, F.col("value")).alias("value")
    )


def _whole(spark, d):
    got = _tiles(spark, d).groupBy("tile_id", "grid_id", "row0", "col0").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg((F.col("value") > 0.1).cast("int")).alias("share"))
    return t.tile_bounds(got.withColumn("size", F.lit(10)), 2.0)


_W = f"SELECT *, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM (SELECT tile_id, grid_id, row0, col0, min(value) AS low, max(value) AS high, avg((value > 0.1)::INT) AS share, 10 AS size, col0 * 2.0::DOUBLE AS minx, (col0 + 10) * 2.0::DOUBLE AS maxx, -(row0 + 10) * 2.0::DOUBLE AS miny, -row0 * 2.0::DOUBLE AS maxy FROM ({_T}) GROUP BY 1, 2, 3, 4)"


@query("tile_bounds", f"SELECT tile_id, minx, miny, maxx, maxy, x, y FROM ({_W})")
def tile_bounds(spark, d):
    return _whole(spark, d).select("tile_id", "minx", "miny", "maxx", "maxy", "x", "y")


@query("tile_statistics", sq(f"SELECT tile_id, count(*) AS cells, count(value) / count(*) AS valid, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high FROM ({_T}) GROUP BY 1", "tile_id cells", "valid mean std low high"))
def tile_statistics(spark, d):
    return rounded(t.patch_statistics(_tiles(spark, d)))


@query("tile_total_extent", f"SELECT count(*) AS tiles, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM ({_W})")
def tile_total_extent(spark, d):
    return t.total_extent(_whole(spark, d))


@query("tile_index", f"SELECT tile_id, grid_id || ':' || row0 || ':' || col0 AS source, x FROM ({_W})")
def tile_index(spark, d):
    got = t.patch_index(_whole(spark, d))
    return got.select("tile_id", F.concat_ws(":", "source.grid_id", "source.row0", "source.col0").alias("source"), F.col("centre.x").alias("x"))


@query("prj_filter_patches", f"SELECT tile_id FROM ({_W}) WHERE x BETWEEN 20 AND 90 AND y BETWEEN -70 AND -20 AND high >= 0.3 AND low <= -0.18")
def prj_filter_patches(spark, d):
    return t.filter_patches(_whole(spark, d), (20, -70, 90, -20), 0.3, -0.18).select("tile_id")


@query("tile_shape_check", f"SELECT tile_id, count(*) = 256 AND bool_and(r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15) AS whole, bool_and(value IS NOT NULL) AND bool_and(depth IS NOT NULL) AS filled FROM (SELECT *, abs(value) AS depth FROM ({_T})) GROUP BY 1")
def tile_shape_check(spark, d):
    return t.shape_check(_tiles(spark, d).withColumn("depth", F.abs("value")), 16, ["value", "depth"])


@query("smp_balanced_tiles")
def smp_balanced_tiles(spark, d):
    return t.balanced_tiles(_whole(spark, d).select("tile_id", "share"), 0.25)


@query("smp_split_tiles")
def smp_split_tiles(spark, d):
    return t.split_tiles(_whole(spark, d).select("tile_id"))


_PER = [(10, 0.4, 100.0), (25, 0.4, 125.0), (100, 0.1, 175.0), (500, 0.1, 225.0)]


@query("smp_assign_periods")
def smp_assign_periods(spark, d):
    return t.assign_periods(_whole(spark, d).select("tile_id"), _PER)


@query("tile_scenarios")
def tile_scenarios(spark, d):
    return t.tile_scenarios(_whole(spark, d).select("tile_id"), 3, _PER)


@query("smp_pairs")
def smp_pairs(spark, d):
    """At most five thousand pairs for a plot; the sample is the feature."""
    return t.sample_pairs(fx.depth_pairs(spark, d), 5000, key=["case_id", "row", "col"])


_POW = f"WITH l AS (SELECT *, pow(value - min(value) OVER (PARTITION BY grid_id) + 1, 0.3) AS v FROM ({G})) SELECT grid_id, row, col, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM l WINDOW w AS (PARTITION BY grid_id)"


@query("norm_power", sq(_POW, "grid_id row col", "z"))
def norm_power(spark, d):
    return rounded(t.power_normalize(fx.cells(spark, d, 50), 0.3).select("grid_id", "row", "col", "z"))


_LAM = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
_BC = " UNION ALL ".join(f"SELECT grid_id, {p}::DOUBLE AS p, -count(*) / 2 * ln(var_pop({'ln(y)' if p == 0 else f'(pow(y, {p}) - 1) / {p}'})) + ({p} - 1) * sum(ln(y)) AS v FROM y GROUP BY 1" for p in _LAM)


@query("norm_fit_power", f"WITH y AS (SELECT grid_id, value - min(value) OVER (PARTITION BY grid_id) + 1 AS y FROM ({G})) SELECT grid_id, arg_max(p, v) AS power FROM ({_BC}) GROUP BY 1")
def norm_fit_power(spark, d):
    return t.fit_power(fx.cells(spark, d, 50), _LAM)


@query("norm_tile", sq(f"SELECT tile_id, r, c, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z FROM ({_T}) WINDOW w AS (PARTITION BY tile_id)", "tile_id r c", "z"))
def norm_tile(spark, d):
    return rounded(t.tile_normalize(_tiles(spark, d)).select("tile_id", "r", "c", "z"))


@query("norm_channels", sq(f"SELECT grid_id, row, col, (value - 0.1) / 0.2 AS elevation, (abs(value) - 1.5) / 3 AS rain FROM ({G})", "grid_id row col", "elevation rain"))
def norm_channels(spark, d):
    wide = fx.cells(spark, d, 50).select("grid_id", "row", "col", F.col("value").alias("elevation"), F.abs("value").alias("rain"))
    return rounded(t.channel_normalize(wide, {"elevation": (0.1, 0.2), "rain": (1.5, 3.0)}))


_FIT = "SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS a, (o_custkey - min(o_custkey) OVER ()) / (max(o_custkey) OVER () - min(o_custkey) OVER ())::DOUBLE AS b, ln(o_totalprice / 1000 - min(o_totalprice / 1000) OVER () + 1) AS c, o_orderkey::DOUBLE AS d FROM orders"


@query("norm_fit_apply", sq(_FIT, "o_orderkey", "a b c d"))
def norm_fit_apply(spark, d):
    """Methods by feature from a config, fitted, saved, loaded and applied; an unknown method leaves a feature as it is."""
    o = fx.table(spark, d, "orders")
    wide = o.select("o_orderkey", F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"), (F.col("o_totalprice") / 1000).alias("c"), F.col("o_orderkey").cast("double").alias("d"))
    folder = shared_folder(spark, "params")
    t.fit_params(wide, {"a": "zscore", "b": "minmax", "c": "log", "d": "other"}).write.parquet(folder)
    return rounded(t.apply_params(wide, spark.read.parquet(folder), ["a", "b", "c", "d"]))


@query("udf_grouped_metric", sq(f"SELECT case_id, avg(abs(pred - obs)) AS value FROM ({fx.SQL_PAIRS}) GROUP BY 1", "case_id", "value"))
def udf_grouped_metric(spark, d):
    """A caller's Python metric over each case."""
    return rounded(t.grouped_metric(fx.depth_pairs(spark, d), ["case_id"], lambda x: (x["pred"] - x["obs"]).abs().mean()))
