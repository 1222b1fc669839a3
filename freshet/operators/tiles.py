"""Tile grids, statistics, samples and splits of tiles, and normalisers fitted once and applied later."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from .rain import uniform_of


def tiles_clamped(meta: DataFrame, size: int, overlap: int) -> DataFrame:
    """``grid_id, i, j, row0, col0``: (dim - overlap) // stride + 1 tiles a side, the last ones moved inside; grids (grid_id, nrows, ncols)."""
    stride = size - overlap
    count = lambda c: F.greatest(F.floor((F.col(c) - overlap) / stride).cast("int") + 1, F.lit(1))
    x = meta.withColumn("i", F.explode(F.sequence(F.lit(0), count("nrows") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), count("ncols") - 1)))
    at = lambda k, c: F.greatest(F.least(F.col(k) * stride, F.col(c) - size), F.lit(0))
    return x.select("grid_id", "i", "j", at("i", "nrows").alias("row0"), at("j", "ncols").alias("col0"))


def tile_bounds(tiles: DataFrame, cellsize: float) -> DataFrame:
    """Tiles (tile_id, row0, col0, size) with their box and centre; x grows east, y grows north from row 0."""
    edge = {"minx": F.col("col0"), "maxx": F.col("col0") + F.col("size"), "miny": -(F.col("row0") + F.col("size")), "maxy": -F.col("row0")}
    x = tiles.withColumns({k: v * F.lit(cellsize) for k, v in edge.items()})
    return x.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2})


def patch_statistics(tile_cells: DataFrame) -> DataFrame:
    """``tile_id`` with count, share of valid cells, mean, spread and ends."""
    v = F.col("value")
    return tile_cells.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("cells"), (F.count(v) / F.count(F.lit(1))).alias("valid"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def total_extent(tiles: DataFrame) -> DataFrame:
    """One row: how many tiles, and the box of all."""
    return tiles.agg(F.count(F.lit(1)).alias("tiles"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def patch_index(tiles: DataFrame) -> DataFrame:
    """``tile_id`` to where it is from."""
    return tiles.select("tile_id", F.struct("grid_id", "row0", "col0", "size").alias("source"), F.struct("x", "y").alias("centre"))


def filter_patches(tiles: DataFrame, box: tuple[float, float, float, float], low: float, high: float) -> DataFrame:
    """Tiles (x, y, low, high) with the centre in a closed box, not all below ``low`` nor all above ``high``."""
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    return tiles.where(inside & (F.col("high") >= low) & (F.col("low") <= high))


def shape_check(tile_cells: DataFrame, size: int, bands: list[str]) -> DataFrame:
    """``tile_id, whole, filled``: size x size cells within the tile, and every band in each."""
    there = F.bool_and(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1))
    filled = [F.bool_and(F.col(b).isNotNull()) for b in bands]
    every = filled[0]
    for f in filled[1:]:
        every = every & f
    return tile_cells.groupBy("tile_id").agg((there & (F.count(F.lit(1)) == size * size)).alias("whole"), every.alias("filled"))


def ranked(df: DataFrame, seed: int, key: str, by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """``df`` with ``place``, its rank from 1 by a seeded hash of ``key`` within ``by``.

    Ranks are counted within hash ranges and moved by the ranges' running totals,
    so no task holds a whole group.
    """
    by = by or []
    x = df.withColumn("draw", F.xxhash64(F.lit(seed), key)).withColumn("bucket", F.shiftright(F.col("draw"), 64 - (buckets - 1).bit_length()))
    sizes = x.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("m"))  # at most so many rows a group
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("m").over(w), F.lit(0))).drop("m")
    inner = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("draw", key))
    return x.withColumn("inner", inner).join(starts, [*by, "bucket"]).withColumn("place", F.col("inner") + F.col("start")).drop("draw", "bucket", "inner", "start")


def balanced_tiles(tiles: DataFrame, threshold: float = 0.02, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """All flooded tiles (tile_id, share) and int(n (1 - ratio) / ratio) dry ones at most, by hash."""
    wet = F.col("share") >= threshold
    cap = tiles.agg(F.floor(F.count_if(wet) * (1 - ratio) / ratio).alias("cap"))  # one row
    marked = ranked(tiles.withColumn("wet", wet), seed, "tile_id", ["wet"]).crossJoin(F.broadcast(cap))
    return marked.where(F.col("wet") | (F.col("place") <= F.col("cap"))).drop("place", "cap")


def split_tiles(tiles: DataFrame, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``split``: int(n x train) to train, int(n x val) to val, the rest to test, by hash."""
    n = tiles.agg(F.count(F.lit(1)).alias("n"))  # one row
    x = ranked(tiles, seed, "tile_id").crossJoin(F.broadcast(n))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    split = F.when(F.col("place") <= a, "train").when(F.col("place") <= a + b, "val").otherwise("test")
    return x.withColumn("split", split).drop("place", "n")


def assign_periods(tiles: DataFrame, periods: list[tuple[int, float, float]], seed: int = 42) -> DataFrame:
    """Tiles with a period and its depth, drawn by weight; ``periods``: (period, weight, depth)."""
    u, total, at = uniform_of(seed, "tile_id"), sum(w for _, w, _ in periods), 0.0
    period = depth = None
    for p, w, d in periods[:-1]:
        at += w / total
        period = F.when(u < at, p) if period is None else period.when(u < at, p)
        depth = F.when(u < at, d) if depth is None else depth.when(u < at, d)
    last = periods[-1]
    return tiles.withColumns({"period": period.otherwise(last[0]) if period is not None else F.lit(last[0]), "depth": depth.otherwise(last[2]) if depth is not None else F.lit(last[2])})


def tile_scenarios(tiles: DataFrame, n: int, periods: list[tuple[int, float, float]], seed: int = 42) -> DataFrame:
    """``n`` copies of each tile, each with a period of its own."""
    copies = tiles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    named = copies.withColumn("tile_id", F.concat_ws("#", F.col("tile_id").cast("string"), F.col("copy").cast("string")))
    return assign_periods(named, periods, seed)


def sample_pairs(pairs: DataFrame, n: int = 5000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """At most ``n`` rows by hash: the sample is the feature."""
    keys = key or pairs.columns
    return pairs.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def power_normalize(df: DataFrame, power: float, offset: float = 1.0, key: str = "grid_id") -> DataFrame:
    """``z`` of (value - least + offset) to a power, per group."""
    low = df.groupBy(key).agg(F.min("value").alias("low"))
    from .grid import zscore

    moved = df.join(low, key).withColumn("value", F.pow(F.col("value") - F.col("low") + offset, F.lit(float(power)))).drop("low")
    return zscore(moved, key)


def fit_power(df: DataFrame, powers: list[float], offset: float = 1.0, key: str = "grid_id") -> DataFrame:
    """``key, power``: of the given ones that of the largest Box-Cox likelihood, in one pass."""
    low = df.groupBy(key).agg(F.min("value").alias("low"))
    x = df.join(low, key).withColumn("y", F.col("value") - F.col("low") + offset)
    n = F.count("y")
    parts = []
    for p in powers:
        t = F.log("y") if p == 0 else (F.pow("y", F.lit(float(p))) - 1) / p
        parts.append((p, -n / 2 * F.log(F.greatest(F.var_pop(t), F.lit(1e-300))) + (p - 1) * F.sum(F.log("y"))))
    got = x.groupBy(key).agg(F.array(*[F.struct(v.alias("v"), F.lit(float(p)).alias("p")) for p, v in parts]).alias("all"))
    return got.select(key, F.array_max("all")["p"].alias("power"))


def tile_normalize(tile_cells: DataFrame) -> DataFrame:
    """``z`` of each tile's cells, its spread plus 1e-8."""
    stats = tile_cells.groupBy("tile_id").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return tile_cells.join(stats, "tile_id").withColumn("z", (F.col("value") - F.col("mu")) / (F.col("sd") + 1e-8)).drop("mu", "sd")


def channel_normalize(df: DataFrame, constants: dict[str, tuple[float, float]]) -> DataFrame:
    """Each band less its mean over its spread, both given."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in constants.items()})


def fit_params(wide: DataFrame, methods: dict[str, str]) -> DataFrame:
    """``feature, method, a, b`` of each feature: mean and spread (zscore), ends (minmax), least and nothing (log); other methods leave a feature as it is."""
    names = list(methods)
    long = wide.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature", "v")
    method = F.element_at(F.create_map(*[F.lit(x) for kv in methods.items() for x in kv]), F.col("feature"))
    got = long.groupBy("feature").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("method", method)
    m = F.col("method")
    a = F.when(m == "zscore", F.col("mu")).when(m.isin("minmax", "log"), F.col("lo"))
    b = F.when(m == "zscore", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))).when(m == "minmax", F.col("hi"))
    return got.select("feature", "method", a.alias("a"), b.alias("b"))


def apply_params(wide: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """``wide`` with the features normalised by fitted ``params``, a row a feature, met as one row."""
    at = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("method", "a", "b")))).alias("p"))
    x = wide.crossJoin(F.broadcast(at))

    def one(c: str) -> Column:
        p, v = F.try_element_at("p", F.lit(c)), F.col(c)
        scaled = F.coalesce(F.try_divide(v - p["a"], p["b"] - p["a"]), F.lit(0.0))
        return F.when(p["method"] == "zscore", (v - p["a"]) / p["b"]).when(p["method"] == "minmax", scaled).when(p["method"] == "log", F.log(v - p["a"] + 1)).otherwise(v)

    return x.withColumns({c: one(c) for c in features}).drop("p")


def grouped_metric(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], float]) -> DataFrame:
    """``keys, value`` of a caller's function over each group's rows as a pandas frame; a group must fit in a task."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "value": float(function(frame))}])

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, value double")


@udtf(returnType="row0: int, col0: int")
class TileGrid:
    """``SELECT * FROM grids, LATERAL tile_grid(nrows, ncols, size, overlap)``: whole tiles of a grid, one a row."""

    def eval(self, nrows: int, ncols: int, size: int, overlap: float):
        step = max(int(size * (1 - overlap)), 1)
        for r in range(0, nrows - size + 1, step):
            for c in range(0, ncols - size + 1, step):
                yield r, c
