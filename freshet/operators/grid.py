"""Grids as cell tables ``grid_id, row, col, value``; row 0 is north. Neighbours by windows, never by driver loops."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import quantiles, with_quantiles

CELL = ["grid_id", "row", "col"]


def _row():
    return Window.partitionBy("grid_id", "row").orderBy("col")


def _col():
    return Window.partitionBy("grid_id", "col").orderBy("row")


def _at(value: str, w, step: int) -> Column:
    """The value so many cells on along a window; null where that cell is missing, whatever lies beyond it."""
    return F.first_value(value).over(w.rangeBetween(step, step))


#: D8 codes by (row, col) step, in the order in which the first steepest wins.
D8 = {(-1, -1): 32, (-1, 0): 64, (-1, 1): 128, (0, -1): 16, (0, 1): 1, (1, -1): 8, (1, 0): 4, (1, 1): 2}


def gradient(cells: DataFrame, size: float = 1.0, value: str = "value", names: tuple[str, str] = ("dx", "dy")) -> DataFrame:
    """Add column and row derivatives: central inside, one-sided at edges."""

    def along(w) -> Column:
        before, after = _at(value, w, -1), _at(value, w, 1)
        inside = (after - before) / (2 * size)
        return F.coalesce(inside, (after - F.col(value)) / size, (F.col(value) - before) / size, F.lit(0.0))

    return cells.withColumn(names[0], along(_row())).withColumn(names[1], along(_col()))


def slope(cells: DataFrame, size: float = 1.0, units: str = "degrees") -> DataFrame:
    rise = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    out = {"degrees": F.degrees(F.atan(rise)), "radians": F.atan(rise), "percent": rise * 100}[units]
    return gradient(cells, size).select(*CELL, out.alias("slope"))


def aspect(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Degrees from north, clockwise: atan2(-dx, dy), made non-negative."""
    a = F.degrees(F.atan2(-F.col("dx"), F.col("dy")))
    return gradient(cells, size).select(*CELL, F.when(a < 0, a + 360).otherwise(a).alias("aspect"))


def curvature(cells: DataFrame, size: float = 1.0, sigma: float = 0.0) -> DataFrame:
    """Profile, planform, mean and Gaussian curvature of the surface, smoothed by ``sigma`` first; 0 where it is flat."""
    first = gradient(gaussian(cells, sigma) if sigma else cells, size)
    second = gradient(gradient(first, size, "dx", ("dxx", "dxy")), size, "dy", ("dyx", "dyy"))
    p, q, r, s, t = (F.col(c) for c in ("dx", "dy", "dxx", "dxy", "dyy"))
    g = p * p + q * q
    sloped = lambda c: F.when(g >= 1e-10, c).otherwise(0.0)
    g1 = F.when(g >= 1e-10, g).otherwise(1.0)
    return second.select(
        *CELL,
        sloped(-(r * p * p + 2 * s * p * q + t * q * q) / (g1 * F.pow(1 + g1, 1.5))).alias("profile"),
        sloped(-(r * q * q - 2 * s * p * q + t * p * p) / F.pow(g1, 1.5)).alias("planform"),
        (-((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * F.pow(1 + g, 1.5))).alias("mean"),
        ((r * t - s * s) / F.pow(1 + g, 2)).alias("gaussian"),
    )


def with_reflection(cells: DataFrame, k: int) -> DataFrame:
    """The cells and ``k`` mirrored rows and columns around each grid; the edge cell repeats."""
    ends = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    x = cells.join(ends, "grid_id")

    def mirrored(df, at: str, n: str):
        low = F.when(F.col(at) < k, -1 - F.col(at))
        high = F.when(F.col(at) >= F.col(n) - k, 2 * F.col(n) - 1 - F.col(at))
        return df.withColumn(at, F.explode(F.array_compact(F.array(F.col(at), low, high))))

    return mirrored(mirrored(x, "row", "rows"), "col", "cols")


def boxed(cells: DataFrame) -> DataFrame:
    """The cells and, for each that a grid's box lacks, one whose other columns are null."""
    ends = cells.groupBy("grid_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    rows = ends.select("grid_id", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1")
    return rows.select("grid_id", "row", F.explode(F.sequence("c0", "c1")).alias("col")).join(cells, CELL, "left")


def focal(cells: DataFrame, k: int, border: str = "null", value: str = "value", holes: bool = False) -> DataFrame:
    """Add focal sum, n, mean, min, max and population std over (2k+1) x (2k+1) cells.

    Two passes of range windows. ``border``: ``null`` takes the cells there are,
    ``reflect`` mirrors the grid first. Holes are rows with a null value; with
    ``holes`` they may also be missing, and rows are added for them first.
    """
    x = boxed(cells) if holes else cells
    x = with_reflection(x, k) if border == "reflect" else x
    v = F.col(value)
    x = x.withColumns({"s1": v, "s2": v * v, "c1": v.isNotNull().cast("long"), "lo": v, "hi": v})
    folds = {"s1": F.sum, "s2": F.sum, "c1": F.sum, "lo": F.min, "hi": F.max}
    for w in (_row(), _col()):
        x = x.withColumns({c: f(c).over(w.rangeBetween(-k, k)) for c, f in folds.items()})
    if border == "reflect":
        x = x.where("row >= 0 and row < rows and col >= 0 and col < cols").drop("rows", "cols")
    mean = F.col("s1") / F.col("c1")
    std = F.sqrt(F.greatest(F.col("s2") / F.col("c1") - mean * mean, F.lit(0.0)))
    return x.withColumns({"f_sum": F.col("s1"), "f_n": F.col("c1"), "f_mean": mean, "f_min": F.col("lo"), "f_max": F.col("hi"), "f_std": std}).drop(*folds)


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of the cells along a line, cut at 4 sigma; they add up to 1."""
    k = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return [w / sum(weights) for w in weights]


def gaussian(cells: DataFrame, sigma: float, value: str = "value") -> DataFrame:
    """Gaussian smoothing, cut at 4 sigma, mirrored at borders: two passes of weighted neighbours; null where one is missing."""
    kernel = gaussian_kernel(sigma)
    k = len(kernel) // 2
    x = with_reflection(cells, k)
    for w in (_row(), _col()):
        parts = [_at(value, w, i) * kernel[i + k] if i else F.col(value) * kernel[k] for i in range(-k, k + 1)]
        x = x.withColumn(value, reduce(lambda a, b: a + b, parts))
    return x.where("row >= 0 and row < rows and col >= 0 and col < cols").drop("rows", "cols")


def neighbours(cells: DataFrame, value: str = "value") -> DataFrame:
    """Add the eight neighbours' values as ``n<drow>_<dcol>`` (m for minus); null outside."""
    others = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(_name((a, b))).alias("name")) for a, b in D8])
    told = cells.where(F.col(value).isNotNull()).select("grid_id", "row", "col", F.col(value).alias("told"), F.explode(others).alias("s"))
    # a cell tells each neighbour its value: holes and corners need no care
    told = told.groupBy("grid_id", (F.col("row") - F.col("s.a")).alias("row"), (F.col("col") - F.col("s.b")).alias("col"))
    named = told.agg(*[F.max(F.when(F.col("s.name") == _name(s), F.col("told"))).alias(_name(s)) for s in D8])
    return cells.join(named, CELL, "left")


def _name(step: tuple[int, int]) -> str:
    return "n" + "_".join(f"m{-x}" if x < 0 else str(x) for x in step)


def tpi(cells: DataFrame, k: int) -> DataFrame:
    """Value less the mean of the other cells in the window."""
    others = F.try_divide(F.col("f_sum") - F.col("value"), F.col("f_n") - 1)
    return focal(cells, k).select(*CELL, (F.col("value") - others).alias("tpi"))


def ruggedness_mean(cells: DataFrame, k: int = 1) -> DataFrame:
    """``tri``: mean ``|other - c|`` of the valid cells of a (2k+1) x (2k+1) window, the centre among them; null with fewer than two.

    Two passes gather each row's values and then the rows of a window.
    """
    # a row is read at every column, so holes take no row away from a window
    x = boxed(cells.select(*CELL, "value")).select(*CELL, "value", F.collect_list("value").over(_row().rangeBetween(-k, k)).alias("near"))
    x = x.withColumn("near", F.flatten(F.collect_list("near").over(_col().rangeBetween(-k, k))))
    off = F.aggregate("near", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("value")))
    x = x.select(*CELL, "value", F.when(F.size("near") > 1, off / F.size("near")).alias("tri"))
    return x.where("value is not null").drop("value")


def wetness_of_cells(wide: DataFrame, size: float = 1.0, accumulation: str = "cells", slope_radians: str = "slope") -> DataFrame:
    """Add ``twi = ln((cells + 1) size / tan slope)``, the slope 0.001 at least."""
    return wide.withColumn("twi", F.log((F.col(accumulation) + 1) * size / F.tan(F.greatest(F.col(slope_radians), F.lit(0.001)))))


def contrast_features(wide: DataFrame, near: int = 4, far: int = 7, eps: float = 1e-8) -> DataFrame:
    """Dimensionless forms of elevation, slope, twi, hand, flow and roughness against their surroundings, borders mirrored.

    Contrasts are (value - mean) / (mean + eps) over the near window, of flow in
    logs; heights are set against the far window's relief. All bands take the
    same two passes: one exchange for rows, one for columns.
    """
    c = F.col
    x = with_reflection(wide.withColumn("flow", F.log(c("flow") + 1)), far)
    bands = ["slope", "twi", "flow", "roughness"]
    x = x.withColumns({f"s_{b}": c(b) for b in bands} | {f"n_{b}": c(b).isNotNull().cast("long") for b in bands} | {"lo": c("elevation"), "hi": c("elevation")})
    for w in (_row(), _col()):
        close, wide_ = w.rangeBetween(-near, near), w.rangeBetween(-far, far)
        sums = {f"{p}_{b}": F.sum(f"{p}_{b}").over(close) for p in "sn" for b in bands}
        x = x.withColumns(sums | {"lo": F.min("lo").over(wide_), "hi": F.max("hi").over(wide_)})
    x = x.where("row >= 0 and row < rows and col >= 0 and col < cols")
    mean = {b: c(f"s_{b}") / c(f"n_{b}") for b in bands}
    contrast = {b: (c(b) - mean[b]) / (mean[b] + eps) for b in bands}
    relief = F.greatest(c("hi") - c("lo"), F.lit(eps))
    names = {"slope_position": contrast["slope"], "twi_contrast": contrast["twi"], "flow_contrast": contrast["flow"], "roughness_contrast": contrast["roughness"]}
    names |= {"relative_elevation": (c("elevation") - c("lo")) / relief, "normalized_hand": c("hand") / relief}
    return x.select(*CELL, *[v.alias(n) for n, v in names.items()])


def ruggedness(cells: DataFrame) -> DataFrame:
    """``|8 c - sum of neighbours|`` with 0 outside, and the mean ``|neighbour - c|`` of valid cells, the centre among them."""
    values = [F.col(_name(s)) for s in D8]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    apart = reduce(lambda a, b: a + b, [F.coalesce(F.abs(v - F.col("value")), F.lit(0.0)) for v in values])
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values]) + 1
    return neighbours(cells).select(*CELL, F.abs(8 * F.col("value") - total).alias("tri_sum"), (apart / n).alias("tri_mean"))


def d8(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Direction code and slope of the steepest of the valid neighbours, the first of equal ones; 0 at the border."""
    drops = [(F.col("value") - F.col(_name(s))) / (size * math.hypot(*s)) for s in D8]
    best = F.greatest(*drops)
    code = reduce(lambda rest, x: F.when(x[0] == best, x[1]).otherwise(rest), reversed(list(zip(drops, D8.values(), strict=True))), F.lit(0))
    whole = reduce(lambda a, b: a & b, [F.col(_name(s)).isNotNull() for s in D8])
    return neighbours(cells).select(*CELL, F.when(whole, code).otherwise(0).alias("direction"), F.when(whole, best).alias("steepest"))


def sinks(cells: DataFrame) -> DataFrame:
    """Cells lower than all eight neighbours."""
    low = F.least(*[F.col(_name(s)) for s in D8])
    whole = reduce(lambda a, b: a & b, [F.col(_name(s)).isNotNull() for s in D8])
    return neighbours(cells).where(whole & (F.col("value") < low)).select(*CELL, "value")


def wetness(wide: DataFrame, area: str = "area", slope_radians: str = "slope") -> DataFrame:
    """Add ``twi = ln(area / tan slope)`` (both 1e-6 at least) and ``spi = area * tan slope``."""
    tan = F.tan(slope_radians)
    twi = F.log(F.greatest(F.col(area), F.lit(1e-6)) / F.greatest(tan, F.lit(1e-6)))
    return wide.withColumn("twi", twi).withColumn("spi", F.col(area) * tan)


def _steps(shape: str) -> list[tuple[int, int]]:
    return [(0, 0), *[s for s in D8 if shape == "square" or 0 in s]]


def dilate(extent: DataFrame, shape: str = "cross", n: int = 1) -> DataFrame:
    """Wet cells and those next to one. ``extent`` holds wet cells only; grown cells may lie outside the grid."""
    for _ in range(n):
        step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _steps(shape)]))
        grown = extent.select("grid_id", "row", "col", step.alias("s"))
        extent = grown.select("grid_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col")).distinct()
    return extent


def erode(extent: DataFrame, shape: str = "cross", n: int = 1) -> DataFrame:
    """Wet cells all of whose neighbours are wet; outside is dry."""
    for _ in range(n):
        step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _steps(shape)]))
        votes = extent.select("grid_id", "row", "col", step.alias("s"))
        votes = votes.groupBy("grid_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col")).count()
        extent = votes.where(F.col("count") == len(_steps(shape))).drop("count")
    return extent


def closing(extent: DataFrame, shape: str = "cross", n: int = 1) -> DataFrame:
    return erode(dilate(extent, shape, n), shape, n)


def opening(extent: DataFrame, shape: str = "cross", n: int = 1) -> DataFrame:
    return dilate(erode(extent, shape, n), shape, n)


def statistics(cells: DataFrame, key: str = "grid_id") -> DataFrame:
    """Count, mean, std, ends, quartiles, skewness and kurtosis of valid cells."""
    v = F.col("value")
    got = cells.groupBy(key).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.skewness(v).alias("skew"),
        F.kurtosis(v).alias("kurtosis"),
    )
    return with_quantiles(got, cells, [key], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})


def coverage(cells: DataFrame, key: str = "grid_id") -> DataFrame:
    """Valid cells, their share and their row and column range."""
    ok = F.col("value").isNotNull()
    at = lambda f, c: f(F.when(ok, F.col(c)))
    return cells.groupBy(key).agg(
        F.count_if(ok).alias("valid"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("share"),
        at(F.min, "row").alias("row_min"),
        at(F.max, "row").alias("row_max"),
        at(F.min, "col").alias("col_min"),
        at(F.max, "col").alias("col_max"),
    )


def clip(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Cells of the half-open box, counted from its corner."""
    inside = cells.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))
    return inside.withColumn("row", F.col("row") - row0).withColumn("col", F.col("col") - col0)


def clip_box(cells: DataFrame, meta: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Cells and meta within a world box (west, south, east, north): indices truncated towards zero, held inside the grid, counted from the new corner.

    ``meta``: grid_id, nrows, ncols, xll, yll, cellsize; row 0 is north.
    """
    west, south, east, north = box
    top = F.col("yll") + F.col("nrows") * F.col("cellsize")
    at = lambda x, n: F.least(F.greatest((x / F.col("cellsize")).cast("int"), F.lit(0)), F.col(n)).cast("int")
    m = meta.withColumns({"r0": at(top - north, "nrows"), "r1": at(top - south, "nrows"), "c0": at(west - F.col("xll"), "ncols"), "c1": at(east - F.col("xll"), "ncols")})
    inside = cells.join(m.select("grid_id", "r0", "r1", "c0", "c1"), "grid_id").where("row >= r0 and row < r1 and col >= c0 and col < c1")
    got = inside.select("grid_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "value")
    new = m.select(
        "grid_id", (F.col("r1") - F.col("r0")).alias("nrows"), (F.col("c1") - F.col("c0")).alias("ncols"), (F.col("xll") + F.col("c0") * F.col("cellsize")).alias("xll"),
        (top - F.col("r1") * F.col("cellsize")).alias("yll"), "cellsize",
    )
    return got, new


def world_coverage(cells: DataFrame, meta: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Per grid: valid cells, all or those whose centre a world box holds, their share, and the bounds of the valid ones in world units."""
    x = cells.join(meta, "grid_id")
    size = F.col("cellsize")
    west, north = F.col("xll") + F.col("col") * size, F.col("yll") + (F.col("nrows") - F.col("row")) * size
    if box is not None:
        x = x.where((west + size / 2).between(box[0], box[2]) & (north - size / 2).between(box[1], box[3]))
    ok = F.col("value").isNotNull()
    at = lambda f, c: f(F.when(ok, c))
    return x.groupBy("grid_id").agg(
        F.count_if(ok).alias("valid"), (F.count_if(ok) / F.count(F.lit(1))).alias("share"), at(F.min, west).alias("west"), at(F.min, north - size).alias("south"),
        at(F.max, west + size).alias("east"), at(F.max, north).alias("north"),
    )


def resample(cells: DataFrame, factor: float) -> DataFrame:
    """Bilinear values at cell centres ``factor`` times as far apart; null where a neighbour is missing."""
    ends = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    count = lambda c: F.floor(F.col(c) / factor).cast("int")
    made = ends.select("grid_id", F.explode(F.sequence(F.lit(0), count("rows") - 1)).alias("row"), count("cols").alias("n"))
    made = made.select("grid_id", "row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("col"))
    y, x = (F.col("row") + 0.5) * factor - 0.5, (F.col("col") + 0.5) * factor - 0.5
    made = made.select("grid_id", "row", "col", F.floor(y).alias("y0"), F.floor(x).alias("x0"), (y - F.floor(y)).alias("fy"), (x - F.floor(x)).alias("fx"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    need = made.withColumn("c", corner).select(
        "grid_id",
        F.col("row").alias("to_row"),
        F.col("col").alias("to_col"),
        (F.col("y0") + F.col("c.a")).cast("int").alias("row"),
        (F.col("x0") + F.col("c.b")).cast("int").alias("col"),
        (F.when(F.col("c.a") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("c.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))).alias("w"),
    )
    need = need.where("w > 0")
    got = need.join(cells, CELL, "left").groupBy("grid_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"))
    value = F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("value")))
    return got.agg(value.alias("value"))


def align_crop(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both grids have: value_a, value_b."""
    return a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), CELL)


def align_pad(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that either grid has; null where one lacks it."""
    return a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), CELL, "full_outer")


def zscore(df: DataFrame, key: str = "grid_id", eps: float = 1e-8) -> DataFrame:
    """Value less the mean over the population std (1 if below eps), per group."""
    stats = df.groupBy(key).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    sd = F.when(F.col("sd") < eps, 1.0).otherwise(F.col("sd"))
    return df.join(stats, key).withColumn("z", (F.col("value") - F.col("mu")) / sd).drop("mu", "sd")


def zscore_robust(df: DataFrame, key: str = "grid_id") -> DataFrame:
    """Value less the median over MAD / 0.67449."""
    half = lambda x, c, name: quantiles(x, [key], [c], [0.5]).select(key, F.get(f"{c}_q", F.lit(0)).alias(name))
    x = df.join(half(df, "value", "med"), key)
    mad = half(x.select(key, F.abs(F.col("value") - F.col("med")).alias("off")), "off", "mad")
    scale = F.when(F.col("mad") / 0.67449 < 1e-8, 1.0).otherwise(F.col("mad") / 0.67449)
    return x.join(mad, key).withColumn("z", (F.col("value") - F.col("med")) / scale).drop("med", "mad")


def minmax(df: DataFrame, low: float = 0.0, high: float = 1.0, pct: tuple[float, float] | None = None, key: str = "grid_id") -> DataFrame:
    """Value scaled so that its ends (or percentiles) are ``low`` and ``high``; a flat group is ``low``."""
    if pct:
        ends = quantiles(df, [key], ["value"], list(pct)).select(key, *[F.get("value_q", F.lit(i)).alias(n) for i, n in enumerate("ab")])
    else:
        ends = df.groupBy(key).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    x = df.join(ends, key)
    part = F.coalesce(F.try_divide(F.col("value") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0))
    return x.withColumn("scaled", low + part * (high - low)).drop("a", "b")


def quantile_rank(df: DataFrame, n: int = 100, key: str = "grid_id") -> DataFrame:
    """Left insertion place among ``n`` evenly spaced reference percentiles, over ``n``."""
    refs = quantiles(df, [key], ["value"], [i / (n - 1) for i in range(n)]).withColumnRenamed("value_q", "refs")
    below = F.size(F.filter("refs", lambda q: q < F.col("value")))
    return df.join(refs, key).withColumn("quantile", below / n).drop("refs")


def log_normalize(df: DataFrame, offset: float = 1.0, key: str = "grid_id") -> DataFrame:
    """Log of the value above the group's least plus an offset, then z."""
    low = df.groupBy(key).agg(F.min("value").alias("low"))
    logs = df.join(low, key).withColumn("value", F.log(F.col("value") - F.col("low") + offset)).drop("low")
    return zscore(logs, key)


def local_normalize(cells: DataFrame, k: int, border: str = "null") -> DataFrame:
    """z and min-max within the window of each cell; ``border``: ``reflect`` mirrors the grid first."""
    x = focal(cells, k, border)
    sd = F.when(F.col("f_std") < 1e-8, 1.0).otherwise(F.col("f_std"))
    part = F.coalesce(F.try_divide(F.col("value") - F.col("f_min"), F.col("f_max") - F.col("f_min")), F.lit(0.0))
    return x.select(*CELL, ((F.col("value") - F.col("f_mean")) / sd).alias("local_z"), part.alias("local_minmax"))


def patches(meta: DataFrame, sizes: list[int], overlap: float) -> DataFrame:
    """Whole patches of each size: tile_id, size, row0, col0. ``meta``: grid_id, nrows, ncols."""
    size = F.explode(F.array(*[F.lit(s) for s in sizes]))
    x = meta.withColumn("size", size).withColumn("step", F.greatest(F.floor(F.col("size") * (1 - overlap)).cast("int"), F.lit(1)))
    x = x.where("nrows >= size and ncols >= size")
    x = x.withColumn("row0", F.explode(F.expr("sequence(0, nrows - size, step)"))).withColumn("col0", F.explode(F.expr("sequence(0, ncols - size, step)")))
    tile = F.concat_ws("_", "grid_id", "size", "row0", "col0")
    return x.select(tile.alias("tile_id"), "grid_id", "size", "row0", "col0")


def assign_cells(cells: DataFrame, size: int, step: int, rows: int, cols: int, least_valid: float) -> DataFrame:
    """``grid_id, row0, col0, n, mean`` of the whole tiles with a share of valid cells: cells find their tiles by arithmetic."""

    def starts(at: str, n: int) -> Column:
        first = F.greatest(F.ceil((F.col(at) - size + 1) / step), F.lit(0))
        last = F.least(F.floor(F.col(at) / step), F.lit((n - size) // step))
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    x = cells.withColumn("i", starts("row", rows)).withColumn("j", starts("col", cols))
    x = x.groupBy("grid_id", (F.col("i") * step).alias("row0"), (F.col("j") * step).alias("col0"))
    got = x.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return got.where(F.col("n") >= least_valid * size * size)


def blend_tiles(tiles: DataFrame, size: int, edge: int, cells: DataFrame | None = None) -> DataFrame:
    """``grid_id, row, col, value``: overlapping tile values blended with weights that taper to the tile edge; 0 at those of ``cells`` that no tile has."""
    near = F.least(F.col("r"), F.col("c"), size - 1 - F.col("r"), size - 1 - F.col("c"))
    w = F.least((near + 1) / edge, F.lit(1.0))
    x = tiles.withColumn("w", w).groupBy("grid_id", (F.col("row0") + F.col("r")).alias("row"), (F.col("col0") + F.col("c")).alias("col"))
    got = x.agg(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("value"))
    if cells is None:
        return got
    return cells.select(*CELL).join(got, CELL, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def augment(tile_cells: DataFrame, size: int) -> DataFrame:
    """Flips and quarter turns of tiles: ``variant, r, c`` besides what is there."""
    n = size - 1
    r, c = F.col("r"), F.col("c")
    ways = {"identity": (r, c), "flip_lr": (r, n - c), "flip_ud": (n - r, c), "rot90": (n - c, r), "rot180": (n - r, n - c), "rot270": (c, n - r)}
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), a.alias("r"), b.alias("c")) for k, (a, b) in ways.items()]))
    rest = [x for x in tile_cells.columns if x not in ("r", "c")]
    return tile_cells.select(*rest, turned.alias("t")).select(*rest, "t.variant", "t.r", "t.c")


def augment_grid(cells: DataFrame, size: int) -> DataFrame:
    """Flips and quarter turns of all tiles side by side, ``row0, col0, variant, r, c``; tiles at the far edges are as small as what is left."""
    ends = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    tiles = cells.join(ends, "grid_id").withColumns({"r": F.col("row") % size, "c": F.col("col") % size})
    tiles = tiles.withColumns({"row0": F.col("row") - F.col("r"), "col0": F.col("col") - F.col("c")})
    m, n = (F.least(F.lit(size), F.col(e) - F.col(o)) - 1 for e, o in (("rows", "row0"), ("cols", "col0")))
    r, c = F.col("r"), F.col("c")
    ways = {"identity": (r, c), "flip_lr": (r, n - c), "flip_ud": (m - r, c), "rot90": (n - c, r), "rot180": (m - r, n - c), "rot270": (c, m - r)}
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), a.alias("r"), b.alias("c")) for k, (a, b) in ways.items()]))
    rest = ["grid_id", "row0", "col0", "value"]
    return tiles.select(*rest, turned.alias("t")).select(*rest, "t.variant", "t.r", "t.c")


def ensemble(cells: DataFrame, threshold: float, sample: bool = False) -> DataFrame:
    """Mean, spread (of the population, or of a ``sample``, as for dropout) and share over a threshold of each cell's members."""
    v = F.col("value")
    got = cells.groupBy("row", "col")
    return got.agg(F.avg(v).alias("mean"), (F.stddev_samp(v) if sample else F.stddev_pop(v)).alias("spread"), (F.count_if(v > threshold) / F.count(v)).alias("exceedance"), F.count(v).alias("members"))
