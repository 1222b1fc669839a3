"""Queries of the grid, normalisation and tile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as g
from ..sources import fixtures as fx
from .metrics import sq
from .registry import query, rounded

C, G = fx.SQL_CELLS, fx.SQL_GRIDS
KEY = "grid_id row col"


def _grad(src: str, v: str = "value", dx: str = "dx", dy: str = "dy") -> str:
    def along(w):
        return f"coalesce((lead({v}) OVER {w} - lag({v}) OVER {w}) / 2, lead({v}) OVER {w} - {v}, {v} - lag({v}) OVER {w}, 0)"

    return f"""SELECT *, {along('gr')} AS {dx}, {along('gc')} AS {dy} FROM ({src})
  WINDOW gr AS (PARTITION BY grid_id, row ORDER BY col), gc AS (PARTITION BY grid_id, col ORDER BY row)"""


_HOLES = f"SELECT * FROM ({G}) WHERE abs(value) > 0.02"


def _gap(src: str) -> str:
    """The gradient of a grid with holes: a missing neighbour is missing, whatever lies behind it."""

    def along(p, o):
        a, b = (f"first_value(value) OVER (PARTITION BY grid_id, {p} ORDER BY {o} RANGE BETWEEN 1 {x} AND 1 {x})" for x in ("FOLLOWING", "PRECEDING"))
        return f"coalesce(({a} - {b}) / 2, {a} - value, value - {b}, 0)"

    return f"SELECT grid_id, row, col, {along('row', 'col')} AS dx, {along('col', 'row')} AS dy FROM ({src})"


def _holes(spark, d):
    return fx.cells(spark, d, 50).where("abs(value) > 0.02")


@query("grid_gradient_holes", sq(_gap(_HOLES), KEY, "dx dy"))
def grid_gradient_holes(spark, d):
    return rounded(g.gradient(_holes(spark, d)).select(*g.CELL, "dx", "dy"))


@query("grid_slope_percent", sq(f"SELECT grid_id, row, col, sqrt(dx * dx + dy * dy) * 100 AS slope FROM ({_gap(_HOLES)})", KEY, "slope"))
def grid_slope_percent(spark, d):
    return rounded(g.slope(_holes(spark, d), units="percent"))


def _near(src: str) -> str:
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    named = [(g._name(s), s) for s in steps]
    joins = " ".join(f"LEFT JOIN src {n} ON {n}.grid_id = s.grid_id AND {n}.row = s.row + ({a}) AND {n}.col = s.col + ({b})" for n, (a, b) in named)
    return f"WITH src AS ({src}) SELECT s.*, {', '.join(f'{n}.value AS {n}' for n, _ in named)} FROM src s {joins}"


def _focal(src: str, k: int) -> str:
    return f"""SELECT a.grid_id, a.row, a.col, any_value(a.value) AS value, sum(b.value) AS f_sum, count(b.value) AS f_n, avg(b.value) AS f_mean, min(b.value) AS f_min, max(b.value) AS f_max,
  stddev_pop(b.value) AS f_std FROM ({src}) a JOIN ({src}) b ON a.grid_id = b.grid_id AND b.row BETWEEN a.row - {k} AND a.row + {k} AND b.col BETWEEN a.col - {k} AND a.col + {k} GROUP BY 1, 2, 3"""


@query("grid_gradient", sq(_grad(C), KEY, "value dx dy"))
def grid_gradient(spark, d):
    return rounded(g.gradient(fx.cells(spark, d)))


@query("grid_slope", sq(f"SELECT grid_id, row, col, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM ({_grad(C)})", KEY, "slope"))
def grid_slope(spark, d):
    return rounded(g.slope(fx.cells(spark, d)))


@query("grid_aspect", sq(f"SELECT grid_id, row, col, CASE WHEN atan2(-dx, dy) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END AS aspect FROM ({_grad(C)})", KEY, "aspect"))
def grid_aspect(spark, d):
    return rounded(g.aspect(fx.cells(spark, d)))


_CURV = f"""SELECT grid_id, row, col, CASE WHEN k >= 1e-10 THEN -(r * p * p + 2 * s * p * q + t * q * q) / (k * (1 + k) ** 1.5) ELSE 0 END AS profile,
  CASE WHEN k >= 1e-10 THEN -(r * q * q - 2 * s * p * q + t * p * p) / k ** 1.5 ELSE 0 END AS planform,
  -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * (1 + k) ** 1.5) AS mean, (r * t - s * s) / (1 + k) ** 2 AS gaussian
FROM (SELECT *, dx AS p, dy AS q, dxx AS r, dxy AS s, dyy AS t, dx * dx + dy * dy AS k FROM ({_grad(_grad(_grad(C), 'dx', 'dxx', 'dxy'), 'dy', 'dyx', 'dyy')}))"""


@query("grid_curvature", f"SELECT grid_id, row, col, {', '.join(f'round({c}, 4) + 0.0::DOUBLE AS {c}' for c in ('profile', 'planform', 'mean', 'gaussian'))} FROM ({_CURV})")
def grid_curvature(spark, d):
    return rounded(g.curvature(fx.cells(spark, d)), 4)


@query("grid_focal", sq(_focal(G, 2), KEY + " f_n", "f_mean f_min f_max f_std"))
def grid_focal(spark, d):
    return rounded(g.focal(fx.cells(spark, d, 50), 2).select("grid_id", "row", "col", "f_n", "f_mean", "f_min", "f_max", "f_std"))


_REFLECT = """SELECT grid_id, r.row, c.col, value FROM (SELECT *, max(row) OVER (PARTITION BY grid_id) + 1 AS nr, max(col) OVER (PARTITION BY grid_id) + 1 AS nc FROM ({src})) x,
  LATERAL (SELECT unnest([x.row, CASE WHEN x.row < {k} THEN -1 - x.row END, CASE WHEN x.row >= nr - {k} THEN 2 * nr - 1 - x.row END]) AS row) r,
  LATERAL (SELECT unnest([x.col, CASE WHEN x.col < {k} THEN -1 - x.col END, CASE WHEN x.col >= nc - {k} THEN 2 * nc - 1 - x.col END]) AS col) c WHERE r.row IS NOT NULL AND c.col IS NOT NULL"""


def _smooth(src: str, sigma: float) -> str:
    k = int(4 * sigma + 0.5)
    return f"""WITH x AS ({_REFLECT.format(src=src, k=k)}), w AS (SELECT i, exp(-0.5 * (i / {sigma}::DOUBLE) ** 2) AS w FROM (SELECT unnest(range(-{k}, {k} + 1)) AS i)),
n AS (SELECT i, w / sum(w) OVER () AS w FROM w), a AS (SELECT x.grid_id, x.row, (x.col + i)::INT AS col, sum(w * value) AS value FROM x, n GROUP BY 1, 2, 3),
b AS (SELECT a.grid_id, (a.row + i)::INT AS row, a.col, sum(w * value) AS value FROM a, n GROUP BY 1, 2, 3)
SELECT b.* FROM b JOIN (SELECT grid_id, row, col FROM ({src})) s USING (grid_id, row, col)"""


@query("grid_gaussian", sq(_smooth(G, 1.0), KEY, "value"))
def grid_gaussian(spark, d):
    return rounded(g.gaussian(fx.cells(spark, d, 50), 1.0))


@query("grid_curvature_smoothed", f"SELECT grid_id, row, col, {', '.join(f'round({c}, 4) + 0.0::DOUBLE AS {c}' for c in ('profile', 'planform', 'mean', 'gaussian'))} FROM ({_CURV.replace(C, _smooth(C, 0.5))})")
def grid_curvature_smoothed(spark, d):
    """Curvature with the smoothing that comes before it; ``grid_curvature`` leaves it out, as its SQL does."""
    return rounded(g.curvature(fx.cells(spark, d), sigma=0.5), 4)


@query("grid_tpi", sq(f"SELECT grid_id, row, col, value - (f_sum - value) / (f_n - 1) AS tpi FROM ({_focal(G, 1)})", KEY, "tpi"))
def grid_tpi(spark, d):
    return rounded(g.tpi(fx.cells(spark, d, 50), 1))


_N = [g._name(s) for s in g.D8]
_NEAR_COUNT = f"SELECT grid_id, row, col, {' + '.join(f'({n} IS NOT NULL)::INT' for n in _N)} AS around, {' + '.join(f'coalesce({n}, 0)' for n in _N)} AS total FROM ({_near(_HOLES)})"


@query("grid_neighbours_holes", sq(_NEAR_COUNT, KEY + " around", "total"))
def grid_neighbours_holes(spark, d):
    """How many of the eight neighbours are there in a grid with holes, and their sum."""
    x = g.neighbours(_holes(spark, d))
    around = sum((F.col(n).isNotNull().cast("int") for n in _N), F.lit(0))
    return rounded(x.select(*g.CELL, around.alias("around"), sum((F.coalesce(n, F.lit(0.0)) for n in _N), F.lit(0.0)).alias("total")))


_TRI = f"""SELECT grid_id, row, col, abs(8 * value - ({' + '.join(f'coalesce({n}, 0)' for n in _N)})) AS tri_sum,
  ({' + '.join(f'coalesce(abs({n} - value), 0)' for n in _N)}) / ({' + '.join(f'({n} IS NOT NULL)::INT' for n in _N)} + 1) AS tri_mean FROM ({_near(G)})"""


@query("grid_ruggedness", sq(_TRI, KEY, "tri_sum tri_mean"))
def grid_ruggedness(spark, d):
    return rounded(g.ruggedness(fx.cells(spark, d, 50)))


_DROPS = [f"(value - {g._name(s)}) / {'sqrt(2)' if 0 not in s else '1'}" for s in g.D8]
_D8 = f"""WITH n AS ({_near(G)}), d AS (SELECT *, greatest({', '.join(_DROPS)}) AS best, {' AND '.join(f'{n} IS NOT NULL' for n in _N)} AS whole FROM n)
SELECT grid_id, row, col, CASE WHEN NOT whole THEN 0 {' '.join(f'WHEN {e} = best THEN {c}' for e, c in zip(_DROPS, g.D8.values(), strict=True))} ELSE 0 END AS direction, CASE WHEN whole THEN best END AS steepest FROM d"""


@query("grid_d8", sq(_D8, KEY + " direction", "steepest"))
def grid_d8(spark, d):
    return rounded(g.d8(fx.cells(spark, d, 50)))


@query("grid_sinks", sq(f"SELECT * FROM ({_near(G)}) WHERE {' AND '.join(f'value < {n}' for n in _N)}", KEY, "value"))
def grid_sinks(spark, d):
    return rounded(g.sinks(fx.cells(spark, d, 50)))


_WET = f"""SELECT grid_id, row, col, ln(greatest(area, 1e-6) / greatest(tan(slope), 1e-6)) AS twi, area * tan(slope) AS spi
  FROM (SELECT grid_id, row, col, abs(value) * 1000 + 1 AS area, atan(sqrt(dx * dx + dy * dy)) AS slope FROM ({_grad(C)}))"""


@query("grid_wetness", sq(_WET, KEY, "twi spi"))
def grid_wetness(spark, d):
    cells = fx.cells(spark, d)
    wide = g.slope(cells, 1.0, "radians").join(cells.withColumn("area", F.abs("value") * 1000 + 1), g.CELL)
    return rounded(g.wetness(wide).select(*g.CELL, "twi", "spi"))


def _wet(spark, d):
    return fx.cells(spark, d, 50).where("value > 0").select(*g.CELL)


_E = f"SELECT grid_id, row, col FROM ({G}) WHERE value > 0"
_CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) s(a, b)"
_DIL = "SELECT DISTINCT grid_id, (row + a)::INT AS row, (col + b)::INT AS col FROM ({e}), " + _CROSS
_ERO = "SELECT grid_id, (row + a)::INT AS row, (col + b)::INT AS col FROM ({e}), " + _CROSS + " GROUP BY 1, 2, 3 HAVING count(*) = 5"


@query("grid_dilate", _DIL.format(e=_E))
def grid_dilate(spark, d):
    return g.dilate(_wet(spark, d))


@query("grid_closing", _ERO.format(e=_DIL.format(e=_E)))
def grid_closing(spark, d):
    return g.closing(_wet(spark, d))


@query("grid_opening", _DIL.format(e=_ERO.format(e=_E)))
def grid_opening(spark, d):
    return g.opening(_wet(spark, d))


_STAT = f"""SELECT grid_id, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, avg((value - m) ** 3) / pow(avg((value - m) ** 2), 1.5) AS skew, kurtosis_pop(value) AS kurtosis
  FROM (SELECT *, avg(value) OVER (PARTITION BY grid_id) AS m FROM ({G})) GROUP BY 1"""


@query("agg_grid_statistics", sq(_STAT, "grid_id n", "mean std low high median q25 q75 skew kurtosis"))
def agg_grid_statistics(spark, d):
    return rounded(g.statistics(fx.cells(spark, d, 50)))


_COV = f"""SELECT grid_id, count(v) AS valid, count(v) / count(*) AS share, min(row) FILTER (v IS NOT NULL) AS row_min, max(row) FILTER (v IS NOT NULL) AS row_max,
  min(col) FILTER (v IS NOT NULL) AS col_min, max(col) FILTER (v IS NOT NULL) AS col_max FROM (SELECT *, CASE WHEN value > 0.1 THEN value END AS v FROM ({G})) GROUP BY 1"""


@query("agg_grid_coverage", sq(_COV, "grid_id valid row_min row_max col_min col_max", "share"))
def agg_grid_coverage(spark, d):
    return rounded(g.coverage(fx.cells(spark, d, 50).withColumn("value", F.when(F.col("value") > 0.1, F.col("value")))))


@query("prj_clip_bbox", f"SELECT grid_id, (row - 5)::INT AS row, (col - 8)::INT AS col, value FROM ({G}) WHERE row >= 5 AND row < 25 AND col >= 8 AND col < 40")
def prj_clip_bbox(spark, d):
    return g.clip(fx.cells(spark, d, 50), 5, 25, 8, 40)


_RES = f"""WITH g AS ({G}), e AS (SELECT grid_id, max(row) + 1 AS nr, max(col) + 1 AS nc FROM g GROUP BY 1),
t AS (SELECT grid_id, r.row, c.col, (r.row + 0.5) * 1.5 - 0.5 AS y, (c.col + 0.5) * 1.5 - 0.5 AS x FROM e, LATERAL (SELECT unnest(range(0, floor(nr / 1.5)::INT))::INT AS row) r, LATERAL (SELECT unnest(range(0, floor(nc / 1.5)::INT))::INT AS col) c),
n AS (SELECT t.grid_id, t.row, t.col, floor(y) + a AS r2, floor(x) + b AS c2, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(a, b))
SELECT n.grid_id, n.row, n.col, CASE WHEN count(g.value) = count(*) THEN sum(w * g.value) END AS value FROM n LEFT JOIN g ON g.grid_id = n.grid_id AND g.row = r2 AND g.col = c2 WHERE w > 0 GROUP BY 1, 2, 3"""


@query("join_resample", sq(_RES, KEY, "value"))
def join_resample(spark, d):
    return rounded(g.resample(fx.cells(spark, d, 50), 1.5))


_A, _B = f"SELECT * FROM ({G})", f"SELECT grid_id, (row + grid_id % 3)::INT AS row, (col + grid_id % 5)::INT AS col, value * 2 AS value FROM ({G})"


def _two(spark, d):
    """All cells, and doubled ones in grids that lie a little further, each by its own number."""
    cells = fx.cells(spark, d, 50)
    moved = lambda c, n: (F.col(c) + F.col("grid_id") % n).cast("int").alias(c)
    return cells, cells.select("grid_id", moved("row", 3), moved("col", 5), (F.col("value") * 2).alias("value"))


@query("join_align_crop", f"SELECT grid_id, row, col, a.value AS value_a, b.value AS value_b FROM ({_A}) a JOIN ({_B}) b USING (grid_id, row, col)")
def join_align_crop(spark, d):
    return g.align_crop(*_two(spark, d))


@query("join_align_pad", f"SELECT grid_id, row, col, a.value AS value_a, b.value AS value_b FROM ({_A}) a FULL JOIN ({_B}) b USING (grid_id, row, col)")
def join_align_pad(spark, d):
    return g.align_pad(*_two(spark, d))


_MOVED = f"SELECT grid_id, (row + 5)::INT AS row, (col + 7)::INT AS col, value FROM ({G})"


def _moved(spark, d):
    """All cells twice, the second time in a grid that lies 5 rows and 7 columns further."""
    cells = fx.cells(spark, d, 50)
    return cells, cells.withColumns({"row": F.col("row") + 5, "col": F.col("col") + 7})


@query("join_align_crop_moved", f"SELECT grid_id, row, col, a.value AS value_a, b.value AS value_b FROM ({G}) a JOIN ({_MOVED}) b USING (grid_id, row, col)")
def join_align_crop_moved(spark, d):
    return g.align_crop(*_moved(spark, d))


@query("join_align_pad_moved", f"SELECT grid_id, row, col, a.value AS value_a, b.value AS value_b FROM ({G}) a FULL JOIN ({_MOVED}) b USING (grid_id, row, col)")
def join_align_pad_moved(spark, d):
    return g.align_pad(*_moved(spark, d))


def _out(col: str):
    return ["grid_id", "row", "col", col]


@query("norm_zscore", sq(f"SELECT grid_id, row, col, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM ({G}) WINDOW w AS (PARTITION BY grid_id)", KEY, "z"))
def norm_zscore(spark, d):
    return rounded(g.zscore(fx.cells(spark, d, 50)).select(_out("z")))


_MAD = f"""WITH m AS (SELECT *, median(value) OVER (PARTITION BY grid_id) AS med FROM ({G})), x AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY grid_id) AS mad FROM m)
SELECT grid_id, row, col, (value - med) / (mad / 0.67449) AS z FROM x"""


@query("norm_zscore_robust", sq(_MAD, KEY, "z"))
def norm_zscore_robust(spark, d):
    return rounded(g.zscore_robust(fx.cells(spark, d, 50)).select(_out("z")))


_MM = f"SELECT grid_id, row, col, (value - a) / (b - a) * 2 - 1 AS scaled FROM (SELECT *, quantile_cont(value, 0.02) OVER w AS a, quantile_cont(value, 0.98) OVER w AS b FROM ({G}) WINDOW w AS (PARTITION BY grid_id))"


@query("norm_minmax", sq(_MM, KEY, "scaled"))
def norm_minmax(spark, d):
    return rounded(g.minmax(fx.cells(spark, d, 50), -1.0, 1.0, (0.02, 0.98)).select(_out("scaled")))


_Q = f"""WITH g AS ({G}), q AS (SELECT grid_id, quantile_cont(value, [{', '.join(str(i / 19) for i in range(20))}]) AS refs FROM g GROUP BY 1)
SELECT grid_id, row, col, len(list_filter(refs, lambda r: r < value)) / 20 AS quantile FROM g JOIN q USING (grid_id)"""


@query("norm_quantile", sq(_Q, KEY, "quantile"))
def norm_quantile(spark, d):
    return rounded(g.quantile_rank(fx.cells(spark, d, 50), 20).select(_out("quantile")))


_LOG = f"WITH l AS (SELECT *, ln(value - min(value) OVER (PARTITION BY grid_id) + 1) AS v FROM ({G})) SELECT grid_id, row, col, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM l WINDOW w AS (PARTITION BY grid_id)"


@query("norm_log", sq(_LOG, KEY, "z"))
def norm_log(spark, d):
    return rounded(g.log_normalize(fx.cells(spark, d, 50)).select(_out("z")))


_LOC = f"SELECT grid_id, row, col, (value - f_mean) / f_std AS local_z, (value - f_min) / (f_max - f_min) AS local_minmax FROM ({_focal(G, 2)})"


@query("norm_local", sq(_LOC, KEY, "local_z local_minmax"))
def norm_local(spark, d):
    return rounded(g.local_normalize(fx.cells(spark, d, 50), 2))


_LOCR = f"""SELECT a.grid_id, a.row, a.col, (a.value - avg(b.value)) / greatest(stddev_pop(b.value), 1e-8) AS local_z, (a.value - min(b.value)) / greatest(max(b.value) - min(b.value), 1e-8) AS local_minmax
  FROM ({G}) a JOIN ({_REFLECT.format(src=G, k=2)}) b ON a.grid_id = b.grid_id AND b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY a.grid_id, a.row, a.col, a.value"""


@query("norm_local_reflect", sq(_LOCR, KEY, "local_z local_minmax"))
def norm_local_reflect(spark, d):
    """Windows mirrored at the border; ``norm_local`` cuts them there."""
    return rounded(g.local_normalize(fx.cells(spark, d, 50), 2, "reflect"))


_META = f"SELECT grid_id, max(row) + 1 AS nrows, max(col) + 1 AS ncols FROM ({G}) GROUP BY 1"
_PATCH = f"""SELECT grid_id || '_' || size || '_' || row0 || '_' || col0 AS tile_id, grid_id, size, row0, col0 FROM ({_META}), (VALUES (16, 12), (8, 6)) s(size, step),
  LATERAL (SELECT unnest(range(0, nrows - size + 1, step))::INT AS row0) a, LATERAL (SELECT unnest(range(0, ncols - size + 1, step))::INT AS col0) b WHERE nrows >= size AND ncols >= size"""


@query("tile_patches", _PATCH)
def tile_patches(spark, d):
    meta = fx.cells(spark, d, 50).groupBy("grid_id").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))
    return g.patches(meta, [16, 8], 0.25)


_ASSIGN = f"""SELECT grid_id, row0, col0, count(v) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high FROM (SELECT *, CASE WHEN value > -0.1 THEN value END AS v FROM ({G})) c
  JOIN (SELECT a.r::BIGINT AS row0, b.c::BIGINT AS col0 FROM (SELECT unnest(range(0, 35, 12)) AS r) a, (SELECT unnest(range(0, 49, 12)) AS c) b) t ON c.row BETWEEN row0 AND row0 + 15 AND c.col BETWEEN col0 AND col0 + 15
  GROUP BY 1, 2, 3 HAVING count(v) >= 0.8 * 256"""


@query("tile_assign_cells", sq(_ASSIGN, "grid_id row0 col0 n", "mean low high"))
def tile_assign_cells(spark, d):
    cells = fx.cells(spark, d, 50).withColumn("value", F.when(F.col("value") > -0.1, F.col("value")))
    return rounded(g.assign_cells(cells, 16, 12, 50, 64, 0.8))


_TC = f"""SELECT c.grid_id, row0, col0, (c.row - row0)::INT AS r, (c.col - col0)::INT AS c, value FROM ({G}) c JOIN
  (SELECT a.r AS row0, b.c AS col0 FROM (SELECT unnest(range(0, 35, 12)) AS r) a, (SELECT unnest(range(0, 49, 12)) AS c) b) t ON c.row BETWEEN row0 AND row0 + 15 AND c.col BETWEEN col0 AND col0 + 15"""
_BLEND = f"SELECT grid_id, (row0 + r)::INT AS row, (col0 + c)::INT AS col, sum(value * w) / sum(w) AS value FROM (SELECT *, least((least(r, c, 15 - r, 15 - c) + 1) / 4, 1) AS w FROM ({_TC})) GROUP BY 1, 2, 3"


@query("agg_blend_tiles", sq(_BLEND, KEY, "value"))
def agg_blend_tiles(spark, d):
    at = lambda c, n: F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 16), F.lit(12)), lambda s: (F.col(c) >= s) & (F.col(c) < s + 16)))
    tiles = fx.cells(spark, d, 50).withColumn("row0", at("row", 50)).withColumn("col0", at("col", 64))
    tiles = tiles.withColumn("r", F.col("row") - F.col("row0")).withColumn("c", F.col("col") - F.col("col0"))
    return rounded(g.blend_tiles(tiles, 16, 4))


_OWN = f"SELECT * EXCLUDE (value), value - avg(value) OVER (PARTITION BY grid_id, row0, col0) AS value FROM ({_TC})"
_BLEND_ALL = f"SELECT grid_id, row, col, coalesce(b.value, 0) AS value FROM ({G}) c LEFT JOIN ({_BLEND.replace(_TC, _OWN)}) b USING (grid_id, row, col)"


@query("agg_blend_all_cells", sq(_BLEND_ALL, KEY, "value"))
def agg_blend_all_cells(spark, d):
    """Tiles that differ where they overlap (less each tile's mean), blended over every cell; ``agg_blend_tiles`` has covered cells alone, as its SQL does."""
    at = lambda c, n: F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 16), F.lit(12)), lambda s: (F.col(c) >= s) & (F.col(c) < s + 16)))
    cells = fx.cells(spark, d, 50)
    tiles = cells.withColumn("row0", at("row", 50)).withColumn("col0", at("col", 64))
    means = tiles.groupBy("grid_id", "row0", "col0").agg(F.avg("value").alias("mean"))
    tiles = tiles.join(means, ["grid_id", "row0", "col0"]).withColumn("value", F.col("value") - F.col("mean"))
    tiles = tiles.withColumn("r", F.col("row") - F.col("row0")).withColumn("c", F.col("col") - F.col("col0"))
    return rounded(g.blend_tiles(tiles, 16, 4, cells))


_AUG_ALL = f"""WITH g AS ({G}), e AS (SELECT grid_id, max(row) + 1 AS nr, max(col) + 1 AS nc FROM g GROUP BY 1),
t AS (SELECT grid_id, row - row % 16 AS row0, col - col % 16 AS col0, row % 16 AS y, col % 16 AS x, least(16, nr - row + row % 16) - 1 AS m, least(16, nc - col + col % 16) - 1 AS n, value FROM g JOIN e USING (grid_id))
SELECT grid_id, row0::INT AS row0, col0::INT AS col0, variant, r::INT AS r, c::INT AS c, value FROM (SELECT grid_id, row0, col0, value, unnest([{{'variant': 'identity', 'r': y, 'c': x}}, {{'variant': 'flip_lr', 'r': y, 'c': n - x}}, {{'variant': 'flip_ud', 'r': m - y, 'c': x}}, {{'variant': 'rot90', 'r': n - x, 'c': y}}, {{'variant': 'rot180', 'r': m - y, 'c': n - x}}, {{'variant': 'rot270', 'r': x, 'c': m - y}}], recursive := true) FROM t)"""


@query("prj_augment_all_tiles", _AUG_ALL)
def prj_augment_all_tiles(spark, d):
    """Every tile of every grid, those at the far edges cut short."""
    return g.augment_grid(fx.cells(spark, d, 50), 16)


_ROWS16 = f"SELECT row // 16 AS grid_id, (row % 16)::INT AS row, col, value FROM ({fx.SQL_CELLS})"


@query("prj_augment_tiles", _AUG_ALL.replace(G, _ROWS16))
def prj_augment_tiles(spark, d):
    """All cells as grids of 16 rows, so that tiles are whole but for the last grid's."""
    return g.augment_grid(fx.cells(spark, d, 16), 16)


_ENS = f"SELECT row, col, avg(value) AS mean, stddev_pop(value) AS spread, count(*) FILTER (value > 0.05) / count(value) AS exceedance, count(value) AS members FROM ({G}) GROUP BY 1, 2"


@query("agg_ensemble", sq(_ENS, "row col members", "mean spread exceedance"))
def agg_ensemble(spark, d):
    return rounded(g.ensemble(fx.cells(spark, d, 50), 0.05))
