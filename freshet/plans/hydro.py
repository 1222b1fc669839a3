"""Queries of the connectivity, flow and drainage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import hydrology as h
from ..sources import fixtures as fx
from .grids import _CROSS, _CURV, _D8, _DIL, _ERO, _REFLECT, _focal, _grad, _near, _smooth
from .metrics import sq
from .registry import query, rounded

G, KEY = fx.SQL_GRIDS, "grid_id row col"
WET = f"SELECT grid_id, row, col FROM ({G}) WHERE value > 0.05"
STREAM = f"SELECT grid_id, row, col, value FROM ({G}) WHERE value > 0.25"


def _cells(spark, d):
    return fx.cells(spark, d, 50)


def _wet(spark, d):
    return _cells(spark, d).where("value > 0.05").select(*g.CELL)


def _stream(spark, d):
    return _cells(spark, d).where("value > 0.25").select(*g.CELL)


def _comp(wet: str) -> str:
    return f"""WITH RECURSIVE e AS ({wet}), reach AS (SELECT grid_id, row, col, row AS r, col AS c FROM e UNION SELECT x.grid_id, x.row, x.col, e.row, e.col FROM reach x, {_CROSS}, e WHERE e.grid_id = x.grid_id AND e.row = x.r + s.a AND e.col = x.c + s.b)
  SELECT grid_id, row, col, min(r::BIGINT * 2147483648 + c) AS component FROM reach GROUP BY 1, 2, 3"""


@query("grid_components", _comp(WET))
def grid_components(spark, d):
    return h.components(_wet(spark, d))


_SMALL = f"SELECT grid_id, row, col FROM (SELECT *, count(*) OVER (PARTITION BY grid_id, component) AS n FROM ({_comp(WET)})) WHERE n >= 4"


@query("grid_drop_small", _SMALL)
def grid_drop_small(spark, d):
    return h.drop_small(_wet(spark, d), 4)


@query("grid_flood_extent", _ERO.format(e=_DIL.format(e=_SMALL)))
def grid_flood_extent(spark, d):
    return h.flood_extent(_cells(spark, d).where("value > 0.05"), 0.05, 4)


_SIZES = f"SELECT grid_id, component, count(*) AS n, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max FROM ({_comp(WET)}) GROUP BY 1, 2"


@query("grid_extent_continuity", sq(f"SELECT grid_id, count(*) AS components, sum(n)::BIGINT AS cells, max(n) / sum(n) AS largest_share, count(*) FILTER (n < 10) / count(*) AS small_share, avg(n) AS mean_size, max(n) AS max_size, min(n) AS min_size FROM ({_SIZES}) GROUP BY 1", "grid_id components cells max_size min_size", "largest_share small_share mean_size"))
def grid_extent_continuity(spark, d):
    return rounded(h.extent_continuity(_wet(spark, d)))


@query("grid_extent_features", f"SELECT grid_id, component, row_min, row_max, col_min, col_max, n AS cells, n * 100.0::DOUBLE AS area FROM ({_SIZES})")
def grid_extent_features(spark, d):
    return h.extent_features(_wet(spark, d), 100.0)


_TO = f"""SELECT grid_id, row, col, CASE WHEN steepest > 0 THEN row + CASE direction {' '.join(f'WHEN {c} THEN {s[0]}' for s, c in g.D8.items())} END END AS r2,
  CASE WHEN steepest > 0 THEN col + CASE direction {' '.join(f'WHEN {c} THEN {s[1]}' for s, c in g.D8.items())} END END AS c2 FROM ({_D8})"""
_ACC = f"""WITH RECURSIVE t AS ({_TO}), path AS (SELECT grid_id, row, col, r2, c2 FROM t UNION ALL SELECT t.grid_id, t.row, t.col, t.r2, t.c2 FROM path p JOIN t ON t.grid_id = p.grid_id AND t.row = p.r2 AND t.col = p.c2)
  SELECT grid_id, row, col, count(*) AS cells FROM path GROUP BY 1, 2, 3"""


@query("grid_flow_accumulation", _ACC)
def grid_flow_accumulation(spark, d):
    return h.flow_accumulation(g.d8(_cells(spark, d)))


@query("grid_streams", f"SELECT grid_id, row, col FROM (SELECT *, count(*) OVER (PARTITION BY grid_id, component) AS n FROM ({_comp(f'SELECT grid_id, row, col FROM ({_ACC}) WHERE cells >= 5')})) WHERE n >= 2")
def grid_streams(spark, d):
    return h.streams(h.flow_accumulation(g.d8(_cells(spark, d))), 5, 2)


@query("grid_burn_streams", sq(f"SELECT grid_id, row, col, value - CASE WHEN value > 0.25 THEN 0.5 ELSE 0 END AS value FROM ({G})", KEY, "value"))
def grid_burn_streams(spark, d):
    return rounded(h.burn_streams(_cells(spark, d), _stream(spark, d), 0.5))


_S2 = f"SELECT grid_id, row, col FROM ({STREAM})"
_BUF = _DIL.format(e=_DIL.format(e=_S2))


@query("grid_burn_smoothed", sq(f"SELECT grid_id, row, col, CASE WHEN b.wet THEN s.value ELSE c.value END AS value FROM ({G}) c JOIN ({_smooth(G, 0.5)}) s USING (grid_id, row, col) LEFT JOIN (SELECT *, true AS wet FROM ({_BUF})) b USING (grid_id, row, col)", KEY, "value"))
def grid_burn_smoothed(spark, d):
    return rounded(h.burn_smoothed(_cells(spark, d), _stream(spark, d), 2, 0.5))


_PAIR = f"""SELECT c.grid_id, c.row, c.col, c.value, s.row AS sr, s.col AS sc, s.value AS sv, (c.row - s.row) ** 2 + (c.col - s.col) ** 2 AS d2, greatest(abs(c.row - s.row), abs(c.col - s.col)) AS k
  FROM ({G}) c LEFT JOIN ({STREAM}) s ON s.grid_id = c.grid_id"""


@query("grid_hand_least", sq(f"SELECT grid_id, row, col, min(value - sv) FILTER (d2 <= 36 AND value >= sv) AS hand FROM ({_PAIR}) GROUP BY 1, 2, 3", KEY, "hand"))
def grid_hand_least(spark, d):
    return rounded(h.hand_least(_cells(spark, d), _stream(spark, d), 6))


@query("grid_hand_nearest", sq(f"SELECT grid_id, row, col, greatest(value - (arg_min(sv, [k, d2, sr, sc]) FILTER (k BETWEEN 1 AND 6)), CASE WHEN count(*) FILTER (k BETWEEN 1 AND 6) > 0 THEN 0 END) AS hand FROM ({_PAIR}) GROUP BY 1, 2, 3, value", KEY, "hand"))
def grid_hand_nearest(spark, d):
    return rounded(h.hand_nearest(_cells(spark, d), _stream(spark, d), 6))


@query("grid_stream_distance", sq(f"SELECT grid_id, row, col, sqrt(min(d2)) * 10 AS distance FROM ({_PAIR}) GROUP BY 1, 2, 3", KEY, "distance"))
def grid_stream_distance(spark, d):
    return rounded(h.stream_distance(_cells(spark, d), _stream(spark, d), 10.0))


_PROXY = f"""WITH f AS (SELECT grid_id, row, col, log10(abs(value) + 1) AS flow FROM ({_smooth(f'SELECT grid_id, row, col, -value AS value FROM ({G})', 1.0)})),
q AS (SELECT grid_id, quantile_cont(flow, 0.05) AS cut FROM f GROUP BY 1)
SELECT grid_id, row, col, flow, flow < cut AS stream, greatest(value - f_min, 0) AS height FROM f JOIN q USING (grid_id) JOIN ({_focal(G, 3)}) USING (grid_id, row, col)"""


@query("grid_drainage_proxy", sq(_PROXY, KEY + " stream", "flow height"))
def grid_drainage_proxy(spark, d):
    return rounded(h.drainage_proxy(_cells(spark, d), 1.0, 3))


_REL = f"""SELECT a.grid_id, a.row, a.col, (a.value - a.f_min) / (a.f_max - a.f_min) AS relative_elevation, (a.value - b.f_min) / (b.f_max - b.f_min) AS slope_position, (a.value - a.f_mean) / a.f_std AS contrast
  FROM ({_focal(G, 4)}) a JOIN ({_focal(G, 7)}) b USING (grid_id, row, col)"""


@query("grid_relative_features", sq(_REL, KEY, "relative_elevation slope_position contrast"))
def grid_relative_features(spark, d):
    return rounded(h.relative_features(_cells(spark, d)))


_BANDS = {"elevation": "200 + value * 100", "slope": "abs(value) * 30", "twi": "5 + value * 10", "hand": "abs(value) * 4", "flow": "floor(abs(value) * 1000)", "roughness": "abs(value) + 0.1"}


def _around(expr: str, k: int, name: str, what: str) -> str:
    src = f"SELECT grid_id, row, col, {expr} AS value FROM ({G})"
    return f"""SELECT a.grid_id, a.row, a.col, {what} AS {name} FROM ({src}) a JOIN ({_REFLECT.format(src=src, k=k)}) b ON a.grid_id = b.grid_id
      AND b.row BETWEEN a.row - {k} AND a.row + {k} AND b.col BETWEEN a.col - {k} AND a.col + {k} GROUP BY 1, 2, 3"""


_MEANS = {b: (f"ln({_BANDS[b]} + 1)" if b == "flow" else _BANDS[b]) for b in ("slope", "twi", "flow", "roughness")}
_CON = f"""SELECT grid_id, row, col, {', '.join(f'({e} - m_{b}) / (m_{b} + 1e-8) AS {"slope_position" if b == "slope" else b + "_contrast"}' for b, e in _MEANS.items())},
  ({_BANDS['elevation']} - lo) / greatest(hi - lo, 1e-8) AS relative_elevation, {_BANDS['hand']} / greatest(hi - lo, 1e-8) AS normalized_hand FROM ({G})
  {' '.join(f'JOIN ({_around(e, 4, f"m_{b}", "avg(b.value)")}) USING (grid_id, row, col)' for b, e in _MEANS.items())}
  JOIN ({_around(_BANDS['elevation'], 7, 'lo', 'min(b.value) AS lo, max(b.value)').replace('AS lo FROM', 'AS hi FROM')}) USING (grid_id, row, col)"""


@query("grid_contrast_features", sq(_CON, KEY, "slope_position twi_contrast flow_contrast roughness_contrast relative_elevation normalized_hand", 5))
def grid_contrast_features(spark, d):
    wide = _cells(spark, d).select(*g.CELL, *[F.expr(e).cast("double").alias(b) for b, e in _BANDS.items()])
    return rounded(g.contrast_features(wide), 5)


_TRI5 = f"""SELECT a.grid_id, a.row, a.col, avg(abs(b.value - a.value)) AS tri FROM ({G}) a JOIN ({G}) b ON a.grid_id = b.grid_id AND b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3"""


@query("grid_ruggedness_mean", sq(_TRI5, KEY, "tri"))
def grid_ruggedness_mean(spark, d):
    return rounded(g.ruggedness_mean(_cells(spark, d), 2))


@query("grid_wetness_cells", sq(f"SELECT grid_id, row, col, ln((cells + 1) * 10 / tan(greatest(atan(sqrt(dx * dx + dy * dy)), 0.001))) AS twi FROM ({_ACC}) JOIN ({_grad(G)}) USING (grid_id, row, col)", KEY, "twi"))
def grid_wetness_cells(spark, d):
    """Wetness of counted upstream cells and the slope in radians."""
    cells = _cells(spark, d)
    wide = h.flow_accumulation(g.d8(cells)).join(g.slope(cells, 1.0, "radians"), g.CELL)
    return rounded(g.wetness_of_cells(wide, 10.0).select(*g.CELL, "twi"))


_ASP = f"SELECT grid_id, row, col, atan2(-dx, dy) AS a FROM ({_grad(G)})"
_SIN, _COS = (f"SELECT grid_id, row, col, {f}(a) AS value FROM ({_ASP})" for f in ("sin", "cos"))
_DIR = f"""SELECT grid_id, row, col, CASE WHEN abs(profile) > 1e-8 THEN planform / profile END AS curvature_ratio, sqrt(e.f_mean ** 2 + n.f_mean ** 2) AS aspect_uniformity
  FROM ({_CURV.replace(fx.SQL_CELLS, G)}) JOIN ({_focal(_SIN, 1)}) e USING (grid_id, row, col) JOIN ({_focal(_COS, 1)}) n USING (grid_id, row, col)"""


@query("grid_direction_features", f"SELECT grid_id, row, col, round(curvature_ratio, 2) + 0.0::DOUBLE AS curvature_ratio, round(aspect_uniformity, 6) + 0.0::DOUBLE AS aspect_uniformity FROM ({_DIR})")
def grid_direction_features(spark, d):
    got = h.direction_features(_cells(spark, d))
    return got.select(*g.CELL, *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("curvature_ratio", 2), ("aspect_uniformity", 6))])


@query("grid_constant", f"SELECT grid_id, row, col, 0.05::DOUBLE AS roughness, 5.0::DOUBLE AS infiltration FROM ({G})")
def grid_constant(spark, d):
    meta = _cells(spark, d).groupBy("grid_id").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))
    return h.constant_grid(meta, {"roughness": 0.05, "infiltration": 5.0})


@query("grid_mass_balance", sq("SELECT l_orderkey AS run_id, abs(sum(l_quantity) - sum(l_quantity * (1 - l_discount)) - sum(l_quantity * l_tax)) / sum(l_quantity) AS error FROM lineitem GROUP BY 1", "run_id", "error"))
def grid_mass_balance(spark, d):
    q = F.col("l_quantity")
    flows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), q.alias("inflow"), (q * (1 - F.col("l_discount"))).alias("outflow"), (q * F.col("l_tax")).alias("stored"))
    return rounded(h.mass_balance(flows))


def _sobel(src: str, along: int) -> str:
    w = {s: s[along] * (2 if 0 in s else 1) for s in g.D8}
    return f"SELECT grid_id, row, col, ({' + '.join(f'{g._name(s)} * ({v})' for s, v in w.items() if v)}) / 8 AS x FROM ({_near(src)})"


_RESID = f"""SELECT grid_id, avg((u.x + v.x - (abs(c.value) - 0.05)) ** 2) AS residual FROM ({G}) c JOIN ({_sobel(G, 1)}) u USING (grid_id, row, col)
  JOIN ({_sobel(f'SELECT grid_id, row, col, -value AS value FROM ({G})', 0)}) v USING (grid_id, row, col) GROUP BY 1"""


@query("grid_balance_residual", sq(_RESID, "grid_id", "residual"))
def grid_balance_residual(spark, d):
    v = F.col("value")
    wide = _cells(spark, d).select(*g.CELL, v.alias("u"), (-v).alias("v"), F.abs(v).alias("rain"), F.lit(0.05).alias("infiltration"))
    return rounded(h.balance_residual(wide))


_QUAL = f"""WITH s AS ({_comp(_S2)}), z AS (SELECT grid_id, max(n) / sum(n) AS connectivity FROM (SELECT grid_id, component, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT grid_id, max(value) - min(value) AS range, avg(value) AS mean, stddev_pop(value) AS std, count(*) FILTER ({' AND '.join(f'value < {g._name(s)}' for s in g.D8)}) AS sinks, any_value(connectivity) AS connectivity
  FROM ({_near(G)}) LEFT JOIN z USING (grid_id) GROUP BY 1"""


@query("grid_dem_quality", sq(_QUAL, "grid_id sinks", "range mean std connectivity"))
def grid_dem_quality(spark, d):
    return rounded(h.dem_quality(_cells(spark, d), _stream(spark, d)))


def _fill(src: str) -> str:
    """The lowest way out of every cell, relaxed until nothing falls: the newest level of a cell stands for it."""
    return f"""WITH RECURSIVE z AS ({src}), s(a, b) AS (VALUES {', '.join(f'({a}, {b})' for a, b in g.D8)}),
    near AS (SELECT z.grid_id, z.row, z.col, count(*) AS n FROM z, s JOIN z o ON o.grid_id = z.grid_id AND o.row = z.row + s.a AND o.col = z.col + s.b GROUP BY 1, 2, 3),
    steps AS (SELECT z.grid_id, z.row, z.col, z.value, z.row + s.a AS r2, z.col + s.b AS c2 FROM z, s),
    fill(grid_id, row, col, value) USING KEY (grid_id, row, col) AS (
      SELECT grid_id, row, col, value FROM z LEFT JOIN near USING (grid_id, row, col) WHERE coalesce(n, 0) < 8
      UNION
      SELECT t.grid_id, t.row, t.col, min(greatest(t.value, f.value)) AS value FROM fill f JOIN steps t ON t.grid_id = f.grid_id AND t.r2 = f.row AND t.c2 = f.col
        LEFT JOIN recurring.fill k ON k.grid_id = t.grid_id AND k.row = t.row AND k.col = t.col
        WHERE k.value IS NULL OR greatest(t.value, f.value) < k.value GROUP BY 1, 2, 3)
    SELECT grid_id, row, col, value FROM fill"""


@query("grid_fill_depressions", sq(_fill(G), KEY, "value"))
def grid_fill_depressions(spark, d):
    return rounded(h.fill_depressions(_cells(spark, d), 64))


#: A valley that winds through the one large grid of all vectors, so that water crosses every block; beside it, ground of two heights more.
_WINDING = "CASE WHEN row % 8 = 4 OR (col = CASE WHEN (row // 8) % 2 = 0 THEN 62 ELSE 1 END AND row % 8 <> 0) THEN value / 100 + col * 0.0001 ELSE value + 2 END"


@query("grid_fill_winding", sq(_fill(f"SELECT grid_id, row, col, {_WINDING} AS value FROM ({fx.SQL_CELLS})"), KEY, "value"))
def grid_fill_winding(spark, d):
    row, col, v = (F.col(c) for c in ("row", "col", "value"))
    turn = F.when(F.floor(row / 8) % 2 == 0, 62).otherwise(1)
    low = (row % 8 == 4) | ((col == turn) & (row % 8 != 0))
    winding = F.when(low, v / 100 + col * 0.0001).otherwise(v + 2)
    return rounded(h.fill_depressions(fx.cells(spark, d).withColumn("value", winding), 32))


_FAR = f"""WITH c AS ({fx.SQL_CELLS}), s AS (SELECT row AS sr, col AS sc FROM c WHERE value > 0.3),
  rows AS (SELECT DISTINCT sr FROM s), cols AS (SELECT DISTINCT col FROM c),
  line AS (SELECT sr, cols.col, min(abs(cols.col - sc)) AS d FROM cols, s GROUP BY 1, 2)
  SELECT grid_id, c.row, c.col, sqrt(min((c.row - sr) ** 2 + d ** 2)) AS distance FROM c LEFT JOIN line USING (col) GROUP BY 1, 2, 3"""


@query("grid_stream_distance_whole", sq(_FAR, KEY, "distance"))
def grid_stream_distance_whole(spark, d):
    whole = fx.cells(spark, d)
    return rounded(h.stream_distance(whole, whole.where("value > 0.3")))


@query("grid_synthetic_extent")
def grid_synthetic_extent(spark, d):
    return h.synthetic_extent(_cells(spark, d), 0.8)
