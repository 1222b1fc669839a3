"""Grid operators over every cell, the ragged edge too."""

from freshet.operators import grid as g


def cells(spark, rows, cols):
    return spark.createDataFrame([(1, r, c, float(r * 100 + c)) for r in range(rows) for c in range(cols)], "grid_id long, row int, col int, value double")


def test_augment_every_tile(spark):
    got = g.augment_grid(cells(spark, 5, 7), 4).collect()
    assert len(got) == 6 * 35
    whole = {(r["row0"] + r["r"], r["col0"] + r["c"]): r["value"] for r in got if r["variant"] == "identity"}
    assert whole == {(r, c): r * 100.0 + c for r in range(5) for c in range(7)}
    edge = {(r["r"], r["c"]): r["value"] for r in got if r["variant"] == "rot90" and (r["row0"], r["col0"]) == (4, 4)}
    assert edge == {(2, 0): 404.0, (1, 0): 405.0, (0, 0): 406.0}


def test_curvature_smooths_first(spark):
    grid = spark.createDataFrame([(1, r, c, float((r * 7 + c * 5) % 6)) for r in range(6) for c in range(6)], "grid_id long, row int, col int, value double")
    got = {(r["row"], r["col"]): r["mean"] for r in g.curvature(grid, sigma=0.5).collect()}
    want = {(r["row"], r["col"]): r["mean"] for r in g.curvature(g.gaussian(grid, 0.5)).collect()}
    rough = {(r["row"], r["col"]): r["mean"] for r in g.curvature(grid).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert any(abs(got[k] - rough[k]) > 1e-3 for k in want)


def test_blend_has_every_cell(spark):
    tiles = spark.createDataFrame([(1, o, 0, r, c, float(o + 1)) for o in (0, 2) for r in range(4) for c in range(4)], "grid_id long, row0 int, col0 int, r int, c int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in g.blend_tiles(tiles, 4, 2, cells(spark, 7, 4)).collect()}
    assert len(got) == 28 and all(got[6, c] == 0 for c in range(4))
    # row 2, col 1: weight 1 of the first tile (1.0), half of the second (3.0)
    assert abs(got[2, 1] - (1.0 * 1.0 + 3.0 * 0.5) / 1.5) < 1e-12
