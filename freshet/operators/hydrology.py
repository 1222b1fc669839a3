"""Connected extents, depressions, flow and drainage on cell tables ``grid_id, row, col, value``.

Loops keep each round as a table in the shared folder, so lineage stays short
and a lost executor costs one round.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Rounds
from . import grid as g
from .ranges import to_tasks, with_quantiles

CELL = g.CELL


def _jumped(labels: DataFrame) -> DataFrame:
    """Each node's label replaced by that label's own label."""
    up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def connected(edges: DataFrame, nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, label`` of every node: the smallest node that ``edges`` (a, b) lead to.

    Rounds of smallest neighbour and pointer jumps; a chain of n nodes takes
    about log n of them. ``most_rounds`` is a guard, which raises.
    """
    rounds = Rounds(edges.sparkSession, "connected")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    now = rounds.keep(nodes.select("node", F.col("node").alias("label")))
    both = rounds.keep(both)
    for _ in range(most_rounds):
        there = now.withColumnsRenamed({"node": "b", "label": "far"})
        near = both.join(there, "b").groupBy("a").agg(F.min("far").alias("low"))
        # the smaller label goes to the node's own label too, so that whole stars move at once
        seen = now.join(near, now["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("low"))
        told = seen.select("node", "low").unionByName(seen.select(F.col("label").alias("node"), "low"))
        told = told.groupBy("node").agg(F.min("low").alias("low"))
        lower = now.join(told, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"))
        after = rounds.keep(_jumped(_jumped(lower)))
        if after.join(now.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            return after
        now = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _pieces(frame: pd.DataFrame) -> pd.DataFrame:
    """The 4-neighbour components of one block, each named by its first cell: runs along rows, joined where those of two rows touch."""
    frame = frame.sort_values(["row", "col"], ignore_index=True)
    row, col = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)]))
    run = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(row)]])))
    low, high, at = col[first].tolist(), col[np.concatenate([first[1:], [len(row)]]) - 1].tolist(), row[first].tolist()
    up = list(range(len(first)))

    def top(k):
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    above, here = 0, 0  # runs of the row above that may still touch, and of this row
    while here < len(at):
        if at[above] < at[here] - 1 or (at[above] == at[here] - 1 and high[above] < low[here]):
            above += 1
        elif at[above] == at[here] - 1 and low[above] <= high[here]:
            x, y = top(above), top(here)
            up[max(x, y)] = min(x, y)
            if high[above] < high[here]:
                above += 1
            else:
                here += 1
        else:
            here += 1
    name = (row[first] * (1 << 31) + col[first])[[top(k) for k in range(len(up))]]
    return frame[["grid_id", "row", "col", "rim"]].assign(component=name[run])


def components(extent: DataFrame, block: int = 256) -> DataFrame:
    """``grid_id, row, col, component`` of wet cells; 4-neighbours are together. The component is its first cell as ``row * 2^31 + col``.

    Blocks are labelled in tasks; rounds run over the pieces that touch other
    blocks alone, so a lake inside a block costs none and a large one few rows.
    """
    rounds = Rounds(extent.sparkSession, "pieces")
    at = lambda c: F.floor(F.col(c) / block)
    on_rim = F.pmod("row", F.lit(block)).isin(0, block - 1) | F.pmod("col", F.lit(block)).isin(0, block - 1)
    cells = extent.select(*CELL).distinct().select("*", on_rim.alias("rim"), at("row").alias("i"), at("col").alias("j"))
    pieces = rounds.keep(cells.groupBy("grid_id", "i", "j").applyInPandas(_pieces, "grid_id long, row int, col int, rim boolean, component long"))
    rim = pieces.where("rim").select(*CELL, "component")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (0, 1))]))
    there = rim.withColumn("s", steps).select("grid_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("component").alias("other"))
    node = lambda c: F.struct("grid_id", F.col(c).alias("at"))
    edges = rim.join(there, CELL).where("component <> other").select(node("component").alias("a"), node("other").alias("b")).distinct()
    edges = rounds.keep(edges)
    if edges.isEmpty():
        return pieces.drop("rim")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    named = connected(edges, nodes).select(F.col("node.grid_id").alias("grid_id"), F.col("node.at").alias("component"), F.col("label.at").alias("whole"))
    return pieces.join(named, ["grid_id", "component"], "left").select(*CELL, F.coalesce("whole", "component").alias("component"))


def drop_small(extent: DataFrame, least: int) -> DataFrame:
    """Wet cells of components of ``least`` cells or more."""
    named = Rounds(extent.sparkSession, "named").keep(components(extent))
    sizes = named.groupBy("grid_id", "component").count().where(F.col("count") >= least)
    return named.join(sizes, ["grid_id", "component"]).select(*CELL)


def flood_extent(cells: DataFrame, depth: float, least: int = 10) -> DataFrame:
    """Cells of a depth or more, without small pieces, small holes closed."""
    return g.closing(drop_small(cells.where(F.col("value") >= depth), least))


def extent_continuity(extent: DataFrame, small: int = 10) -> DataFrame:
    """Per grid: components, cells, the largest one's share, the share of small ones, and sizes."""
    sizes = components(extent).groupBy("grid_id", "component").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return sizes.groupBy("grid_id").agg(
        F.count(n).alias("components"), F.sum(n).alias("cells"), (F.max(n) / F.sum(n)).alias("largest_share"),
        (F.count_if(n < small) / F.count(n)).alias("small_share"), F.avg(n).alias("mean_size"), F.max(n).alias("max_size"), F.min(n).alias("min_size"),
    )


def extent_features(extent: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """A row for each component: box, cells and area."""
    by = components(extent).groupBy("grid_id", "component")
    ends = {"row_min": F.min("row"), "row_max": F.max("row"), "col_min": F.min("col"), "col_max": F.max("col")}
    return by.agg(*[c.alias(k) for k, c in ends.items()], F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * cell_area).alias("area"))


def _grid_of(at: tuple, shape: tuple, values, empty=np.nan) -> np.ndarray:
    out = np.full(shape, empty)
    out[at] = values
    return out


def _forest(edges: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
    """The edges of a minimum spanning forest: all lowest passes are among them."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if (x := top(a)) != (y := top(b)):
            up[x] = y
            kept.append((a, b, w))
    return kept


def _basins(block: pd.DataFrame) -> pd.DataFrame:
    """One block flooded from its outlets and from the cells that touch other blocks.

    Rows of cells have the level within the block and the basin (the cell that
    started it, -1 for outlets: that water is gone). Rows without a cell are the
    lowest passes between basins, as level, basin and other.
    """
    r0, c0 = int(block["row"].min()), int(block["col"].min())
    shape = (int(block["row"].max()) - r0 + 1, int(block["col"].max()) - c0 + 1)
    at = (block["row"].to_numpy() - r0, block["col"].to_numpy() - c0)
    z = np.pad(_grid_of(at, shape, block["value"]), 1, constant_values=np.nan)
    own = np.pad(_grid_of(at, shape, block["own"], False).astype(bool), 1)
    there = ~np.isnan(z)
    near = sum((np.roll(there, (-a, -b), (0, 1)).astype(int) for a, b in g.D8))
    strange = sum((np.roll(there & ~own, (-a, -b), (0, 1)).astype(int) for a, b in g.D8))
    outlet, rim = own & (near < 8), own & (strange > 0)
    width = z.shape[1]
    heights, mine = z.ravel().tolist(), own.ravel().tolist()
    level, basin = [None] * len(heights), [None] * len(heights)
    queue = [(heights[k], -1, k) for k in np.flatnonzero(outlet).tolist()]
    queue += [(heights[k], (k // width + r0 - 1) * (1 << 31) + k % width + c0 - 1, k) for k in np.flatnonzero(rim & ~outlet).tolist()]
    heapq.heapify(queue)
    steps = [a * width + b for a, b in g.D8]
    passes: dict[tuple[int, int], float] = {}
    while queue:
        w, name, k = heapq.heappop(queue)
        if level[k] is not None:
            continue
        level[k], basin[k] = w, name
        for step in steps:
            n = k + step
            if not mine[n]:
                continue
            if level[n] is None:
                heapq.heappush(queue, (max(heights[n], w), name, n))
            elif basin[n] != name:  # popped before, so it is no higher than w
                pair = (basin[n], name) if basin[n] < name else (name, basin[n])
                if w < passes.get(pair, np.inf):
                    passes[pair] = w
    i, j = np.nonzero(own)
    flat = i * width + j
    cells = pd.DataFrame({"row": i + r0 - 1, "col": j + c0 - 1, "value": z[own], "level": [level[k] for k in flat], "basin": [basin[k] for k in flat], "rim": rim[own]})
    between = pd.DataFrame([(b, a, w) for a, b, w in _forest(passes)], columns=["basin", "other", "level"])
    for frame in (cells, between):
        frame["grid_id"] = block["grid_id"].iloc[0]
    out = pd.concat([cells, between]) if len(between) else cells.assign(other=None)
    return out.astype({"row": "Int64", "col": "Int64", "other": "Int64", "rim": "boolean"})[["grid_id", "row", "col", "value", "level", "basin", "other", "rim"]]


def lowest_passes(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, level``: the lowest height over which each node of ``edges`` (a, b, w) reaches the outside, an edge without ``b``.

    In a round every node takes its lowest edge, and what hangs together becomes
    one node; all its members must rise to the edge they took, so a member's
    level is the highest edge that it and those it became have taken. Edges fall
    along each path to the node where a tree of them ends, so that holds whatever
    way out the new node takes. Nodes halve in a round at least; ties go by names.
    """
    rounds = Rounds(edges.sparkSession, "passes")
    now = rounds.keep(edges.where("b is null or a <> b"))
    nodes = now.select(F.col("a").alias("node")).unionByName(now.where("b is not null").select(F.col("b").alias("node"))).distinct()
    nodes = rounds.keep(nodes.select("node", F.col("node").alias("now"), F.lit(float("-inf")).alias("level")))
    done = []
    for _ in range(most_rounds):
        both = now.unionByName(now.where("b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        edge = F.struct("w", F.when(F.col("b").isNotNull(), F.least("a", "b")).alias("lo"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("hi"), "b")
        took = rounds.keep(both.groupBy("a").agg(F.min(edge).alias("e")).select("a", F.col("e.b").alias("to"), F.col("e.w").alias("w")))
        if took.isEmpty():
            break
        back = took.select(F.col("a").alias("to"), F.col("to").alias("back"))
        # of two that took each other the first stays; without a way on, the outside is reached
        root = (F.col("a") == F.col("back")) & (F.col("a") < F.col("to"))
        tops = took.join(back, "to", "left").select("a", "w", F.when(~F.coalesce(root, F.lit(False)), F.col("to")).alias("to"), F.coalesce(root, F.lit(False)).alias("root"))
        tops = rounds.keep(tops.select("a", "w", F.when(F.col("root"), F.col("a")).otherwise(F.col("to")).alias("to")))
        for _ in range(most_rounds):
            on = tops.select(F.col("a").alias("to"), F.col("to").alias("next"))
            moved = tops.join(on.withColumn("known", F.lit(True)), "to", "left")
            after = rounds.keep(moved.select("a", "w", F.when(F.col("known"), F.col("next")).alias("to"), (F.col("known") & ~F.col("to").eqNullSafe(F.col("next"))).alias("moves")))
            tops = after.drop("moves")
            if after.where("moves").isEmpty():
                break
        named = tops.withColumnRenamed("a", "now")
        risen = rounds.keep(nodes.join(named, "now").select("node", F.col("to").alias("now"), F.greatest("level", "w").alias("level")))
        done.append(risen.where("now is null").select("node", "level"))
        nodes = risen.where("now is not null")
        left, right = (tops.select(F.col("a").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b"))
        new = now.join(left, "a").join(right, "b", "left").where("a2 is not null and (b is null or not a2 <=> b2)")
        # a node whose other end has reached the outside goes there by the same edge
        now = rounds.keep(new.groupBy(F.col("a2").alias("a"), F.col("b2").alias("b")).agg(F.min("w").alias("w")).unionByName(
            now.where("b is not null").join(left, "a").join(right, "b").where("a2 is null and b2 is not null").select(F.col("b2").alias("a"), F.col("a2").alias("b"), "w")
        ))
    else:
        raise RuntimeError(f"passes did not settle in {most_rounds} rounds")
    out = nodes.select("node", "level").where("false")
    for x in done:
        out = out.unionByName(x)
    return out


def fill_depressions(cells: DataFrame, block: int = 256) -> DataFrame:
    """``grid_id, row, col, value`` raised to the lowest level from which water can leave over the border or a hole.

    A block is flooded once, in a task, from its outlets and from the cells that
    touch other blocks; each such cell is a basin of its own unless water from
    another reaches it at no greater height. The lowest passes between basins,
    in blocks and across their borders, are a graph of a few percent of the cells,
    whose lowest ways out give each basin's level. One more pass raises the cells.
    Levels are exact, whatever the length of a valley.
    """
    rounds = Rounds(cells.sparkSession, "fill")
    valid = cells.where("value is not null and not isnan(value)").select(*CELL, F.col("value").cast("double").alias("value"))
    at = lambda c, move=0: F.floor((F.col(c) + move) / block).cast("int")
    home = F.struct(at("row").alias("i"), at("col").alias("j"))
    near = F.array_distinct(F.array(*[F.struct(at("row", a).alias("i"), at("col", b).alias("j")) for a, b in [(0, 0), *g.D8]]))
    dealt = valid.withColumn("to", F.explode(near)).withColumn("own", F.col("to") == home)
    dealt = dealt.select("grid_id", "row", "col", "value", "own", "to.i", "to.j")
    schema = "grid_id long, row int, col int, value double, level double, basin long, other long, rim boolean"

    def flooded(frame: pd.DataFrame) -> pd.DataFrame:
        return _basins(frame) if frame["own"].any() else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    found = rounds.keep(dealt.groupBy("grid_id", "i", "j").applyInPandas(flooded, schema))
    node = lambda c: F.when(F.col(c) >= 0, F.struct("grid_id", F.col(c).alias("at")))
    edges = found.where("other is not null").select(node("basin").alias("a"), node("other").alias("b"), F.col("level").alias("w"))
    rim = found.where("rim").select(*CELL, "value", "basin")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in g.D8 if (a, b) > (0, 0)]))
    there = rim.withColumn("s", steps).select("grid_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("value").alias("value2"), F.col("basin").alias("basin2"))
    across = rim.join(there, CELL).where("basin <> basin2")
    across = across.select(node("basin").alias("a"), node("basin2").alias("b"), F.greatest("value", "value2").alias("w"))
    edges = edges.unionByName(across)
    edges = edges.select(F.coalesce("a", "b").alias("a"), F.when(F.col("a").isNotNull(), F.col("b")).alias("b"), "w")
    edges = edges.where("a is not null").groupBy(F.when(F.col("b").isNotNull(), F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("b")).agg(F.min("w").alias("w"))
    levels = rounds.keep(lowest_passes(edges).withColumnRenamed("level", "rise"))
    done = found.where("row is not null and basin = -1").select(*CELL, F.col("level").alias("value"))
    rest = found.where("row is not null and basin <> -1").withColumn("node", node("basin")).join(levels, "node")
    return done.unionByName(rest.select(*CELL, F.greatest("level", "rise").alias("value")))


def flow_accumulation(directions: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``grid_id, row, col, cells``: cells upstream, itself among them. ``directions``: direction and steepest of ``grid.d8``.

    A slope of 0 or less is no outlet, which leaves a forest; by pointer doubling
    a path of n cells takes log n rounds.
    """
    rounds = Rounds(directions.sparkSession, "flow")
    step = F.create_map(*[x for s, code in g.D8.items() for x in (F.lit(code), F.struct(F.lit(s[0]).alias("a"), F.lit(s[1]).alias("b")))])
    to = F.when(F.col("steepest") > 0, F.try_element_at(step, F.col("direction")))
    at = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    row, col = F.col("row"), F.col("col")
    now = directions.select("grid_id", at(row, col).alias("node"), F.when(to.isNotNull(), at(row + to["a"], col + to["b"])).alias("ptr"), F.lit(1).cast("long").alias("n"))
    now = rounds.keep(now)
    for _ in range(most_rounds):
        if now.where("ptr is not null").isEmpty():
            return now.select("grid_id", F.col("node.r").alias("row"), F.col("node.c").alias("col"), F.col("n").alias("cells"))
        sent = now.where("ptr is not null").groupBy("grid_id", F.col("ptr").alias("node")).agg(F.sum("n").alias("more"))
        up = now.select("grid_id", F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        # cells that have met their outlet stay out of the join: their null pointers would be one key
        got = now.where("ptr is not null").join(up, ["grid_id", "ptr"], "left").select("grid_id", "node", F.col("next").alias("ptr"), "n")
        got = got.unionByName(now.where("ptr is null").select("grid_id", "node", "ptr", "n"))
        got = got.join(sent, ["grid_id", "node"], "left").select("grid_id", "node", "ptr", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        now = rounds.keep(got, 3)
    raise RuntimeError("flow directions hold a cycle")


def streams(accumulation: DataFrame, least_cells: int, least_piece: int = 1) -> DataFrame:
    """Cells that drain ``least_cells`` or more, in pieces of ``least_piece`` or more."""
    found = accumulation.where(F.col("cells") >= least_cells).select(*CELL)
    return drop_small(found, least_piece) if least_piece > 1 else found


def burn_streams(cells: DataFrame, stream: DataFrame, depth: float) -> DataFrame:
    """Stream cells lowered by ``depth``."""
    marked = cells.join(stream.select(*CELL).distinct().withColumn("wet", F.lit(True)), CELL, "left")
    return marked.select(*CELL, (F.col("value") - F.when(F.col("wet"), depth).otherwise(0.0)).alias("value"))


def burn_smoothed(cells: DataFrame, stream: DataFrame, buffer: int, sigma: float) -> DataFrame:
    """Cells within ``buffer`` steps of a stream replaced by their smoothed value."""
    near = g.dilate(stream.select(*CELL), "cross", buffer).withColumn("wet", F.lit(True))
    smooth = g.gaussian(cells, sigma).withColumnRenamed("value", "soft")
    both = cells.join(smooth.select(*CELL, "soft"), CELL).join(near, CELL, "left")
    return both.select(*CELL, F.when(F.col("wet"), F.col("soft")).otherwise(F.col("value")).alias("value"))


_STRIP = 32
#: A strip of columns has so many cells at most, or is one column; tasks are dealt about so many.
_STRIP_CELLS = 1 << 18


def _slices(keys: np.ndarray):
    """The key and slice of each run of sorted keys."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(keys)], strict=True):
        if hi > lo:
            yield int(keys[lo]), slice(int(lo), int(hi))


_SIDES = ("left", "here", "right")
_LINE = "grid_id long, line_row int, line_col int, " + ", ".join(f"{s}_far long, {s}_value double" for s in _SIDES)
_NONE = -1


def _lines(frame: pd.DataFrame) -> pd.DataFrame:
    """For each column of a grid's box, the stream cells of some rows at it, and next to it on either side."""
    frame = frame.sort_values(["row", "col"])
    rows, cols, v = (frame[c].to_numpy() for c in ("row", "col", "value"))
    col = np.arange(int(frame["c_min"].iloc[0]), int(frame["c_max"].iloc[0]) + 1)
    out = []
    for row, own in _slices(rows):
        at, z = cols[own], v[own]
        left, right = np.searchsorted(at, col, "left") - 1, np.searchsorted(at, col, "right")
        here = np.where(right - left > 1, right - 1, -1)
        part = {"line_row": row, "line_col": col}
        for name, k in (("left", left), ("here", here), ("right", right)):
            ok, k = (k >= 0) & (k < len(at)), np.clip(k, 0, len(at) - 1)
            part |= {f"{name}_far": np.where(ok, np.abs(at[k].astype(np.int64) - col), _NONE), f"{name}_value": np.where(ok, z[k], np.nan)}
        out.append(pd.DataFrame(part))
    return pd.concat(out).assign(grid_id=frame["grid_id"].iloc[0])[[c.split()[0] for c in _LINE.split(", ")]]


def _stream_lines(ends: DataFrame, stream: DataFrame, deal) -> DataFrame:
    """Each row that has stream cells (value), read at every column of its grid (c_min to c_max of ends): as many rows as the grid's box has cells at most."""
    rows = stream.select(*CELL, "value").join(ends.select("grid_id", "c_min", "c_max"), "grid_id").withColumn("strip", F.floor(F.col("row") / _STRIP))
    return deal(rows, "grid_id", "strip").groupBy("grid_id", "strip").applyInPandas(_lines, _LINE)


def _along_columns(cells: DataFrame, stream: DataFrame, found, name: str) -> DataFrame:
    """``found(rows, values, at, far, height)`` for the cells of each column of a grid: rows and values of the cells; rows, distances and values (a row for each side) of the stream at that column.

    Strips of a tall grid are narrow, and tasks as many as there are cells for:
    cells take few bytes, and Spark would put the strips of a large grid together.
    """

    def columns(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["col", "row"]), right.sort_values(["line_col", "line_row"])
        rows, values = left["row"].to_numpy(np.int64), left["value"].to_numpy(np.float64)
        at = right["line_row"].to_numpy(np.int64)
        far, height = (np.stack([right[f"{s}_{c}"].to_numpy(np.float64) for s in _SIDES]) for c in ("far", "value"))
        far[far == _NONE] = np.inf
        there, got = dict(_slices(right["line_col"].to_numpy())), np.full(len(left), np.nan)
        for col, own in _slices(left["col"].to_numpy()):
            if col in there:
                got[own] = found(rows[own], values[own], at[there[col]], far[:, there[col]], height[:, there[col]])
        return left[CELL].assign(**{name: got})

    box = [F.min("col").alias("c_min"), F.max("col").alias("c_max"), F.max(F.col("row").cast("long") + 1).alias("r_max"), F.min("row").alias("r_min"), F.count(F.lit(1)).alias("n")]
    ends = Rounds(cells.sparkSession, "ends").keep(cells.groupBy("grid_id").agg(*box))
    size = ends.agg(F.max(F.col("r_max") - F.col("r_min")).alias("rows"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("grids")).first()
    strip = max(1, min(_STRIP, _STRIP_CELLS // (size["rows"] or 1)))
    few = (size["n"] or 0) <= _STRIP_CELLS
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] or 0) // _STRIP_CELLS))
    deal = lambda df, *keys: df if few else df.repartition(tasks, *keys)
    lines = _stream_lines(to_tasks(ends, size["grids"]), stream, deal)
    own = deal(cells.select(*CELL, "value").withColumn("strip", F.floor(F.col("col") / strip)), "grid_id", "strip")
    lines = deal(lines.withColumn("line_strip", F.floor(F.col("line_col") / strip)).withColumnRenamed("grid_id", "line_grid"), "line_grid", "line_strip")
    both = own.groupBy("grid_id", "strip").cogroup(lines.groupBy("line_grid", "line_strip"))
    got = both.applyInPandas(columns, f"grid_id long, row int, col int, {name} double")
    return got.select(*CELL, F.when(~F.isnan(name), F.col(name)).alias(name))


def _envelope(rows: np.ndarray, at: np.ndarray, f: np.ndarray) -> np.ndarray:
    """For each of ``rows``, the least (row - at)^2 + f: the lower envelope of parabolas, whose corners tell which is lowest where."""
    hull, corner = [], []
    for k, (x, y) in enumerate(zip(at.tolist(), (f + at * at).tolist(), strict=True)):
        while hull:
            cut = (y - f[hull[-1]] - at[hull[-1]] ** 2) / (2.0 * (x - at[hull[-1]]))
            if len(hull) > 1 and cut <= corner[-1]:
                hull.pop()
                corner.pop()
            else:
                break
        if hull:
            corner.append(cut)
        hull.append(k)
    k = np.searchsorted(np.array(corner), rows)
    hull = np.array(hull)
    beside = hull[np.clip(k[:, None] + np.array([-1, 0, 1]), 0, len(hull) - 1)]  # a corner's rounding moves a row by one parabola at most
    return ((rows[:, None] - at[beside]) ** 2 + f[beside]).min(1)


def stream_distance(cells: DataFrame, stream: DataFrame, size: float = 1.0) -> DataFrame:
    """Distance to the nearest stream cell, null in a grid without any.

    An exact distance transform in two passes: along rows that have stream cells,
    then down each column, as the lower envelope of the rows' parabolas. What
    moves is in proportion to the cells, however dense the stream is.
    """

    def nearest(rows, values, at, far, height):
        return np.sqrt(_envelope(rows, at, far.min(0) ** 2)) * size

    wet = stream.select(*CELL).distinct().withColumn("value", F.lit(0.0))
    return _along_columns(cells.withColumn("value", F.lit(0.0)), wet, nearest, "distance")


def hand_nearest(cells: DataFrame, stream: DataFrame, reach: int) -> DataFrame:
    """Height, 0 at least, over the stream cell of the nearest square ring, the nearest in it, then the first; never over itself; null beyond ``reach``.

    In the nearest ring a row's nearest stream cells are its only candidates, so
    rows are read once and columns look ``reach`` rows up and down.
    """

    def nearest(rows, values, at, far_of, height_of):
        first = int(rows.min()) - reach
        n = int(rows.max()) + reach + 1 - first
        far, height = np.full((3, n), np.inf), np.full((3, n), np.nan)
        near = (at >= first) & (at < first + n)
        far[:, at[near] - first], height[:, at[near] - first] = far_of[:, near], height_of[:, near]
        best, under = np.full(len(rows), np.inf), np.full(len(rows), np.nan)
        for step in range(-reach, reach + 1):
            for k in range(3):
                if k == 1 and step == 0:
                    continue  # itself
                d = far[k, rows - first + step]
                rank = np.maximum(d, abs(step)) * (4 * reach * reach + 1) + d * d + step * step
                nearer = (d <= reach) & (rank < best)
                best = np.where(nearer, rank, best)
                under = np.where(nearer, height[k, rows - first + step], under)
        return np.maximum(values - under, 0.0)

    wet = cells.join(stream.select(*CELL).distinct(), CELL, "left_semi").where("value is not null")
    return _along_columns(cells, wet, nearest, "hand")


def hand_least(cells: DataFrame, stream: DataFrame, reach: int, block: int = 128) -> DataFrame:
    """Least non-negative height over the stream cells within ``reach``; null if there is none.

    Blocks take the stream cells about them and are moved over them step by step
    of the disc, whole blocks at a time: no row for a pair of cells.
    """
    block = max(block, reach)
    disc = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach]

    def least(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*CELL, "hand"])
        r0, c0 = (int(k) * block - reach for k in key[1:])
        shape = (block + 2 * reach, block + 2 * reach)
        wet = _grid_of((right["wet_row"].to_numpy() - r0, right["wet_col"].to_numpy() - c0), shape, right["wet_value"])
        z = _grid_of((left["row"].to_numpy() - r0 - reach, left["col"].to_numpy() - c0 - reach), (block, block), left["value"])
        best = np.full(z.shape, np.inf)
        for a, b in disc:
            over = z - wet[reach + a : reach + a + block, reach + b : reach + b + block]
            np.minimum(best, np.where(over >= 0, over, np.inf), out=best)
        hand = best[left["row"].to_numpy() - r0 - reach, left["col"].to_numpy() - c0 - reach]
        return left[CELL].assign(hand=np.where(np.isinf(hand), np.nan, hand))

    wet = cells.join(stream.select(*CELL).distinct(), CELL, "left_semi").where("value is not null")
    part = lambda c, move=0: F.floor((F.col(c) + move) / block).cast("int")
    about = lambda c: F.explode(F.sequence(part(c, -reach), part(c, reach)))
    near = wet.select("grid_id", "row", "col", "value", about("row").alias("i")).withColumn("j", about("col"))
    near = near.withColumnsRenamed({c: f"wet_{c}" for c in near.columns})
    own = cells.select(*CELL, "value", part("row").alias("i"), part("col").alias("j"))
    both = own.groupBy("grid_id", "i", "j").cogroup(near.groupBy("wet_grid_id", "wet_i", "wet_j"))
    got = both.applyInPandas(least, "grid_id long, row int, col int, hand double")
    return got.select(*CELL, F.when(~F.isnan("hand"), F.col("hand")).alias("hand"))


def drainage_proxy(cells: DataFrame, sigma: float = 2.0, k: int = 5, share: float = 0.05) -> DataFrame:
    """``flow`` = log10(|smooth(-z)| + 1), ``stream`` below its percentile, ``height`` = z less the lowest about it."""
    smooth = g.gaussian(cells.withColumn("value", -F.col("value")), sigma)
    flow = smooth.select(*CELL, F.log10(F.abs("value") + 1).alias("flow"))
    cut = with_quantiles(flow.select("grid_id").distinct(), flow, ["grid_id"], "flow", {"cut": share})
    low = g.focal(cells, k).select(*CELL, F.greatest(F.col("value") - F.col("f_min"), F.lit(0.0)).alias("height"))
    return flow.join(cut, "grid_id").join(low, CELL).select(*CELL, "flow", (F.col("flow") < F.col("cut")).alias("stream"), "height")


def synthetic_extent(cells: DataFrame, rain: float, least: int = 4) -> DataFrame:
    """A plausible wet extent: low ground, smoothed more the more it rains, deeper on the flattest third; small pieces dropped.

    ``rain`` in 0..1 raises the depth; cells deeper than a half are wet.
    """
    ends = cells.groupBy("grid_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    low = cells.join(ends, "grid_id").select(*CELL, (1 - F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).alias("value"))
    deep = g.gaussian(low, 0.5 + rain)
    flat = g.slope(cells)
    cut = with_quantiles(flat.select("grid_id").distinct(), flat, ["grid_id"], "slope", {"cut": 0.3})
    both = deep.join(flat, CELL).join(cut, "grid_id")
    depth = F.col("value") * rain * F.when(F.col("slope") <= F.col("cut"), 1.5).otherwise(1.0)
    return g.opening(drop_small(both.where(depth > 0.5).select(*CELL), least), "cross")


def relative_features(cells: DataFrame, near: int = 4, far: int = 7) -> DataFrame:
    """Position in the range of the near and far windows, and the contrast to the near mean in its spreads."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col("value") - F.col(a), F.col(b) - F.col(a)), F.lit(0.5))
    x = g.focal(cells, near).select(*CELL, "value", "f_mean", "f_std", part("f_min", "f_max").alias("relative_elevation"))
    x = x.withColumn("contrast", (F.col("value") - F.col("f_mean")) / F.when(F.col("f_std") < 1e-8, 1.0).otherwise(F.col("f_std")))
    y = g.focal(cells, far).select(*CELL, part("f_min", "f_max").alias("slope_position"))
    return x.join(y, CELL).select(*CELL, "relative_elevation", "slope_position", "contrast")


def direction_features(cells: DataFrame, k: int = 1) -> DataFrame:
    """Planform over profile curvature, and how alike aspects are about a cell: the length of their mean direction."""
    bend = g.curvature(cells).select(*CELL, F.try_divide("planform", F.when(F.abs("profile") > 1e-8, F.col("profile"))).alias("curvature_ratio"))
    angle = F.radians(F.col("aspect"))
    faces = g.aspect(cells)
    east = g.focal(faces.withColumn("value", F.sin(angle)), k).select(*CELL, F.col("f_mean").alias("e"))
    north = g.focal(faces.withColumn("value", F.cos(angle)), k).select(*CELL, F.col("f_mean").alias("n"))
    both = east.join(north, CELL).select(*CELL, F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n")).alias("aspect_uniformity"))
    return bend.join(both, CELL)


def constant_grid(meta: DataFrame, bands: dict[str, float]) -> DataFrame:
    """Every cell of grids (grid_id, nrows, ncols) with constant bands."""
    rows = meta.select("grid_id", "ncols", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("row"))
    rows = rows.select("grid_id", "row", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1)).alias("col"))
    return rows.select("*", *[F.lit(v).alias(k) for k, v in bands.items()])


def mass_balance(flows: DataFrame) -> DataFrame:
    """``run_id, error``: |in - (out + stored)| over in, of volumes summed over a run's rows; null without inflow."""
    got = flows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("inflow", "outflow", "stored")])
    return got.select("run_id", F.try_divide(F.abs(F.col("inflow") - F.col("outflow") - F.col("stored")), F.col("inflow")).alias("error"))


def balance_residual(wide: DataFrame) -> DataFrame:
    """Per grid: mean (divergence of (u, v) by Sobel weights - (rain - infiltration))^2 over inner cells."""

    def sobel(band: str, along: str) -> Column:
        weight = lambda s: (s[1] if along == "col" else s[0]) * (2 if 0 in s else 1)
        return sum((F.col(f"{band}_{g._name(s)}") * weight(s) for s in g.D8 if weight(s)), F.lit(0.0)) / 8

    x = wide
    for band in ("u", "v"):
        named = g.neighbours(x.select(*CELL, F.col(band).alias("value"))).drop("value")
        x = x.join(named.withColumnsRenamed({g._name(s): f"{band}_{g._name(s)}" for s in g.D8}), CELL)
    off = sobel("u", "col") + sobel("v", "row") - (F.col("rain") - F.col("infiltration"))
    return x.groupBy("grid_id").agg(F.avg(off * off).alias("residual"))


def dem_quality(cells: DataFrame, stream: DataFrame) -> DataFrame:
    """Per grid: sinks, range, mean, std, and the largest stream piece's share of all stream cells."""
    v = F.col("value")
    stats = cells.groupBy("grid_id").agg((F.max(v) - F.min(v)).alias("range"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    sinks = g.sinks(cells).groupBy("grid_id").agg(F.count(F.lit(1)).alias("sinks"))
    joined = extent_continuity(stream).select("grid_id", F.col("largest_share").alias("connectivity"))
    return stats.join(sinks, "grid_id", "left").join(joined, "grid_id", "left").fillna(0, ["sinks"])
