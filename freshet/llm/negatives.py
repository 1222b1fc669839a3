"""Hard negatives from embeddings: Hilbert-ordered blocks with zone maps, and windows of scores read from the blocks that may hold them.

Vectors are whole numbers, floor(scale * x). Rows stand by label and then along
a Hilbert curve over all dimensions, and are packed into Parquet blocks of
``block`` rows, each with the least and greatest value of every dimension. The
bounds that interval arithmetic gives for the inner product of an anchor and a
block tell which blocks its windows must read: first for whole tiles of anchors
by their own boxes, on the zone maps alone, so that only wanted blocks are moved;
then anchor by anchor in the tasks, best blocks first, against the places that
are already taken. An anchor's own block, scored while it is packed, gives the
first bound for its positives.

Both searches are exact. Anchors (a stated query set) meet rows in blocks; what
a task holds is a tile of anchors and ``lane`` blocks.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part. Shorter vectors count as padded with zeros, empty ones
among them. A null id stays: it is never an anchor and comes last among equal
scores. Rows that repeat an id are rows of their own: each may be an anchor, a
positive or a negative, and a row is never its own positive. Ties go to the
smaller id. Scores are exact while they fit in a long and end there beyond it.
A positive of a score below 0 has no window. An empty table gives an empty
result. Columns beside those named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, small_batches

_NO_ID = 2**63 - 1
_LOW, _HIGH = -(2**63), 2**63 - 1
_EXACT = 1 << 53
_BLOCK = "place long, size int, anchors int, labels array<long>, rows binary, vectors binary, kind string, low binary, high binary"
_ANCHOR = "place long, uid long, id long, label long, vector binary, floor long"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place along a Hilbert curve of each row of ``cells`` (whole numbers of so many bits), as bytes that sort by it.

    The axes are taken bit by bit from the top: where an axis has the bit, the
    lower bits of the first axis are turned over; else they change places with
    its own. Gray coding across the axes then gives the curve's digits.
    """
    x = cells.astype(np.uint32).T.copy()
    if not len(x):
        return [b""] * cells.shape[0]
    for bit in range(bits - 1, 0, -1):
        lower = np.uint32((1 << bit) - 1)
        for axis in range(len(x)):
            there = (x[axis] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(there, np.uint32(0), (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(there, lower, swap)
            x[axis] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    digits = np.stack([(x >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)])
    packed = np.packbits(digits.reshape(bits * len(x), -1).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in np.ascontiguousarray(packed)]


def _matrix(vectors, dims: int) -> np.ndarray:
    """A list-of-longs Arrow column as rows of ``dims`` numbers, short ones padded with 0."""
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    n = np.diff(ends)
    if (n == dims).all():
        return flat[ends[0] : ends[-1]].reshape(len(n), dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = flat[ends[0] : ends[-1]]
    return out


def _rows(data: bytes, n: int, kind: str = "i8") -> np.ndarray:
    flat = np.frombuffer(data, f"<{kind}")
    return flat.reshape(n, len(flat) // n)


def _packed(m: np.ndarray) -> tuple[bytes, str]:
    for kind in ("i2", "i4"):
        if not m.size or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return m.astype(f"<{kind}").tobytes(), kind
    return m.astype("<i8").tobytes(), "i8"


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact."""
    top = lambda m: int(np.abs(m.astype(np.float64)).max()) if m.size else 0
    if max(1, a.shape[1]) * (top(a) + 1) * (top(b) + 1) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LOW, _HIGH).astype(np.int64)


def bounds(a_low: np.ndarray, a_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of vectors in boxes ``a`` (rows) with vectors in boxes ``low..high`` (rows)."""
    parts = [m.astype(np.float64) for m in (a_low, a_high, low, high)]
    if sum(1 for m in parts if m.size and np.abs(m).max() >= 1 << 22) or a_low.shape[1] > 1 << 8:  # else all sums are exact
        return np.full((len(a_low), len(low)), -np.inf), np.full((len(a_low), len(low)), np.inf)
    al, ah, bl, bh = parts
    if a_low is a_high:
        up, down = np.maximum(al, 0), np.minimum(al, 0)
        return up @ bl.T + down @ bh.T, up @ bh.T + down @ bl.T
    least, most = np.zeros((len(al), len(bl))), np.zeros((len(al), len(bl)))
    for d in range(al.shape[1]):
        ends = [np.outer(p[:, d], q[:, d]) for p in (al, ah) for q in (bl, bh)]
        least += np.minimum.reduce(ends)
        most += np.maximum.reduce(ends)
    return least, most


def curve_blocks(rows: DataFrame, ends: list[tuple[int, int]], block: int, bits: int, positives: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Blocks and anchors of ``rows`` (id, label, anchor, v), as tables: the order is by label, then along the curve.

    A block's ``rows`` are ids and labels; ``low`` and ``high`` are its zone map.
    An anchor's ``floor`` is the score of the last of its positives within its own block.
    """
    import pyarrow as pa

    dims = len(ends)
    least = np.array([a for a, _ in ends], np.float64)
    span = np.maximum(np.array([b for _, b in ends], np.float64) - least, 1.0)

    def keyed(parts):
        for part in parts:
            m = _matrix(part.column("v"), dims)
            cells = np.clip((m - least) / span * (1 << bits), 0, (1 << bits) - 1)
            yield part.append_column("key", pa.array(hilbert_keys(cells, bits), pa.binary()))

    def pieces(parts):
        """Tables of ``block`` rows, whatever the size of batches."""
        held, n = [], 0
        for part in parts:
            while part.num_rows:
                take = part.slice(0, block - n)
                held.append(take)
                n, part = n + take.num_rows, part.slice(take.num_rows)
                if n == block:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def blocks(parts):
        at = TaskContext.get().partitionId() << 32
        for place, t in enumerate(pieces(parts), at):
            ids = t.column("id").fill_null(_NO_ID).to_numpy()
            labels = t.column("label").to_numpy()
            anchor = np.flatnonzero(t.column("anchor").to_numpy())
            m = _matrix(t.column("v").combine_chunks(), dims)
            data, kind = _packed(m)
            floors = []
            got = _scores(m[anchor], m)
            for k, a in enumerate(anchor):
                others = got[k][(labels == labels[a]) & (np.arange(len(m)) != a)]
                floors.append(int(np.partition(others, -positives)[-positives]) if len(others) >= positives else None)
            zone = [f(m, axis=0).astype("<i8").tobytes() for f in (np.min, np.max)]
            yield pa.RecordBatch.from_pydict(
                {
                    "place": pa.array([place], pa.int64()), "size": pa.array([len(m)], pa.int32()), "anchors": pa.array([len(anchor)], pa.int32()),
                    "labels": pa.array([np.unique(labels)], pa.list_(pa.int64())), "rows": [np.stack([ids, labels]).astype("<i8").tobytes()],
                    "vectors": [data], "kind": [kind], "low": [zone[0]], "high": [zone[1]],
                    "found": pa.array([[{"row": int(a), "floor": f} for a, f in zip(anchor, floors, strict=True)]], pa.list_(pa.struct([("row", pa.int32()), ("floor", pa.int64())]))),
                }
            )

    def anchors(parts):
        for part in parts:
            for row in part.to_pylist():
                ids, labels = np.frombuffer(row["rows"], "<i8").reshape(2, -1)
                m = _rows(row["vectors"], row["size"], row["kind"])
                own = np.array([f["row"] for f in row["found"]], np.int64)
                uid = _uids(row["place"], own)
                yield pa.RecordBatch.from_pydict(
                    {
                        "place": pa.array([row["place"]] * len(own), pa.int64()), "uid": pa.array(uid, pa.int64()), "id": ids[own], "label": labels[own],
                        "vector": pa.array([m[k].astype("<i8").tobytes() for k in own], pa.binary()), "floor": pa.array([f["floor"] for f in row["found"]], pa.int64()),
                    }
                )

    order = ["label", "key", "id", "_read"]
    known = rows.withColumn("_read", F.monotonically_increasing_id()).mapInArrow(keyed, "id long, label long, anchor boolean, v array<long>, _read long, key binary")
    known = scratch.keep(known, "keyed")
    ranged = known.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.keep(ranged.select("id", "label", "anchor", "v").mapInArrow(blocks, f"{_BLOCK}, found array<struct<row:int,floor:long>>"), "blocks")
    with small_batches(rows.sparkSession, 16):
        queries = scratch.keep(found.where("anchors > 0").mapInArrow(anchors, _ANCHOR), "anchors")
    scratch.drop("keyed")
    return found.drop("found"), queries


def _uids(place: int, rows: np.ndarray) -> np.ndarray:
    """Names of rows: the range and block, then the row within it."""
    part, block = place >> 32, place & 0xFFFFFFFF
    return (np.int64(part) << 44) | (np.int64(block) << 16) | rows.astype(np.int64)


def numbered(blocks: DataFrame, scratch: Scratch, tile: int) -> DataFrame:
    """``place, nth, tile``: each block's number in order, and the tile of its anchors. Ranges are summed, then blocks within each."""
    small = blocks.select("place", "anchors", F.shiftright("place", 32).alias("part"))
    parts = small.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.sum("anchors").alias("k"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("m", "k")])
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inner = small.withColumn("inner", F.coalesce(F.sum("anchors").over(own), F.lit(0))).withColumn("at", F.coalesce(F.count(F.lit(1)).over(own), F.lit(0)))
    got = inner.join(parts, "part").select("place", (F.col("m0") + F.col("at")).alias("nth"), F.floor((F.col("k0") + F.col("inner")) / tile).alias("tile"))
    return scratch.keep(got, "numbered")


def wanted(blocks: DataFrame, anchors: DataFrame, slab: int, same: bool) -> DataFrame:
    """``tile, nth``: blocks whose bounds with a tile's box may hold a score that some anchor of it looks for.

    Only zone maps and boxes take part: a row for each tile, and one for each ``slab`` blocks.
    """
    import pyarrow as pa

    def boxes(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.frombuffer(v, "<i8") for v in frame["vector"]])
        ends = [f(m, axis=0).tobytes() for f in (np.min, np.max)]
        labels = np.unique(frame["label"].to_numpy())
        return pd.DataFrame({"tile": [frame["tile"].iloc[0]], "t_low": [ends[0]], "t_high": [ends[1]], "t_labels": [labels], "least": [frame["least"].min()], "most": [frame["most"].max()]})

    def slabs(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slab": [frame["slab"].iloc[0]], "nths": [frame["nth"].to_numpy()], "lows": [b"".join(frame["low"])], "highs": [b"".join(frame["high"])], "sets": [list(frame["labels"])]})

    def meet(parts):
        for part in parts:
            out = []
            for r in part.to_pylist():
                own = set(r["t_labels"])
                n = len(r["nths"])
                low, high = (_rows(r[c], n) for c in ("lows", "highs"))
                box = [_rows(r[c], 1) for c in ("t_low", "t_high")]
                least, most = bounds(*box, low, high)
                ok = (most[0] >= r["least"]) & (least[0] <= r["most"])
                fits = [bool(own & set(s)) if same else len(own) > 1 or set(s) != own for s in r["sets"]]
                out += [(r["tile"], k) for k, a, b in zip(r["nths"], ok, fits, strict=True) if a and b]
            yield pa.RecordBatch.from_pydict({"tile": pa.array([t for t, _ in out], pa.int64()), "nth": pa.array([k for _, k in out], pa.int64())})

    zones = blocks.select("nth", "labels", "low", "high", F.floor(F.col("nth") / slab).alias("slab"))
    many = (blocks.agg(F.max("nth").alias("n")).first()["n"] or 0) // slab
    packed = zones.groupBy("slab").applyInPandas(slabs, "slab long, nths array<long>, lows binary, highs binary, sets array<array<long>>")
    tiles = anchors.select("tile", "vector", "label", "least", "most").groupBy("tile").applyInPandas(boxes, "tile long, t_low binary, t_high binary, t_labels array<long>, least long, most long")
    dealt = tiles.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many).cast("long")))).join(packed, "slab")
    return dealt.mapInArrow(meet, "tile long, nth long")


class _Places:
    """The best ``k`` so far of every window: higher scores first, then smaller ids, then rows."""

    def __init__(self, windows: int, k: int, least: np.ndarray):
        self.k, self.bar = k, least.copy()
        self.held = [np.empty(0, np.int64)] * 4

    def add(self, w: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        if not len(w):
            return
        w, score, ids, uid = (np.concatenate(p) for p in zip(self.held, (w, score, ids, uid), strict=True))
        order = np.lexsort((uid, ids, ~score, w))
        w, score, ids, uid = (v[order] for v in (w, score, ids, uid))
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        rank = np.arange(len(w)) - np.repeat(first, np.diff(np.concatenate([first, [len(w)]])))
        last = rank == self.k - 1
        self.bar[w[last]] = np.maximum(self.bar[w[last]], score[last])
        keep = rank < self.k
        self.held = [v[keep] for v in (w, score, ids, uid)]


def best_in_blocks(anchors: pd.DataFrame, blocks: pd.DataFrame, k: int, same: bool, chunk: int = 512) -> tuple[np.ndarray, ...]:
    """Window, score, id and row of the best ``k`` of each window (a row of ``anchors``: uid, label, vector, least, most) over ``blocks``.

    A block is read by the windows whose bounds it may meet, those that it may serve best first.
    """
    vectors = {u: np.frombuffer(v, "<i8") for u, v in zip(anchors["uid"], anchors["vector"], strict=True)}
    uids = np.array(list(vectors), np.int64)
    a = np.stack(list(vectors.values()))
    of = pd.Index(uids).get_indexer(anchors["uid"])
    own = anchors["label"].to_numpy()
    least, most = anchors["least"].to_numpy(np.int64), anchors["most"].to_numpy(np.int64)
    places = _Places(len(anchors), k, least)
    zone = [np.stack([np.frombuffer(z, "<i8") for z in blocks[c]]) for c in ("low", "high")]
    low, high = bounds(a, a, *zone)
    for b in np.argsort(-high.max(axis=0), kind="stable"):
        row = blocks.iloc[b]
        ids, labels = np.frombuffer(row["rows"], "<i8").reshape(2, -1)
        fits = np.isin(own, row["labels"]) if same else (own != row["labels"][0]) | (len(row["labels"]) > 1)
        reads = np.flatnonzero(fits & (high[of, b] >= places.bar) & (low[of, b] <= most))
        if not len(reads):
            continue
        m = _rows(row["vectors"], len(ids), row["kind"])
        names = _uids(int(row["place"]), np.arange(len(ids)))
        needed, at = np.unique(of[reads], return_inverse=True)
        score = _scores(a[needed], m)
        for s in range(0, len(reads), chunk):
            w = reads[s : s + chunk]
            x = score[at[s : s + chunk]]
            ok = (x >= places.bar[w, None]) & (x <= most[w, None]) & ((labels == own[w, None]) == same)
            if same:
                ok &= names != uids[of[w], None]
            crowded = np.flatnonzero(ok.sum(1) > k)
            if len(crowded):  # what the k-th best of the block itself already rules out
                bar = np.partition(np.where(ok[crowded], x[crowded], _LOW), -k, axis=1)[:, -k]
                ok[crowded] &= x[crowded] >= bar[:, None]
            i, j = np.nonzero(ok)
            places.add(w[i], x[i, j], ids[j], names[j])
    return tuple(places.held)


def _searched(anchors: DataFrame, blocks: DataFrame, k: int, same: bool, scratch: Scratch, name: str, slab: int, lane: int) -> DataFrame:
    """``uid, window, id, score, row``: the best ``k`` of each window over all blocks that may hold them."""
    needed = wanted(blocks, anchors, slab, same).withColumn("lane", F.floor(F.col("nth") / lane))
    needed = scratch.keep(needed, f"{name}-wanted")
    sent = needed.select("tile", "lane").distinct().join(anchors, "tile")
    read = needed.join(blocks.select("nth", "place", "labels", "rows", "vectors", "kind", "low", "high"), "nth")
    read = read.withColumnsRenamed({"tile": "read_tile", "lane": "read_lane"})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("uid", "window", "id", "score", "row")})
        left = left.sort_values(["uid", "window"], ignore_index=True)
        w, score, ids, row = best_in_blocks(left, right, k, same)
        return pd.DataFrame({"uid": left["uid"].to_numpy()[w], "window": left["window"].to_numpy()[w], "id": ids, "score": score, "row": row})

    both = sent.groupBy("tile", "lane").cogroup(read.groupBy("read_tile", "read_lane"))
    found = both.applyInPandas(search, "uid long, window int, id long, score long, row long")
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id", "row")
    return scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"{name}-found")


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", positives: int = 5, negatives: int = 10,
    window: tuple[int, int, int] = (30, 90, 100), scale: int = 256, block: int = 1024, bits: int = 4, tile: int = 2048, slab: int = 256, lane: int = 64,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row of ``anchor`` and each of its best ``positives`` of the same
    label, the best ``negatives`` of other labels whose score is between the
    window's shares of the positive's. Of ``window`` (low, high, whole), low *
    positive <= whole * negative <= high * positive. The other parameters shape
    blocks and tasks, never the result.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    label = F.col("label") if label is None else label
    taken = rows.where(finite & F.col(vector_col).isNotNull())
    taken = taken.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v"))
    taken = scratch.keep(taken.where("label is not null"), "rows")
    short = taken.agg(F.min(F.size("v")).alias("n")).first()["n"] or 0
    found = taken.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("d").collect()  # a row for each dimension
    ends = [(min(r["a"], 0), max(r["b"], 0)) if r["d"] >= short else (r["a"], r["b"]) for r in found]

    blocks, queries = curve_blocks(taken, ends, block, bits, positives, scratch)
    order = numbered(blocks, scratch, tile)
    blocks = scratch.keep(blocks.join(order.select("place", "nth"), "place"), "numbered-blocks")
    queries = queries.join(order.select("place", "tile"), "place").drop("place")
    queries = scratch.keep(queries.withColumn("window", F.lit(0)), "queries")

    first = queries.withColumns({"least": F.coalesce("floor", F.lit(_LOW)), "most": F.lit(_HIGH)}).drop("floor")
    best = _searched(first, blocks, positives, True, scratch, "positives", slab, lane)
    low, high, of = window
    score = F.col("score").cast("decimal(38,0)")
    ends_of = {"least": F.ceil(score * low / of), "most": F.floor(score * high / of)}
    named = best.select("uid", F.col("rank").alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score"), *[c.cast("long").alias(k) for k, c in ends_of.items()])
    named = scratch.keep(named, "windows")
    second = queries.drop("window", "floor").join(named.where("least <= most").drop("positive", "positive_score"), "uid")
    worst = _searched(scratch.keep(second, "second"), blocks, negatives, False, scratch, "negatives", slab, lane)

    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    out = worst.join(named.drop("least", "most"), ["uid", "window"]).join(queries.select("uid", F.col("id").alias("anchor_id")), "uid")
    return out.select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
