"""N-gram Jaccard self-join by signature trees.

A document is its set of distinct five-word shingles; documents link when their
sets' Jaccard similarity is 0.75 or more. The result is each document's set size
and the component that links put it in. It is exact:

1. *Cells.* Every pair that links shares one of the first
   ``n - ceil(0.75 n) + 1`` shingles of either set, whatever the order. The order
   puts shingles that are frequent in a sample last, so cells are small; the
   sample only shapes the order. Exact copies are one node from here on.
2. *Stars.* In each cell the member that holds most frequent shingles is the
   hub. Distinct (member, hub) pairs, as many as rows, that the bitmap bound below
   leaves are verified exactly and joined into components. That settles each hub
   with its whole cell, so hubs leave. Cells whose other members are by now one
   component are done, and of cells with equal members the first counts.
3. *Signature trees.* In each remaining cell the members are leaves of a tree
   whose nodes hold the OR of token bitmaps, the range of set sizes and of
   components. A dual traversal from (root, root) drops a pair of nodes when its
   size ranges cannot reach the threshold, when all below is one component, or
   when the most that its members can share, ``popcount(A & B)`` plus the tokens
   that collided within a bitmap, is too little. A bitmap has two bits or more a
   token, so members form units by bitmap width, and of about ``_CELL`` members;
   each pair of units of like width is a traversal of its own, the wider folded.
   A component of ``_CELL`` members or more has units of its own, which never meet
   each other. A pair that shares several large cells is found in the first alone.
4. Surviving pairs are verified exactly, and their links complete the components.

Defined results: a null text, or one without words, has an empty set, links with
nothing and is a component of its own; fewer than five words are one shingle.
Repeated ids are one document's rows: each row is in the result. A component's
id is the smallest id in it; null only if all its ids are null. An empty table
gives an empty result. Very long texts are read whole. There are no ties: links
have no order. Extra columns are ignored. Shingles are 64-bit hashes and
nodes 64-bit hashes of sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened
from .graph import components
from .scratch import Scratch
from .shingles import lists_column, mix, shingle_set

_CELL = 1024
_CHUNK = 1 << 14  # documents whose prefixes are packed together at most
_SALTS = 16
_LARGE = 64  # members from which a cell is large
_BITS = 27  # power of two: bits of the filter of wanted documents, 16 MB at any size
_FAN = 4
_NARROW, _WIDE = 8, 15  # powers of two: bits of the smallest and largest bitmap
_SLICE = 1 << 22  # words of bitmap met at once


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def frequent_shingles(docs: DataFrame, n: int, every: int, least: int, most: int) -> np.ndarray:
    """Sorted hashes, ``most`` at most, that ``least`` or more documents of a hash sample hold."""

    def shingles(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t.as_py(), n) for t in b.column(0)]
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            uniq, count = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(count)], names=["hash", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(shingles, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(most).toArrow()
    return np.sort(top["hash"].to_numpy().view(np.uint64))


def prefix_rows(docs: DataFrame, frequent: np.ndarray, buckets: int, n: int, num: int, den: int) -> DataFrame:
    """A row for each document: doc_id, row, n, node, central, bits; and rows bucket, chunk, entries of packed prefixes.

    A prefix goes out once for a set in a task, as entries of eight bytes: 48 bits
    of a shingle, its marks, and the place of its document in the chunk, a batch
    of documents. A bucket is a range of shingles; entries lie byte by byte, so
    that what sorted entries have in common costs next to nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = "doc_id long, row long, n long, node long, central int, bits binary, bucket int, chunk long, entries binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def make(batches):
        import pyarrow as pa

        last, met, task, number = shared.value, set(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(at, _CHUNK)
                chunk = (task << 24) + number
                number += 1
                sizes, nodes, central, bits, parts = [], [], [], [], []
                for i, t in enumerate(b.column(1)):
                    s = shingle_set(t.as_py(), n)
                    spot = np.minimum(np.searchsorted(last, s), max(len(last) - 1, 0))
                    often = last[spot] == s if len(last) else np.zeros(len(s), bool)
                    node = xxhash.xxh3_64_intdigest(s.tobytes())
                    keep = prefix_length(len(s), num, den)
                    sizes.append(len(s))
                    nodes.append(node)
                    central.append(int(often.sum()))
                    bits.append(None if node in met else bitmap(s).tobytes())
                    if node not in met:
                        order = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])[:keep]
                        # the place in the prefix is one in which the smaller set of a link has its first common shingle
                        early = (num + den) * (len(s) - np.arange(len(order))) >= 2 * num * len(s)
                        marks = often[order] * np.uint64(2) + early
                        parts.append((s[order] >> np.uint64(16) << np.uint64(16)) | marks << np.uint64(14) | np.uint64(i))
                    met.add(node)
                    if len(met) > 2_000_000:
                        met.clear()
                m = b.num_rows
                cols = [b.column(0), pa.array((chunk << 14) + np.arange(m)), pa.array(sizes, pa.int64())]
                cols += [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(central, pa.int32()), pa.array(bits, pa.binary())]
                cols += [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                entries = np.concatenate(parts) if parts else np.empty(0, np.uint64)
                # a range of shingles; frequent ones are salted by their document
                bucket = ((entries >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                salt = np.where(entries >> np.uint64(15) & np.uint64(1), entries % np.uint64(_SALTS), 0).astype(np.int64)
                bucket = (bucket + salt * (buckets // _SALTS + 1)) % buckets
                order = np.lexsort((entries, bucket))
                entries, bucket = entries[order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts[1:], len(bucket))
                data = [np.ascontiguousarray(entries[i:j].astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes() for i, j in zip(starts, ends, strict=True)]
                m = len(starts)
                cols = [pa.nulls(m, pa.array([], t).type) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
                cols += [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(m, chunk)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(make, schema)


def repeated(rows: DataFrame) -> DataFrame:
    """hash, row, often, early of packed prefixes: shingles of two rows or more that are early in one, and all frequent ones."""

    def find(chunks, data):
        import pyarrow as pa

        parts = [np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(8, -1).T).view(">u8").ravel() for d in data]
        entries = np.concatenate(parts).astype(np.uint64)
        chunk = np.repeat(np.array(chunks), [len(x) for x in parts])
        order = np.argsort(entries, kind="stable")
        entries, chunk = entries[order], chunk[order]
        hashes = entries >> np.uint64(16)
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        size = np.diff(np.append(starts, len(hashes)))
        often, early = (entries >> np.uint64(15) & np.uint64(1)).astype(bool), (entries >> np.uint64(14) & np.uint64(1)).astype(bool)
        ok = np.logical_or.reduceat(often, starts) | (size > 1) & np.logical_or.reduceat(early, starts)
        at = np.flatnonzero(np.repeat(ok, size))
        row = (chunk[at] << 14) + (entries[at] & np.uint64(_CHUNK - 1)).astype(np.int64)
        cols = [pa.array(hashes[at].astype(np.int64)), pa.array(row), pa.array(often[at]), pa.array(early[at])]
        return pa.RecordBatch.from_arrays(cols, names=["hash", "row", "often", "early"])

    def make(batches):
        now, chunks, data = None, [], []
        for b in batches:
            for bucket, chunk, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and data:
                    yield find(chunks, data)
                    chunks, data = [], []
                now = bucket
                chunks.append(chunk)
                data.append(d)
        if data:
            yield find(chunks, data)

    packed = rows.where("entries is not null").select("bucket", "chunk", "entries").repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(make, "hash long, row long, often boolean, early boolean")


def shared_cells(rows: DataFrame, salts: int) -> DataFrame:
    """hash, often, node, n, early, hub, hub_n of members of cells with two nodes or more; cells of frequent shingles are salted."""
    named = rows.where("n is not null").select("row", "node", "n", "central")
    salt = F.when(F.col("often"), F.pmod("node", F.lit(salts))).otherwise(0).cast("int")
    rows = repeated(rows).join(named, "row").select("hash", salt.alias("salt"), "node", "n", "central", "often", "early")
    # one exchange, used twice: both uses read the same columns under the same filter
    rows = rows.where("hash is not null and salt is not null").repartition("hash", "salt")
    best = F.max(F.struct("central", "n", "node")).alias("best")
    tops = [F.max("often").alias("often"), F.max("early").alias("early")]
    cells = rows.groupBy("hash", "salt").agg(best, F.min("node").alias("low"), F.max("node").alias("high"), *tops)
    cells = cells.where("often or low <> high")
    cells = cells.groupBy("hash").agg(F.max("best").alias("best"), F.min("low").alias("low"), F.max("high").alias("high"), *tops)
    cells = cells.where("low <> high and early")
    spread = F.explode(F.when(F.col("often"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    cells = cells.select("hash", spread.alias("salt"), F.col("best.node").alias("hub"), F.col("best.n").alias("hub_n"))
    found = rows.join(cells.hint("shuffle_hash"), ["hash", "salt"])
    return found.distinct().drop("salt", "central")  # both follow from hash and node


def _spots(ids: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Two places of each id in the filter; a null id has its own."""
    h = mix(np.where(there, ids, 0).astype(np.int64).view(np.uint64) * np.uint64(2) + there)
    return [(h >> np.uint64(s)) & np.uint64((1 << _BITS) - 1) for s in (0, 64 - _BITS)]


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(), there


def filter_words(wanted: DataFrame) -> DataFrame:
    """word, bits: the words of the filter that have any of these ids."""

    def make(batches):
        import pyarrow as pa

        for b in batches:
            at = np.concatenate(_spots(*_ids(b.column(0))))
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return wanted.select("rep").mapInArrow(make, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))


_FILTERS: dict[str, np.ndarray] = {}


def _filter(uri: str) -> np.ndarray:
    """The filter kept in a shared table, held for a worker's next task."""
    import pyarrow.parquet as pq

    if uri not in _FILTERS:
        _FILTERS.clear()
        system, path = opened(uri)
        table = pq.read_table(path, filesystem=system)
        words = np.zeros(1 << _BITS - 6, np.uint64)
        words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        _FILTERS[uri] = words
    return _FILTERS[uri]


def node_sets(docs: DataFrame, wanted: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """node, set of at least the wanted classes (node, rep), read where the texts lie.

    A filter of fixed size says which documents may be wanted: it only ever lets
    too many through, whose sets meet no pair.
    """
    scratch.keep(filter_words(wanted), f"{name}-filter")
    uri = scratch.path(f"{name}-filter")

    def make(batches):
        import pyarrow as pa

        words = _filter(uri)
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for at in _spots(*_ids(b.column(0))):
                ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            texts = b.column(1)
            sets = [shingle_set(texts[int(i)].as_py(), n) for i in np.flatnonzero(ok)]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), lists_column(sets)], names=["node", "set"])

    return docs.mapInArrow(make, "node long, set array<long>")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Tokens by their low bits, two bits or more a token up to the widest; halves fold onto each other."""
    bits = 1 << min(max((2 * len(s) - 1).bit_length(), _NARROW), _WIDE)
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def possible(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps allow to link. bits: node, n, bits."""
    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = both.join(bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")

    def meet(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for n_a, n_b, x, y in zip(*(b.column(k).to_pylist() for k in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                words = min(len(x), len(y)) // 8
                x, y = (folded(np.frombuffer(v, "<u8"), words) for v in (x, y))
                ex = min(n - int(np.bitwise_count(v).sum()) for n, v in ((n_a, x), (n_b, y)))
                ok.append((num + den) * (int(np.bitwise_count(x & y).sum()) + ex) >= num * (n_a + n_b))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(meet, "a long, b long")


class Forest:
    """Signature trees over the members of many cells at once.

    Members come sorted by tree. ``tree`` numbers the trees from 0; level 0 is the
    members, a node of the next level has up to ``_FAN`` children.
    """

    def __init__(self, tree: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        excess = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [{"tree": tree, "lo": size, "hi": size, "ex": excess, "c0": comp, "c1": comp, "or": bits}]
        self.first: list[np.ndarray] = []
        self.many: list[np.ndarray] = []
        while True:
            x = self.levels[-1]
            start = np.flatnonzero(np.concatenate([[True], x["tree"][1:] != x["tree"][:-1]]))
            local = np.arange(len(x["tree"])) - np.repeat(start, np.diff(np.append(start, len(x["tree"]))))
            at = np.flatnonzero(local % _FAN == 0)
            self.first.append(at)
            self.many.append(np.diff(np.append(at, len(x["tree"]))))
            up = {"tree": x["tree"][at], "lo": np.minimum.reduceat(x["lo"], at), "hi": np.maximum.reduceat(x["hi"], at)}
            up |= {"ex": np.maximum.reduceat(x["ex"], at), "or": np.bitwise_or.reduceat(x["or"], at)}
            up |= {"c0": np.minimum.reduceat(x["c0"], at), "c1": np.maximum.reduceat(x["c1"], at)}
            self.levels.append(up)
            if len(at) == len(start):  # every tree has its root
                return

    def keep(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether a pair of nodes may hold a link between components."""
        x, out = self.levels[level], np.zeros(len(a), bool)
        lo = x["lo"][a] + x["lo"][b]
        sizes = (den * x["hi"][a] >= num * x["lo"][b]) & (den * x["hi"][b] >= num * x["lo"][a])
        mixed = (np.minimum(x["c0"][a], x["c0"][b]) != np.maximum(x["c1"][a], x["c1"][b]))
        left = np.flatnonzero(sizes & mixed)
        step = max(1, _SLICE // max(1, x["or"].shape[1]))
        for i in range(0, len(left), step):
            part = left[i : i + step]
            common = np.bitwise_count(x["or"][a[part]] & x["or"][b[part]]).sum(1, dtype=np.int64)
            most = common + np.minimum(x["ex"][a[part]], x["ex"][b[part]])
            out[part] = (num + den) * most >= num * lo[part]
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Members' pairs below the pairs of roots (a, b)."""
        for level in range(len(self.levels) - 1, 0, -1):
            ok = self.keep(level, a, b, num, den)
            a, b = a[ok], b[ok]
            first, many = self.first[level - 1], self.many[level - 1]
            n = many[a] * many[b]
            which = np.repeat(np.arange(len(a)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = first[a[which]] + k // many[b[which]], first[b[which]] + k % many[b[which]]
            once = (a[which] != b[which]) | (i <= j)
            a, b = i[once], j[once]
        ok = (a != b) & self.keep(0, a, b, num, den)
        return a[ok], b[ok]


def tree_candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes that the trees of (hash, i, j) leave. Rows: width, hash, i, j, side, node, comp, n, large, bits.

    ``i = j``: one tree met with itself; else side 0 is met with side 1.
    ``width`` is the power of two of the bits to compare in. ``large``: the
    member's large cells in ascending order.
    """

    def first_met(table, at, x, y):
        """Whether no large cell before that of ``at`` holds both members; small cells count as first."""
        column = table["large"].combine_chunks()
        ends = column.offsets.to_numpy().astype(np.int64)
        here = column.flatten().to_numpy() if len(column) else np.empty(0, np.int64)
        if not len(here) or not len(x):
            return np.ones(len(x), bool)
        names, rank = np.unique(here, return_inverse=True)
        ends = ends - ends[0]
        sizes = np.diff(ends)
        keys = np.repeat(np.arange(len(sizes)), sizes) * len(names) + rank  # ascending: lists are sorted
        own = np.minimum(np.searchsorted(names, at), len(names) - 1)
        ok = np.ones(len(x), bool)
        for i in range(0, len(x), 100_000):
            a, b = x[i : i + 100_000], y[i : i + 100_000]
            many = sizes[a]
            which = np.repeat(np.arange(len(a)), many)
            mine = np.repeat(ends[a] - np.cumsum(many) + many, many) + np.arange(len(which))
            want = b[which] * len(names) + rank[mine]
            spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            earlier = (keys[spot] == want) & (rank[mine] < own[a[which]]) & (names[own[a[which]]] == at[a[which]])
            ok[i : i + 100_000] = np.bincount(which[earlier], minlength=len(a)) == 0
        return ok

    def run(table):
        import pyarrow as pa

        cell = np.stack([table[c].to_numpy() for c in ("hash", "i", "j")], 1)
        side, node, comp, n = (table[c].to_numpy() for c in ("side", "node", "comp", "n"))
        words = (1 << int(table["width"][0].as_py())) // 64
        bits = np.stack([folded(np.frombuffer(x, "<u8"), words) for x in table["bits"].to_pylist()])
        new_cell = np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)])
        new_tree = new_cell | np.concatenate([[True], side[1:] != side[:-1]])
        forest = Forest(np.cumsum(new_tree) - 1, n, comp, bits)
        first = np.flatnonzero(new_tree)
        self_met = np.flatnonzero(cell[first, 1] == cell[first, 2])
        crossed = np.flatnonzero((~new_cell[first]) & (cell[first, 1] != cell[first, 2]))  # side 1, after side 0
        a, b = np.concatenate([self_met, crossed - 1]), np.concatenate([self_met, crossed])
        x, y = forest.pairs(a, b, num, den)
        first = first_met(table, cell[:, 0], x, y)
        x, y = x[first], y[first]
        lo, hi = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        both = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def walk(batches, most=4 << 20):
        """Whole cells of one width at a time, of about ``most`` bytes of bitmaps."""
        import pyarrow as pa

        held: list = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table[c].to_numpy() for c in ("width", "hash", "i", "j")], 1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            end = len(keys) if last else int(starts[-1])  # the last cell may go on
            edges = np.append(starts[starts < end], end)
            cuts, at = [], 0
            for k in range(len(edges) - 1):
                full = (edges[k + 1] - edges[at]) * (1 << int(keys[edges[at], 0])) // 8 > most
                if k + 1 == len(edges) - 1 or full or keys[edges[k + 1], 0] != keys[edges[at], 0]:
                    cuts.append((int(edges[at]), int(edges[k + 1])))
                    at = k + 1
            rest = table.slice(end)
            held, size = (rest.to_batches() if rest.num_rows else []), rest.nbytes
            for a, b in cuts:
                yield run(table.slice(a, b - a).combine_chunks())

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
                if size > 4 * most:
                    yield from flush(False)
        if held:
            yield from flush(True)

    order = ["width", "hash", "i", "j", "side", "n", "node"]
    dealt = rows.repartition("width", "hash", "i", "j").sortWithinPartitions(*order)
    return dealt.select(*order, "comp", "large", "bits").mapInArrow(walk, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, n: int, num: int, den: int, each: int = 2000) -> DataFrame:
    """The pairs (a, b) that link; b may be in very many pairs, so its set is dealt out by salt."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = scratch.keep(node_sets(docs, classes.join(ends, "node"), n, scratch, name), f"{name}-sets")
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("salts"))
    left = pairs.join(hubs, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    left = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).join(hubs, "b")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    links = left.join(right, ["b", "salt"]).where(den * common >= num * union).select("a", "b")
    links = scratch.keep(links, f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-filter")
    return links


def tree_rows(members: DataFrame, num: int, den: int) -> DataFrame:
    """What ``tree_candidates`` takes but the bits: members of mixed cells, once for each pair of units they are in.

    A unit is a block of one width: of one component if that has ``_CELL`` members
    or more, else of components by their hash.
    """
    one, two = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    cells = members.groupBy("hash", "often").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("cell"), one.alias("x"), two.alias("y")
    )
    first = cells.where("c0 <> c1").groupBy("cell", "x", "y").agg(F.min(F.struct("often", "hash")).alias("first"))
    found = members.join(first.select(F.col("first.hash").alias("hash"), "cell"), "hash")
    large = found.where(F.col("cell") >= _LARGE).groupBy("node").agg(F.array_sort(F.collect_set("hash")).alias("large"))

    sizes = found.groupBy("hash", "width", "comp").agg(F.count(F.lit(1)).alias("many"))
    own = F.when(F.col("many") >= _CELL, F.col("comp"))
    units = sizes.groupBy("hash", "width", own.alias("own")).agg(F.sum("many").alias("many"))
    blocks = F.ceil(F.col("many") / _CELL).cast("int")
    units = units.groupBy("hash").agg(F.collect_list(F.struct("width", "own", blocks.alias("blocks"))).alias("units"))
    rows = found.join(sizes, ["hash", "width", "comp"]).withColumn("own", own).join(units, "hash")

    def name(width, own, block):
        """Units in an order that goes by width first; ids of 56 bits below it, of hashes where a component has its own."""
        low = F.when(own.isNull(), block).otherwise(F.lit(1 << 55).bitwiseOR(F.xxhash64(own, block).bitwiseAND(F.lit((1 << 55) - 1))))
        return F.shiftleft(width.cast("long"), 56).bitwiseOR(low.cast("long"))

    mine = F.filter("units", lambda u: (u["width"] == F.col("width")) & u["own"].eqNullSafe(F.col("own")))[0]["blocks"]
    block = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("comp")).otherwise(F.col("node"))), mine).cast("int")
    reach = math.ceil(math.log2(den / num))
    near = F.filter("units", lambda u: (F.abs(u["width"] - F.col("width")) <= reach) & ~F.coalesce(u["own"] == F.col("own"), F.lit(False)))
    others = F.flatten(F.transform(near, lambda u: F.transform(F.sequence(F.lit(0), u["blocks"] - 1), lambda k: name(u["width"], u["own"], k))))
    rows = rows.withColumn("unit", name(F.col("width"), F.col("own"), block)).withColumn("other", F.explode(others))
    rows = rows.select(
        F.shiftright(F.least("unit", "other"), 56).cast("int").alias("width"),
        "hash",
        F.least("unit", "other").alias("i"),
        F.greatest("unit", "other").alias("j"),
        (F.col("unit") > F.col("other")).cast("int").alias("side"),
        "node",
        "comp",
        "n",
    )
    return rows.join(large, "node", "left").withColumn("large", F.coalesce("large", F.array().cast("array<long>")))


def jaccard_components(
    docs: DataFrame, num: int = 3, den: int = 4, shingle: int = 5, every: int = 16, often: int = 2, most_frequent: int = 200_000
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); links at ``num / den``.

    ``every``, ``often`` and ``most_frequent`` shape the order of shingles and
    with it the size of cells, never the result.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = frequent_shingles(docs, shingle, every, often, most_frequent)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.keep(prefix_rows(docs, frequent, buckets, shingle, num, den), "rows")
    ids = scratch.keep(rows.where("n is not null").select("doc_id", "n", "node"), "ids")
    shared = scratch.keep(shared_cells(rows, _SALTS), "shared")
    classes = ids.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    bits = rows.where("bits is not null").select("node", "n", "bits").join(shared.select("node").distinct(), "node", "left_semi")
    bits = scratch.keep(bits.dropDuplicates(["node"]), "bits")
    scratch.drop("rows")

    fits = f"node <> hub and {den} * n >= {num} * hub_n and {den} * hub_n >= {num} * n"
    stars = shared.where(fits).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = scratch.keep(possible(stars, bits, num, den), "stars")
    links = verified(stars, docs, classes, scratch, "star", shingle, num, den)
    label = components(links, scratch, "star")

    # cells that still hold more than one component; their hubs have met all others
    width = F.least(F.greatest(F.ceil(F.log2(2 * F.col("n"))), F.lit(_NARROW)), F.lit(_WIDE)).cast("int")
    comp = F.coalesce("label", "node").alias("comp")
    members = shared.where("node <> hub").join(label, "node", "left").select("hash", "often", "node", "n", width.alias("width"), comp)
    members = scratch.keep(members, "members")
    open_rows = tree_rows(members, num, den).join(bits.select("node", "bits"), "node")
    candidates = scratch.keep(tree_candidates(open_rows, num, den), "candidates")
    more = verified(candidates, docs, classes, scratch, "tree", shingle, num, den)
    label = components(links.unionByName(more), scratch, "all")

    named = ids.join(label, "node", "left")
    group = F.when(F.col("n") > 0, F.coalesce("label", "node"))
    named = scratch.keep(named.select("doc_id", "n", group.alias("group")), "named")
    smallest = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    out = named.join(smallest, "group", "left")
    scratch.drop("ids", "shared", "bits", "members", "stars", "candidates")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
