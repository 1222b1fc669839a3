"""SimHash near-duplicates: a self-join of the binary trie of all fingerprints.

Pairs of trie nodes are traversed together; the bits in which their paths differ
add up, and a pair goes as soon as they pass the error budget. Of two
fingerprints within the budget, one half of the bits differs in at most half of
it, so the trie is walked twice, each half first once, with the half budget for
those bits; that keeps the number of open node pairs near N log^2 N.

The top of the trie is a table: nodes with their counts, split further while
they hold more than ``cap`` fingerprints, and a frontier of node pairs joined
with their children level by level. What is left are pairs of cells of bounded
size, which tasks traverse by index ranges of their sorted fingerprints. A task
returns a spanning forest of the links it found, never all pairs; node pairs
whose leaves are already one class are skipped, so large groups of near copies
stay cheap.

Defined results: a null text is an empty one; without words the fingerprint is
zero, linked like any other. Very long texts are read whole, some words at a
time. Equal fingerprints are one node, whatever the number of their rows. A
null id stays a row; it never names a component unless no other id is in it
(then the component is null). Rows that repeat an id stay. There are no ties.
An empty table gives an empty result. Columns beside the two are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch, small_batches

_PIECE = 1 << 20


def _word_lists(data: bytes, keep: int):
    """The words of a text in lists of about a megabyte, each led by the last ``keep`` words before it."""
    at, last = 0, []
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = last + data[at:end].split()
        yield words
        at, last = end, words[max(0, len(words) - keep) :] if keep else []


def shingle_hashes(text: str | None, n: int = 4, seed: int = 42):
    """XXH64 of each ``n``-word shingle, repeats included, in arrays; fewer words are one shingle; none: nothing."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    few = True
    for words in _word_lists(data, n - 1):
        if len(words) >= n:
            few = False
            made = (xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), seed) for k in range(len(words) - n + 1))
            yield np.fromiter(made, np.uint64, len(words) - n + 1)
    if few and (words := data.split()):
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is in over half of the hashes."""
    total, m = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, n, seed):
        m += len(hashes)
        for k in range(0, len(hashes), 1 << 14):
            part = hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > m).view(">u8")[0])


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint's bits as a long."""
    import pyarrow as pa

    def batches(parts):
        for part in parts:
            prints = np.array([fingerprint(t, n, seed) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, fp long")


def _prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits, in place; the others are 0."""
    return key.bitwiseAND(F.lit(-1 << (64 - depth))) if depth else F.lit(0).cast("long")


def trie_nodes(keys: DataFrame, scratch: Scratch, cap: int, step: int = 2) -> tuple[DataFrame, int]:
    """``turn, depth, prefix, leaf`` of the top of both tries, and its depth: nodes are split while they hold more than ``cap`` keys."""
    n = keys.count() / 2
    depth = 0
    while (n / cap) * 2 > 1 << depth and depth < 64 - step:
        depth += step
    levels, now = [], keys.groupBy("turn", _prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("m"))
    now = scratch.keep(now, "nodes-first")
    up = now
    for d in range(depth - step, -1, -step):
        up = up.groupBy("turn", _prefix(F.col("prefix"), d).alias("prefix")).agg(F.sum("m").alias("m"))
        levels.append(up.select("turn", F.lit(d).alias("depth"), "prefix", F.lit(False).alias("leaf")))
    while True:
        full = (F.col("m") > cap) & F.lit(depth < 64)
        levels.append(now.select("turn", F.lit(depth).alias("depth"), "prefix", (~full).alias("leaf")))
        more = now.where(full)
        if more.isEmpty():
            break
        above = more.select(F.col("turn").alias("t"), F.col("prefix").alias("p"))
        inside = keys.join(above, (F.col("turn") == F.col("t")) & (_prefix(F.col("key"), depth) == F.col("p")), "left_semi")
        depth += step
        now = scratch.keep(inside.groupBy("turn", _prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("m")), f"nodes-{depth}")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return scratch.keep(out, "nodes"), depth


def within(a: str, b: str, depth: str, budget: int) -> Column:
    """Whether two prefixes may lead to a pair within the budget, half of it in the first half of the bits."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    differ = F.when(F.col(depth) > 0, differ.bitwiseAND(F.expr(f"shiftleft(-1L, 64 - {depth})"))).otherwise(F.lit(0).cast("long"))
    return (F.bit_count(F.shiftrightunsigned(differ, 32)) <= budget // 2) & (F.bit_count(differ) <= budget)


def cell_pairs(nodes: DataFrame, depth: int, scratch: Scratch, budget: int, step: int = 2) -> DataFrame:
    """``turn, a, a_depth, b, b_depth``: pairs of leaves of the top, by traversal of node pairs from the root."""
    at = nodes.where("depth = 0").select("turn", F.col("prefix").alias("a"), F.lit(0).alias("a_depth"), F.col("leaf").alias("a_leaf"))
    now = at.select("*", F.col("a").alias("b"), F.col("a_depth").alias("b_depth"), F.col("a_leaf").alias("b_leaf"))
    for d in range(0, depth, step):
        below = nodes.where(F.col("depth") == d + step)
        down = below.select("turn", _prefix(F.col("prefix"), d).alias("of"), F.lit(d).alias("of_depth"), "prefix", "depth", "leaf")
        stay = nodes.where(F.col("leaf") & (F.col("depth") <= d)).select("turn", F.col("prefix").alias("of"), F.col("depth").alias("of_depth"), "prefix", "depth", "leaf")
        step_to = down.unionByName(stay)
        for side in ("a", "b"):
            to = step_to.withColumnsRenamed({"of": side, "of_depth": f"{side}_depth", "prefix": f"{side}2", "depth": f"{side}2_depth", "leaf": f"{side}2_leaf"})
            now = now.join(to, ["turn", side, f"{side}_depth"])
        same = (F.col("a") == F.col("b")) & (F.col("a_depth") == F.col("b_depth"))
        now = now.where(~same | (F.col("a2") <= F.col("b2"))).withColumn("common", F.least("a2_depth", "b2_depth"))
        now = now.where(within("a2", "b2", "common", budget))
        now = scratch.keep(now.select("turn", *[F.col(f"{s}2{c}").alias(f"{s}{c}") for s in "ab" for c in ("", "_depth", "_leaf")]), f"frontier-{d}")
    return now.select("turn", "a", "a_depth", "b", "b_depth")


class _Classes:
    """Union-find over the keys of a pair of cells."""

    def __init__(self, n: int):
        self.up, self.grown = np.arange(n), False

    def flat(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if (top == self.up).all():
                return top
            self.up = top

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.flat()
        a, b = roots[a], roots[b]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return
        self.grown = True
        pairs = np.unique(np.stack([np.minimum(a, b)[open_], np.maximum(a, b)[open_]], 1), axis=0)
        up = self.up
        for x, y in pairs.tolist():
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)


def linked(x: np.ndarray, y: np.ndarray, budget: int = 4, most: int = 1 << 18) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sorted arrays of keys (one with itself if they are the same object), as index pairs into x and then y.

    A node is a range of a sorted array, its children the parts before and after the first key with the level's bit.
    """
    same = x is y
    every = x if same else np.concatenate([x, y])
    move = 0 if same else len(x)
    classes = _Classes(len(every))
    for s, z in ((0, x),) if same else ((0, x), (move, y)):  # neighbours in order are often linked, and make later pairs needless
        k = np.flatnonzero(np.bitwise_count(z[1:] ^ z[:-1]) <= budget)
        classes.join(k + s, k + 1 + s)
    if same:
        for bit in range(64):
            k = np.flatnonzero((x >> np.uint64(bit)) & np.uint64(1) == 0)
            to = np.searchsorted(x, x[k] | np.uint64(1 << bit))
            k, to = k[to < len(x)], to[to < len(x)]
            hit = x[to] == x[k] | np.uint64(1 << bit)
            classes.join(k[hit], to[hit])
    zeros: dict[tuple[int, int], np.ndarray] = {}

    def middle(which: int, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (which, depth) not in zeros:
            z = (x, y)[which]
            zeros[which, depth] = np.concatenate([[0], np.cumsum((z >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        count = zeros[which, depth]
        return lo + count[hi] - count[lo]

    stack = [(0, *(np.array([v]) for v in (0, len(x), 0, len(y), 0)))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > most:
            stack += [(depth, *(v[k : k + most] for v in (alo, ahi, blo, bhi, diff))) for k in range(0, len(alo), most)]
            continue
        if classes.grown:  # leave out what is one class already
            roots = classes.flat()
            turns = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
            one = (turns[alo] == turns[ahi - 1]) & (turns[blo + move] == turns[bhi - 1 + move]) & (roots[alo] == roots[blo + move])
            alo, ahi, blo, bhi, diff = (v[~one] for v in (alo, ahi, blo, bhi, diff))
        small = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[small], blo[small]
        hit = np.bitwise_count(x[a] ^ y[b]) <= budget
        classes.join(a[hit], b[hit] + move)
        alo, ahi, blo, bhi, diff = (v[~small] for v in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        amid, bmid = middle(0, depth, alo, ahi), middle(1, depth, blo, bhi)
        own = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        most_here = budget // 2 if depth < 32 else budget
        parts = []
        for a0, a1, b0, b1, more in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            ok = (a0 < a1) & (b0 < b1) & (diff + more <= most_here)
            if more and a0 is amid:
                ok &= ~own
            parts.append(tuple(v[ok] for v in (a0, a1, b0, b1, diff + more)))
        stack.append((depth + 1, *(np.concatenate(p) for p in zip(*parts, strict=True))))
    roots = classes.flat()
    return [(int(k), int(roots[k])) for k in np.flatnonzero(roots != np.arange(len(every)))]


def _turned(keys: np.ndarray, turn: int) -> np.ndarray:
    return (keys << np.uint64(32)) | (keys >> np.uint64(32)) if turn else keys


def cell_links(dealt: DataFrame, budget: int) -> DataFrame:
    """``a, b``: linked fingerprints of pairs of cells (turn, alone, x, y: arrays of keys), a spanning forest of each pair's."""
    import pyarrow as pa

    def batches(parts):
        for part in parts:
            for turn, alone, one, other in zip(*(part.column(k) for k in range(4)), strict=True):
                x = np.sort(one.values.to_numpy(zero_copy_only=False).view(np.uint64))
                y = x if alone.as_py() else np.sort(other.values.to_numpy(zero_copy_only=False).view(np.uint64))
                found = np.array(linked(x, y, budget), np.int64).reshape(-1, 2)
                if len(found):
                    every = _turned(x if y is x else np.concatenate([x, y]), turn.as_py()).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(every[found[:, 0]]), pa.array(every[found[:, 1]])], ["a", "b"])

    return dealt.select("turn", "alone", "x", "y").mapInArrow(batches, "a long, b long")


def near_components(docs: DataFrame, n: int = 4, budget: int = 4, seed: int = 42, cap: int = 16_384) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text); fingerprints link at ``budget`` or fewer differing bits.

    ``cap`` bounds the fingerprints of a cell, never the result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, n, seed), "rows")
    lows = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    fp = F.col("fp")
    turned = F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), k.alias("key")) for t, k in ((0, fp), (1, turned))]))
    keys = scratch.keep(lows.select(both.alias("k")).select("k.turn", "k.key"), "keys")
    nodes, depth = trie_nodes(keys, scratch, cap)
    pairs = scratch.keep(cell_pairs(nodes, depth, scratch, budget), "pairs")

    placed = None  # each key with its cell: the leaf that its first bits name
    for d in range(0, depth + 1, 2):
        leaves = nodes.where(F.col("leaf") & (F.col("depth") == d)).select("turn", "prefix", "depth")
        found = keys.withColumn("prefix", _prefix(F.col("key"), d)).join(leaves, ["turn", "prefix"])
        placed = found if placed is None else placed.unionByName(found)
    cells = placed.groupBy("turn", "prefix", "depth").agg(F.collect_list("key").alias("keys"))  # cap keys at most
    cells = scratch.keep(cells, "cells")
    alone = (F.col("a") == F.col("b")) & (F.col("a_depth") == F.col("b_depth"))
    for side, name in (("a", "x"), ("b", "y")):
        there = cells.withColumnsRenamed({"prefix": side, "depth": f"{side}_depth", "keys": name})
        pairs = pairs.join(there, ["turn", side, f"{side}_depth"])
    dealt = pairs.select("turn", alone.alias("alone"), "x", "y").repartition(F.xxhash64("turn", "a", "a_depth", "b", "b_depth"))
    with small_batches(docs.sparkSession, 64):  # rows of two cells each
        links = scratch.keep(cell_links(dealt, budget), "links")
    label = components(links, scratch, "all")

    named = lows.join(label, lows["fp"] == label["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    named = scratch.keep(named, "named")
    first = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = scratch.keep(named.join(first, "label").select("fp", "component_id"), "components")
    scratch.drop("prints", "keys", "nodes", "pairs", "cells", "links", "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op13_simhash_trie(spark, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
