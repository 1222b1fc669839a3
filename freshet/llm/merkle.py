"""A Merkle manifest of a dataset: leaves, trees by group, a tree over the groups, and each row's proof.

Nodes of a tree stand in leaf order, cut into blocks whose size is a power of
the fan-out, so that runs of siblings never cross a block. Within a block, a
level is one window step: the first leaf of a node carries its digest, and
columns at fixed offsets (lag and lead by d * fanout^level rows), masked by the
node's slot and its run's length, are its siblings. Rows that are a run's first
child hash the parent. What a block leaves is one node, and the nodes of all
blocks take the same step again until one is left; a block is the largest thing
that one task holds, whatever a group's share of the rows is. Places within a
group are counted by ranges of the order, not by one window.

Defined results: a leaf is H, the lowercase hex sha256, of the columns in
order, each ``-`` for a null, else its UTF-8 byte count, ``:`` and itself, so
nulls and empty texts differ. Very long texts are hashed whole. Rows that
repeat an id stand in the order of their leaves, and equal leaves are
interchangeable. A null id comes first, a null group too. A lone node is not
hashed again; the last run of a level may be shorter, even one node, and is
hashed. An empty table gives an empty result. Columns beside those named are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

_STEP = "struct<before:binary,after:binary>"


def digest(*parts: Column) -> Column:
    """H of concatenated parts, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf_of(values: list[Column]) -> Column:
    """H of a row's columns, framed by their lengths."""
    framed = []
    for v in values:
        text = v.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*framed)


def placed(rows: DataFrame, group: str, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``pos``, its place from 0 within ``group`` by ``by``, and ``n``, the group's rows.

    Rows are sorted in ranges and numbered there; a range's rows of a group
    start after those of earlier ranges, which are at most one row a range and
    group. Rows that are alike in ``by`` are told apart by where they were read,
    so they too are split over ranges.
    """
    known = scratch.keep(rows.withColumn("_read", F.monotonically_increasing_id()), f"{name}-read")
    order = [group, *by, "_read"]
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = known.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = scratch.keep(ranged.select("*", F.spark_partition_id().alias("_range"), within.alias("_at")).drop("_read"), f"{name}-ranged")
    scratch.drop(f"{name}-read")
    sizes = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("m"), F.min("_at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.sum("m").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(
        F.col(group).alias("_group"), F.col("_range").alias("_in"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_move"), F.sum("m").over(whole).alias("n")
    )
    starts = scratch.keep(starts, f"{name}-starts")
    same = (F.col("_range") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group"))
    return ranged.join(starts, same).withColumn("pos", F.col("_at") + F.col("_move")).drop("_range", "_at", "_in", "_group", "_move")


def block_step(nodes: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (group, pos, n, node) with ``block``, ``steps`` (a node's siblings within its block, level by level) and ``top`` (the block's last node, on its first row)."""
    size = fanout**levels
    w = Window.partitionBy(group, "block").orderBy("pos")
    x = nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("top", F.col("node"))
    pos, n = F.col("pos"), F.col("n")
    for level in range(levels):
        width = fanout**level
        at = F.floor(pos / width)
        slot = F.pmod(at, F.lit(fanout))
        run = F.least(F.lit(fanout), F.ceil(n / width) - (at - slot))
        here = (pos % width == 0) & (n > width)
        left = {d: F.lag("top", d * width).over(w) for d in range(1, fanout)}
        right = {d: F.lead("top", d * width).over(w) for d in range(1, fanout)}
        x = x.withColumns({f"left{d}": c for d, c in left.items()} | {f"right{d}": c for d, c in right.items()})
        none = F.lit(b"")
        before = F.concat(*[F.when(slot >= d, F.col(f"left{d}")).otherwise(none) for d in range(fanout - 1, 0, -1)])
        after = F.concat(*[F.when(slot + d < run, F.col(f"right{d}")).otherwise(none) for d in range(1, fanout)])
        x = x.withColumn(f"step{level}", F.when(here, F.struct(before.alias("before"), after.alias("after"))))
        parent = digest(_hex(F.col("top")), _hex(F.col(f"step{level}.after")))
        x = x.withColumn("top", F.when(F.col(f"step{level}").isNull(), F.col("top")).when(slot == 0, parent))
        x = x.drop(*[f"{side}{d}" for side in ("left", "right") for d in range(1, fanout)])
    # a node's siblings at a level are those of its first leaf, the last row so far that has any
    down = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = F.array(*[F.last_value(f"step{level}", ignoreNulls=True).over(down) for level in range(levels)])
    x = x.withColumn("steps", steps).withColumn("steps", F.filter("steps", lambda s: s.isNotNull()))
    return x.drop(*[f"step{level}" for level in range(levels)])


def tree(nodes: DataFrame, group: str, scratch: Scratch, name: str, fanout: int = 2, levels: int = 10) -> DataFrame:
    """``nodes`` (group, pos, n, node, ...) with ``steps`` (siblings up to the group's root, level by level) and ``root``."""
    size = fanout**levels
    inner = scratch.keep(block_step(nodes, group, fanout, levels), f"{name}-blocks")
    firsts = inner.where(F.col("pos") % size == 0)
    upper = firsts.select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("node"))
    if upper.where("n > 1").isEmpty():
        above = upper.select(group, "pos", F.array().cast(f"array<{_STEP}>").alias("more"), F.col("node").alias("root"))
    else:
        above = tree(upper, group, scratch, f"{name}-up", fanout, levels).select(group, "pos", F.col("steps").alias("more"), "root")
    above = scratch.keep(above.withColumnsRenamed({group: "_group", "pos": "_block"}), f"{name}-above")
    same = (F.col("block") == F.col("_block")) & F.col(group).eqNullSafe(F.col("_group"))
    return inner.join(above, same).withColumn("steps", F.concat("steps", "more")).drop("block", "top", "_group", "_block", "more")


def folded(node: Column, steps: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(steps, node, lambda acc, s: digest(_hex(s["before"]), _hex(acc), _hex(s["after"])))


def manifest(
    docs: DataFrame, columns: list[str], group: str, by: str, tampered: dict[str, Column] | None = None, when: Column | None = None, fanout: int = 2, levels: int = 10
) -> DataFrame:
    """A row for each of ``docs``: ``by``, ``leaf``, ``subroot``, ``root``, ``steps``, and ``found`` (the leaf of what the row is now).

    Leaves are hashed from ``columns``; those of a ``group`` are a tree by ``by``,
    and the groups' roots, ordered by group, another. ``tampered`` gives other
    values of some columns for the rows of ``when``, to hold against the proofs.
    Digests are 32 bytes each; ``steps`` goes from the leaf to the root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = leaf_of([F.col(c) for c in columns])
    other = leaf_of([(tampered or {}).get(c, F.col(c)) for c in columns])
    found = F.when(when, other) if when is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(by).alias("_by"), F.col(group).alias("_lang"), leaf.alias("node"), found.alias("found"))
    low = scratch.keep(tree(placed(rows, "_lang", ["_by", "node"], scratch, "leaves"), "_lang", scratch, "tree", fanout, levels), "trees")

    roots = low.where("pos = 0").select(F.lit(0).alias("_all"), "_lang", F.col("root").alias("node"))
    top = tree(placed(roots, "_all", ["_lang"], scratch, "roots"), "_all", scratch, "top", fanout, levels)
    top = scratch.keep(top.select(F.col("_lang").alias("_name"), F.col("steps").alias("more"), F.col("root").alias("whole")), "tops")
    both = low.join(top, F.col("_lang").eqNullSafe(F.col("_name")))
    return both.select(
        F.col("_by").alias(by), F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"),
        F.concat("steps", "more").alias("steps"), F.coalesce("found", "node").alias("found"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with hex digests, ``proof_sha256``, ``folded_root`` and ``verified``."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")
    whole = rows.withColumn("folded_root", folded(F.col("found"), F.col("steps")))
    digests = {c: _hex(F.col(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    whole = whole.withColumns({"proof_sha256": F.sha2(siblings, 256), "verified": F.col("folded_root") == F.col("root")} | digests)
    return whole.drop("steps", "found")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": more}, marked)
    return verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: DuckDB has no crc32: its table and the fold over the digits of an id are stated here.
SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k))),
framed AS (
  SELECT doc_id, lang, text, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS marked
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN marked AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || tail) END AS other
  FROM framed),
low AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, lang, pos, n, leaf AS node FROM low
  UNION ALL
  SELECT level + 1, lang, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 2),
roots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM roots
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
siblings AS (
  SELECT l.lang, l.pos, s.level, (l.pos >> s.level) & 1 AS slot, coalesce(o.node, '') AS node
  FROM low l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.pos = l.pos >> s.level AND s.n > 1
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = s.level AND o.pos = xor(s.pos, 1)
  UNION ALL
  SELECT l.lang, l.pos, 1000 + s.level, (r.pos >> s.level) & 1, coalesce(o.node, '')
  FROM low l JOIN roots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN tops s ON s.pos = r.pos >> s.level AND s.n > 1
  LEFT JOIN tops o ON o.level = s.level AND o.pos = xor(s.pos, 1)),
paths AS (
  SELECT lang, pos, sha256(string_agg(node, '' ORDER BY level)) AS proof_sha256, list(slot || node ORDER BY level) AS steps FROM siblings GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, r.subroot, w.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(l.other, l.leaf), coalesce(p.steps, [])), lambda acc, s: CASE WHEN s[1] = '1' THEN sha256(s[2:] || acc) ELSE sha256(acc || s[2:]) END) AS folded_root,
       folded_root = root AS verified
FROM low l JOIN roots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT node FROM tops WHERE n = 1) w ON true
LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
"""
