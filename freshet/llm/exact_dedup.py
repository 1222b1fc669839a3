"""Exact deduplication by a heavy-hitter split.

A frequent-items sketch (the Misra-Gries family, mergeable, of fixed size)
names digests that may be frequent. Their exact counts and the rows that stay
are aggregated with map-side combining, and the verified winners, at most
``max_heavy`` rows, are broadcast so that rows of the largest groups are
resolved where they lie. All other digests take an ordinary shuffle, in which
no group can be larger than about ``rows / max_heavy``.

Defined results: a null text counts as empty; texts are equal when identical
after deleting ``[\\x20\\x09-\\x0D]``; of equal texts the one with the most code
points stays, then the smallest id, a null id last. Of rows that also repeat
the id exactly one is kept. Very long texts are hashed whole. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_SPACE = r"[\x20\x09-\x0D]+"
_NO_ID = 9223372036854775807


def heavy_digests(rows: DataFrame, max_heavy: int) -> DataFrame:
    """At most ``max_heavy`` short digests that may be frequent: the sketch's answer as rows."""
    sketch = F.expr(f"approx_top_k(short, {max_heavy}, {max_heavy * 16})")
    return rows.agg(sketch.alias("top")).select(F.explode("top.item").alias("short"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_heavy: int = 512,
    min_heavy: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``max_heavy`` bounds the broadcast; a digest counts as heavy when its exact
    count is ``min_heavy`` or more. Neither changes the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.char_length(text).cast("long").alias("n"),
            F.unhex(F.sha2(F.regexp_replace(text, _SPACE, ""), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("short", F.xxhash64("digest")),
        "rows",
    )

    # the row that stays has the largest n, then the smallest id, then the first place; ~x falls as x rises, for every long
    rank = F.struct(
        F.col("n"), F.bitwise_not(F.coalesce("doc_id", F.lit(_NO_ID))).alias("neg"), F.col("doc_id").isNotNull().alias("known"),
        (-F.col("row")).alias("place"), F.col("doc_id"),
    )
    groups = [F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("best")]
    maybe = F.broadcast(heavy_digests(rows, max_heavy))
    winners = (
        rows.join(maybe, "short", "left_semi").groupBy("digest").agg(*groups).where(F.col("group_size") >= min_heavy)
    )
    winners = scratch.keep(winners, "winners")  # at most max_heavy rows

    split = rows.join(F.broadcast(winners), "digest", "left")
    heavy = split.where(F.col("group_size").isNotNull())
    light = split.where(F.col("group_size").isNull()).select("digest", "n", "doc_id", "row")
    light = light.join(light.groupBy("digest").agg(*groups), "digest")
    both = heavy.select("digest", "doc_id", "row", "group_size", "best").unionByName(light.drop("n"))
    return both.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id
  FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
