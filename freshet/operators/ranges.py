"""Ranks, running sums and exact quantiles of groups of any size, by ranges of values.

A sketch of a large group's values gives cut points of about equal shares; rows
are counted by range, and the ranges' running totals move what is ranked or
summed within one range. Cut points only spread the work: a poor sketch makes
ranges uneven, never a result wrong. Values that are equal are one row before
they are ordered, so no range holds more than its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Rounds

#: Groups up to so many rows are ordered in one piece.
SMALL = 8192
#: Tables of so many large groups at most (8 KB of cut points each) go to every task.
FEW = 1000
#: Ranges are dealt to tasks of about so many rows.
TASK_ROWS = 250_000
#: Past so many tasks, which a shuffle writes without sorting rows by task in memory, tasks grow to four times the rows first.
UNSORTED = 200


def _key(keys: list[str]) -> Column:
    """Groups by one struct: null keys are a group too, and joins find them."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def large_groups(df: DataFrame, small: int) -> DataFrame | None:
    """``_key`` of groups of more than ``small`` rows; None if there are none, so that nobody plans for them."""
    large = Rounds(df.sparkSession, "large").keep(df.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("_key"))
    return None if (n := large.count()) == 0 else to_tasks(large, n)


def to_tasks(df: DataFrame, groups: int) -> DataFrame:
    """``df``, a few rows for each of so many large groups, as the small side of a join by group.

    The planner takes what is aggregated for about as large as what it came from
    and would send all rows of a group to one task.
    """
    return F.broadcast(df) if groups <= FEW else df


def ranged(df: DataFrame, value: str, small: int = SMALL, levels: int = 10) -> DataFrame:
    """``df`` (_key, value, ...) with ``_range``, which rises with the value: 2^levels ranges of a group of more than ``small`` rows, else one."""
    n, large = 1 << levels, large_groups(df, small)
    if large is None:
        return df.withColumn("_range", F.lit(0))
    shares = ", ".join(f"{k / n}D" for k in range(1, n))
    cuts = df.join(large, "_key", "left_semi").groupBy("_key").agg(F.expr(f"percentile_approx({value}, array({shares}), {10 * n})").alias("_cuts"))
    cuts = to_tasks(Rounds(df.sparkSession, "cuts").keep(cuts), large.count())
    x = df.join(cuts, "_key", "left").withColumn("_range", F.lit(0))
    for s in (1 << k for k in range(levels - 1, -1, -1)):  # halves; a step is a projection of its own, since a function of arrays would copy the cuts for each row
        x = x.withColumn("_range", F.col("_range") + F.when(F.col(value) > F.get("_cuts", F.col("_range") + (s - 1)), s).otherwise(0))
    return x.drop("_cuts")


def running(df: DataFrame, keys: list[str], value: str, sums: list[str], down: bool = False, small: int = SMALL, levels: int = 10) -> DataFrame:
    """``df``, one row for each of ``keys`` and ``value``, with ``<s>_before`` (the sum of ``s`` over smaller values) and ``<s>_whole`` for each of ``sums``.

    ``down``: over larger values. No task holds more than a few ranges of a group.
    Rows come in the order of ``_key`` (``keys``) and ``_range``, each pair in one
    task: what is grouped by both is neither moved nor sorted again.
    """
    rounds = Rounds(df.sparkSession, "running")
    kept = rounds.keep(df.withColumn("_key", _key(keys)))  # read several times
    turn = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if large_groups(kept, small) is None:
        own = Window.partitionBy("_key")
        before = {f"{s}_before": F.coalesce(F.sum(s).over(earlier(own.orderBy(turn(value)))), F.lit(0)) for s in sums}
        return kept.withColumns(before | {f"{s}_whole": F.sum(s).over(own) for s in sums}).withColumn("_range", F.lit(0))
    x = ranged(kept, value, small, levels)
    totals = x.groupBy("_key", "_range").agg(*[F.sum(s).alias(f"{s}_in") for s in sums])  # a row for each range
    by = Window.partitionBy("_key")
    totals = totals.select(
        "_key", "_range", *[F.coalesce(F.sum(f"{s}_in").over(earlier(by.orderBy(turn("_range")))), F.lit(0)).alias(f"{s}_start") for s in sums],
        *[F.sum(f"{s}_in").over(by).alias(f"{s}_whole") for s in sums],
    )
    totals = rounds.keep(totals)
    tasks = -(-kept.count() // TASK_ROWS)
    x = x.repartition(max(min(tasks, UNSORTED), -(-tasks // 4)), "_key", "_range")
    inner = earlier(Window.partitionBy("_key", "_range").orderBy(turn(value)))
    x = x.withColumns({f"{s}_inner": F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums}).join(totals, ["_key", "_range"])
    x = x.withColumns({f"{s}_before": F.col(f"{s}_start") + F.col(f"{s}_inner") for s in sums})
    return x.drop(*[f"{s}_{c}" for s in sums for c in ("start", "inner")])


def _large_quantiles(x: DataFrame, probabilities: list[float], small: int, levels: int) -> DataFrame:
    """``_key, q`` of large groups: only ranges that hold a wanted rank are ordered."""
    x = ranged(x, "v", small, levels)
    by = Window.partitionBy("_key")
    totals = x.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_key", "_range", "m", before.alias("before"), F.sum("m").over(by).alias("n"))
    wanted = totals.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("i", "p"))
    at = (F.col("n") - 1) * F.col("p")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.floor(at) + 1, F.col("n") - 1).alias("rank")))
    wanted = wanted.select("_key", "_range", "before", "m", "i", (at - F.floor(at)).alias("part"), F.explode(ends).alias("e"))
    wanted = wanted.select("_key", "_range", "before", "m", "i", "part", "e.*").where("before <= rank and rank < before + m").drop("m")
    wanted = Rounds(x.sparkSession, "wanted").keep(wanted)  # its size is known now: it goes to the rows, not they to it
    held = x.join(wanted.select("_key", "_range").distinct(), ["_key", "_range"], "left_semi").groupBy("_key", "_range", "v").agg(F.count(F.lit(1)).alias("k"))
    inner = Window.partitionBy("_key", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("inner", F.coalesce(F.sum("k").over(inner), F.lit(0)))
    low = F.col("before") + F.col("inner")
    found = held.join(wanted, ["_key", "_range"]).where((low <= F.col("rank")) & (F.col("rank") < low + F.col("k")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    got = found.groupBy("_key", "i").agg(side(0).alias("a"), side(1).alias("b"), F.max("part").alias("part"))
    between = F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")
    got = got.select("_key", "i", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("x"))
    return got.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))


def quantiles(df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], small: int = SMALL, levels: int = 10) -> DataFrame:
    """``keys`` and, for each of ``columns``, ``<c>_q``: the exact quantiles at ``probabilities``, interpolated; null for a group without values.

    Nulls and NaN are left out. Small groups are ordered whole; of large ones,
    counts by range tell which few ranges hold the wanted ranks. The values are
    kept as a table, since they are read several times, and so is the answer, a
    row for each group, so that plans built on it stay short.
    """
    rounds = Rounds(df.sparkSession, "quantiles")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")
    every = rounds.keep(df.select(_key(keys).alias("g"), named))
    long = every.select(F.struct("g", "s.c").alias("_key"), F.col("s.v").alias("v")).where("v is not null and not isnan(v)")
    large = large_groups(long, small)
    little = long if large is None else long.join(large, "_key", "left_anti")
    both = little.groupBy("_key").agg(F.percentile("v", [float(p) for p in probabilities]).alias("q"))
    if large is not None:
        both = both.unionByName(_large_quantiles(long.join(large, "_key", "left_semi"), probabilities, small, levels))
    both = both.unionByName(every.select(F.struct("g", "s.c").alias("_key"), F.lit(None).cast("array<double>").alias("q")).distinct())
    got = both.groupBy(F.col("_key.g").alias("g")).agg(*[F.max(F.when(F.col("_key.c") == c, F.col("q"))).alias(f"{c}_q") for c in columns])
    return rounds.keep(got.select(*[F.col(f"g.{k}").alias(k) for k in keys], *[f"{c}_q" for c in columns]))


def with_quantiles(got: DataFrame, df: DataFrame, keys: list[str], column: str, names: dict[str, float]) -> DataFrame:
    """``got``, a row for each of ``keys``, with quantiles of a column of ``df`` by name."""
    q = quantiles(df, keys, [column], list(names.values())).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = got.join(q, same, "left") if keys else got.crossJoin(F.broadcast(q))  # one row each
    return joined.withColumns({n: F.get(f"{column}_q", F.lit(i)) for i, n in enumerate(names)}).drop(f"{column}_q", *[f"_{k}" for k in keys])
