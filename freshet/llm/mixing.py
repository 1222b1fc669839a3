"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domain, language and source. A node's budget
is shared among its children in proportion to their weights, but no child gets
more than its subtree can give (its tokens times ``max_epochs``); what a child
cannot take goes to its siblings, by weight, until they are full too. A node is
only ever given what its subtree holds, so a shortage is settled among siblings
before it reaches an ancestor. Shares are whole tokens: each is the difference
of two rounded running totals, so they add up to the node's budget.

A leaf's budget is met by whole epochs of all its documents and a token-prefix
of one more epoch, whose order is by ``md5(seed:epoch:id)``. The prefix is found
in two steps, totals of hash ranges and then an order within the one range that
the budget cuts, so no leaf is ever sorted in one task.

Defined results: a null lang, source or domain is a leaf of its own ('' in the
result); a null text has no words and is never chosen, nor is any text without
words; a null id is ordered like the text 'null'; rows that repeat an id are
ordered by token count, the tie-break of equal draws too. Words of a very long
text are counted over the whole of it. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

LEVELS = ["domain", "lang", "source"]


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: none."""
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    return F.coalesce(F.size(F.array_remove(words, "")), F.lit(0))


def source_domain(source: Column) -> Column:
    """The domain of a source: three families by its number, and one for names without."""
    number = F.try_to_number(F.regexp_extract(source, "^src([0-9]{1,6})$", 1), F.lit("999999")).cast("int")
    return F.when(number.isNull(), "other").when(number < 5, "web").when(number < 12, "reference").otherwise("forum")


def share(children: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """Add ``given``: each child's share of its parent's ``budget``; needs ``cap`` and ``weight``.

    Children are taken by falling weight for what they hold; the first that can
    hold its proportional share of what is left ends the full ones, and all from
    there on take in proportion.
    """
    order = [F.col("cap") / F.col("weight"), "name"]
    above = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*parents).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    upto = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = F.col(budget) - F.coalesce(F.sum("cap").over(above), F.lit(0))
    rest = F.sum("weight").over(below)
    ranked = (
        children.withColumn("left", left)
        .withColumn("rest", rest)
        .withColumn("full", F.col("cap") * F.col("rest") <= F.col("left") * F.col("weight"))
        .withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
        .withColumn("open_upto", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(upto))
    )
    open_budget = F.greatest(F.col(budget) - F.col("full_cap"), F.lit(0))

    def running(w: Column) -> Column:
        """Whole tokens of the open budget up to a running weight; all integers."""
        return F.floor(F.try_divide(open_budget.cast("decimal(30,0)") * w.cast("decimal(8,0)"), F.col("open_weight").cast("decimal(8,0)")))

    part = running(F.col("open_upto")) - running(F.col("open_upto") - F.col("weight"))
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0))).cast("long")
    return ranked.withColumn("given", F.least(given, F.col("cap"))).drop("left", "rest", "full", "full_cap", "open_weight", "open_upto")


def leaf_budgets(leaves: DataFrame, share_num: int, share_den: int, max_epochs: int, weights: dict[str, int]) -> DataFrame:
    """``domain, lang, source, tokens, budget`` of each leaf, from its ``tokens``.

    The total budget is ``share_num / share_den`` of all tokens. ``weights`` has
    whole-number weights by node name; others weigh 1.
    """
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None

    def weight(level: str) -> Column:
        return F.coalesce(F.try_element_at(given, F.col(level)), F.lit(1)).cast("long") if weights else F.lit(1).cast("long")

    budgets = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share_num / share_den).cast("long").alias("budget"))
    for k, level in enumerate(LEVELS):
        path = LEVELS[: k + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("long").alias("cap"))
        nodes = nodes.withColumn("weight", weight(level)).withColumn("name", F.col(level))
        nodes = nodes.join(budgets, path[:-1]) if k else nodes.crossJoin(F.broadcast(budgets))  # one row
        parents = path[:-1] if k else ["root"]
        nodes = share(nodes.withColumn("root", F.lit(0)), parents, "budget")
        budgets = nodes.select(*path, F.col("given").alias("budget"))
    return leaves.join(budgets, LEVELS)


def mix(
    docs: DataFrame,
    share_num: int = 1,
    share_den: int = 2,
    max_epochs: int = 2,
    seed: int = 20,
    weights: dict[str, int] | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """Chosen documents: doc_id, domain, lang, source, epoch, n_tokens, taken.

    ``taken`` is less than ``n_tokens`` only for the document that the leaf's
    budget cuts. Columns needed: doc_id, text, lang, source.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    domain = source_domain(F.col("source")) if domain is None else domain
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(LEVELS, [domain, F.col("lang"), F.col("source")], strict=True)],
        count_words(F.col("text")).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0")
    rows = scratch.keep(rows, "tokens")
    leaves = scratch.keep(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budgets = leaf_budgets(leaves, share_num, share_den, max_epochs, weights or {})
    budgets = budgets.select(
        *LEVELS,
        F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"),
        F.expr("budget % tokens").alias("part"),
    ).where("epochs > 0 or part > 0")
    budgets = scratch.keep(budgets, "budgets")

    chosen = rows.join(budgets, LEVELS)
    cols = ["doc_id", *LEVELS, "epoch", "n_tokens", "taken"]
    whole = chosen.where("epochs > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    whole = whole.withColumn("taken", F.col("n_tokens")).select(*cols)

    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    last = chosen.where("part > 0").withColumn("draw", draw).withColumn("range", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    sums = last.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("range_tokens"))  # at most 4096 a leaf
    ahead = F.sum("range_tokens").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = scratch.keep(sums.withColumn("before", F.coalesce(ahead, F.lit(0))), "ranges")
    last = last.join(sums.drop("range_tokens"), [*LEVELS, "range"]).where("before < part")
    within = Window.partitionBy(*LEVELS, "range").orderBy("draw", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    cut = last.withColumn("start", start).where("start < part")
    cut = cut.withColumn("taken", F.least("n_tokens", F.col("part") - F.col("start"))).withColumn("epoch", F.col("epochs"))
    return whole.unionByName(cut.select(*cols))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, share_num=1, share_den=2, max_epochs=2, seed=20, weights=WEIGHTS)


#: The production weights: text from the web domain and in English counts double.
WEIGHTS = {"web": 2, "en": 2, "src0": 1}


def _sql() -> str:
    def level(k: int) -> str:
        path = LEVELS[: k + 1]
        keys, parent = ", ".join(path), ", ".join(path[:-1]) or "1"
        case = " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS.items())
        source = f"n{k} JOIN b{k - 1} USING ({', '.join(path[:-1])})" if k else f"n{k}, total"
        return f"""
n{k} AS (SELECT {keys}, (sum(tokens) * 2)::BIGINT AS cap, CASE {path[-1]} {case} ELSE 1 END AS weight FROM leaves GROUP BY {keys}),
r{k} AS (SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source}),
f{k} AS (SELECT *, cap * rest <= lft * weight AS is_full FROM r{k}),
g{k} AS (SELECT *, greatest(budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}), 0) AS open_budget,
  sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_weight,
  sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent} ORDER BY cap / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f{k}),
b{k} AS (SELECT {keys}, (CASE WHEN is_full THEN cap ELSE least(cap, (open_budget * upto) // open_weight - (open_budget * (upto - weight)) // open_weight) END)::BIGINT AS budget FROM g{k}),"""

    keys = ", ".join(LEVELS)
    return f"""
WITH t AS (SELECT doc_id, CASE WHEN NOT regexp_full_match(coalesce(source, ''), 'src[0-9]{{1,6}}') THEN 'other' WHEN substr(source, 4)::INT < 5 THEN 'web'
    WHEN substr(source, 4)::INT < 12 THEN 'reference' ELSE 'forum' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT * FROM t WHERE n_tokens > 0),
leaves AS (SELECT {keys}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY {keys}),
total AS (SELECT (sum(tokens) // 2)::BIGINT AS budget FROM leaves),{level(0)}{level(1)}{level(2)}
c AS (SELECT d.*, (budget // tokens)::INT AS epochs, budget % tokens AS part FROM d JOIN leaves USING ({keys}) JOIN b2 USING ({keys})),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY md5('20:' || epochs || ':' || doc_id), n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c WHERE part > 0)
SELECT doc_id, {keys}, epoch::INT AS epoch, n_tokens, n_tokens AS taken FROM (SELECT *, unnest(range(0, epochs)) AS epoch FROM c WHERE epochs > 0)
UNION ALL SELECT doc_id, {keys}, epochs, n_tokens, least(n_tokens, part - start) FROM p WHERE start < part
"""


SQL = _sql()
