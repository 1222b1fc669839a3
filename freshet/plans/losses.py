"""Queries of claim cleaning, matching, economics and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import claims as c
from ..operators import metrics as m
from ..sources import fixtures as fx
from .claims import _CAT
from .metrics import sq
from .registry import query, rounded

CL, G = fx.SQL_CLAIMS, fx.SQL_GRIDS
#: Claims as they arrive: names of another spelling, text for numbers, some of them bad.
RAW = f"""SELECT claim_id, CASE WHEN claim_id % 11 = 0 THEN 'n/a' ELSE (longitude * 1.5)::VARCHAR END AS Lon, latitude::VARCHAR AS y_coord, date_of_loss::VARCHAR AS "Loss Date",
  CASE WHEN claim_id % 13 = 0 THEN NULL ELSE amount_paid::VARCHAR END AS Paid_Amount, CASE WHEN claim_id % 7 = 0 THEN 'Wind and rain' WHEN claim_id % 5 = 0 THEN NULL ELSE 'Flood' END AS cause_of_damage FROM ({CL})"""


def raw(spark, d):
    x, i = fx.claims(spark, d), F.col("claim_id")
    return x.select(
        "claim_id",
        F.when(i % 11 == 0, "n/a").otherwise((F.col("longitude") * 1.5).cast("string")).alias("Lon"),
        F.col("latitude").cast("string").alias("y_coord"),
        F.col("date_of_loss").cast("string").alias("Loss Date"),
        F.when(i % 13 != 0, F.col("amount_paid").cast("string")).alias("Paid_Amount"),
        F.when(i % 7 == 0, "Wind and rain").when(i % 5 != 0, "Flood").alias("cause_of_damage"),
    )


@query("prj_canonical_columns", f'SELECT claim_id, Lon AS longitude, y_coord AS latitude, "Loss Date" AS date_of_loss, Paid_Amount AS amount_paid, cause_of_damage FROM ({RAW})')
def prj_canonical_columns(spark, d):
    return c.canonical_columns(raw(spark, d))


CLEAN = f"""SELECT claim_id, longitude, latitude, date_of_loss, amount_paid, {_CAT} AS damage_category, 1 AS has_claim FROM (SELECT claim_id, try_cast(Lon AS DOUBLE) AS longitude, y_coord::DOUBLE AS latitude, "Loss Date"::DATE AS date_of_loss,
  Paid_Amount::DOUBLE AS amount_paid, cause_of_damage FROM ({RAW})) WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AND amount_paid >= 2000 AND NOT coalesce(regexp_matches(lower(cause_of_damage), 'wind|hurricane|tornado|storm'), false)"""


def clean(spark, d):
    return c.clean_claims(c.canonical_columns(raw(spark, d)), 2000.0).drop("cause_of_damage")


@query("prj_clean_claims", CLEAN)
def prj_clean_claims(spark, d):
    return clean(spark, d)


_CELLS = "SELECT row, col, avg(value) AS value FROM (SELECT * FROM ({})) GROUP BY 1, 2".format(G)
_MATCH = f"SELECT claim_id, amount_paid, k.row, k.col, value FROM (SELECT *, floor((60.5 - latitude) / 2.5)::INT AS row, floor((longitude + 80.5) / 2.5)::INT AS col, (60.5 - latitude) / 2.5 AS y, (longitude + 80.5) / 2.5 AS x FROM ({CLEAN})) p JOIN ({_CELLS}) k USING (row, col) WHERE x <> floor(x) AND y <> floor(y)"


def _matched(spark, d):
    cells = fx.cells(spark, d, 50).groupBy("row", "col").agg(F.avg("value").alias("value"))
    return c.match_points(clean(spark, d), cells, -80.5, 60.5, 2.5)


@query("join_match_points", sq(_MATCH, "claim_id row col", "amount_paid value"))
def join_match_points(spark, d):
    return rounded(_matched(spark, d).select("claim_id", "row", "col", "amount_paid", "value"))


_EC = f"""SELECT sum(amount_paid) AS total, avg(amount_paid) AS mean, max(amount_paid) AS largest, quantile_cont(amount_paid, 0.5) AS median, count(*) AS claims, count(*) FILTER (damage_category = 'minimal') / count(*) AS minimal_share,
  count(*) FILTER (damage_category = 'moderate') / count(*) AS moderate_share, count(*) FILTER (damage_category = 'substantial') / count(*) AS substantial_share, count(*) FILTER (damage_category = 'severe') / count(*) AS severe_share FROM ({CLEAN})"""


@query("agg_claim_economics", "SELECT claims, {} FROM ({})".format(", ".join(f"round({x}, 3) + 0.0::DOUBLE AS {x}" for x in "total mean largest median minimal_share moderate_share substantial_share severe_share".split()), _EC))
def agg_claim_economics(spark, d):
    claims = clean(spark, d)
    median = c.median_by_ranges(claims, "amount_paid").withColumnRenamed("value", "median")
    return rounded(c.claim_economics(claims).crossJoin(median), 3)


_HIT = f"SELECT damage_category AS case_id, abs(value) * 20 AS pred, CASE WHEN amount_paid > 100000 THEN 1.0 ELSE 0.0 END AS obs, amount_paid FROM (SELECT m.*, damage_category FROM ({_MATCH}) m JOIN ({CLEAN}) USING (claim_id))"
_HM = f"""SELECT count(*) AS claims, count(*) FILTER (pred > 0.5 AND obs > 0.5) AS tp, count(*) FILTER (pred > 0.5 AND obs <= 0.5) AS fp, count(*) FILTER (pred <= 0.5 AND obs <= 0.5) AS tn, count(*) FILTER (pred <= 0.5 AND obs > 0.5) AS fn,
  covar_pop(pred, amount_paid) / (stddev_pop(pred) * stddev_pop(amount_paid)) AS correlation FROM ({_HIT})"""


@query("agg_claim_metrics", sq(_HM, "claims tp fp tn fn", "correlation"))
def agg_claim_metrics(spark, d):
    """Hits of deep cells on large claims, and how depth and amount go together."""
    x = _matched(spark, d).select(F.lit(0).alias("case_id"), (F.abs("value") * 20).alias("pred"), (F.col("amount_paid") > 100000).cast("double").alias("obs"), "amount_paid")
    both = x.groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"), m.pearson(F.col("pred"), F.col("amount_paid")).alias("correlation"))
    return rounded(both.join(m.confusion(x), "case_id").drop("case_id"))


_BYC = f"SELECT damage_category AS category, count(*) AS claims, avg(value) AS mean_depth, avg(m.amount_paid) AS mean_amount, count(*) / sum(count(*)) OVER () AS share FROM ({_MATCH}) m JOIN ({CLEAN}) USING (claim_id) GROUP BY 1"


@query("agg_by_category_depth", sq(_BYC, "category claims", "mean_depth mean_amount share"))
def agg_by_category_depth(spark, d):
    by = _matched(spark, d).groupBy(F.col("damage_category").alias("category"))
    got = by.agg(F.count(F.lit(1)).alias("claims"), F.avg("value").alias("mean_depth"), F.avg("amount_paid").alias("mean_amount"))
    total = got.agg(F.sum("claims").alias("total"))  # one row
    return rounded(got.crossJoin(F.broadcast(total)).withColumn("share", F.col("claims") / F.col("total")).drop("total"))


_RATE = f"SELECT (SELECT count(*) FROM ({_MATCH})) AS matched, count(*) AS claims, (SELECT count(*) FROM ({_MATCH})) / greatest(count(*), 1) AS matching_rate FROM ({CLEAN})"


@query("agg_matching_rate", sq(_RATE, "matched claims", "matching_rate"))
def agg_matching_rate(spark, d):
    matched = _matched(spark, d).agg(F.count(F.lit(1)).alias("matched"))
    both = clean(spark, d).agg(F.count(F.lit(1)).alias("claims")).crossJoin(matched)  # one row each
    return rounded(both.withColumn("matching_rate", F.col("matched") / F.greatest("claims", F.lit(1))))


_CUT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("join_retain_results", f"SELECT event_id, user_id AS run_id FROM events ANTI JOIN (SELECT run_id FROM (SELECT user_id AS run_id, min(ts) AS ts FROM events GROUP BY 1) WHERE ts < TIMESTAMP '2024-01-01 06:00:00') r ON r.run_id = user_id")
def join_retain_results(spark, d):
    """Results whose run (a user's first event) is not old."""
    events = fx.table(spark, d, "events")
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("ts"))
    cutoff = F.lit("2024-01-01 06:00:00").cast("timestamp")
    alerts = events.select("event_id", "ts", (F.col("event_type") != "error").alias("resolved"))
    _, kept, _ = c.retain(runs, events.select("event_id", F.col("user_id").alias("run_id")), alerts, cutoff)
    return kept.select("event_id", "run_id")


@query("join_retain_alerts", f"SELECT event_id, ts FROM events WHERE event_type = 'error' OR ts >= {_CUT}")
def join_retain_alerts(spark, d):
    """Alerts still open, or not old."""
    events = fx.table(spark, d, "events")
    alerts = events.select("event_id", "ts", (F.col("event_type") != "error").alias("resolved"))
    runs = events.select(F.col("user_id").alias("run_id"), "ts")
    _, _, kept = c.retain(runs, runs, alerts, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return kept.select("event_id", "ts")


@query("qc_outliers_z", f"SELECT claim_id FROM (SELECT *, abs(amount_paid - avg(amount_paid) OVER ()) / stddev_pop(amount_paid) OVER () AS z FROM ({CL})) WHERE z > 1.5")
def qc_outliers_z(spark, d):
    claims = fx.claims(spark, d)
    stats = claims.agg(F.avg("amount_paid").alias("mu"), F.stddev_pop("amount_paid").alias("sd"))  # one row
    return claims.crossJoin(F.broadcast(stats)).where(F.abs(F.col("amount_paid") - F.col("mu")) / F.col("sd") > 1.5).select("claim_id")


_MZ = f"WITH m AS (SELECT quantile_cont(amount_paid, 0.5) AS med FROM ({CL})), a AS (SELECT quantile_cont(abs(amount_paid - med), 0.5) AS mad FROM ({CL}), m) SELECT claim_id FROM ({CL}), m, a WHERE 0.6745 * abs(amount_paid - med) / mad > 1.2"


@query("qc_outliers_modified_z", _MZ)
def qc_outliers_modified_z(spark, d):
    claims = fx.claims(spark, d).select("claim_id", "amount_paid")
    med = c.median_by_ranges(claims, "amount_paid").withColumnRenamed("value", "med")
    off = claims.crossJoin(F.broadcast(med)).withColumn("off", F.abs(F.col("amount_paid") - F.col("med")))
    mad = c.median_by_ranges(off, "off").withColumnRenamed("value", "mad")
    return off.crossJoin(F.broadcast(mad)).where(0.6745 * F.col("off") / F.col("mad") > 1.2).select("claim_id")


@query("prj_overall_grade", "SELECT doc_id % 50 AS report_id, CASE WHEN avg(p) >= 3.5 THEN 'A' WHEN avg(p) >= 2.5 THEN 'B' WHEN avg(p) >= 1.5 THEN 'C' WHEN avg(p) >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM (SELECT doc_id, CASE WHEN s >= 0.9 THEN 4 WHEN s >= 0.8 THEN 3 WHEN s >= 0.7 THEN 2 WHEN s >= 0.6 THEN 1 ELSE 0 END AS p FROM (SELECT doc_id, 1 - n_chars / 20000.0::DOUBLE AS s FROM documents)) GROUP BY 1")
def prj_overall_grade(spark, d):
    docs = fx.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("report_id"), rules.grade(1 - F.col("n_chars") / 20000.0).alias("g"))
    return docs.groupBy("report_id").agg(rules.overall_grade(F.avg(rules.grade_points(F.col("g")))).alias("grade"))


@query("prj_convert_units", "SELECT p_partkey, round(p_retailprice * 25.4, 6) AS mm, round(p_retailprice * 0.0254, 6) AS m, round(p_retailprice * 0.001, 6) AS from_mm, p_retailprice AS unknown FROM part")
def prj_convert_units(spark, d):
    v, of = F.col("p_retailprice"), rules.convert_units
    return fx.table(spark, d, "part").select("p_partkey", F.round(of(v, "inches", "mm"), 6).alias("mm"), F.round(of(v, "inches", "m"), 6).alias("m"), F.round(of(v, "mm", "m"), 6).alias("from_mm"), of(v, "mm", "feet").alias("unknown"))


@query("prj_clean_depth", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN v < 0.01 THEN 0 ELSE least(v, 100) END::DOUBLE AS depth FROM (SELECT event_id, event_type, round(value - 20, 2) AS v FROM events)")
def prj_clean_depth(spark, d):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.round(F.col("value") - 20, 2))
    return fx.table(spark, d, "events").select("event_id", rules.clean_depth(v, 0.01, 100.0).alias("depth"))


_LAB = "CASE m " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules.DURATIONS.items()) + " ELSE m || '-min' END"


@query("prj_duration_label", f"SELECT o_orderkey, {_LAB} AS label, m AS minutes FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 ELSE [5, 60, 1440, 86400][o_orderkey % 4 + 1] END AS m FROM orders)")
def prj_duration_label(spark, d):
    """Minutes to a label and back."""
    i = F.col("o_orderkey")
    m = F.when(i % 3 == 0, i % 100).otherwise(F.get(F.array(*[F.lit(x) for x in (5, 60, 1440, 86400)]), (i % 4).cast("int")).cast("long"))
    x = fx.table(spark, d, "orders").select("o_orderkey", rules.duration_label(m).alias("label"))
    return x.withColumn("minutes", rules.duration_minutes(F.col("label")))
