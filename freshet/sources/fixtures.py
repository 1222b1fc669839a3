"""The operators' table shapes, derived from the given tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import to_digits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of about so many rows: a small file whose rows are exploded would else be one task's work."""
    n = df.count()
    return df.repartition(-(-n // rows), key) if n > rows else df


def cells(spark, sf_dir: str, rows_per_grid: int | None = None) -> DataFrame:
    """``grid_id, row, col, value``: embeddings as one grid, or as grids of so many rows."""
    dense = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    if rows_per_grid is None:
        grid, row = F.lit(0).cast("long"), F.col("vec_id")
    else:
        grid, row = F.floor(F.col("vec_id") / rows_per_grid), F.col("vec_id") % rows_per_grid
    return dense.select(grid.alias("grid_id"), row.cast("int").alias("row"), "col", F.col("v").cast("double").alias("value"))


def depth_pairs(spark, sf_dir: str) -> DataFrame:
    """``case_id, row, col, pred, obs``: a cell's depth and its right neighbour's, 50 rows a case."""
    depth = cells(spark, sf_dir, 50).withColumn("value", F.abs("value") * 8)
    right = depth.select(F.col("grid_id").alias("g"), F.col("row").alias("r"), (F.col("col") - 1).alias("c"), F.col("value").alias("obs"))
    same = (F.col("grid_id") == F.col("g")) & (F.col("row") == F.col("r")) & (F.col("col") == F.col("c"))
    return depth.join(right.hint("merge"), same).select(F.col("grid_id").alias("case_id"), "row", "col", F.col("value").alias("pred"), "obs")


def claims(spark, sf_dir: str) -> DataFrame:
    """Orders as claims, placed by customer."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("claim_id"),
        (F.col("c_custkey") % 360 - 180).cast("double").alias("longitude"),
        (F.col("c_custkey") % 180 - 90).cast("double").alias("latitude"),
        F.to_date("o_orderdate").alias("date_of_loss"),
        F.col("o_totalprice").cast("double").alias("amount_paid"),
        F.col("o_orderpriority").alias("cause_of_damage"),
    )


def scored(spark, sf_dir: str) -> DataFrame:
    """``case_id, score, target``: labelled documents, scored by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("case_id"), "doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"), F.col("quality").cast("int").alias("target")
    )


def runs(spark, sf_dir: str) -> DataFrame:
    """Line items of an order as a simulation's depth statistics."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("simulation_id"))
        .agg(
            F.max(F.col("l_quantity").cast("double")).alias("max_depth"),
            F.avg(F.col("l_quantity").cast("double")).alias("mean_depth"),
            F.count(F.lit(1)).alias("cells"),
            F.min("l_returnflag").alias("status"),
        )
    )


def history(spark, sf_dir: str) -> DataFrame:
    """``component, ts, score``: hourly means of events, scaled to 0..1 over all of them."""
    hourly = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("component"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("mean"))
    )
    ends = hourly.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))  # one row
    scaled = F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo"))
    return hourly.crossJoin(F.broadcast(ends)).select("component", "ts", to_digits(scaled, 9).alias("score"))


def stations(spark, sf_dir: str) -> DataFrame:
    """Customers as rain stations: station_id, nation, x (longitude), y (latitude), value."""
    c = table(spark, sf_dir, "customer")
    x, y = ((F.col("c_custkey") % m - m / 2).cast("double") for m in (360, 180))
    return c.select(F.col("c_custkey").alias("station_id"), F.col("c_nationkey").alias("nation"), x.alias("x"), y.alias("y"), F.col("c_acctbal").alias("value"))


#: A station has sixteen depths, and some queries make hundreds of rows of each.
STATIONS_A_TASK = 5000


def ddf(spark, sf_dir: str) -> DataFrame:
    """A frequency table: 24-hour depths by period, by the root of the duration's share of a day, higher where the balance is."""
    known = {10: 4.5, 25: 5.2, 100: 6.4, 500: 7.8}
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(b).alias("b")) for m in (60, 180, 360, 1440) for p, b in known.items()]))
    rows = spread(stations(spark, sf_dir).select("station_id", "value"), "station_id", STATIONS_A_TASK).select("station_id", "value", both.alias("k"))
    depth = F.col("k.b") * F.sqrt(F.col("k.m") / 1440) * F.sqrt(1 + F.col("value") / 50000)
    return rows.select("station_id", F.col("k.m").alias("duration_minutes"), F.col("k.p").alias("return_period_years"), to_digits(depth, 9).alias("depth_in"))


def requests(spark, sf_dir: str) -> DataFrame:
    """Orders as requests for a depth: request_id, station_id, duration_minutes, return_period_years."""
    pick = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("station_id"),
        pick([60, 180, 720, 1440], "o_orderkey").alias("duration_minutes"),
        pick([10, 25, 100, 500, 1000], "o_orderkey").alias("return_period_years"),
    )


#: The same in DuckDB.
SQL_STATIONS = "SELECT c_custkey AS station_id, c_nationkey AS nation, (c_custkey % 360 - 180)::DOUBLE AS x, (c_custkey % 180 - 90)::DOUBLE AS y, c_acctbal AS value FROM customer"
SQL_DDF = f"""SELECT station_id, m AS duration_minutes, p AS return_period_years, round(b * sqrt(m / 1440::DOUBLE) * sqrt(1 + value / 50000), 9) AS depth_in
  FROM ({SQL_STATIONS}), (VALUES (60), (180), (360), (1440)) a(m), (VALUES (10, 4.5::DOUBLE), (25, 5.2::DOUBLE), (100, 6.4::DOUBLE), (500, 7.8::DOUBLE)) c(p, b)"""
SQL_REQUESTS = """SELECT o_orderkey AS request_id, o_custkey AS station_id, [60, 180, 720, 1440][o_orderkey % 4 + 1] AS duration_minutes,
  [10, 25, 100, 500, 1000][o_orderkey % 5 + 1] AS return_period_years FROM orders"""
SQL_CELLS = """SELECT 0::BIGINT AS grid_id, vec_id::INT AS row, col::INT AS col, v::DOUBLE AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings)"""
SQL_GRIDS = f"SELECT row // 50 AS grid_id, (row % 50)::INT AS row, col, value FROM ({SQL_CELLS})"
SQL_PAIRS = f"""SELECT a.grid_id AS case_id, a.row, a.col, abs(a.value) * 8 AS pred, abs(b.value) * 8 AS obs
  FROM ({SQL_GRIDS}) a JOIN ({SQL_GRIDS}) b ON a.grid_id = b.grid_id AND a.row = b.row AND a.col = b.col - 1"""
SQL_CLAIMS = """SELECT o_orderkey AS claim_id, (c_custkey % 360 - 180)::DOUBLE AS longitude, (c_custkey % 180 - 90)::DOUBLE AS latitude,
  o_orderdate::DATE AS date_of_loss, o_totalprice::DOUBLE AS amount_paid, o_orderpriority AS cause_of_damage
  FROM orders JOIN customer ON o_custkey = c_custkey"""
SQL_SCORED = """SELECT lang AS case_id, doc_id, least(n_chars / 20000.0::DOUBLE, 1.0::DOUBLE) AS score, quality::INT AS target
  FROM documents JOIN labels USING (doc_id)"""
SQL_RUNS = """SELECT l_orderkey AS simulation_id, max(l_quantity::DOUBLE) AS max_depth, avg(l_quantity::DOUBLE) AS mean_depth,
  count(*) AS cells, min(l_returnflag) AS status FROM lineitem GROUP BY 1"""
SQL_HISTORY = """SELECT component, ts, round((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()), 9) AS score
  FROM (SELECT event_type AS component, date_trunc('hour', ts) AS ts, avg(value) AS mean FROM events GROUP BY 1, 2)"""
