"""Queries of the readers and writers: tables written as the files they read, and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..sources import files as f
from ..sources import fixtures as fx
from ..sources.scratch import shared_folder
from .losses import CLEAN, RAW, clean, raw
from .registry import query

G = fx.SQL_GRIDS


def _written(spark, files, label: str) -> str:
    """The folder of files written now."""
    folder = shared_folder(spark, label)
    f.write_files(files, folder).count()
    return folder


_SUP = "SELECT s_suppkey, round(s_suppkey % 90 + 0.25, 2) AS latitude, round(-(s_suppkey % 180) - 0.5, 2) AS longitude, s_acctbal FROM supplier"
_PTS = f"SELECT latitude, longitude, m AS duration_minutes, m || '-min' AS duration_label, p AS return_period_years, round(s_acctbal / 100 + p / 10.0::DOUBLE, 3) AS precipitation_inches FROM ({_SUP}), (VALUES (60), (1440)) a(m), (VALUES (10), (100)) b(p)"


@query("src_rain_points", _PTS)
def src_rain_points(spark, d):
    """Suppliers' rain tables as one file each, the place in its name."""
    k = F.col("s_suppkey")
    s = fx.table(spark, d, "supplier").select(F.round(k % 90 + 0.25, 2).alias("lat"), F.round(-(k % 180) - 0.5, 2).alias("lon"), "s_suppkey", "s_acctbal")
    lines = [F.concat_ws(",", F.lit(m), F.lit(f"{m}-min"), F.lit(p), F.round(F.col("s_acctbal") / 100 + p / 10.0, 3).cast("string"), F.lit(0), F.lit(1)) for m in (60, 1440) for p in (10, 100)]
    head = F.lit("duration_minutes,duration_label,return_period_years,precipitation_inches,lower_bound,upper_bound")
    name = F.concat_ws("_", F.concat(F.lit("s"), k.cast("string"), F.lit("/point")), F.col("lat").cast("string"), F.concat(F.col("lon").cast("string"), F.lit(".csv")))
    folder = _written(spark, s.select(name.alias("name"), F.concat_ws("\n", head, *lines).alias("content")), "points")
    return f.read_rain_points(spark, f"{folder}/*").drop("lower_bound", "upper_bound")


_SEC = "SELECT 's' || s_suppkey AS station, section, duration, period, round(s_acctbal / 100 * k * period / 10, 3) AS depth FROM supplier, (VALUES ('estimate', 1), ('upper', 2), ('lower', 3)) a(section, k), (VALUES ('60-min'), ('24-hr')) b(duration), (VALUES (10), (100)) c(period)"


@query("src_rain_sections", _SEC)
def src_rain_sections(spark, d):
    s = fx.table(spark, d, "supplier")
    number = lambda k, p: F.round(F.col("s_acctbal") / 100 * k * p / 10, 3).cast("string")
    parts = [F.concat(F.lit("Station: s"), F.col("s_suppkey").cast("string"))]
    for k, title in enumerate(("Estimates of depth", "Upper bound", "Lower bound"), 1):
        parts += [F.lit(title), F.lit("by duration for period (years):, 10, 100")]
        parts += [F.concat_ws(", ", F.lit(f"{name}:"), number(k, 10), number(k, 100)) for name in ("60-min", "24-hr")]
    files = s.select(F.format_string("station_%s.txt", F.col("s_suppkey").cast("string")).alias("name"), F.concat_ws("\n", *parts).alias("content"))
    return f.read_rain_sections(spark, _written(spark, files, "sections"))


_HOLES = f"SELECT 'grid_' || grid_id AS grid_id, row, col, CASE WHEN value > -0.1 THEN round(value, 6) END AS value FROM ({G})"


def _meta(cells):
    ends = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))
    return ends.withColumns({"xll": F.col("grid_id") * 640.0, "yll": F.lit(0.0), "cellsize": F.lit(10.0)})


@query("src_ascii_grids", _HOLES)
def src_ascii_grids(spark, d):
    """Grids with no-data cells written as ASCII and read back."""
    cells = fx.cells(spark, d, 50).withColumn("value", F.when(F.col("value") > -0.1, F.round("value", 6)))
    return f.read_ascii_grids(spark, _written(spark, f.ascii_grids(cells, _meta(cells)), "ascii"))[0]


@query("snk_ascii_headers", f"SELECT 'grid_' || grid_id AS grid_id, max(row) + 1 AS nrows, max(col) + 1 AS ncols, grid_id * 640.0::DOUBLE AS xll, 0.0::DOUBLE AS yll, 10.0::DOUBLE AS cellsize, -9999.0::DOUBLE AS nodata FROM ({G}) GROUP BY 1, 4, grid_id")
def snk_ascii_headers(spark, d):
    cells = fx.cells(spark, d, 50)
    return f.read_ascii_grids(spark, _written(spark, f.ascii_grids(cells, _meta(cells)), "ascii"))[1]


@query("src_depth_files", "SELECT 'depth_' || vec_id AS grid_id, (k // 8)::INT AS row, (k % 8)::INT AS col, round(greatest(v::DOUBLE, 0), 4) AS value FROM (SELECT vec_id, unnest(embedding)::FLOAT AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def src_depth_files(spark, d):
    """Vectors as files of raw floats; 64 values are 8 x 8 cells."""

    def pack(frames):
        for x in frames:
            yield pd.DataFrame({"name": [f"depth_{i}.bin" for i in x["vec_id"]], "content": [np.asarray(v, "<f4").tobytes() for v in x["embedding"]]})

    files = fx.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "name string, content binary")
    got = f.read_depth_files(spark, _written(spark, files, "depths"))
    return got.withColumn("value", F.round("value", 4))


@query("src_process_files")
def src_process_files(spark, d):
    """A caller's function over many files; those it can't take are rows with their error."""

    def longest(name, content):
        text = content.decode()
        if "error" in text:
            raise ValueError("bad file")
        return pd.DataFrame({"words": [len(text.split())]})

    files = fx.table(spark, d, "pages").select(F.format_string("page_%s.html", F.col("page_id").cast("string")).alias("name"), F.coalesce("html", F.lit("")).alias("content"))
    return f.process_files(spark, _written(spark, files, "pages"), longest, "words long")


@query("src_claims_csv", f'SELECT claim_id::VARCHAR AS claim_id, Lon, y_coord, "Loss Date", Paid_Amount, cause_of_damage FROM ({RAW})')
def src_claims_csv(spark, d):
    folder = shared_folder(spark, "claims")
    raw(spark, d).write.csv(folder, header=True)
    return f.read_claims(spark, folder, "csv")


@query("src_claims_parquet", CLEAN)
def src_claims_parquet(spark, d):
    folder = shared_folder(spark, "claims")
    clean(spark, d).write.parquet(folder)
    return f.read_claims(spark, folder)


_RES = "SELECT event_id AS run_id, 'done' AS status, value AS seconds, [10, 100, 500][event_id % 3 + 1] AS period, event_type AS pattern, value / 10 AS max_depth, unnest(['depth_' || event_id || '.tif', 'extent_' || event_id || '.tif']) AS file FROM events WHERE event_type <> 'error'"


@query("snk_manifest", _RES)
def snk_manifest(spark, d):
    """Runs as a nested manifest, read back flat."""
    i = F.col("event_id").cast("string")
    runs = fx.table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("value").alias("seconds"), F.get(F.array(F.lit(10), F.lit(100), F.lit(500)), (F.col("event_id") % 3).cast("int")).alias("period"),
        F.col("event_type").alias("pattern"), (F.col("value") / 10).alias("max_depth"), F.array(F.concat(F.lit("depth_"), i, F.lit(".tif")), F.concat(F.lit("extent_"), i, F.lit(".tif"))).alias("files"),
    )
    folder = shared_folder(spark, "manifest")
    f.write_manifest(runs, folder)
    return f.read_manifest(spark, folder)


@query("snk_tiles", f"SELECT grid_id AS tile_id, row AS r, col AS c, value, CASE WHEN grid_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM ({G})")
def snk_tiles(spark, d):
    tiles = fx.cells(spark, d, 50).select(F.col("grid_id").alias("tile_id"), F.col("row").alias("r"), F.col("col").alias("c"), "value", F.when(F.col("grid_id") % 5 == 0, "test").otherwise("train").alias("split"))
    folder = shared_folder(spark, "tiles")
    f.write_tiles(tiles, folder)
    return spark.read.parquet(folder)


@query("src_grid_catalog", "SELECT name, period, hours FROM (SELECT 'se' || (p_size * 10) || 'yr' || lpad((p_partkey % 48)::VARCHAR, 2, '0') || 'ha' AS name, (p_size * 10)::INT AS period, (p_partkey % 48)::INT AS hours FROM part WHERE p_partkey % 6 <> 0)")
def src_grid_catalog(spark, d):
    k = F.col("p_partkey")
    good = F.concat(F.lit("se"), (F.col("p_size") * 10).cast("string"), F.lit("yr"), F.lpad((k % 48).cast("string"), 2, "0"), F.lit("ha"))
    return f.grid_catalog(fx.table(spark, d, "part").select(F.when(k % 6 == 0, F.concat(F.lit("readme"), k.cast("string"))).otherwise(good).alias("name")))


@query("src_file_validity", "SELECT 'page_' || page_id || '.html' AS name, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN strlen(coalesce(html, '')) < 2000 THEN 'too small' ELSE 'valid' END AS status FROM pages")
def src_file_validity(spark, d):
    """Pages as files, every seventh not there."""
    name = F.format_string("page_%s.html", F.col("page_id").cast("string")).alias("name")
    pages = fx.table(spark, d, "pages")
    folder = _written(spark, pages.where("page_id % 7 <> 0").select(name, F.coalesce("html", F.lit("")).alias("content")), "pages")
    entries = f.file_entries(spark, folder).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return f.file_validity(pages.select(name), entries, 2000)


@query("src_fresh_entries", "SELECT event_id, ts FROM events WHERE event_id * 10 >= 50 AND ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY")
def src_fresh_entries(spark, d):
    entries = fx.table(spark, d, "events").select("event_id", (F.col("event_id") * 10).alias("length"), F.col("ts").alias("modified"))
    return f.fresh_entries(entries, F.lit("2024-01-25 00:00:00").cast("timestamp"), 10, 50).select("event_id", F.col("modified").alias("ts"))


@query("src_parameter_key", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS cache_key, md5('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS provenance_key FROM part""")
def src_parameter_key(spark, d):
    p = fx.table(spark, d, "part")
    return p.select("p_partkey", f.parameter_key(p, ["p_size", "p_brand"]).alias("cache_key"), f.parameter_key(p, ["p_size", "p_brand"], "md5").alias("provenance_key"))


_HEADS = " UNION ALL ".join(f"SELECT '{n}' AS file, (SELECT count(*) FROM {n}) AS rows, (SELECT list(column_name) FROM information_schema.columns WHERE table_name = '{n}') AS header" for n in ("orders", "customer", "lineitem"))


@query("src_required_columns", f"SELECT file, rows, array_to_string(list_filter(['o_orderkey', 'c_custkey'], lambda c: NOT list_contains(header, c)), ',') AS missing FROM ({_HEADS})")
def src_required_columns(spark, d):
    """Files' headers against what they must have: missing columns of each table."""
    names = ["orders", "customer", "lineitem"]
    heads = None
    for n in names:
        t = fx.table(spark, d, n)
        row = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("file"), "rows", F.array(*[F.lit(c) for c in t.columns]).alias("header"))
        heads = row if heads is None else heads.unionByName(row)
    return heads.select("file", "rows", F.array_join(F.array_except(F.array(F.lit("o_orderkey"), F.lit("c_custkey")), "header"), ",").alias("missing"))
