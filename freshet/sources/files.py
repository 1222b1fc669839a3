"""Readers and writers of rain tables, grids, depth files, manifests and tiles: many files a job, each read where Spark puts it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns of a rain table's file; the place is in its name alone.
POINT_SCHEMA = "duration_minutes int, duration_label string, return_period_years int, precipitation_inches double, lower_bound double, upper_bound double"
NODATA = -9999.0


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, content: string or binary) as a file below ``folder``, whole or not at all; ``name, length``. Lazy."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            sizes = []
            for name, content in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                data = content.encode() if isinstance(content, str) else content
                path, part = f"{root}/{name}", f"{root}/.{name.replace('/', '_')}.{uuid.uuid4().hex}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(part, compression=None) as out:
                    out.write(data)
                system.move(part, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "length"])

    return files.select("name", "content").mapInArrow(write, "name string, length long")


def read_rain_points(spark: SparkSession, path: str) -> DataFrame:
    """Rain tables of points, a file each, named ``..._<latitude>_<longitude>.csv``."""
    rows = spark.read.csv(path, header=True, schema=POINT_SCHEMA)
    name = F.input_file_name()
    part = lambda k: F.regexp_extract(name, r"_(-?[0-9]+(?:\.[0-9]+)?)_(-?[0-9]+(?:\.[0-9]+)?)\.csv$", k).try_cast("double")
    return rows.select(part(1).alias("latitude"), part(2).alias("longitude"), "*")


def read_rain_sections(spark: SparkSession, path: str) -> DataFrame:
    """``station, section, duration, period, depth`` of files with a station line and sections, each with a line of periods and lines ``duration:, v1, v2``.

    A section begins at a line that names it (estimate, upper or lower); numbers
    that can't be read are null.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "t"))
    t = F.trim("t")
    section = F.when(F.lower(t).rlike("^(estimates?|upper|lower)\\b"), F.regexp_extract(F.lower(t), "^(estimate|upper|lower)", 1))
    station = F.when(t.startswith("Station:"), F.trim(F.regexp_replace(t, "^Station:", "")))
    periods = F.when(F.lower(t).startswith("by duration"), F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()))
    w = Window.partitionBy("file").orderBy("line")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    x = text.select("file", "line", t.alias("t"), section.alias("s"), station.alias("st"), periods.alias("p"))
    x = x.select("t", last("st").alias("station"), last("s").alias("section"), last("p").alias("periods"), F.col("p").isNull().alias("body"))
    x = x.where("body and section is not null and periods is not null and t rlike '^[^,:]+:,'")
    values = F.transform(F.slice(F.split("t", ","), 2, F.size(F.split("t", ","))), lambda v: F.trim(v).try_cast("double"))
    both = F.inline(F.arrays_zip(F.col("periods").alias("period"), values.alias("depth")))
    return x.select("station", "section", F.split_part("t", F.lit(":"), F.lit(1)).alias("duration"), both).where("period is not null and depth is not null")


def ascii_grids(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """``name, content`` of grids as ASCII: six header lines, then rows from the north. ``meta``: grid_id, nrows, ncols, xll, yll, cellsize.

    A row of cells is one string before rows meet, so a grid is gathered as lines.
    """
    rows = meta.select("grid_id", "ncols", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("row"))
    there = cells.where("value is not null").groupBy("grid_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("at"))
    number = lambda c: F.coalesce(F.try_element_at("at", c), F.lit(NODATA)).cast("string")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("ncols") - 1), number), " ")
    lines = rows.join(there, ["grid_id", "row"], "left").select("grid_id", "row", line.alias("line"))
    body = lines.groupBy("grid_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = [("ncols", "ncols"), ("nrows", "nrows"), ("xllcorner", "xll"), ("yllcorner", "yll"), ("cellsize", "cellsize")]
    header = F.concat_ws("\n", *[F.concat_ws(" ", F.lit(n), F.col(c).cast("string")) for n, c in head], F.lit(f"NODATA_value {NODATA}"))
    return meta.join(body, "grid_id").select(F.format_string("grid_%s.asc", F.col("grid_id").cast("string")).alias("name"), F.concat_ws("\n", header, "body").alias("content"))


def read_ascii_grids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(cells, meta)`` of ASCII grids; the grid is its file's name, the sentinel and NaN are null."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[A-Za-z]+$", 1).alias("grid_id"), F.split(F.trim("value"), "\r?\n").alias("lines"))
    head = F.map_from_entries(F.transform(F.slice("lines", 1, 6), lambda s: F.struct(F.lower(F.split_part(s, F.lit(" "), F.lit(1))), F.element_at(F.split(F.trim(s), " +"), -1))))
    text = text.withColumn("head", head)
    at = lambda k, kind: F.element_at("head", k).cast(kind)
    meta = text.select("grid_id", at("nrows", "int").alias("nrows"), at("ncols", "int").alias("ncols"), at("xllcorner", "double").alias("xll"), at("yllcorner", "double").alias("yll"), at("cellsize", "double").alias("cellsize"), at("nodata_value", "double").alias("nodata"))
    rows = text.select("grid_id", at("nodata_value", "double").alias("nodata"), F.posexplode(F.slice("lines", 7, 1 << 30)).alias("row", "line"))
    values = rows.select("grid_id", "nodata", "row", F.posexplode(F.split(F.trim("line"), " +")).alias("col", "v"))
    v = F.col("v").try_cast("double")
    return values.select("grid_id", "row", "col", F.when((v != F.col("nodata")) & ~F.isnan(v), v).alias("value")), meta


def near_square(n: int) -> tuple[int, int]:
    """The factor pair of ``n`` closest to a square, the smaller first."""
    rows = next((k for k in range(int(n**0.5), 0, -1) if n % k == 0), 1)
    return rows, n // rows


def read_depth_files(spark: SparkSession, path: str) -> DataFrame:
    """``grid_id, row, col, value`` of files of raw 32-bit floats, as near a square as their size allows; negatives and NaN are 0."""

    def decode(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                values = np.frombuffer(content, "<f4").astype(float)
                rows, cols = near_square(len(values)) if len(values) else (0, 0)
                values = np.where(np.isnan(values) | (values < 0), 0.0, values)
                row, col = np.divmod(np.arange(len(values)), max(cols, 1))
                yield pd.DataFrame({"grid_id": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "row": row.astype("int32"), "col": col.astype("int32"), "value": values})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "grid_id string, row int, col int, value double")


def process_files(spark: SparkSession, path: str, function: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``path, error`` and the columns of ``schema`` of a caller's function over many files; a file that fails is a row with its error."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    made = function(name, bytes(content))[names].assign(path=name, error=None)
                except Exception as e:  # noqa: BLE001  a caller's function may raise anything
                    made = pd.DataFrame([{n: None for n in names} | {"path": name, "error": f"{type(e).__name__}: {e}"}])
                yield made[["path", "error", *names]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, error string, {schema}")


def read_claims(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Claims as they are, from parquet or from csv with a header; every csv column is text."""
    return spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True)


MANIFEST = "run_id long, status string, seconds double, config struct<period:int,pattern:string>, outputs struct<max_depth:double,files:array<string>>"


def write_manifest(results: DataFrame, path: str) -> None:
    """A nested JSON record for each run that succeeded (run_id, status, seconds, period, pattern, max_depth, files)."""
    good = results.where("status = 'done'")
    good.select("run_id", "status", "seconds", F.struct("period", "pattern").alias("config"), F.struct("max_depth", "files").alias("outputs")).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's records flat, a row for each file."""
    m = spark.read.schema(MANIFEST).json(path)
    return m.select("run_id", "status", "seconds", "config.period", "config.pattern", "outputs.max_depth", F.explode("outputs.files").alias("file"))


def write_tiles(tile_cells: DataFrame, path: str) -> None:
    """Tiles' cells partitioned by split."""
    tile_cells.write.mode("overwrite").partitionBy("split").parquet(path)


def grid_catalog(files: DataFrame) -> DataFrame:
    """``name, period, hours`` of grids named like ``se100yr06ha``, by period, then by the duration's text; other names go."""
    part = lambda k: F.regexp_extract("name", r"([0-9]+)yr([0-9]+)h", k)
    got = files.select("name", part(1).try_cast("int").alias("period"), part(2).try_cast("int").alias("hours")).where("period is not null and hours is not null")
    return got.orderBy("period", F.col("hours").cast("string"), "name")


def file_entries(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def file_validity(wanted: DataFrame, entries: DataFrame, least: int) -> DataFrame:
    """Wanted files (name) with ``status``: valid, too small or missing, of entries (name, length)."""
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") < least, "too small").otherwise("valid")
    return wanted.join(entries.select("name", "length"), "name", "left").select("name", status.alias("status"))


def fresh_entries(entries: DataFrame, now: Column, days: int, least: int = 1) -> DataFrame:
    """Entries (length, modified) of a size and younger than so many days."""
    return entries.where((F.col("length") >= least) & (F.col("modified") > now - F.expr(f"INTERVAL {days} DAYS")))


def parameter_key(df: DataFrame, names: list[str], method: str = "sha256") -> Column:
    """A key of parameters, whatever their order: a hash of their JSON sorted by name; nulls take part."""
    text = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return F.sha2(text, 256) if method == "sha256" else F.md5(text)
