"""Every registered query and its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.rules import to_digits

QUERIES: dict = {}
SQL: dict = {}
FLAGSHIP = "agg_flood_metrics"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without negative zeros: sums differ in their last bits by order."""
    return df.select(
        *[(to_digits(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def load() -> None:
    """Import the modules that register queries."""
    from . import checks, claims, files, grids, histories, hydro, losses, metrics, more, rain, scores, series, streams, tiles, wholes  # noqa: F401
