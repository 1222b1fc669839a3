"""Insurance claims: names, cleaning, matching to cells, economics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .ranges import quantiles

#: Spellings of each column, the first that is there counts.
SYNONYMS = {
    "longitude": ["longitude", "lon", "lng", "long", "x_coord"],
    "latitude": ["latitude", "lat", "y_coord"],
    "date_of_loss": ["date_of_loss", "loss_date", "date", "event_date"],
    "amount_paid": ["amount_paid", "paid_amount", "claim_amount", "loss_amount"],
}
#: Causes that are no flood.
OTHER_CAUSES = ["wind", "hurricane", "tornado", "storm"]


def canonical_columns(df: DataFrame) -> DataFrame:
    """``df`` with the known columns under their canonical names; case and blanks in a header do not matter."""
    plain = {}
    for c in df.columns:
        plain.setdefault(c.lower().replace(" ", "_"), c)
    found = {name: next((plain[v] for v in spellings if v in plain), None) for name, spellings in SYNONYMS.items()}
    return df.withColumnsRenamed({old: new for new, old in found.items() if old is not None and old != new})


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """The required columns that ``df`` lacks, in their order."""
    return [c for c in required if c not in df.columns]


def clean_claims(claims: DataFrame, least_amount: float = 0.0, exclude: list[str] | None = None) -> DataFrame:
    """Claims with numbers cast (bad ones null), real coordinates, an amount of at least so much and a flood's cause; category and ``has_claim`` added."""
    number = lambda c: F.col(c).try_cast("double")
    x = claims.withColumns({"longitude": number("longitude"), "latitude": number("latitude"), "amount_paid": number("amount_paid"), "date_of_loss": F.col("date_of_loss").try_cast("date")})
    inside = F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90)
    x = x.where(inside & (F.col("amount_paid") >= least_amount))
    if "cause_of_damage" in claims.columns:
        x = x.where(~rules.has_keyword(F.col("cause_of_damage"), OTHER_CAUSES if exclude is None else exclude))
    return x.withColumns({"damage_category": rules.damage_category(F.col("amount_paid")), "has_claim": F.lit(1)})


def match_points(claims: DataFrame, cells: DataFrame, west: float, north: float, size: float) -> DataFrame:
    """Claims with the row, column and value of the cell they lie within; a point on a cell's edge is in none. Row 0 is north."""
    x, y = (F.col("longitude") - west) / size, (north - F.col("latitude")) / size
    inside = (x != F.floor(x)) & (y != F.floor(y))
    placed = claims.withColumns({"row": F.floor(y).cast("int"), "col": F.floor(x).cast("int")}).where(inside)
    return placed.join(cells.select("row", "col", "value"), ["row", "col"])


def claim_economics(claims: DataFrame) -> DataFrame:
    """One row: total, mean, median, largest amount, and the share of each category."""
    a = F.col("amount_paid")
    names = ["minimal", "moderate", "substantial", "severe"]
    share = lambda n: (F.count_if(F.col("damage_category") == n) / F.count(F.lit(1))).alias(f"{n}_share")
    return claims.agg(F.sum(a).alias("total"), F.avg(a).alias("mean"), F.max(a).alias("largest"), F.count(a).alias("claims"), *[share(n) for n in names])


def median_by_ranges(df: DataFrame, column: str, probability: float = 0.5) -> DataFrame:
    """One row ``value``: the exact quantile of a whole column, interpolated."""
    return quantiles(df, [], [column], [probability]).select(F.get(f"{column}_q", F.lit(0)).alias("value"))


def retain(runs: DataFrame, results: DataFrame, alerts: DataFrame, cutoff) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs since ``cutoff``, the results of those, and alerts since then or still open."""
    old = runs.where(F.col("ts") < cutoff).select("run_id")
    return runs.where(F.col("ts") >= cutoff), results.join(old, "run_id", "left_anti"), alerts.where(~F.col("resolved") | (F.col("ts") >= cutoff))
