"""Unit, range, band and score rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of the known unit pairs.
UNIT_FACTORS = {("inches", "mm"): 25.4, ("mm", "inches"): 1 / 25.4, ("inches", "m"): 0.0254, ("mm", "m"): 0.001}

#: Duration labels by minutes.
DURATIONS = {
    5: "5-min", 10: "10-min", 15: "15-min", 30: "30-min", 60: "60-min", 120: "2-hr", 180: "3-hr", 360: "6-hr",
    720: "12-hr", 1440: "24-hr", 2880: "2-day", 4320: "3-day", 5760: "4-day", 10080: "7-day", 14400: "10-day",
    28800: "20-day", 43200: "30-day", 64800: "45-day", 86400: "60-day",
}


def r6(c: Column) -> Column:
    """Rounded to six digits, without a negative zero."""
    return to_digits(c, 6) + F.lit(0.0)


def to_digits(c: Column, digits: int) -> Column:
    """Rounded as SQL engines and C libraries do it: the scaled double, halves away from zero.

    ``round`` takes the shortest decimal that stands for the double, so 1.005
    (really a little less) would become 1.01.
    """
    return F.round(c * float(10**digits)) / float(10**digits)


def told(c: Column, digits: int) -> Column:
    """A number below 2^24 as text with so many digits, as printf has it: what the double holds, exact halves to the even digit.

    ``format_string`` rounds the shortest decimal's halves up. The value is cut
    in two parts whose multiples are exact.
    """
    scale = float(10**digits)
    minus, c = F.when(c < 0, "-").otherwise(""), F.abs(c.cast("double"))
    high = c.cast("float").cast("double")
    low = (c - high) * scale
    whole = F.floor(c * scale)
    rest = (high * scale - whole) + low
    up = (rest > 0.5) | ((rest == 0.5) & (whole % 2 != 0))
    return F.concat(minus, F.format_string(f"%.{digits}f", (whole + up.cast("int")) / scale))


def convert_units(value: Column, src: str, dst: str) -> Column:
    """Depth in another unit; an unknown pair leaves the value as it is."""
    return value * F.lit(UNIT_FACTORS.get((src, dst), 1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def clean_depth(value: Column, least: float = 0.0, most: float = 100.0) -> Column:
    """NaN is null; what is negative or below ``least`` is 0; capped at ``most``."""
    value = F.when(~F.isnan(value), value)
    return F.when(value.isNull(), None).when((value < 0) | (value < least), 0.0).otherwise(F.least(value, F.lit(most)))


def range_status(value: Column, least: float, most: float) -> Column:
    """``warning`` below the range, ``failed`` above it, else ``passed``; null is ``warning`` (counts as 0)."""
    value = F.coalesce(value, F.lit(0.0))
    return F.when(value < least, "warning").when(value > most, "failed").otherwise("passed")


def banded(value: Column, bands: list[tuple[float, str]], first: str) -> Column:
    """The name of the half-open band that holds ``value``: ``first`` below the first bound."""
    out = F.lit(first)
    for bound, name in bands:
        out = F.when(value >= bound, name).otherwise(out)
    return out


def damage_category(amount: Column) -> Column:
    known = banded(amount, [(10_000, "moderate"), (50_000, "substantial"), (100_000, "severe")], "minimal")
    return F.when(amount >= 0, known).otherwise("unknown")


def risk_level(score: Column) -> Column:
    return F.when(score.isNotNull(), banded(score, [(0.25, "moderate"), (0.5, "high"), (0.75, "extreme")], "low"))


def grade(score: Column) -> Column:
    return F.when(score.isNotNull(), banded(score, [(0.6, "D"), (0.7, "C"), (0.8, "B"), (0.9, "A")], "F"))


def grade_points(letter: Column) -> Column:
    """A is 4, F is 0."""
    return F.lit(4) - F.when(letter == "F", 4).otherwise(F.ascii(letter) - 65)


def overall_grade(points: Column) -> Column:
    """The letter nearest a mean of grade points, ties to the better."""
    return F.when(points.isNotNull(), banded(points, [(0.5, "D"), (1.5, "C"), (2.5, "B"), (3.5, "A")], "F"))


def duration_label(minutes: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DURATIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, minutes.cast("int")), F.concat(minutes.cast("string"), F.lit("-min")))


def duration_minutes(label: Column) -> Column:
    """The minutes of a label; null for one that is none."""
    known = F.create_map(*[F.lit(x) for k, v in DURATIONS.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(known, label).cast("long"), F.regexp_extract(label, "^([0-9]+)-min$", 1).try_cast("long"))


def sanitize(text: Column) -> Column:
    """Without ``;`` and ``--``, trimmed."""
    return F.trim(F.replace(F.replace(text, F.lit(";")), F.lit("--")))


def has_keyword(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, in any case; null: no."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(False))


def status_of(score: Column) -> Column:
    """PASS from 0.8, WARN from 0.6, else FAIL."""
    return banded(score, [(0.6, "WARN"), (0.8, "PASS")], "FAIL")


def penalised(penalties: list[tuple[Column, float]]) -> Column:
    """1 less the penalties whose condition holds, 0 at least."""
    total = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0.0) for c, p in penalties])
    return F.greatest(F.lit(1.0) - total, F.lit(0.0))


def estimate_depth(period: Column, minutes: Column) -> Column:
    """24-hour depth by return period, known or linear, by the root of the duration's share of a day."""
    known = {10: 100.0, 25: 125.0, 50: 150.0, 100: 175.0, 500: 225.0, 1000: 250.0}  # fixed values, mm
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    base = F.coalesce(F.try_element_at(table, period), 100 + (period - 10) * 1.5)
    return base * F.sqrt(minutes / 1440)
