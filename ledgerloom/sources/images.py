"""What is decided about a scanned page before it is read: how far to turn it and how far to enlarge it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Angles in degrees, the least number of lines, and the resolution aimed at.
LEAST_TURN, MOST_TURN, LEAST_LINES = 0.5, 15.0, 8
AIM_DPI, MOST_SCALE, PAGE_INCHES = 300.0, 3.0, 8.5


def deskew_angle(segments: DataFrame, key: str = "page") -> DataFrame:
    """key, angle: the turn that straightens each page of line segments (key, angle); 0 unless enough lines agree on one worth it."""
    flat = F.when(F.abs("angle") <= MOST_TURN, F.col("angle"))
    per = segments.groupBy(key).agg(F.median(flat).alias("_m"), F.count(flat).alias("_n"))
    turn = (F.col("_n") >= LEAST_LINES) & F.abs("_m").between(LEAST_TURN, MOST_TURN)
    return per.select(key, F.when(turn, F.col("_m")).otherwise(0.0).alias("angle"))


def upscale_factor(width: Column, dpi: Column) -> Column:
    """How far to enlarge an image: to 300 dpi, three times at most; without a known dpi the width is that of a page."""
    own = F.coalesce(F.when(dpi > 0, dpi), width / PAGE_INCHES)
    return F.when(own < AIM_DPI, F.least(AIM_DPI / F.nullif(own, F.lit(0.0)), F.lit(MOST_SCALE))).otherwise(1.0)
