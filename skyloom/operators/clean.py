"""Checks and normalisation of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import as_double, nan_to_null

SLACK = 1e-6


def position_extrema(df: DataFrame, ra: str, dec: str) -> DataFrame:
    """One row: ra_min, ra_max, dec_min, dec_max (NaN and NULL skipped), n_missing rows without a finite position."""
    r, d = nan_to_null(as_double(df, ra)), nan_to_null(as_double(df, dec))
    missing = F.sum(F.when(r.isNull() | d.isNull(), 1).otherwise(0))
    return df.agg(F.min(r).alias("ra_min"), F.max(r).alias("ra_max"), F.min(d).alias("dec_min"), F.max(d).alias("dec_max"), F.coalesce(missing, F.lit(0)).cast("long").alias("n_missing"))


def needs_ra_shift(ra_min: float | None, ra_max: float | None, dec_min: float | None, dec_max: float | None) -> bool:
    """Whether right ascensions run over -180..180. ValueError if the extrema fit neither range or DEC leaves -90..90."""
    values = (ra_min, ra_max, dec_min, dec_max)
    if any(v is None or v in (float("inf"), float("-inf")) for v in values):
        raise ValueError(f"positions are not finite: {values}")
    if dec_min < -90 - SLACK or dec_max > 90 + SLACK:
        raise ValueError(f"declinations {dec_min} to {dec_max} leave -90..90")
    if -SLACK <= ra_min and ra_max <= 360 + SLACK:
        return False
    if -180 - SLACK <= ra_min and ra_max <= 180 + SLACK:
        return True
    raise ValueError(f"right ascensions {ra_min} to {ra_max} fit neither 0..360 nor -180..180")


def shifted_ra(ra: Column) -> Column:
    return F.pmod(ra + 360.0, F.lit(360.0))


def normalise_positions(df: DataFrame, ra: str, dec: str) -> DataFrame:
    """``df`` with RA in 0..360 (the range is decided by the extrema of the whole column, one job). Missing positions raise ValueError."""
    r = position_extrema(df, ra, dec).first()
    if r.ra_min is None and r.n_missing == 0:
        return df  # no rows
    if r.n_missing:
        raise ValueError(f"{r.n_missing} rows have no position")
    if needs_ra_shift(r.ra_min, r.ra_max, r.dec_min, r.dec_max):
        return df.withColumn(ra, shifted_ra(as_double(df, ra)))
    return df
