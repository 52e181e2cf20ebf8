"""HEALPix NESTED pixel numbers as native columns (Gorski et al. 2005, ApJ 622, 759).

The numbers are built in stages of temporary columns, so that generated code computes every common part once. A filter on a pixel is
pushed through the stages and repeats them: filter positions before, or pixels after an aggregation or a written table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 16


def pixels_at(order: int) -> int:
    return 12 << (2 * order)


def parent(pixel: Column, levels: int) -> Column:
    """The pixel ``levels`` orders up that holds ``pixel``."""
    return F.shiftright(pixel, 2 * levels)


def _bits(v: Column, n: int) -> Column:
    return v.bitwiseAND(F.lit(n - 1).cast("long"))


def _spread(v: Column) -> Column:
    """The bits of ``v`` at the even positions: its binary digits read in base 4. ``v`` stands in it once, unlike in shifting and masking."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def with_pixel(df: DataFrame, ra: Column, dec: Column, order: int, name: str) -> DataFrame:
    """``df`` with column ``name``: the NESTED pixel (long) at ``order`` of the position in degrees.

    RA counts modulo 360. Rows with a NULL coordinate are dropped; others must be finite, dec within -90..90. The pixel is known never to be NULL (the
    stand-in -1 cannot occur), so the null checks that joins and windows add vanish instead of repeating the computation.
    """
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"order must lie between 0 and {MAX_ORDER}")
    n = 1 << order
    long = lambda c: F.floor(c).cast("long")
    theta = F.radians(90.0 - dec)
    d = df.where(ra.isNotNull() & dec.isNotNull()).withColumn("_z", F.cos(theta)).withColumn("_sin", F.sin(theta))
    d = d.withColumn("_t", F.pmod(F.radians(F.pmod(ra, F.lit(360.0))) / (math.pi / 2), F.lit(4.0)))
    z, t, up = F.col("_z"), F.col("_t"), F.abs(F.col("_z"))
    # belt: the two diagonals through the point; caps: distances along the two edges from the pole
    d = d.withColumn("_jp", long(n * (0.5 + t) - n * z * 0.75)).withColumn("_jm", long(n * (0.5 + t) + n * z * 0.75))
    quarter = F.least(F.lit(3).cast("long"), long(t))
    near_pole = n * F.col("_sin") / F.sqrt((1 + up) / 3)
    reach = F.when(up > 0.99995, near_pole).otherwise(n * F.sqrt(3 * (1 - up)))
    d = d.withColumn("_q", quarter).withColumn("_s", reach)
    u, s, most = t - F.col("_q"), F.col("_s"), F.lit(n - 1).cast("long")
    d = d.withColumn("_a", F.least(most, long(u * s))).withColumn("_b", F.least(most, long((1 - u) * s)))
    jp, jm, q, a, b = (F.col(c) for c in ("_jp", "_jm", "_q", "_a", "_b"))
    fp, fm = F.shiftright(jp, order), F.shiftright(jm, order)
    four = F.lit(4).cast("long")
    belt, north = up <= 2 / 3, z > 0
    belt_face = F.when(fp == fm, fp % four + 4).when(fp < fm, fp % four).otherwise(fm % four + 8)
    d = d.withColumn("_face", F.when(belt, belt_face).when(north, q).otherwise(q + 8))
    d = d.withColumn("_x", F.when(belt, _bits(jm, n)).when(north, most - b).otherwise(a))
    d = d.withColumn("_y", F.when(belt, most - _bits(jp, n)).when(north, most - a).otherwise(b))
    pixel = F.col("_face") * (n * n) + _spread(F.col("_x")) + F.shiftleft(_spread(F.col("_y")), 1)
    return d.withColumn(name, F.coalesce(pixel, F.lit(-1).cast("long"))).drop("_z", "_sin", "_t", "_jp", "_jm", "_q", "_s", "_a", "_b", "_face", "_x", "_y")
