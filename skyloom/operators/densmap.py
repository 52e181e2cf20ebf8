"""Counts per pixel for all orders at once, as sparse rows, and the coverage cells derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def density_maps(df: DataFrame, pixel: str, order: int) -> DataFrame:
    """(depth, ipix, n) for depths 0..order of the non-empty pixels, from ``pixel`` at ``order``.

    Rows are counted once at the deepest order; upper orders come from those counts. NULL pixels don't count.
    """
    deepest = df.where(F.col(pixel).isNotNull()).groupBy(F.col(pixel).alias("deep")).agg(F.count(F.lit(1)).alias("c"))
    depths = deepest.select("deep", "c", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("depth"))
    up = F.expr(f"shiftright(deep, 2 * ({order} - depth))")
    return depths.groupBy("depth", up.alias("ipix")).agg(F.sum("c").alias("n"))


def density_stats(maps: DataFrame) -> DataFrame:
    """(depth, n_total, n_pixels) of each order."""
    return maps.groupBy("depth").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_pixels"))


def coverage_cells(maps: DataFrame, order: int) -> DataFrame:
    """(ipix) of the non-empty pixels at ``order``."""
    return maps.where((F.col("depth") == order) & (F.col("n") > 0)).select("ipix")


def compact_cells(cells: DataFrame, order: int) -> DataFrame:
    """(depth, ipix): the same area in as few cells as possible, four full children giving way to their parent, repeatedly.

    A cell is full if all its descendants at ``order`` are there; it stays if its parent is not full. Repeated cells count once.
    """
    spread = cells.select(F.col("ipix").alias("deep")).distinct().select("deep", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("depth"))
    held = spread.groupBy("depth", F.expr(f"shiftright(deep, 2 * ({order} - depth))").alias("ipix")).agg(F.count(F.lit(1)).alias("c"))
    full = held.where(F.expr(f"c = shiftleft(1L, 2 * ({order} - depth))")).select("depth", "ipix")
    parents = full.select((F.col("depth") + 1).alias("below"), F.col("ipix").alias("above"))
    return full.join(parents, (F.col("depth") == F.col("below")) & (F.shiftright("ipix", 2) == F.col("above")), "left_anti")
