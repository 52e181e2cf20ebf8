"""Points in regions, and points near points, on the sphere by crossing parity.

A region is a polygon given by its edges. Edges are binned into latitude strips (and, within a strip, into cells of right
ascension, as many as the strip's circumference holds); points fall into exactly one cell. A ray from the point towards larger right
ascension crosses some of the region's edges; an odd number of crossings means inside. Edges and points meet in an equi-join on the
cell and the crossings are grouped by cell, point and region, so the grouping needs no further shuffle. An edge is crossed by a
point's ray if its lower end is at or below the point's latitude and its upper end above it (half open: shared vertices count
once); points lying on an edge are reported apart (``on_boundary``) and count as inside.

Longitudes are kept relative to each region's own reference meridian, so nothing special happens at RA 0 or 360.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import as_double, column, is_finite
from skyloom.runtime import materialize

ARCSEC = 1.0 / 3600.0
#: Cells of near-point searches are so many radii wide: wider ones need fewer copies of a region, narrower ones fewer comparisons.
CELL_RADII = 4.0


def ra_offset(ra: Column, ref: Column) -> Column:
    """Degrees from ``ref`` eastwards to ``ra``, in [-180, 180)."""
    return F.pmod(ra - ref + 180.0, F.lit(360.0)) - 180.0


def strip_of(dec: Column, height: float) -> Column:
    return F.floor((dec + 90.0) / height)


def cells_in_strip(strip: Column, height: float, width: float) -> Column:
    """Number of RA cells of a strip: at least ``width`` degrees of arc each at the strip's narrowest latitude."""
    edge = F.greatest(F.abs(strip * height - 90.0), F.abs((strip + 1) * height - 90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / width)).cast("long")


def cell_of(ra: Column, n_cells: Column) -> Column:
    return F.least(F.floor(ra / 360.0 * n_cells), n_cells - 1)


def sky_points(rows: DataFrame, identifier: str, ra: str, dec: str) -> DataFrame:
    """(id, ra, dec) of the rows with an id and finite coordinates, dec within -90..90, ra taken modulo 360, each once."""
    r, d = as_double(rows, ra), as_double(rows, dec)
    placed = rows.where(column(identifier).isNotNull() & is_finite(r) & is_finite(d) & d.between(-90.0, 90.0))
    turned = F.pmod(r, F.lit(360.0))
    return placed.select(column(identifier).alias("id"), F.when(turned >= 360.0, 0.0).otherwise(turned + 0.0).alias("ra"), (d + 0.0).alias("dec")).distinct()


def _placed(points: DataFrame, height: float, width: float) -> DataFrame:
    """(id, ra, dec, cell) of every point: strip and cell in it as one number."""
    strip = strip_of(F.col("dec"), height)
    return points.select("id", "ra", "dec", _cell(strip, cell_of(F.col("ra"), cells_in_strip(strip, height, width))).alias("cell"))


def _cell(strip: Column, within: Column) -> Column:
    return F.shiftleft(strip, 32).bitwiseOR(within)


def _spread_over_cells(rows: DataFrame, columns: list[str], low: Column, high: Column, ref: Column, west: Column, east: Column, height: float, width: float) -> DataFrame:
    """``columns`` of each row, and ``cell``, once for each cell between declinations low and high and RA offsets west and east from ref."""
    strips = F.explode(F.sequence(strip_of(low, height), strip_of(high, height))).alias("_strip")
    wide = rows.select(*columns, ref.alias("_ref"), west.alias("_west"), east.alias("_east"), strips)
    n = cells_in_strip(F.col("_strip"), height, width)
    first, last = (F.floor((F.col("_ref") + F.col(side)) / 360.0 * n) for side in ("_west", "_east"))
    wide = wide.withColumn("_n", n).withColumn("_first", first).withColumn("_last", F.least(last, first + F.col("_n") - 1))
    wide = wide.withColumn("_k", F.explode(F.sequence("_first", "_last")))
    return wide.select(*columns, _cell(F.col("_strip"), F.pmod("_k", "_n")).alias("cell"))


def _inside(met: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and on_boundary of the points inside their region, from points met with edges (x, y of the point; x1, y1, x2, y2).

    The crossings are grouped within the cell, by which the rows are already partitioned.
    """
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "dec", "x1", "y1", "x2", "y2"))
    at = F.when(y2 == y1, F.greatest(x1, x2)).otherwise(x1 + (y - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1))
    crosses = ((y1 > y) != (y2 > y)) & (x < at)
    touches = y.between(F.least(y1, y2), F.greatest(y1, y2)) & F.when(y1 == y2, x.between(F.least(x1, x2), F.greatest(x1, x2))).otherwise(x == at)
    met = met.withColumn("crossed", crosses.cast("int")).withColumn("touched", touches)
    grouped = met.where((F.col("crossed") == 1) | F.col("touched")).groupBy("cell", *keys).agg(F.sum("crossed").alias("crossings"), F.max("touched").alias("on_boundary"))
    return grouped.where((F.col("crossings") % 2 == 1) | F.col("on_boundary")).select(*keys, "on_boundary")


def _offset_in_box() -> Column:
    """The point's RA offset from the region's meridian; the seam -180 is also 180, so a region reaching 180 sees its own copy of the point."""
    x = ra_offset(F.col("ra"), F.col("ref"))
    return F.when((F.col("east") >= 180.0) & (x == -180.0), F.when(F.col("west") <= -180.0, x).otherwise(180.0)).otherwise(x)


def points_in_regions(points: DataFrame, edges: DataFrame, height: float, width: float) -> DataFrame:
    """(id, ra, dec, region, payload columns of the region, on_boundary) of every point and region containing it.

    ``points``: id, ra in [0, 360), dec. ``edges``: region, ref (reference RA), x1, y1, x2, y2 (edge ends: RA offset from ref and
    declination, degrees, an edge being straight in these), west, east, south, north (the region's box in the same terms); any other
    column is payload and must be equal on all edges of a region. A region must span less than 360 degrees unless its box is
    -180..180. ``height``, ``width``: strip height and least cell width in degrees; they change speed, never the result. Edge cases: a point
    on an edge or vertex is inside with on_boundary true; regions without area hold only boundary points; NULLs must be removed before
    (sky_points does).
    """
    payload = [c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = _spread_over_cells(edges, edges.columns, low, high, F.col("ref"), F.col("west"), F.col("east"), height, width)
    met = _placed(points, height, width).join(e, "cell").withColumn("x", _offset_in_box())
    met = met.where(F.col("x").between(F.col("west"), F.col("east")) & F.col("dec").between(F.col("south"), F.col("north")))
    return _inside(met, ["id", "ra", "dec", *payload])


def _box(radius: float, ra: Column, dec: Column) -> dict[str, Column]:
    """A box around a point that holds its circle of ``radius`` degrees, poles included: ref, west, east, south, north.

    It is a little larger than the circle, so points at the very distance lie inside it, not on its boundary.
    """
    r = radius * 1.001 + 1e-9
    polar = F.abs(dec) + r >= 90.0
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(r, 90.0)))) / F.greatest(F.cos(F.radians(dec)), F.lit(1e-300)))))
    half = F.when(polar | (half >= 179.0), 180.0).otherwise(half * 1.001 + 1e-9)
    # a box over a pole ends beyond it, so that the pole itself is inside
    south = F.when(dec - r <= -90.0, -91.0).otherwise(dec - r)
    north = F.when(dec + r >= 90.0, 91.0).otherwise(dec + r)
    return {"ref": ra, "west": -half, "east": half, "south": south, "north": north}


def points_in_boxes(points: DataFrame, centres: DataFrame, radius: float, height: float, width: float, pair_condition: Column | None = None) -> DataFrame:
    """(id, ra, dec, region, ra0, dec0) of every point and every box (see _box) of ``centres`` (region, ra0, dec0) containing it.

    What points_in_regions does, for regions that follow from their centre: only centres are shuffled, once a cell, and the box and its
    edges are made after the join. Edges along a parallel are left out, as no ray along the parallel crosses them (the half-open rule).
    """
    box = _box(radius, F.col("ra0"), F.col("dec0"))
    # an edge meets only strips that can hold points
    low, high = F.greatest(box["south"], F.lit(-90.0)), F.least(box["north"], F.lit(90.000001))
    c = _spread_over_cells(centres, ["region", "ra0", "dec0"], low, high, box["ref"], box["west"], box["east"], height, width)
    met = _placed(points, height, width).join(c, "cell")
    if pair_condition is not None:
        met = met.where(pair_condition)
    met = met.where(F.col("dec").between(box["south"], box["north"])).withColumns(box).withColumn("x", _offset_in_box())
    met = met.where(F.col("x").between(F.col("west"), F.col("east")))
    side = F.explode(F.array(F.col("west"), F.when(F.col("east") >= 180.0, 180.5).otherwise(F.col("east")))).alias("x1")
    keys = ["id", "ra", "dec", "region", "ra0", "dec0"]
    met = met.select("cell", *keys, "x", low.alias("y1"), high.alias("y2"), side).withColumn("x2", F.col("x1"))
    return _inside(met, keys).drop("on_boundary")


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees by the haversine formula (exact to rounding at small distances)."""
    a, b = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def pairs_within(rows: DataFrame, identifier: str, ra: str, dec: str, radius_arcsec: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of different identifiers with positions at most ``radius_arcsec`` apart, once.

    Every point is a region (a box around its circle); crossing parity finds the points inside, and the great-circle distance decides.
    Rows without identifier, without finite coordinates or with dec outside -90..90 are ignored; RA counts modulo 360; repeated rows
    and further positions of one identifier add no rows. Identical positions of different identifiers are pairs. A radius <= 0 finds only
    those; NULL or NaN radius raises.
    """
    if not (radius_arcsec >= 0 and math.isfinite(radius_arcsec)):
        raise ValueError("the radius must be a finite number of arcseconds, 0 or more")
    radius = radius_arcsec * ARCSEC
    points = materialize(sky_points(rows, identifier, ra, dec))
    centres = points.select(F.col("id").alias("region"), F.col("ra").alias("ra0"), F.col("dec").alias("dec0"))
    side = max(CELL_RADII * radius, 1.0 * ARCSEC)
    inside = points_in_boxes(points, centres, radius, side, side, F.col("region") < F.col("id"))
    near = separation_deg(F.col("ra0"), F.col("dec0"), F.col("ra"), F.col("dec")) <= radius * (1 + 1e-12)
    return inside.where(near).select(F.col("region").alias("id_a"), F.col("id").alias("id_b")).distinct()
