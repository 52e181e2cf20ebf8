import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions.healpix import parent, pixels_at, with_pixel

FACE_ROW = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_COLUMN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def xy(order, inside):
    x = sum((inside >> (2 * b) & 1) << b for b in range(order))
    y = sum((inside >> (2 * b + 1) & 1) << b for b in range(order))
    return x, y


def ring_number(order, pixel):
    n = 1 << order
    face, inside = divmod(pixel, n * n)
    x, y = xy(order, inside)
    ring = FACE_ROW[face] * n - x - y - 1
    if ring < n:
        width, before, shift = ring, 2 * ring * (ring - 1), 0
    elif ring > 3 * n:
        width = 4 * n - ring
        before, shift = 12 * n * n - 2 * (width + 1) * width, 0
    else:
        width, before, shift = n, 2 * n * (n - 1) + (ring - n) * 4 * n, (ring - n) & 1
    place = (FACE_COLUMN[face] * width + x - y + 1 + shift) // 2
    return before + (place - 1) % (4 * n)


def centre(order, pixel):
    """Position of a pixel's middle, degrees."""
    n = 1 << order
    face, inside = divmod(pixel, n * n)
    x, y = xy(order, inside)
    ring = FACE_ROW[face] * n - x - y - 1
    if ring < n:
        width, z, shift = ring, 1 - ring * ring / (3 * n * n), 0
    elif ring > 3 * n:
        width = 4 * n - ring
        z, shift = -1 + width * width / (3 * n * n), 0
    else:
        width, z, shift = n, (2 * n - ring) * 2 / (3 * n), (ring - n) & 1
    place = (FACE_COLUMN[face] * width + x - y + 1 + shift) // 2
    place = place - 4 * n if place > 4 * n else place + 4 * n if place < 1 else place
    phi = (place - (shift + 1) / 2) * (math.pi / 2) / width
    return math.degrees(phi), math.degrees(math.asin(z))


def pixels(spark, points, order):
    df = spark.createDataFrame([(i, float(r), float(d)) for i, (r, d) in enumerate(points)], "i int, ra double, dec double")
    return [r["p"] for r in with_pixel(df, F.col("ra"), F.col("dec"), order, "p").orderBy("i").collect()]


def test_known_rings(spark):
    angles = [(math.pi / 2, 0), (math.pi / 4, math.pi / 4), (math.pi / 2, math.pi / 2), (0, 0), (math.pi, 0)]
    found = pixels(spark, [(math.degrees(phi), 90 - math.degrees(theta)) for theta, phi in angles], 4)
    assert [ring_number(4, p) for p in found] == [1440, 427, 1520, 0, 3068]


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_every_centre_falls_into_its_pixel(spark, order):
    n = pixels_at(order)
    assert pixels(spark, [centre(order, p) for p in range(n)], order) == list(range(n))


def test_parents_and_ranges(spark):
    points = [(r * 7.3 - 180, d * 3.1 - 89) for r in range(50) for d in range(57)]
    deep = pixels(spark, points, 11)
    assert all(0 <= p < pixels_at(11) for p in deep)
    for order in (0, 4, 8):
        assert pixels(spark, points, order) == [p >> 2 * (11 - order) for p in deep]
    df = spark.createDataFrame([(1234567,)], "p long")
    assert df.select(parent(F.col("p"), 3)).first()[0] == 1234567 >> 6


def test_poles_full_turn_and_missing(spark):
    assert pixels(spark, [(0, 90), (360, 12.5), (0, -90)], 3)[1] == pixels(spark, [(0, 12.5)], 3)[0]
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 2.0)], "ra double, dec double")
    assert with_pixel(df, F.col("ra"), F.col("dec"), 3, "p").count() == 1
    with pytest.raises(ValueError):
        with_pixel(df, F.col("ra"), F.col("dec"), 17, "p")
