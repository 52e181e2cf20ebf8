import math
import random
from collections import Counter

import pytest

from skyloom.operators.eager import eager_join_aggregate, heavy_keys
from skyloom.operators.spatial import pairs_within, points_in_regions, sky_points

NAN, INF = float("nan"), float("inf")
SCHEMA = "id long, ra double, dec double, cell string, strip int, region long, x1 double"


def separation(a, b):
    v = [(math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d))) for r, d in (a, b)]
    return math.degrees(2 * math.asin(min(1, math.dist(*v) / 2)))


def brute(rows, radius):
    good = {(i, r, d) for i, r, d in rows if i is not None and r is not None and d is not None and math.isfinite(r) and math.isfinite(d) and abs(d) <= 90}
    return sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[0] != b[0] and separation(a[1:], b[1:]) * 3600 <= radius})


def pairs(spark, rows, radius):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], SCHEMA)  # names the operator uses itself must do no harm
    return sorted(tuple(r) for r in pairs_within(df, "id", "ra", "dec", radius).collect())


@pytest.mark.parametrize("radius", [0.5, 2.0, 40.0, 4000.0])
def test_pairs_equal_brute_force(spark, radius):
    rng = random.Random(int(radius))
    step = radius / 3600
    rows = []
    for ra, dec in ((0.0, 0.0), (359.99999, 45.0), (180.0, -30.0), (12.0, 89.9999), (77.0, -89.99995), (200.0, 90.0), (10.0, -90.0), (123.4, 60.0)):
        for _ in range(12):
            d = dec + rng.uniform(-1.5, 1.5) * step
            d = 180 - d if d > 90 else -180 - d if d < -90 else d
            rows.append((len(rows), ra + rng.uniform(-1.5, 1.5) * step / max(math.cos(math.radians(d)), 1e-6) + rng.choice([0, 360, -360]), d))
    rows += rows[:10]
    assert pairs(spark, rows, radius) == brute(rows, radius)


def test_pairs_edge_cases(spark):
    rows = [(1, 10.0, 5.0), (2, 370.0, 5.0), (2, 10.0, 5.0), (3, None, 5.0), (4, NAN, 1.0), (5, INF, 1.0), (6, 10.0, 90.5), (None, 10.0, 5.0), (7, 10.0, 5.0 + 3 / 3600)]
    assert pairs(spark, rows, 2.0) == [(1, 2)]
    assert pairs(spark, rows, 0.0) == [(1, 2)]
    assert pairs(spark, [], 2.0) == []
    assert pairs(spark, [(i, 1.0, 1.0) for i in range(30)], 2.0) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
    for bad in (-1.0, NAN, INF):
        with pytest.raises(ValueError):
            pairs(spark, rows, bad)


def edges_of(spark, regions):
    """regions: {name: [(ra, dec), ...]}, corners in order; offsets from the first corner."""
    rows = []
    for name, corners in regions.items():
        ref = corners[0][0] % 360
        local = [((r - ref + 180) % 360 - 180, d) for r, d in corners]
        box = min(x for x, _ in local), max(x for x, _ in local), min(y for _, y in local), max(y for _, y in local)
        for (x1, y1), (x2, y2) in zip(local, local[1:] + local[:1]):
            rows.append((name, ref, float(x1), float(y1), float(x2), float(y2), *map(float, box)))
    return spark.createDataFrame(rows, "region string, ref double, x1 double, y1 double, x2 double, y2 double, west double, east double, south double, north double")


def inside(spark, points, regions, height=1.0, width=1.0):
    df = spark.createDataFrame(points, "id long, ra double, dec double")
    return {(r["id"], r["region"]): r["on_boundary"] for r in points_in_regions(sky_points(df, "id", "ra", "dec"), edges_of(spark, regions), height, width).collect()}


def test_regions_with_boundaries(spark):
    regions = {"square": [(359.0, 0.0), (1.0, 0.0), (1.0, 2.0), (359.0, 2.0)], "notch": [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (15.0, 4.0), (10.0, 10.0)]}
    points = [(1, 0.0, 1.0), (2, 360.0, 0.0), (3, 1.0, 1.0), (4, 359.0, 2.0), (5, 1.5, 1.0), (6, 15.0, 3.0), (7, 15.0, 5.0), (8, 15.0, 4.0), (9, 11.0, 8.0), (10, 20.0, 10.0), (11, 12.0, 0.0), (12, 0.0, -0.001)]
    want = {(1, "square"): False, (2, "square"): True, (3, "square"): True, (4, "square"): True, (6, "notch"): False, (8, "notch"): True, (9, "notch"): False, (10, "notch"): True, (11, "notch"): True}
    assert inside(spark, points, regions) == want
    assert inside(spark, points, regions, 0.3, 7.0) == want  # strips change speed only


def test_random_polygons_equal_plain_parity(spark):
    rng = random.Random(3)
    regions = {}
    for k in range(6):
        c, d = rng.uniform(0, 360), rng.uniform(-60, 60)
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        regions[f"r{k}"] = [(c + 5 * rng.uniform(0.3, 1) * math.cos(t), d + 5 * rng.uniform(0.3, 1) * math.sin(t)) for t in turn]
    points = [(i, *rng.choice([(c[0][0] + rng.uniform(-6, 6), c[0][1] + rng.uniform(-6, 6)) for c in regions.values()])) for i in range(400)]
    want = set()
    for i, ra, dec in points:
        for name, corners in regions.items():
            ref = corners[0][0] % 360
            x = (ra - ref + 180) % 360 - 180
            local = [((r - ref + 180) % 360 - 180, d) for r, d in corners]
            hits = sum((y1 > dec) != (y2 > dec) and x < x1 + (dec - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(local, local[1:] + local[:1]))
            if hits % 2:
                want.add((i, name))
    assert set(inside(spark, points, regions)) == want and want


def test_eager_equals_plain_join(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, NAN, None, INF])) for _ in range(300)]
    right = [(rng.choice([1, 2, 2, 4, None]), rng.choice([10, 20, None]), "x") for _ in range(40)]
    l = spark.createDataFrame(left, "k long, g string, v double")
    r = spark.createDataFrame(right, "k long, w long, g string")  # g clashes with a column of the left side
    for how in ("inner", "left"):
        want = {}
        for k, g, v in left:
            partners = [w for kk, w, _ in right if kk == k and k is not None]
            if how == "left" and not partners:
                partners = [None]
            n, s, c, sw, cw = want.get(g, (0, 0.0, 0, 0, 0))
            good = v is not None and math.isfinite(v)
            ws = [w for w in partners if w is not None]
            want[g] = (n + len(partners), s + (v * len(partners) if good else 0), c + good * len(partners), sw + sum(ws), cw + len(ws))
        want = {g: w for g, w in want.items() if w[0]}
        got = {x["g"]: (x["n_rows"], x["sum_v"] or 0.0, x["cnt_v"], x["sum_w"] or 0, x["cnt_w"]) for x in eager_join_aggregate(l, r, ["k"], ["g"], {"v": "v"}, {"w": "w"}, how).collect()}
        assert got == want
    assert eager_join_aggregate(l.limit(0), r, ["k"], ["g"]).count() == 0
    assert eager_join_aggregate(l, r.limit(0), ["k"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        eager_join_aggregate(l, r, ["k"], ["g"], {"v": "v"}, {"v": "w"})
    with pytest.raises(ValueError):
        eager_join_aggregate(l, r, ["k"], ["g"], how="outer")


def test_heavy_keys(spark):
    rows = [(5, 1, 40)] * 34 + [(None, 1, 41)] * 30 + [(-1, 2, 40)] * 5 + [(100 + i, 2, i) for i in range(131)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "__icov__ long, norder int, npix long, key_name string")
    parts = spark.createDataFrame([(1, 40), (1, 41), (2, 40), (2, 40)], "norder int, npix long")
    got = sorted(tuple(r) for r in heavy_keys(df, parts, "__icov__", "norder", "npix", 8, 10, 50).collect())
    cells, where = Counter(r[0] for r in rows), Counter(r[1:] for r in rows)
    want = [("icov", 8, c) for c, n in cells.items() if c is not None and c >= 0 and n * 100 >= len(rows)]
    want += [("npix", *k) for k, n in where.items() if n * 20 >= len(rows)]
    assert got == sorted(want)
    assert heavy_keys(df.limit(0), parts, "__icov__", "norder", "npix", 8).count() == 0
