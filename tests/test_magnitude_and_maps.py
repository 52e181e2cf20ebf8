import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import magnitude as mg
from skyloom.operators.densmap import compact_cells, coverage_cells, density_maps, density_stats

NAN, INF = float("nan"), float("inf")


def mags(spark, values):
    return spark.createDataFrame([(v,) for v in values], "__mag__ double")


def test_histogram_and_quantiles(spark):
    df = mags(spark, [0.5, 1.5, 1.5, 2.5, 3.5, 3.5, 3.5, 4.0, NAN, None, 5.0])
    counts = mg.histogram_counts(mg.magnitude_histogram(df, 0.0, 4.0, 4), 4)
    assert counts.tolist() == [1, 2, 1, 4]
    cdf, edges = np.cumsum(counts) / 8, mg.bin_edges(0, 4, 4)
    assert [mg.quantile_edge(cdf, edges, q) for q in (0.125, 0.25, 0.5, 0.6, 0, 1, -1, 2)] == [0.0, 1.0, 2.0, 3.0, 0.0, 4.0, 0.0, 4.0]
    assert mg.peak_magnitude(counts, edges, 40) == 3.5 and mg.peak_magnitude(counts, edges, 3.123456) == 3.12


def test_window_keeps_both_ends(spark):
    assert mg.in_window(mags(spark, [9.0, 10.0, 12.0, 15.0, NAN, None]), 10, 15).count() == 3


def test_targets():
    assert mg.depth_targets(100, [1, 1, 1, 1], [150, 50, None]).tolist() == [75, 25, 0, 0]
    assert mg.depth_targets(100, [0, 1, 3], [None, None, None]).tolist() == [20, 20, 60]
    with pytest.raises(ValueError):
        mg.depth_targets(10, [1], [-1])


def test_slices(spark):
    counts, edges = np.array([1, 2, 1, 4]), mg.bin_edges(0, 4, 4)
    cuts = mg.slice_edges(counts, edges, np.array([2.0, 2.0, 4.0]))
    assert cuts == [0.0, 1.0, 2.0, 4.0]
    df = mags(spark, [0.0, 0.99, 1.0, 2.0, 4.0, 4.1, NAN]).withColumn("depth", mg.slice_depth(F.col("__mag__"), cuts))
    assert [r["depth"] for r in df.collect()] == [1, 1, 2, 3, 3, None, None]
    # all quota used up early: rows at the very end still belong to the last depth
    full = mg.slice_edges(counts, edges, np.array([6.0, 2.0, 0.0]))
    assert full[-2:] == [4.0, 4.0]
    df = mags(spark, [3.9, 4.0]).withColumn("depth", mg.slice_depth(F.col("__mag__"), full))
    assert [r["depth"] for r in df.collect()][1] == 3


def test_bounds():
    assert mg.bounds(-5.0, 50.0, None, None) == (-2.0, 40.0)
    assert mg.bounds(1.0, 30.0, 2.0, 20.0) == (2.0, 30.0)
    for bad in ((None, None, None, None), (1.0, INF, None, None), (2.0, 2.0, None, None), (1.0, 5.0, 6.0, None), (1.0, 5.0, 2.0, 1.5), (45.0, 50.0, None, None)):
        with pytest.raises(ValueError):
            mg.bounds(*bad)
    assert mg.bounds(1.0, 5.0, None, 3.0) == (1.0, 5.0)


def test_maps(spark):
    df = spark.createDataFrame([(p,) for p in (0, 1, 1, 5, 191, None)], "p long")
    maps = density_maps(df, "p", 2)
    got = {(r["depth"], r["ipix"]): r["n"] for r in maps.collect()}
    assert got == {(2, 0): 1, (2, 1): 2, (2, 5): 1, (2, 191): 1, (1, 0): 3, (1, 1): 1, (1, 47): 1, (0, 0): 4, (0, 11): 1}
    assert {tuple(r) for r in density_stats(maps).collect()} == {(0, 5, 2), (1, 5, 3), (2, 5, 4)}
    assert sorted(r["ipix"] for r in coverage_cells(maps, 1).collect()) == [0, 1, 47]
    assert density_maps(df.limit(0), "p", 3).count() == 0


@pytest.mark.parametrize("cells, want", [([0, 1, 2, 3, 5], {(1, 0), (2, 5)}), (range(16), {(0, 0)}), ([], set()), ([7, 7], {(2, 7)})])
def test_compaction(spark, cells, want):
    df = spark.createDataFrame([(c,) for c in cells], "ipix long")
    assert {(r["depth"], r["ipix"]) for r in compact_cells(df, 2).collect()} == want
