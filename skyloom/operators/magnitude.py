"""Magnitude selection: one global distribution cut into a slice for each depth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import nan_to_null

MAG = "__mag__"
#: Automatic bounds: not below, not above.
BRIGHTEST, FAINTEST = -2.0, 40.0


def magnitude_extrema(rows: DataFrame, mag: str = MAG) -> DataFrame:
    """One row: mag_low, mag_high, NaN and NULL skipped."""
    m = nan_to_null(F.col(mag))
    return rows.agg(F.min(m).alias("mag_low"), F.max(m).alias("mag_high"))


def in_window(rows: DataFrame, low: float, high: float, mag: str = MAG) -> DataFrame:
    """Rows with low <= magnitude <= high; missing magnitudes fail either comparison (NaN is above all numbers)."""
    return rows.where((F.col(mag) >= low) & (F.col(mag) <= high))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    return [float(e) for e in np.linspace(low, high, bins + 1)]


def magnitude_histogram(rows: DataFrame, low: float, high: float, bins: int, mag: str = MAG) -> DataFrame:
    """(bin, n) of the non-empty bins between low and high: each holds its left edge, the last also its right."""
    edges = bin_edges(low, high, bins)
    binned = Bucketizer(splits=edges, inputCol="_mag", outputCol="_bin", handleInvalid="skip").transform(in_window(rows, low, high, mag).select(F.col(mag).alias("_mag")))
    return binned.groupBy(F.col("_bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_counts(histogram: DataFrame, bins: int) -> np.ndarray:
    """The counts of all bins (at most ``bins`` rows come to the driver)."""
    counts = np.zeros(bins, np.int64)
    for r in histogram.collect():
        counts[r["bin"]] = r["n"]
    return counts


def peak_magnitude(counts: np.ndarray, edges: Sequence[float], most: float) -> float:
    """Middle of the fullest bin (the first of several), at most ``most``, to two decimals."""
    at = int(np.argmax(counts))
    return float(np.round(min((edges[at] + edges[at + 1]) / 2, most), 2))


def bounds(low: float | None, high: float | None, given_min: float | None, given_max: float | None) -> tuple[float, float]:
    """(mag_min, highest magnitude for the peak histogram) from the extrema present and the configured minimum."""
    if low is None or high is None or not np.isfinite([low, high]).all():
        raise ValueError("the magnitude column has no finite range")
    if low >= high:
        raise ValueError(f"the magnitude column's range {low} to {high} is empty")
    least = max(low, BRIGHTEST) if given_min is None else float(given_min)
    most = min(high, FAINTEST)
    # the automatic limit holds for a configured maximum, too
    if most <= least or given_max is not None and least >= given_max:
        raise ValueError(f"mag_min {least} is not below the upper limit {most if given_max is None else min(most, given_max)}")
    return least, most


def quantile_edge(cdf: np.ndarray, edges: Sequence[float], q: float) -> float:
    """Left edge of the first bin whose cumulative share reaches q; the ends for q <= 0 and q >= 1."""
    if q <= 0:
        return float(edges[0])
    if q >= 1:
        return float(edges[-1])
    return float(edges[min(int(np.searchsorted(cdf, q, side="left")), len(cdf) - 1)])


def depth_targets(total: int, weights: Sequence[int], fixed: Sequence[int | None]) -> np.ndarray:
    """Rows wanted at each depth: fixed ones first (scaled down if they exceed the total), the rest by weight (at least 1 each)."""
    w = np.maximum(1, np.asarray(weights, float))
    out = np.zeros(len(w))
    held = np.zeros(len(w), bool)
    for i, n in enumerate(fixed[: len(w)]):
        if n is not None:
            if n < 0:
                raise ValueError(f"n_{i + 1} must not be negative")
            out[i], held[i] = n, True
    if out.sum() > total:
        out *= total / out.sum()
    rest = max(0.0, total - out.sum())
    if rest > 0 and not held.all():
        out[~held] += rest * w[~held] / w[~held].sum()
    return out


def slice_edges(counts: np.ndarray, edges: Sequence[float], targets: np.ndarray) -> list[float]:
    """Magnitude edges of the depths: quantiles of the cumulative targets, never decreasing, ends at the window's."""
    total = counts.sum()
    cdf = np.cumsum(counts) / total if total else np.zeros(len(counts))
    share = np.cumsum(targets) / total if total and targets.sum() > 0 else np.zeros(len(targets))
    cut = np.maximum.accumulate([edges[0], *[quantile_edge(cdf, edges, q) for q in share]])
    cut[0], cut[-1] = edges[0], edges[-1]
    return [float(c) for c in cut]


def slice_depth(mag: Column, edges: Sequence[float]) -> Column:
    """Depth (from 1) of a magnitude: slices hold their lower edge, the last also its upper; NULL outside."""
    depth = F.lit(None).cast("int")
    last = len(edges) - 1
    for d in range(last, 0, -1):
        inside = (mag >= edges[d - 1]) & ((mag <= edges[d]) if d == last else (mag < edges[d]))
        depth = F.when(inside, d).otherwise(depth)
    return depth
