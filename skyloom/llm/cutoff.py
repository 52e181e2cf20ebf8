"""Score cutoffs that keep a target share of every source's records.

Iterative histogram refinement: scores of every unresolved source are counted into bins, the bin holding the target rank
becomes the source's new interval (tightened to the bin's smallest and largest score), and the next pass counts only rows
inside the intervals, until an interval holds one distinct score. Only counters cross the shuffle (at most ``bins`` rows a source and
task), so a source with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numeric import as_double, column, is_finite
from skyloom.runtime import bounded, materialize

BINS = 4096


def _signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _linear_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Halved before subtracting, so that no finite interval overflows; the two ends always fall into different bins."""
    width = hi / 2 - lo / 2
    scaled = F.floor((x / 2 - lo / 2) / F.when(width > 0, width) * bins)
    return F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), scaled))).otherwise(F.when(x > lo, bins - 1).otherwise(0)).cast("int")


def usable_scores(rows: DataFrame, source: str, score: str, *keep: str) -> DataFrame:
    """(_source, _score, keep...) of the rows whose source is not NULL and whose score is finite; -0.0 counts as 0.0."""
    x = as_double(rows, score)
    return rows.where(column(source).isNotNull() & is_finite(x)).select(column(source).alias("_source"), (x + F.lit(0.0)).alias("_score"), *[column(k) for k in keep])


def fraction_cutoffs(rows: DataFrame, targets: DataFrame, source: str, score: str, permille: str = "keep_permille", bins: int = BINS) -> DataFrame:
    """One row per target source: (source, permille, n_usable, cutoff, n_kept).

    With n usable rows the cutoff is the smallest score present whose rows at or below it, times 1000, reach permille * n; rows
    tied with the cutoff are all kept. Defined edge cases: a target of 0 or less gives the smallest score, a target above 1000 the largest, a
    source without usable rows a NULL cutoff and 0 kept rows; targets with NULL source or share are ignored, and of several
    targets for one source the largest counts. Rows with NULL source or a NULL, NaN or infinite score are not counted. Columns
    of ``rows`` other than the two named are never read.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    wanted = (
        targets.where(column(source).isNotNull() & column(permille).isNotNull())
        .groupBy(column(source).alias("_source"))
        .agg(F.max(column(permille)).cast("long").alias("_permille"))
    )
    wanted = materialize(wanted)
    n_sources = wanted.count()
    scores = usable_scores(rows, source, score)
    listed = scores.join(bounded(wanted.select("_source"), n_sources), "_source", "left_semi")
    stats = listed.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.min("_score").alias("lo"), F.max("_score").alias("hi"))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.expr("(_permille * n + 999) div 1000")))
    state = materialize(
        stats.join(bounded(wanted, n_sources), "_source").select(
            "_source",
            "n",
            rank.alias("rank"),
            F.lit(0).cast("long").alias("below"),
            "lo",
            "hi",
            F.when(F.col("lo") == F.col("hi"), F.col("n")).alias("kept"),
        )
    )
    done = []
    turn = 0
    while True:
        done.append(state.where(F.col("kept").isNotNull()))
        active = state.where(F.col("kept").isNull())
        left = active.count()
        if not left:
            break
        lo, hi, x = F.col("lo"), F.col("hi"), F.col("_score")
        # the first pass may span many magnitudes (placeholders, wild values): logarithmic bins find the right one at once
        index = _linear_bin(_signed_log(x), _signed_log(lo), _signed_log(hi), bins) if turn == 0 else _linear_bin(x, lo, hi, bins)
        counted = (
            scores.join(bounded(active, left), "_source")
            .where((x >= lo) & (x <= hi))
            .groupBy("_source", "n", "rank", "below", index.alias("bin"))
            .agg(F.count(F.lit(1)).alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        )
        upto = F.sum("c").over(Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        state = materialize(
            counted.withColumn("upto", F.col("below") + upto)
            .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
            .select("_source", "n", "rank", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi", F.when(F.col("lo") == F.col("hi"), F.col("upto")).alias("kept"))
        )
        turn += 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return wanted.join(bounded(found, n_sources), "_source", "left").select(
        F.col("_source").alias(source),
        F.col("_permille").cast("int").alias(permille),
        F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n_usable"),
        F.col("lo").alias("cutoff"),
        F.coalesce(F.col("kept"), F.lit(0).cast("long")).alias("n_kept"),
    )


def keep_fraction(rows: DataFrame, targets: DataFrame, source: str, score: str, identifier: str, permille: str = "keep_permille", bins: int = BINS) -> DataFrame:
    """(source, identifier) of every usable row at or below its source's cutoff; see fraction_cutoffs for the edge cases."""
    cutoffs = fraction_cutoffs(rows, targets, source, score, permille, bins)
    cutoffs = materialize(cutoffs.where(F.col("cutoff").isNotNull()).select(column(source).alias("_source"), "cutoff"))
    scores = usable_scores(rows, source, score, identifier)
    return (
        scores.join(bounded(cutoffs, cutoffs.count()), "_source")
        .where(F.col("_score") <= F.col("cutoff"))
        .select(F.col("_source").alias(source), column(identifier))
    )
