"""Percentiles of very large columns, exact or within a stated error, and combinable across days.

Exact bisection: every (group, percentile) keeps an interval of values known to hold the target rank and the number of rows below it.
Each pass counts the rows below the midpoints of the intervals (LEVELS halvings at once, so 2^LEVELS - 1 midpoints), and the half with
the target rank becomes the next interval, tightened to the values seen, until it holds one value or is narrower than the tolerance.
Counts below fixed points add up, so results of single days combine: ``ladder`` keeps them per day on a common grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numeric import column, is_finite
from skyloom.runtime import bounded, materialize

LEVELS = 6
#: Forms of a number in text after trimming, lower-casing and removing the unit "mag".
PLAIN, COMMA = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$", r"^[+-]?[0-9]+,[0-9]+$"
#: Magnitudes at or beyond these are placeholders.
VALID = (-90.0, 90.0)


def magnitude(text: Column) -> Column:
    """Text as a magnitude: decimal point or comma, exponent, sign, leading zeros, spaces and the unit "mag" are understood.

    Anything else, NaN, infinities, and values outside VALID (placeholders such as 99 or -999) give NULL.
    """
    bare = F.regexp_replace(F.trim(F.lower(text)), r"\s*mag$", "")
    number = F.when(bare.rlike(PLAIN), bare.try_cast("double")).when(bare.rlike(COMMA), F.translate(bare, ",", ".").try_cast("double"))
    return F.when((number > VALID[0]) & (number < VALID[1]), number)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _met(data: DataFrame, spans: list[tuple[float, float]]) -> DataFrame:
    """Values with each span holding them, without groups: at most one span a probability, so literals do."""
    own = [F.when(F.col("x").between(lo, hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for lo, hi in spans]
    return data.withColumn("_s", F.explode(F.array(*own))).where(F.col("_s").isNotNull()).select("x", "_s.lo", "_s.hi")


def percentiles(rows: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], tolerance: float = 0.0) -> DataFrame:
    """One row per group and probability: (groups..., probability, n, value).

    With n values in the group, the value is the smallest one that at least max(1, ceil(probability * n)) values don't exceed; exact
    with tolerance 0, else an actual value at most ``tolerance`` above the true one. Rows whose value is NULL, NaN or infinite don't count; a
    group without others gives no rows. NULL is a group of its own. -0.0 counts as 0.0. Ties and repeated rows count as often as
    they stand. Columns not named are never read.
    """
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must lie between 0 and 1")
    names = [f"_g{i}" for i in range(len(groups))]
    data = rows.where(is_finite(column(value))).select(*[column(g).alias(n) for g, n in zip(groups, names)], (column(value).cast("double") + F.lit(0.0)).alias("x"))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probabilities)]))
    stats = data.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = stats.withColumn("p", ps).withColumn("rank", F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("p") * F.col("n"))))).withColumn("below", F.lit(0).cast("long"))
    keep = [*names, "p", "n", "rank", "below", "lo", "hi"]
    state = materialize(state.select(*keep))
    parts = 1 << LEVELS
    done = []
    while True:
        open_ = F.col("hi") - F.col("lo") > tolerance
        done.append(state.where(~open_))
        active = state.where(open_)
        left = active.count()
        if not left:
            break
        spans = active.select(*[F.col(n).alias(f"_{n}") for n in names], "lo", "hi").distinct()
        match = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        for n in names:
            match &= _same(n, f"_{n}")
        half = F.col("hi") / 2 - F.col("lo") / 2
        step = F.when(half > 0, F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / F.when(half > 0, half) * parts)))).otherwise(F.when(F.col("x") > F.col("lo"), parts - 1).otherwise(0)).cast("int")
        met = data.join(bounded(spans, left), match) if names else _met(data, [(r.lo, r.hi) for r in spans.collect()])
        counted = met.groupBy(*names, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), step.alias("part")).agg(F.count("x").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*names, "_lo", "_hi").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        ladder_ = counted.withColumn("upto", upto).select(*[F.col(n).alias(f"_{n}") for n in names], "_lo", "_hi", "c", "least", "most", "upto")
        match = (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        for n in names:
            match &= _same(n, f"_{n}")
        narrowed = active.join(ladder_, match).where((F.col("below") + F.col("upto") >= F.col("rank")) & (F.col("below") + F.col("upto") - F.col("c") < F.col("rank")))
        state = materialize(narrowed.select(*names, "p", "n", "rank", (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi")))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], F.col("p").alias("probability"), "n", F.col("hi").alias("value"))


def ladder(rows: DataFrame, groups: Sequence[str], value: str, error: float) -> DataFrame:
    """(groups..., rung, n): counts of values per rung of a common grid, 2 * error wide. States of separate days are added by ``add_up``."""
    if not error > 0:
        raise ValueError("the error bound must be above 0")
    rung = F.floor(column(value) / (2 * error))
    return rows.where(is_finite(column(value))).groupBy(*[column(g) for g in groups], rung.alias("rung")).agg(F.count(F.lit(1)).alias("n"))


def add_up(ladders: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Ladders of several days (or partitions) as one, for coarser ``groups``."""
    return ladders.groupBy(*[column(g) for g in groups], "rung").agg(F.sum("n").alias("n"))


def from_ladder(ladders: DataFrame, groups: Sequence[str], probabilities: Sequence[float], error: float) -> DataFrame:
    """(groups..., probability, n, value): percentiles at most ``error`` from the exact ones (the middle of the rung with the target rank)."""
    by = [column(g) for g in groups]
    w = Window.partitionBy(*by).orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    counted = ladders.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    out = counted.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("total")))
    hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    return out.where(hit).select(*by, "probability", F.col("total").alias("n"), ((F.col("rung") + 0.5) * (2 * error)).alias("value"))
