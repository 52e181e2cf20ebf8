"""Coverage selection: the best rows of every cell, depth by depth.

Rows carry ``__icov__`` (cell), ``__score__`` (double; NULL where the score is NULL, NaN or infinite, which ranks worst), RA and DEC. Ties
of score are broken by RA, DEC and further columns given, so results don't depend on the layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.config import Algorithm
from skyloom.functions.numeric import column
from skyloom.functions.philox import LOW, philox
from skyloom.runtime import bounded, materialize

CELL, SCORE, RANK = "__icov__", "__score__", "__rk__"
#: Up to so many rows a global limit is left to Spark's top-k; beyond it sorts by range and counts.
SMALL_LIMIT = 100_000
#: A score held by this share of all rows is handled apart before the shuffle (at most its inverse many such scores); changes the plan only.
FREQUENT = 0.005
#: Distance between the keys of the depths' random numbers, odd.
DEPTH_STEP = 2_246_822_519


def best_first(ties: Sequence[str], descending: bool, score: str = SCORE) -> list[Column]:
    """Sort keys: score (NULL last either way), then the tie columns ascending, NULL last."""
    first = column(score).desc_nulls_last() if descending else column(score).asc_nulls_last()
    return [first, *[column(t).asc_nulls_last() for t in ties]]


def ranked(rows: DataFrame, order: Sequence[Column], cell: str = CELL, name: str = RANK) -> DataFrame:
    """Rows with their place (1 is best) within the cell; rows without a cell are dropped."""
    place = F.row_number().over(Window.partitionBy(column(cell)).orderBy(*order))
    return rows.where(column(cell).isNotNull()).withColumn(name, place)


def top_k(rows: DataFrame, k: int, order: Sequence[Column], cell: str = CELL) -> DataFrame:
    """At most ``k`` best rows of each cell, with their rank. The rank filter limits groups before and after the shuffle."""
    return ranked(rows, order, cell).where(F.col(RANK) <= int(max(0, k)))


def top_k_by_cell(rows: DataFrame, limits: DataFrame, order: Sequence[Column], cell: str = CELL) -> DataFrame:
    """Best rows of each cell, as many as ``limits`` (cell, k) allows; cells not in it get none.

    The largest k filters first, as a literal, since a limit held in a column cannot limit groups before the shuffle.
    """
    most = limits.agg(F.max("k")).first()[0] or 0
    per_cell = limits.select(column(cell).alias("_cell"), F.col("k").alias("_k"))
    return top_k(rows, int(most), order, cell).join(per_cell, column(cell) == F.col("_cell")).where(F.col(RANK) <= F.col("_k")).drop("_cell", "_k")


def first_rows(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of the whole table. Many rows are sorted by range and counted, never gathered."""
    if n <= SMALL_LIMIT:
        return rows.orderBy(*order).limit(max(0, n))
    sorted_ = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ahead, offsets = 0, []
    for r in sorted_.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], ahead))
        ahead += r["count"]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _ahead long")
    return sorted_.join(F.broadcast(table), part == F.col("_part")).where(F.col("_ahead") + place < n).drop("_at", "_part", "_ahead")


def thresholds(selected: DataFrame, descending: bool, cell: str = CELL, score: str = SCORE) -> DataFrame:
    """(cell, threshold): the worst kept score of each cell; NULL where all kept scores are missing."""
    worst = F.min(column(score)) if descending else F.max(column(score))
    return selected.where(column(cell).isNotNull()).groupBy(column(cell).alias(cell)).agg(worst.alias("threshold"))


def remainder(rows: DataFrame, cuts: DataFrame, descending: bool, n_cuts: int | None = None, cell: str = CELL, score: str = SCORE) -> DataFrame:
    """Rows of cells without a threshold, and of others those strictly worse than it.

    A missing score is worse than any threshold; a NULL threshold (only missing scores were kept) drops the whole cell.
    """
    side = cuts.select(column(cell).alias("_cell"), F.col("threshold").alias("_cut"))
    if n_cuts is not None:
        side = bounded(side, n_cuts)
    s, cut = column(score), F.col("_cut")
    worse = cut.isNotNull() & (s.isNull() | ((s < cut) if descending else (s > cut)))
    return rows.join(side, column(cell) == F.col("_cell"), "left").where(F.col("_cell").isNull() | worse).drop("_cell", "_cut")


def profile(mode: str, initial: float, depth: int, base: float = 2.0) -> float:
    """Rows per cell (or in total) wanted at ``depth`` (from 1)."""
    below = max(0, depth - 1)
    match (mode or "constant").lower():
        case "constant":
            return float(initial)
        case "linear":
            return initial * (1.0 + below)
        case "exp":
            return initial * (base if base > 1 else 2.0) ** below
        case "log":
            return initial * math.log2(below + 2)
    raise ValueError(f"unknown density_mode {mode!r}")


def needs_cell_count(a: Algorithm, depth: int) -> bool:
    return a.targets_total_initial is not None or depth in (a.targets_total_per_level or {})


def rows_per_cell(a: Algorithm, depth: int, n_cells: int = 0) -> float:
    """k of a depth: profile (or total profile over the cells), per-level value instead, total cap last. A cap of 0 caps nothing."""
    if a.targets_total_initial is None:
        k = profile(a.density_mode, a.k_per_cov_initial, depth, a.density_exp_base)
    else:
        total = profile(a.density_mode, a.targets_total_initial, depth, a.density_exp_base)
        k = total / n_cells if n_cells > 0 else 0.0
    k = max(0.0, float((a.k_per_cov_per_level or {}).get(depth, k)))
    cap = float((a.targets_total_per_level or {}).get(depth, 0))
    return min(k, cap / n_cells) if cap > 0 and n_cells > 0 else k


def bias_weights(cells: DataFrame, mode: str, exponent: float) -> DataFrame:
    """(cell, weight) from (cell, n): (n + 1e-6) to the power of +-|exponent|, divided by the mean over the cells."""
    power = abs(exponent) * (1 if mode == "proportional" else -1)
    raw = cells.where(F.col("n") > 0).select(CELL, F.pow(F.col("n") + 1e-6, F.lit(float(power))).alias("weight"))
    mean = raw.agg(F.avg("weight")).first()[0]
    return raw.withColumn("weight", F.col("weight") / F.lit(mean))


def integer_limits(weights: DataFrame, k: float) -> DataFrame:
    """(cell, k_cell, k): the biased k of each cell and the whole number of candidates it allows; cells with nothing are left out."""
    return weights.select(CELL, (F.col("weight") * k).alias("k_cell")).where("k_cell > 0").withColumn("k", F.greatest(F.lit(1), F.ceil("k_cell")).cast("int"))


def whole_k(k: float) -> int:
    return max(1, math.ceil(k))


def draw(key: Column, seed: int, depth: int = 0) -> Column:
    """A reproducible number in [0, 1) for a whole-number key, another one at each depth."""
    return philox(key, (seed + depth * DEPTH_STEP) & LOW) / F.lit(float(1 << 32))


def resolve_logic(mode: str, logic: str) -> tuple[str, str]:
    mode, logic = (mode or "random").lower(), (logic or "auto").lower()
    if mode not in ("score", "random"):
        raise ValueError(f"unknown fractional_mode {mode!r}")
    if logic == "auto":
        logic = "global" if mode == "score" else "local"
    if logic not in ("local", "global"):
        raise ValueError(f"unknown fractional_mode_logic {logic!r}")
    return mode, logic


def fractional(selected: DataFrame, k: float, mode: str, logic: str, order: Sequence[Column], row_key: Column, seed: int, limits: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """What remains of the selected rows when k (or a cell's biased k in ``limits``) is no whole number.

    score/global, random/global: round(k * cells) rows over all cells, the best or the first by random order (the bias is not
    considered). score/local: the cell's floor(k) best rows and the next with the fraction as probability; random/local: so many
    random ones. A whole k without bias changes nothing in random/local. Random numbers depend on ``seed``, ``depth`` and, for a cell, its number; for a
    row, ``row_key``.
    """
    mode, logic = resolve_logic(mode, logic)
    if k <= 0:
        return selected
    if logic == "global":
        n = round(k * selected.select(CELL).distinct().count())
        return first_rows(selected, n, order if mode == "score" else [draw(row_key, seed, depth), *order])
    if mode == "random" and limits is None and k - math.floor(k) <= 1e-9:
        return selected
    w = Window.partitionBy(CELL)
    picks = w.orderBy(*order) if mode == "score" else w.orderBy(draw(row_key, seed, depth), *order)
    out = selected.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_at", F.row_number().over(picks))
    wanted = F.lit(float(k))
    if limits is not None:
        side = limits.select(F.col(CELL).alias("_cell"), F.col("k_cell").alias("_k"))
        out = out.join(side, F.col(CELL) == F.col("_cell"), "left")
        wanted = F.coalesce(F.col("_k"), wanted)
    wanted = F.least(wanted, F.col("_n").cast("double"))
    whole = F.floor(wanted)
    extra = F.when(draw(F.col(CELL), seed, depth) < wanted - whole, 1).otherwise(0)
    return out.where(F.col("_at") <= whole + extra).drop("_n", "_at", "_cell", "_k")


@dataclass(frozen=True)
class Selection:
    """What the depth loop needs besides the rows."""

    algorithm: Algorithm
    ties: tuple[str, ...]
    row_key: str  # whole-number column for random order, the same on every layout
    density: DataFrame | None  # (cell, n) of the whole catalogue, for the bias
    row: str | None = None  # whole-number column unlike in all rows, for tie_policy "keep"; not given: row_key


def is_biased(s: Selection) -> bool:
    return s.algorithm.density_bias_mode in ("proportional", "inverse") and s.density is not None


def can_select_at_once(a: Algorithm) -> bool:
    """Whether all depths are one ranking cut at running sums of k: whole k everywhere, no totals, no bias, tied rows kept."""
    if a.tie_policy != "keep" or a.density_bias_mode in ("proportional", "inverse"):
        return False
    if a.targets_total_initial is not None or a.targets_total_per_level:
        return False
    return all((k := rows_per_cell(a, d)) > 0 and k == math.floor(k) for d in range(1, a.level_limit + 1))


def can_select_within_cells(a: Algorithm) -> bool:
    """Whether no depth looks beyond single cells: no totals, and no fraction that is settled over all cells."""
    if a.targets_total_initial is not None or a.targets_total_per_level:
        return False
    return resolve_logic(a.fractional_mode, a.fractional_mode_logic)[1] == "local"


def select_at_once(rows: DataFrame, s: Selection) -> DataFrame:
    """All depths from one ranking: ``depth`` is the first whose running sum of k reaches the row's rank."""
    sums, total = [], 0
    for d in range(1, s.algorithm.level_limit + 1):
        total += int(rows_per_cell(s.algorithm, d))
        sums.append((d, total))
    best = top_k(rows, total, best_first(s.ties, s.algorithm.order_desc))
    depth = F.lit(sums[-1][0])
    for d, upto in reversed(sums[:-1]):
        depth = F.when(F.col(RANK) <= upto, d).otherwise(depth)
    return best.withColumn("depth", depth).drop(RANK)


def contenders(rows: DataFrame, s: Selection, most: Sequence[int]) -> DataFrame:
    """The rows that may be chosen if depth i takes at most ``most[i]`` rows of a cell; no other row can be.

    "keep": a cell's sum(most) best rows and one more (which shows that the cell isn't used up). "reference": by induction over the depths a
    chosen row is among the sum(most) best different scores of its cell, and among the max(most) first rows of that score. Both are
    group limits, applied before and after the shuffle on the cell; scores that very many rows hold (missing ones above all) are first limited
    among themselves, so that they don't meet in one task either.
    """
    a, total = s.algorithm, sum(most)
    order = best_first(s.ties, a.order_desc)
    if a.tie_policy == "keep":
        return top_k(rows, total + 1, order).drop(RANK)
    rows = rows.where(F.col(CELL).isNotNull())
    score = F.col(SCORE).desc_nulls_last() if a.order_desc else F.col(SCORE).asc_nulls_last()
    within = F.row_number().over(Window.partitionBy(CELL, SCORE).orderBy(*order[1:]))
    among = F.dense_rank().over(Window.partitionBy(CELL).orderBy(score))
    first = lambda df, place, limit: df.withColumn(RANK, place).where(F.col(RANK) <= int(limit)).drop(RANK)
    frequent = [x for x in rows.where(F.col(SCORE).isNotNull()).stat.freqItems([SCORE], FREQUENT).first()[0] or [] if x is not None]
    held = F.col(SCORE).isNull() | F.col(SCORE).isin(*frequent) if frequent else F.col(SCORE).isNull()
    kept = first(rows.where(held), within, max(most)).unionByName(first(rows.where(~held), among, total))
    return first(first(kept, among, total), within, max(most))


def select_within_cells(work: DataFrame, s: Selection, weights: DataFrame | None) -> DataFrame:
    """All depths in one plan over ``work`` (see contenders): windows over the cell tell for each depth what is left, chosen and cut.

    They share the partitioning by cell and, but for random choices, one sort. A row with a missing score may be chosen at several depths
    ("reference"), so depths are gathered in an array.
    """
    a, order = s.algorithm, best_first(s.ties, s.algorithm.order_desc)
    cell = Window.partitionBy(CELL)
    running = cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mode, _ = resolve_logic(a.fractional_mode, a.fractional_mode_logic)
    out = work.withColumns({"_alive": F.lit(True), "_depths": F.array().cast("array<int>")})
    if weights is not None:
        out = out.join(weights.select(F.col(CELL).alias("_cell"), F.col("weight").alias("_weight")), F.col(CELL) == F.col("_cell")).drop("_cell")
    for depth in range(1, a.level_limit + 1):
        k = rows_per_cell(a, depth)
        if k <= 0:
            continue
        k_cell = F.lit(float(k)) if weights is None else F.col("_weight") * k
        limit = F.lit(whole_k(k)) if weights is None else F.when(k_cell > 0, F.greatest(F.lit(1), F.ceil(k_cell)))
        out = out.withColumn("_at", F.sum(F.col("_alive").cast("int")).over(running))
        out = out.withColumn("_chosen", F.col("_alive") & (F.col("_at") <= F.coalesce(limit, F.lit(0))))
        if weights is not None or k != math.floor(k):
            wanted = F.least(k_cell, F.sum(F.col("_chosen").cast("int")).over(cell).cast("double"))
            whole = F.floor(wanted)
            if mode == "random":
                place = F.row_number().over(cell.orderBy(F.col("_chosen").desc(), draw(F.col(s.row_key), a.seed, depth), *order))
                out = out.withColumn("_at", place)
            extra = F.when(draw(F.col(CELL), a.seed, depth) < wanted - whole, 1).otherwise(0)
            out = out.withColumn("_upto", whole + extra).withColumn("_chosen", F.col("_chosen") & (F.col("_at") <= F.col("_upto"))).drop("_upto")
        out = out.withColumn("_depths", F.when(F.col("_chosen"), F.array_append("_depths", F.lit(depth))).otherwise(F.col("_depths")))
        if a.tie_policy == "keep":
            out = out.withColumn("_alive", F.col("_alive") & ~F.col("_chosen"))
            continue
        held = F.when(F.col("_chosen"), F.col(SCORE))
        cut = (F.min(held) if a.order_desc else F.max(held)).over(cell)
        out = out.withColumns({"_cut": cut, "_any": F.max("_chosen").over(cell)})
        worse = F.col("_cut").isNotNull() & (F.col(SCORE).isNull() | ((F.col(SCORE) < F.col("_cut")) if a.order_desc else (F.col(SCORE) > F.col("_cut"))))
        out = out.withColumn("_alive", F.col("_alive") & (~F.col("_any") | worse)).drop("_cut", "_any")
    out = out.where(F.size("_depths") > 0).withColumn("depth", F.explode("_depths"))
    return out.select(*work.columns, "depth")


def select_depth(rows: DataFrame, k: float, s: Selection, depth: int, weights: DataFrame | None) -> DataFrame:
    """The rows chosen among ``rows`` at one depth with ``k`` rows per cell."""
    a, order = s.algorithm, best_first(s.ties, s.algorithm.order_desc)
    limits = None
    if weights is not None:
        limits = integer_limits(weights, k)
        chosen = top_k_by_cell(rows, limits, order)
    else:
        chosen = top_k(rows, whole_k(k), order)
    return fractional(chosen.drop(RANK), k, a.fractional_mode, a.fractional_mode_logic, order, F.col(s.row_key), a.seed, limits, depth)


def _worst(rows: DataFrame, descending: bool) -> DataFrame:
    """(cell, score) of the worst row of each cell; a missing score is worst."""
    missing, worst = F.max(F.col(SCORE).isNull()), F.min(SCORE) if descending else F.max(SCORE)
    return rows.where(F.col(CELL).isNotNull()).groupBy(CELL).agg(F.when(~missing, worst).alias(SCORE))


def _end_at_gap(chosen: DataFrame, a: Algorithm) -> DataFrame:
    """``chosen`` up to the first depth at which something was wanted and nothing chosen: there the loop ends."""
    present = {r["depth"] for r in chosen.select("depth").distinct().collect()}  # at most level_limit rows
    wanted = [d for d in range(1, a.level_limit + 1) if rows_per_cell(a, d) > 0]
    gap = next((d for d in wanted if d not in present), None)
    return chosen if gap is None else chosen.where(F.col("depth") < gap)


def select_hierarchy(rows: DataFrame, s: Selection, report: Callable[[int, float, int, int], None] | None = None) -> DataFrame:
    """All chosen rows with their ``depth``.

    Only ``rows`` that may be chosen are looked at (contenders), so the catalogue is read once and what a depth reads does not grow with it.
    Where every depth stays within single cells, all depths are one plan; where totals or fractions are settled over all cells, the
    depths follow one another, each written. Only a total profile, whose k has no bound beforehand, makes each depth read all rows. Depths
    without anything to choose are skipped; all ends at the first depth where nothing was chosen.
    ``tie_policy`` "reference": rows tied with a cut are lost to deeper levels, and rows with missing scores may come again; "keep": every
    row not chosen stays, none comes twice. ``report`` is told depth, k, cells and chosen rows of each depth that follows another.
    """
    a = s.algorithm
    nothing = rows.where(F.lit(False)).withColumn("depth", F.lit(0))
    if a.k_per_cov_initial <= 0 and not a.k_per_cov_per_level:
        return nothing
    if can_select_at_once(a):
        return select_at_once(rows, s)
    weights, heaviest = None, 1.0
    if is_biased(s):
        weights = materialize(bias_weights(s.density, a.density_bias_mode, a.density_bias_exponent))
        n_weights, heaviest = weights.agg(F.count(F.lit(1)), F.coalesce(F.max("weight"), F.lit(1.0))).first()
        weights = bounded(weights, n_weights)
    if a.targets_total_initial is None:
        ks = [rows_per_cell(a, d) for d in range(1, a.level_limit + 1)]
        most = [whole_k(k * heaviest) for k in ks if k > 0]
        if not most:
            return nothing
        if can_select_within_cells(a):
            return _end_at_gap(materialize(select_within_cells(contenders(rows, s, most), s, weights)), a)
        work = materialize(contenders(rows, s, most))
        cells = materialize(_worst(rows, a.order_desc)) if a.targets_total_per_level and a.tie_policy != "keep" else work
    else:
        work = cells = materialize(rows)
    found = _depth_by_depth(work, cells, s, weights, report)
    return nothing if found is None else found


def _depth_by_depth(work: DataFrame, cells: DataFrame, s: Selection, weights: DataFrame | None, report: Callable[[int, float, int, int], None] | None) -> DataFrame | None:
    """The loop over depths; ``cells`` holds a row of each cell that is left as long as any row of the cell is."""
    a, row = s.algorithm, s.row or s.row_key
    keep_ties = a.tie_policy == "keep"
    chosen: list[DataFrame] = []
    cuts: DataFrame | None = None
    n_cuts = n_chosen = 0
    for depth in range(1, a.level_limit + 1):
        def left(df: DataFrame) -> DataFrame:
            if keep_ties and chosen:
                taken = reduce(DataFrame.unionByName, [c.select(F.col(row).alias("_row")) for c in chosen])
                return df.join(bounded(taken, n_chosen), F.col(row) == F.col("_row"), "left_anti")
            return df if cuts is None else remainder(df, cuts, a.order_desc, n_cuts)

        n_cells = left(cells).select(CELL).where(F.col(CELL).isNotNull()).distinct().count() if needs_cell_count(a, depth) else 0
        k = rows_per_cell(a, depth, n_cells)
        if k <= 0:
            continue
        picked = materialize(select_depth(left(work), k, s, depth, weights).withColumn("depth", F.lit(depth)))
        n = picked.count()
        if report:
            report(depth, k, n_cells, n)
        if not n:
            break
        n_chosen += n
        chosen.append(picked)
        if not keep_ties:
            new = thresholds(picked, a.order_desc)
            if cuts is not None:
                new = cuts.join(new.select(F.col(CELL).alias("_cell")), F.col(CELL) == F.col("_cell"), "left_anti").unionByName(new)
            cuts = materialize(new)
            n_cuts = cuts.count()
    return reduce(DataFrame.unionByName, chosen) if chosen else None
