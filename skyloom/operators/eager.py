"""Per-key results of a join without per-key imbalance, by eager aggregation.

Both inputs are aggregated by join key before the join (map-side combine leaves one state per key and task), the compact
states are joined, counts multiply and sums scale with the other side's count, and the result is rolled up. No task ever holds the
rows of a heavy key, only its states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import as_double, column, finite_or_null
from skyloom.runtime import materialize


def compact(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, str], prefix: str) -> DataFrame:
    """Counts (``{prefix}n``) and, for each ``alias: column`` in ``sums``, sum and number of finite values per key combination."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    for alias, name in sums.items():
        value = finite_or_null(as_double(rows, name))
        aggs += [F.sum(value).alias(f"{prefix}sum_{alias}"), F.count(value).alias(f"{prefix}cnt_{alias}")]
    return rows.groupBy(*[column(k).alias(k) for k in keys]).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    left_sums: Mapping[str, str] | None = None,
    right_sums: Mapping[str, str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """What grouping ``left join right on ...`` by ``by`` would give, computed from compact states.

    ``by`` names columns of ``left`` (join columns included). Result: the ``by`` columns, ``n_rows`` (joined rows) and per sum alias
    ``sum_alias`` and ``cnt_alias`` over the joined rows, NULL, NaN and infinite values skipped (the sum of no value is NULL).
    ``how``: "inner", or "left", where left rows without a partner count once. NULL join keys match nothing. Other columns, clashing
    names among them, are never read.
    """
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    if set(left_sums) & set(right_sums):
        raise ValueError("left and right sums need different aliases")
    mine = compact(left, list(dict.fromkeys([*on, *by])), left_sums, "_l")
    other = compact(right, list(on), right_sums, "_r").select(*[column(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col("_rn"), *[F.col(f"_r{what}_{a}") for a in right_sums for what in ("sum", "cnt")])
    match = F.lit(True)
    for i, k in enumerate(on):
        match &= column(k) == F.col(f"_k{i}")
    both = mine.join(other, match, how)
    times = F.coalesce(F.col("_rn"), F.lit(1).cast("long"))
    aggs = [F.sum(F.col("_ln") * times).alias("n_rows")]
    for a in left_sums:
        aggs += [F.sum(F.col(f"_lsum_{a}") * times).alias(f"sum_{a}"), F.sum(F.col(f"_lcnt_{a}") * times).alias(f"cnt_{a}")]
    for a in right_sums:
        aggs += [F.sum(F.col(f"_rsum_{a}") * F.col("_ln")).alias(f"sum_{a}"), F.coalesce(F.sum(F.col(f"_rcnt_{a}") * F.col("_ln")), F.lit(0).cast("long")).alias(f"cnt_{a}")]
    return both.groupBy(*[column(k) for k in by]).agg(*aggs)


def heavy_keys(rows: DataFrame, partitions: DataFrame, cell: str, norder: str, npix: str, cell_order: int, cell_permille: int = 10, partition_permille: int = 50) -> DataFrame:
    """(key_name, norder, key_value) of the cells and partitions holding at least the given share of all rows.

    Rows are compacted once by (norder, npix, cell), joined with the compact partition table, and the small joined state is rolled up to
    cells, partitions and the total. Partitions missing from ``partitions`` and rows without a cell still count in the total; NULL or negative
    cells and NULL partitions are never named. No rows give no keys. A partition listed twice changes no share.
    """
    listed = partitions.select(column(norder).alias(norder), column(npix).alias(npix)).distinct()
    state = materialize(eager_join_aggregate(rows, listed, [norder, npix], [norder, npix, cell], how="left"))
    n_all = state.agg(F.sum("n_rows")).first()[0] or 0
    keys = [column(norder), column(npix), column(cell)]
    rolled = state.groupingSets([keys[2:], keys[:2]], *keys).agg(F.sum("n_rows").alias("n"), F.grouping(column(cell)).alias("by_partition"))
    is_cell = F.col("by_partition") == 0
    cells = is_cell & (column(cell) >= 0) & (F.col("n") * 1000 >= n_all * cell_permille)
    parts = ~is_cell & column(npix).isNotNull() & column(norder).isNotNull() & (F.col("n") * 1000 >= n_all * partition_permille)
    return rolled.where(cells | parts).select(
        F.when(is_cell, "icov").otherwise("npix").alias("key_name"),
        F.when(is_cell, cell_order).otherwise(column(norder)).cast("int").alias("norder"),
        F.when(is_cell, column(cell)).otherwise(column(npix)).cast("long").alias("key_value"),
    )
