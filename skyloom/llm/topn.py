"""The N best items of every group.

A row_number window with a rank filter: the optimiser turns it into a group limit before and after the shuffle, so each task
sends at most N rows of a group and a group with millions of items never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numeric import as_double, column, is_finite


def top_n(rows: DataFrame, group: str, score: str, ties: list[str], n: int = 5, descending: bool = False) -> DataFrame:
    """The rows of each group's first ``n`` items, all columns kept, plus ``rank_in_group`` (1 is best).

    Order: score (ascending unless ``descending``), then the tie columns ascending with NaN after numbers and NULL last. The result is the
    same on every run and layout if the tie columns end in a unique one. Rows with a NULL group or a NULL, NaN or infinite score are left
    out; n <= 0 gives no rows; a group with fewer rows gives all. Repeated rows take a rank each. A column named
    ``rank_in_group`` in ``rows`` is replaced.
    """
    if "rank_in_group" in rows.columns:
        rows = rows.drop("rank_in_group")
    x = as_double(rows, score)
    first = x.desc() if descending else x.asc()
    order = Window.partitionBy(column(group)).orderBy(first, *[column(t).asc_nulls_last() for t in ties])
    usable = rows.where(column(group).isNotNull() & is_finite(x))
    return usable.withColumn("rank_in_group", F.row_number().over(order)).where(F.col("rank_in_group") <= int(n))
