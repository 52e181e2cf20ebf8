"""Statistics of a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.numeric import column, nan_to_null

#: Rows a sampled partition is taken to hold when the sample's fraction is chosen.
ROWS_A_PART = 10_000


def column_report(df: DataFrame) -> DataFrame:
    """One row a column: column, type, n_null (NaN counts as missing), min, max, mean (numbers only), example (others: a value present).

    Infinities of both signs have no mean: it is NULL. One aggregation over all columns at once.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    aggs, stacked = [], []
    for i, f in enumerate(df.schema):
        c = column(f.name)
        if f.name in numeric:
            x = nan_to_null(c.cast("double"))
            aggs += [F.count(x), F.min(x), F.max(x), nan_to_null(F.avg(x))]
        else:
            shown = F.to_json(c) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else c.cast("string")
            aggs += [F.count(c), F.lit(None), F.lit(None), F.first(shown, ignorenulls=True)]
        base = 4 * i
        number = f.name in numeric
        stacked.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                (F.col("_total") - F.col(f"_{base}")).alias("n_null"),
                (F.col(f"_{base + 1}") if number else F.lit(None)).cast("double").alias("min"),
                (F.col(f"_{base + 2}") if number else F.lit(None)).cast("double").alias("max"),
                (F.col(f"_{base + 3}") if number else F.lit(None)).cast("double").alias("mean"),
                (F.lit(None) if number else F.col(f"_{base + 3}")).cast("string").alias("example"),
            )
        )
    one = df.agg(F.count(F.lit(1)).alias("_total"), *[a.alias(f"_{i}") for i, a in enumerate(aggs)])
    return one.select(F.explode(F.array(*stacked)).alias("r")).select("r.*")


def sampled_column_report(df: DataFrame, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """column_report of about ``rows`` rows: a random share sized by the number of columns, cut at ``rows``."""
    share = min(1.0, rows / (max(1, len(df.columns)) * ROWS_A_PART))
    return column_report(df.sample(share, seed=seed).limit(rows))
