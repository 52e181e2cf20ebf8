"""Numeric coercion and the one place where NULL, NaN and infinities are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def as_double(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double; text that is no number becomes NULL. Numeric columns are not cast, so filters still reach the scan."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DoubleType):
        return column(name)
    if isinstance(kind, T.NumericType):
        return column(name).cast("double")
    if isinstance(kind, T.StringType):
        return column(name).try_cast("double")
    if isinstance(kind, T.BooleanType):
        return column(name).cast("int").cast("double")
    return F.lit(None).cast("double")


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def is_finite(c: Column) -> Column:
    """True for finite numbers, false for NULL, NaN and infinities (Spark orders NaN above +inf)."""
    return F.coalesce((c > -INF) & (c < INF), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)
