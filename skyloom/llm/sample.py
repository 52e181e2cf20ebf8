"""A random sample that stays the same on every run and layout and keeps its picks as data grows.

Epoch-rate selection: a registry holds, for every identifier, the epoch in which it was first seen and that epoch's rate, frozen. An
identifier is picked if its draw, a counter-based random number (Philox 2x32-10 keyed by the seed, the identifier being the counter), falls
below its frozen rate. Rates of later epochs may differ; nothing picked is ever given up, and repeated rows share their identifier's fate.

The registry lasts in a folder the caller names: ``register`` appends what a delivery brings, ``load_registry`` reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.numeric import column, quoted
from skyloom.functions.philox import philox


def draw(identifier: Column, seed: int) -> Column:
    """The identifier's draw, a long in [0, 2^32); NULL for a NULL identifier."""
    return philox(identifier, seed)


def new_entries(rows: DataFrame, identifier: str, epoch: str, rates: dict[int, float], default_rate: float, registry: DataFrame | None = None) -> DataFrame:
    """(id, epoch, rate) of the identifiers not yet in ``registry``: what to append to it, and never to change afterwards.

    The epoch is the smallest among the identifier's rows; its rate comes from ``rates``, else ``default_rate``, also where no row
    has an epoch. NULL identifiers are left out. Only identifiers and epochs are shuffled, combined before.
    """
    if any(not 0 <= r <= 1 for r in [*rates.values(), default_rate]):
        raise ValueError("rates must lie between 0 and 1")
    seen = rows.where(column(identifier).isNotNull()).groupBy(column(identifier).cast("long").alias("id")).agg(F.min(column(epoch)).cast("int").alias("epoch"))
    if registry is not None:
        seen = seen.join(registry.select("id"), "id", "left_anti")
    rate = F.lit(float(default_rate))
    for e, r in rates.items():
        rate = F.when(F.col("epoch") == e, float(r)).otherwise(rate)
    return seen.withColumn("rate", rate)


def sampled(rows: DataFrame, identifier: str, registry: DataFrame, seed: int) -> DataFrame:
    """The rows, all columns kept, whose identifier is picked; rows whose identifier is NULL or not registered are left out.

    Draws are made on the registry (once an identifier), and only picked identifiers meet the rows.
    """
    picked = registry.where(draw(F.col("id"), seed) < F.floor(F.col("rate") * float(1 << 32))).select(F.col("id").alias("_picked"))
    return rows.join(picked, rows[quoted(identifier)].cast("long") == picked["_picked"], "left_semi")


REGISTRY = "id long, epoch int, rate double"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, epoch, rate) of the registry in folder ``path``, one row an identifier; empty where no folder is.

    Two deliveries registered at the same time may both have brought an identifier: its earliest epoch and its highest rate count, so
    nothing picked from either is given up.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(path).groupBy("id").agg(F.min("epoch").alias("epoch"), F.max("rate").alias("rate"))


def register(rows: DataFrame, identifier: str, epoch: str, rates: dict[int, float], default_rate: float, path: str) -> DataFrame:
    """Append the identifiers of ``rows`` not yet registered to the registry in folder ``path``; the registry as it is then.

    Nothing already there changes, so a delivery registered twice, or again after a failure, adds only what is missing.
    """
    spark = rows.sparkSession
    new_entries(rows, identifier, epoch, rates, default_rate, load_registry(spark, path)).write.mode("append").parquet(path)
    return load_registry(spark, path)
