"""Session helpers shared by every operator: session defaults, shared scratch tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000

#: Rankings cut at up to so many rows a group are cut before the shuffle too.
GROUP_LIMITS = {"spark.sql.optimizer.windowGroupLimitThreshold": "10000"}

_scratch: list[tuple[SparkSession, str]] = []
_shipped: set[str | tuple[str, str]] = set()


def build_session(app: str = "skyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; on a cluster the submitter's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **GROUP_LIMITS,
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is made only where that is unset and the
    session runs in one process; on a cluster without the setting we refuse rather than use a machine-local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="skyloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    Unlike an RDD checkpoint the plan runs once and later reads keep column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is deleted at the end of the surrounding scratch(), else of the process."""
    path = f"{shared_dir(spark).rstrip('/')}/skyloom-tables/{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables written inside when it ends; results needed longer must be written elsewhere before."""
    before = len(_scratch)
    try:
        yield
    finally:
        done = _scratch[before:]
        del _scratch[before:]
        _delete(done)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(build())``; the tables written while building are deleted then."""
    before = len(_scratch)
    out = materialize(build())
    done = _scratch[before:-1]
    del _scratch[before:-1]
    _delete(done)
    return out


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned inside; restored afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: its files go along with the application, once a context."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="skyloom-code-")) / "skyloom.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    context.addPyFile(str(archive))


def ship_file(spark: SparkSession, path: str) -> Callable[[], str]:
    """Let Python workers read a file of the driver (or of any store Spark reads) wherever they run; what is returned tells a worker its path."""
    context, name = spark.sparkContext, path.rstrip("/").rpartition("/")[2]
    if (context.applicationId, path) not in _shipped:
        _shipped.add((context.applicationId, path))
        context.addFile(path)
    return functools.partial(SparkFiles.get, name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least one partition a core, for work that is heavy per row; inputs of enough files stay as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if its counted ``rows`` stay within ``limit``; otherwise ``df`` for a shuffled join (AQE splits skew)."""
    return F.broadcast(df) if rows <= limit else df


@atexit.register
def _sweep() -> None:
    _delete(_scratch)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return
