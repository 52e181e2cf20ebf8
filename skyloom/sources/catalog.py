"""Catalogues as DataFrames: Parquet, CSV, TSV and HATS folders, column resolution and the kept columns."""

from __future__ import annotations

import glob
import re
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.config import Columns, Config
from skyloom.functions.numeric import column
from skyloom.functions.score import score_columns
from skyloom.runtime import materialize

#: Columns a HATS folder layout adds; they are partition keys, not catalogue columns.
HATS_KEYS = ("Norder", "Dir", "Npix")
MARKERS = ("collection.properties", "hats.properties", "properties")


def is_uri(path: str) -> bool:
    """Whether a scheme comes first; Hadoop writes file:/x for file:///x."""
    return re.match(r"[A-Za-z][\w+.-]+:/", path) is not None


class Folder:
    """A path in any file system Spark reads, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path if is_uri(path) else "file://" + str(Path(path).resolve())

    def _hadoop(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path.rstrip('/')}/{name}")

    @property
    def parent(self) -> Folder | None:
        above = self._hadoop()[1].getParent()
        return None if above is None else Folder(self.spark, above.toString())

    def is_file(self) -> bool:
        system, where = self._hadoop()
        return system.exists(where) and system.getFileStatus(where).isFile()

    def is_dir(self) -> bool:
        system, where = self._hadoop()
        return system.exists(where) and system.getFileStatus(where).isDirectory()

    def glob(self) -> list[str]:
        """The matches of the path as a pattern, in order."""
        system, where = self._hadoop()
        return sorted(x.getPath().toString() for x in system.globStatus(where) or [])

    def lines(self) -> list[str]:
        system, where = self._hadoop()
        stream = system.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8").splitlines()
        finally:
            stream.close()


def expand_paths(patterns: Sequence[str], spark: SparkSession | None = None) -> list[str]:
    """Files matching the patterns, in order; those of other file systems by their own listing (without a session they are kept). None is an error."""
    found: list[str] = []
    for p in patterns:
        found += (Folder(spark, p).glob() if spark else [p]) if is_uri(p) else sorted(glob.glob(p))
    if not found:
        raise FileNotFoundError(f"no input matches {list(patterns)}")
    return found


def _properties(lines: Sequence[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        key, sign, value = line.partition("=")
        if sign and not line.lstrip().startswith("#"):
            out[key.strip()] = value.strip()
    return out


def read_properties(path: Path) -> dict[str, str]:
    """A "key = value" file; blank lines and lines starting with # are skipped."""
    return _properties(path.read_text(encoding="utf-8").splitlines())


def find_hats_root(path: str, spark: SparkSession | None = None) -> Path | str | None:
    """The nearest folder at or above ``path`` that a HATS marker file names as a catalogue or collection."""
    if not is_uri(path):
        here = Path(path).resolve()
        return next((p for p in [here, *here.parents] if any((p / m).is_file() for m in MARKERS[:2])), None)
    at = Folder(spark, path) if spark else None
    while at is not None:
        if any((at / m).is_file() for m in MARKERS[:2]):
            return at.path
        at = at.parent
    return None


def hats_catalog_folder(here: Folder) -> Folder:
    """The catalogue folder: a collection names its primary one in its properties."""
    collection = here / MARKERS[0]
    if collection.is_file():
        return here / _properties(collection.lines()).get("hats_primary_table_url", "catalog")
    return here


def read_hats(spark: SparkSession, path: str) -> DataFrame:
    """A HATS catalogue with its partition keys ``Norder`` and ``Npix`` as columns, taken from the folders Norder=/Dir=/Npix=."""
    folder = hats_catalog_folder(Folder(spark, path))
    data = folder / "dataset" if (folder / "dataset").is_dir() else folder
    if not (data / "Norder=*/Dir=*/Npix=*").glob():
        raise FileNotFoundError(f"no HATS partitions under {data.path}")
    reader = spark.read.option("basePath", data.path).option("recursiveFileLookup", "false")
    df = reader.parquet((data / "Norder=*/Dir=*").path)
    if "Npix" not in df.columns:  # leaves are files Npix=N.parquet, which partition discovery does not see
        df = df.withColumn("Npix", F.regexp_extract(F.input_file_name(), r"Npix=(\d+)", 1).cast("long"))
    return df.withColumn("Norder", F.col("Norder").cast("int")).withColumn("Npix", F.col("Npix").cast("long")).drop("Dir")


def hats_index_order(df: DataFrame) -> tuple[str, int] | None:
    """Name and order of a ``_healpix_N`` column, if there is one."""
    for name in df.columns:
        digits = name.removeprefix("_healpix_")
        if name != digits and digits.isdigit() and isinstance(df.schema[name].dataType, T.IntegralType):
            return name, int(digits)
    return None


#: A number as text files hold it (a cast alone would also take "1d").
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|NaN|NAN|inf|Inf|Infinity|-inf)\s*$"


def _text_table(spark: SparkSession, paths: list[str], config: Config) -> DataFrame:
    """A text table, parsed once and written to the shared folder as it stands; the types are found there.

    A column is double if all its values are numbers, boolean if all are true or false, else text as in the file. Empty fields are NULL.
    """
    kind = (config.input.ascii_format or config.input.format).lower()
    reader = spark.read.option("sep", "\t" if kind == "tsv" else ",").option("header", config.input.header).option("inferSchema", False)
    df = materialize(reader.csv(paths))
    facts = []
    for i, f in enumerate(df.schema):
        c = column(f.name)
        facts += [F.count(c).alias(f"n{i}"), F.count(F.when(c.rlike(NUMBER_TEXT), 1)).alias(f"d{i}"), F.count(F.when(F.lower(F.trim(c)).isin("true", "false"), 1)).alias(f"b{i}")]
    found = df.agg(*facts).first()
    typed = []
    for i, f in enumerate(df.schema):
        c, n = column(f.name), found[f"n{i}"]
        typed.append(c.try_cast("double").alias(f.name) if n and found[f"d{i}"] == n else (F.lower(F.trim(c)) == "true").alias(f.name) if n and found[f"b{i}"] == n else c)
    return df.select(*typed)


def read_catalog(spark: SparkSession, config: Config) -> DataFrame:
    """The input as one lazily read DataFrame; files are split at spark.sql.files.maxPartitionBytes, no shuffle."""
    kind = config.input.format.lower()
    if kind == "hats":
        if len(config.input.paths) != 1:
            raise ValueError("a hats input is exactly one folder")
        return read_hats(spark, expand_paths(config.input.paths, spark)[0])
    paths = expand_paths(config.input.paths, spark)
    if kind == "parquet":
        return spark.read.parquet(*paths)
    if kind in ("csv", "tsv"):
        return _text_table(spark, paths, config)
    raise ValueError(f"unknown input format {config.input.format!r}")


def resolve(name: str | int, columns: Sequence[str], header: bool = True) -> str:
    """A column by name; without header also by its number from 1. KeyError for unknown names, IndexError for numbers out of range."""
    text = str(name)
    if not header and text.lstrip("-").isdigit():
        at = int(text)
        if not 1 <= at <= len(columns):
            raise IndexError(f"column {at} of {len(columns)}")
        return columns[at - 1]
    if text not in columns:
        raise KeyError(f"no column {text!r} among {list(columns)}")
    return text


@dataclass(frozen=True)
class Roles:
    ra: str
    dec: str
    score: str
    mag: str | None
    keep: tuple[str, ...]  # columns of the tiles, in order


def roles(df: DataFrame, config: Config) -> Roles:
    """Resolved columns and the tile's columns: RA, DEC, what the score needs, the magnitude (mag_global only), then the kept others.

    No ``keep``: all others in input order; empty: none; unknown names in it are ignored.
    """
    wanted: Columns = config.columns
    available = [c for c in df.columns if not (config.input.format.lower() == "hats" and c in HATS_KEYS)]
    header = config.input.header or config.input.format.lower() not in ("csv", "tsv")
    find = lambda name: resolve(name, available, header)
    ra, dec = find(wanted.ra), find(wanted.dec)
    score = wanted.score
    if not header and str(score).isdigit():
        score = find(score)
    mag = config.algorithm.mag_column
    mag = find(mag) if mag is not None and config.algorithm.selection_mode == "mag_global" else None
    first = [ra, dec, *score_columns(str(score), available), *([mag] if mag else [])]
    rest = available
    if wanted.keep is not None:
        rest = [find(k) if not header and str(k).isdigit() else k for k in wanted.keep]
    keep = tuple(dict.fromkeys(c for c in [*first, *rest] if c in available))
    return Roles(ra, dec, str(score), mag, keep)
