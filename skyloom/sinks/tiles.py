"""Tiles as TSV files, written by the executors.

Rows are shuffled by tile and sorted within partitions, so a task streams each of its tiles from its first row to its last; nothing is
gathered in memory and nothing passes the driver but one line per file. In front of a tile's rows comes a row with its counts, which are
aggregated beforehand. Files appear under their final name only when complete, so a repeated task merely writes the same file again. The
store must be one all executors reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.numeric import column
from skyloom.runtime import ship_package
from skyloom.sinks.store import Store

TILES_A_DIR = 10_000
ALLSKY_ORDERS = (1, 2)
INTERNAL = ("__ipix__", "__score__", "__icov__")
_BLANK = str.maketrans("\t\r\n", "   ")


def tile_path(depth: int, pixel: int) -> str:
    return f"Norder{depth}/Dir{pixel // TILES_A_DIR * TILES_A_DIR}/Npix{pixel}.tsv"


def tile_path_column(depth: Column, pixel: Column) -> Column:
    folder = F.floor(pixel / TILES_A_DIR) * TILES_A_DIR
    return F.concat(F.lit("Norder"), depth.cast("string"), F.lit("/Dir"), folder.cast("string"), F.lit("/Npix"), pixel.cast("string"), F.lit(".tsv"))


def header_line(columns: Sequence[str]) -> str:
    return "\t".join(columns) + "\n"


def completeness_line(in_catalogue: int, written: int) -> str:
    return f"# Completeness = {max(0, in_catalogue - written)} / {in_catalogue}\n"


def clean_text(text: Column) -> Column:
    return F.regexp_replace(text, "[\t\r\n]", " ")


def cell_text(value: Any) -> str:
    """A value as tile text: missing and NaN empty, floats in their shortest exact form, True/False, text on one line, quoted if needed."""
    if value is None:
        return ""
    if isinstance(value, float):
        return "" if math.isnan(value) else repr(value)
    if isinstance(value, bool | int | Decimal):
        return str(value)
    text = str(value).translate(_BLANK)
    if '"' in text:
        return '"' + text.replace('"', '""') + '"'
    return text


def _plain(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Tile columns as types a text cell can show: nested ones as JSON, times as text."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            out.append(F.to_json(column(c)))
        elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            out.append(column(c).cast("string"))
        elif isinstance(kind, T.BinaryType):
            out.append(F.base64(column(c)))
        elif isinstance(kind, T.FloatType):
            out.append(column(c).cast("string").cast("double"))
        else:
            out.append(column(c))
    return out


def _writer(root: str, columns: list[str], path_of: Callable[[int, int], str]) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        tile, key, rows, done = None, None, 0, []
        try:
            for batch in batches:
                keys = zip(*[batch.column(n).to_pylist() for n in ("_depth", "_ipix", "_head", "_in_catalogue", "_written")])
                cells = zip(*[[cell_text(v) for v in batch.column(f"_c{i}").to_pylist()] for i in range(len(columns))])
                for (depth, pixel, head, in_catalogue, written), line in zip(keys, cells):
                    if head:
                        if tile:
                            tile.finish()
                            done.append((*key, rows))
                        key, rows = (depth, pixel), 0
                        tile = store.open(path_of(depth, pixel))
                        tile.write((completeness_line(in_catalogue or 0, written) + header_line(columns)).encode())
                    elif (depth, pixel) != key:
                        raise RuntimeError(f"rows of tile {depth}/{pixel} without its counts")
                    else:
                        tile.write(("\t".join(line) + "\n").encode())
                        rows += 1
            if tile:
                tile.finish()
                done.append((*key, rows))
        except BaseException:
            if tile:
                tile.discard()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["depth", "ipix", "n_written"])

    return write


def _within(selected: DataFrame) -> DataFrame:
    """Rows whose pixel is 0 .. 12 * 4^depth - 1."""
    return selected.where((F.col("ipix") >= 0) & (F.col("ipix") < F.expr("12 * shiftleft(1L, 2 * depth)")))


def _for_writer(rows: DataFrame, heads: DataFrame, columns: Sequence[str], order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows as the writer takes them: files (``by``) whole in a partition, each one's counts (``heads``) in front of its rows."""
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True)), allowMissingColumns=True)
    met = both.repartition(*by).sortWithinPartitions(*by, F.desc("_head"), "ipix", *order)
    text = [c.alias(f"_c{i}") for i, c in enumerate(_plain(met, columns))]
    pixel = F.col("ipix") if "ipix" in by else F.lit(-1)
    return met.select(F.col("depth").cast("int").alias("_depth"), pixel.cast("long").alias("_ipix"), "_head", "_in_catalogue", "_written", *text)


def tile_counts(selected: DataFrame, maps: DataFrame) -> DataFrame:
    """(depth, ipix, _in_catalogue, _written) of every tile; the catalogue's count of a pixel without one is 0."""
    written = selected.groupBy(F.col("depth").cast("int").alias("depth"), "ipix").agg(F.count(F.lit(1)).alias("_written"))
    counts = maps.select(F.col("depth").cast("int").alias("depth"), "ipix", F.col("n").alias("_in_catalogue"))
    return written.join(counts, ["depth", "ipix"], "left").withColumn("_in_catalogue", F.coalesce("_in_catalogue", F.lit(0).cast("long")))


def write_tiles(selected: DataFrame, maps: DataFrame, columns: Sequence[str], order: Sequence[Column], root: str) -> DataFrame:
    """Write every tile of the selected rows (with ``depth`` and ``ipix``); (depth, ipix, n_written) of the files.

    Pixels outside 0 .. 12 * 4^depth - 1 are dropped. Run by an action on the result (materialize it).
    """
    ship_package(selected.sparkSession)
    shown = [c for c in columns if c not in INTERNAL]
    kept = _within(selected)
    rows = _for_writer(kept, tile_counts(kept, maps), shown, order, ["depth", "ipix"])
    return rows.mapInArrow(_writer(root, list(shown), tile_path), "depth int, ipix long, n_written long")


def write_allsky(selected: DataFrame, stats: dict[int, int], columns: Sequence[str], order: Sequence[Column], root: str) -> DataFrame:
    """Write Norder{d}/Allsky.tsv for orders 1 and 2: one file each, streamed by one task in tile order (the format wants one file)."""
    ship_package(selected.sparkSession)
    shown = [c for c in columns if c not in INTERNAL]
    total = F.lit(None).cast("long")
    for d, n in stats.items():
        total = F.when(F.col("depth") == d, n).otherwise(total)
    kept = selected.where(F.col("depth").isin(*ALLSKY_ORDERS))
    heads = kept.groupBy("depth").agg(F.count(F.lit(1)).alias("_written")).withColumn("_in_catalogue", total)
    rows = _for_writer(kept, heads, shown, order, ["depth"])
    return rows.mapInArrow(_writer(root, list(shown), lambda depth, _: f"Norder{depth}/Allsky.tsv"), "depth int, ipix long, n_written long")
