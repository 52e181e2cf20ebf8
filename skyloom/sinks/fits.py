"""FITS binary tables with one integer column, as density maps and coverage maps need them (FITS standard 4.0)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.healpix import pixels_at
from skyloom.runtime import ship_package
from skyloom.sinks.store import Store

BLOCK, CARD = 2880, 80
#: Pixels in one piece of a map: 512 KB of counts.
PIECE = 1 << 16
#: Deeper maps are not written.
DEEPEST_MAP = 12


def card(key: str, value: object, comment: str = "") -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {text}{' / ' + comment if comment else ''}"[:CARD].ljust(CARD)


def header(cards: Sequence[tuple]) -> bytes:
    text = "".join(card(*c) for c in cards) + "END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


def write_integer_table(path: str | Path, column: str, rows: int, pieces: Iterable[bytes], extra: Sequence[tuple] = (), store: Store | None = None) -> None:
    """A file with an empty primary unit and a table of ``rows`` big-endian 64-bit integers, written piece by piece.

    ``path`` is a name in ``store``, or a local file.
    """
    if store is None:
        store, path = Store(str(Path(path).parent)), Path(path).name
    with store.open(str(path)) as f:
        f.write(header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]))
        table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 8), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", column), ("TFORM1", "K")]
        f.write(header([*table, *extra]))
        size = 0
        for p in pieces:
            f.write(p)
            size += len(p)
        if size != 8 * rows:
            raise ValueError(f"{size} bytes for {rows} rows")
        f.write(b"\0" * (-size % BLOCK))


def _dense(group: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(PIECE, ">i8")
    counts[group["ipix"].to_numpy() % PIECE] = group["n"].to_numpy()
    return pd.DataFrame({"piece": [int(group["ipix"].iloc[0]) // PIECE], "data": [counts.tobytes()]})


def map_pieces(maps: DataFrame, depth: int) -> Iterator[bytes]:
    """The dense map of one depth in pieces, in pixel order: executors densify, the driver passes on one piece at a time."""
    ship_package(maps.sparkSession)
    rows = maps.where(F.col("depth") == depth).select("ipix", "n")
    done = rows.groupBy(F.floor(F.col("ipix") / PIECE)).applyInPandas(_dense, "piece long, data binary").orderBy("piece")
    total, at = pixels_at(depth), 0
    for r in done.toLocalIterator():
        yield from _empty(at, r["piece"] * PIECE)
        at = min((r["piece"] + 1) * PIECE, total)
        yield bytes(r["data"])[: 8 * (at - r["piece"] * PIECE)]
    yield from _empty(at, total)


def dense_map(maps: DataFrame, depth: int) -> np.ndarray:
    """The counts of all pixels of one depth as one array (8 bytes a pixel in the driver; depths up to DEEPEST_MAP)."""
    if depth > DEEPEST_MAP:
        raise ValueError(f"depth {depth} is too deep for a dense map")
    return np.frombuffer(b"".join(map_pieces(maps, depth)), ">i8").astype(np.int64)


def _empty(first: int, end: int) -> Iterator[bytes]:
    while first < end:
        n = min(PIECE, end - first)
        yield bytes(8 * n)
        first += n


def write_density_map(maps: DataFrame, depth: int, store: Store) -> None:
    if depth <= DEEPEST_MAP:
        write_integer_table(f"densmap_o{depth}.fits", "VALUE", pixels_at(depth), map_pieces(maps, depth), store=store)


def read_integer_table(path: Path) -> tuple[dict[str, str], np.ndarray]:
    """(table header, values) of a file written by write_integer_table."""
    raw = path.read_bytes()
    cards, at, heads = [], 0, 0
    while heads < 2:
        block = raw[at : at + BLOCK].decode("ascii")
        at += BLOCK
        found = [block[i : i + CARD] for i in range(0, BLOCK, CARD)]
        cards += found if heads else []
        heads += any(c.startswith("END ") for c in found)
    info = {c[:8].strip(): c[10:].split(" / ")[0].strip().strip("'").strip() for c in cards if c[8:10] == "= "}
    return info, np.frombuffer(raw, ">i8", int(info["NAXIS2"]), at)
