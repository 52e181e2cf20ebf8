"""Coverage map, table description, properties and other small files, written by the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyloom.config import Config, Output
from skyloom.sinks.fits import write_integer_table
from skyloom.sinks.store import Store

BUILDER = "skyloom"
# Publisher and status of a hierarchy that is not published, and meanings of the position columns in table descriptions.
PUBLISHER, STATUS = "ivo://PRIVATE_USER", "public master unclonable"
UCD_RA, UCD_DEC = "pos.eq.ra;meta.main", "pos.eq.dec;meta.main"
VOTABLE = "http://www.ivoa.net/xml/VOTable/v1.3"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_coverage_map(cells: DataFrame, order: int, folder: Store | Path) -> None:
    """Moc.fits (numbers 4 * 4^depth + pixel, ascending) and Moc.json ({depth: pixels}) of compacted cells; empty is allowed.

    ``cells`` (depth, ipix) are at most 12 * 4^order rows, of which the driver holds one 8-byte number each.
    """
    store = folder if isinstance(folder, Store) else Store(str(folder))
    rows = cells.selectExpr("shiftleft(4L, 2 * depth) + ipix AS uniq").orderBy("uniq").toPandas()["uniq"].to_numpy(np.int64)
    extra = [("MOCVERS", "2.0"), ("MOCDIM", "SPACE"), ("ORDERING", "NUNIQ"), ("COORDSYS", "C"), ("MOCORD_S", order), ("MOCTOOL", BUILDER)]
    write_integer_table("Moc.fits", "UNIQ", len(rows), [rows.astype(">i8").tobytes()], extra, store)
    depth = (np.frexp(rows.astype(float))[1] - 3) // 2
    held: dict[str, list[int]] = {str(int(d)): [int(p) for p in rows[depth == d] - (4 << (2 * int(d)))] for d in np.unique(depth)}
    held.setdefault(str(order), [])
    store.write_text("Moc.json", json.dumps(held))


def votable_type(kind: T.DataType) -> str:
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "double"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "long"
    return "char"


def votable(schema: T.StructType, columns: Sequence[str], ra: str, dec: str) -> str:
    """A table description without rows: name and type of each column, the positions marked."""
    root = ET.Element("VOTABLE", {"version": "1.4", "xmlns": VOTABLE})
    table = ET.SubElement(ET.SubElement(root, "RESOURCE", {"type": "results"}), "TABLE")
    for c in columns:
        kind = votable_type(schema[c].dataType)
        field = {"name": c, "ID": "".join(x if x.isalnum() or x == "_" else "_" for x in c), "datatype": kind}
        if kind == "char":
            field["arraysize"] = "*"
        if c in (ra, dec):
            field["ucd"] = UCD_RA if c == ra else UCD_DEC
        ET.SubElement(table, "FIELD", field)
    ET.SubElement(ET.SubElement(table, "DATA"), "TABLEDATA")
    ET.indent(root)
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def write_votables(schema: T.StructType, columns: Sequence[str], ra: str, dec: str, store: Store) -> None:
    for name in ("metadata.xml", "Metadata.xml"):
        store.write_text(name, votable(schema, columns, ra, dec))


def properties(output: Output, level: int, rows: int, when: str) -> str:
    """The hierarchy's properties, HiPS 1.4 keys."""
    place = output.target.split()
    ra, dec = place if len(place) == 2 else ("0", "0")
    values = {
        "creator_did": output.creator_did or f"{PUBLISHER}/{output.cat_name}",
        "obs_title": output.obs_title or output.cat_name,
        "dataproduct_type": "catalog",
        "hips_version": "1.4",
        "hips_release_date": when,
        "hips_status": STATUS,
        "hips_frame": "equatorial",
        "hips_order": level,
        "hips_tile_format": "tsv",
        "publisher_id": PUBLISHER,
        "hips_service_url": f"{output.out_dir.rstrip('/')}/{output.cat_name}",
        "hips_builder": BUILDER,
        "hips_cat_nrows": rows,
        "hips_initial_ra": ra,
        "hips_initial_dec": dec,
        "label": output.cat_name,
        "coordsys": "C",
    }
    return "".join(f"{k:<18}= {v}\n" for k, v in values.items())


def arguments(config: Config, effective: Mapping[str, object]) -> str:
    """The configuration of the run, section by section; ``effective`` holds values found during the run."""
    lines = []
    for section, values in asdict(config).items():
        lines.append(f"# {section}")
        lines += [f"{k}: {effective.get(k, v)}" for k, v in values.items()]
    return "\n".join(lines) + "\n"


class RunLog:
    """Lines with time stamps, appended to process.log."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def __call__(self, text: str) -> None:
        self.store.append_text("process.log", f"{now()} {text}\n")
