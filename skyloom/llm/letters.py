"""Pages as streams of letters in reading order, the form in which scanned text is compared.

Case, punctuation, spaces and line ends vanish (so broken, split and joined words need no repair), and letters that scanning confuses
fall into one class. Everything is done on whole batches with NumPy.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Groups of glyphs that scanners take for one another, the first standing for all; and pairs read as one letter.
LOOKALIKES = ("ao0", "ec", "il1j", "sft5", "nu", "hb8", "gq9")
PAIRS = (("c", "l", "d"), ("r", "n", "m"), ("v", "v", "w"))


@functools.cache
def base_table() -> np.ndarray:
    """For every UTF-16 unit the ASCII letter or digit it is based on, or 0; letters of other scripts share the 26 letters."""
    table = np.zeros(65536, np.uint8)
    for unit in range(65536):
        if 0xD800 <= unit < 0xE000:
            continue
        ch = chr(unit)
        if not ch.isalnum():
            continue
        first = unicodedata.normalize("NFKD", ch).casefold()[:1]
        table[unit] = ord(first) if first.isascii() and first.isalnum() else 97 + unit % 26
    return table


@functools.cache
def class_table() -> np.ndarray:
    """ASCII letter or digit to its class, 1..31."""
    same = {g: group[0] for group in LOOKALIKES for g in group}
    kept = sorted({same.get(chr(c), chr(c)) for c in [*range(48, 58), *range(97, 123)]})
    assert len(kept) < 32
    table = np.zeros(256, np.uint8)
    for c in [*range(48, 58), *range(97, 123)]:
        table[c] = 1 + kept.index(same.get(chr(c), chr(c)))
    return table


@dataclass
class Letters:
    codes: np.ndarray  # uint8 classes, all texts one after the other
    text: np.ndarray  # index of the text of each letter
    unit: np.ndarray  # position of each letter among the UTF-16 units of all texts
    units: np.ndarray  # all UTF-16 units
    starts: np.ndarray  # first letter of each text, and the end


def to_letters(texts: list[str]) -> Letters:
    """The letters of ``texts``; a missing text counts as empty."""
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16)
    base = base_table()[units]
    unit = np.flatnonzero(base)
    base = base[unit]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[unit]
    keep = np.ones(len(base), bool)
    if len(base) > 1:
        near = text[1:] == text[:-1]
        for a, b, one in PAIRS:
            hit = np.flatnonzero((base[:-1] == ord(a)) & (base[1:] == ord(b)) & near & keep[:-1] & keep[1:])
            if a == b and len(hit) > 1:  # of three in a row only the first two are a pair
                hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
            base[hit] = ord(one)
            keep[hit + 1] = False
    codes, text, unit = class_table()[base[keep]], text[keep], unit[keep]
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    return Letters(codes, text, unit, units, starts)


def reading_order(texts: pa.Array, boxes: pa.Array | None) -> list[str]:
    """Each page's lines column by column, top to bottom, as their boxes lie.

    Left edges further apart than half the page's median line width start another column. A page without boxes, or with another
    number of boxes than lines, keeps its own order; a NULL page is empty.
    """
    pages = [t or "" for t in texts.to_pylist()]
    if boxes is None or not len(pages):
        return pages
    n_boxes = np.asarray(boxes.value_lengths().fill_null(0), np.int64)
    flat = boxes.flatten()
    if not len(flat):
        return pages
    x, y, w = (np.asarray(flat.field(flat.type.get_field_index(f)).fill_null(0), np.int64) for f in "xyw")
    page = np.repeat(np.arange(len(pages)), n_boxes)
    ends = np.cumsum(n_boxes)
    begins = ends - n_boxes
    by_width = np.lexsort((w, page))
    some = np.flatnonzero(n_boxes)
    half = np.zeros(len(pages))
    half[some] = np.maximum(1, w[by_width[begins[some] + n_boxes[some] // 2]] / 2)
    by_x = np.lexsort((x, page))
    new = np.ones(len(by_x), bool)
    new[1:] = (np.diff(x[by_x]) > half[page[by_x[1:]]]) | (np.diff(page[by_x]) > 0)
    col = np.empty(len(by_x), np.int64)
    col[by_x] = np.cumsum(new)
    order = np.lexsort((np.arange(len(col)), y, col))
    moved = np.zeros(len(pages), bool)
    moved[page[order[order != np.arange(len(order))]]] = True
    for i in np.flatnonzero(moved):
        lines = pages[i].split("\n")
        if len(lines) == n_boxes[i]:
            first = begins[i]
            pages[i] = "\n".join([lines[k - first] for k in order[first : ends[i]]])
    return pages
