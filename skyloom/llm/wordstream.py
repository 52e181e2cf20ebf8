"""Pages as streams of word numbers, line by line, the form in which word frequencies are counted.

A word is a run of letters and digits of two and more characters; case, accents and the letters that scanning confuses don't tell words
apart. Three classes of words stand for all their members, as a page may repeat the class without repeating a word: web addresses
(a whole address is one word), the mark of a hash tag (besides the tag's own word) and numbers (words half of digits or more). Everything is done on whole batches with NumPy.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

from skyloom.llm.letters import LOOKALIKES, PAIRS

#: Word numbers of the classes; no other word has them.
ADDRESS, TAG, NUMBER = -1, -2, -3
#: A word's letters count at most so many times.
MOST_LETTERS = 255
_HASHED = 1024  # letters of a word by which it is known; from then on places repeat

_LETTER, _SPACE, _LOWER, _DIGIT = 1, 2, 4, 8


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every UTF-16 unit its plain small letter and what kind of character it is; for every small letter the one it is taken for."""
    fold, kind = np.zeros(65536, np.uint16), np.zeros(65536, np.uint8)
    taken = np.arange(65536, dtype=np.uint16)
    for group in LOOKALIKES:
        taken[[ord(g) for g in group]] = ord(group[0])
    for unit in range(65536):
        if 0xD800 <= unit < 0xE000:
            continue
        ch = chr(unit)
        if ch.isspace():
            kind[unit] = _SPACE
        if not ch.isalnum():
            continue
        base = ord(unicodedata.normalize("NFKD", ch).casefold()[:1] or ch)
        fold[unit] = base if base < 65536 else unit
        kind[unit] = _LETTER | (_DIGIT if ch.isdigit() else 0) | (_LOWER if "a" <= ch <= "z" else 0)
    return fold, kind, taken


@functools.cache
def _powers() -> np.ndarray:
    return np.random.default_rng(2**31 - 1).integers(1, 2**63, _HASHED, np.uint64) | np.uint64(1)


@dataclass
class Words:
    word: np.ndarray  # int32 numbers, all pages one after the other
    letters: np.ndarray  # of each word (an address: its characters)
    line: np.ndarray  # of each word, counted through all pages, lines of spaces left out
    starts: np.ndarray  # first word of each page, and the end
    lines: np.ndarray  # lines of each page


def to_words(texts: list[str]) -> Words:
    """The words of ``texts``; a missing text counts as empty."""
    fold, kind, taken = _tables()
    raw = [(t or "").encode("utf-16-le", "surrogatepass") + b"\n\0" for t in texts]
    ends = np.cumsum([len(r) // 2 for r in raw])
    units = np.frombuffer(b"".join(raw) or b"\n\0", np.uint16)
    kinds = kind[units]
    space = (kinds & _SPACE) > 0
    newline = units == 10
    # lines holding anything but spaces, numbered through
    line_end = np.flatnonzero(newline)
    line_of_unit = np.cumsum(newline) - newline
    shown = np.zeros(len(line_end), bool)
    shown[line_of_unit[~space]] = True
    number = np.cumsum(shown) - 1
    first_line = np.searchsorted(line_end, np.append(0, ends))
    lines = np.diff(np.append(0, np.cumsum(shown))[first_line])

    inside = (kinds & _LETTER) > 0
    # addresses: stretches without spaces that hold "://" after a word, "www." or a dot between word and lower-case letters
    dash = inside | (units == 45)
    dots = np.flatnonzero(units == 46)
    at = lambda i: np.clip(i, 0, len(units) - 1)
    named = np.ones(len(dots), bool)
    for k in (1, 2, 3):
        named &= dash[at(dots - k)] & (kinds[at(dots + k)] & _LOWER > 0)
    named |= (units[at(dots - 1)] | 32 == 119) & (units[at(dots - 2)] | 32 == 119) & (units[at(dots - 3)] | 32 == 119) & inside[at(dots + 1)]
    colons = np.flatnonzero(units == 58)
    schemes = (units[at(colons + 1)] == 47) & inside[at(colons - 1)] & inside[at(colons - 2)] & inside[at(colons - 3)]
    hits = np.concatenate([dots[named], colons[schemes]])
    position, word, length = [], [], []
    if len(hits):
        begin = np.flatnonzero(~space & np.append(True, space[:-1]))
        end = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        own = np.unique(np.searchsorted(begin, hits, side="right") - 1)
        cover = np.zeros(len(units) + 1, np.int8)
        cover[begin[own]] = 1
        cover[end[own]] -= 1
        inside = inside & ~(np.cumsum(cover[:-1], dtype=np.int8) > 0)
        position.append(begin[own])
        length.append(end[own] - begin[own])
        word.append(np.full(len(own), ADDRESS, np.int32))
    tags = np.flatnonzero((units[:-1] == 35) & inside[1:])
    position.append(tags)
    length.append(np.ones(len(tags), np.int64))
    word.append(np.full(len(tags), TAG, np.int32))

    first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    last = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    where = np.flatnonzero(inside)
    code = fold[units[where]]
    size = last - first
    place = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
    keep = np.ones(len(code), bool)
    joined = place[1:] > 0
    for a, b, one in PAIRS:
        hit = np.flatnonzero((code[:-1] == ord(a)) & (code[1:] == ord(b)) & joined & keep[:-1] & keep[1:])
        if a == b and len(hit) > 1:  # of three in a row only the first two are a pair
            hit = hit[np.append(True, np.diff(hit) > 1)]
        code[hit] = ord(one)
        keep[hit + 1] = False
    digit = (kinds[where] & _DIGIT) > 0
    if len(first):
        of_word = np.repeat(np.arange(len(first)), size)
        kept = np.flatnonzero(keep)
        code = taken[code]
        n = np.bincount(of_word[kept], minlength=len(first))
        rank = np.arange(len(kept)) - np.repeat(np.cumsum(n) - n, n)
        mixed = code[kept].astype(np.uint64) * _powers()[rank % _HASHED]
        total = np.add.reduceat(mixed, np.cumsum(n) - n)
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        hashed = (total >> np.uint64(32)).astype(np.uint32).view(np.int32)
        hashed[(hashed <= ADDRESS) & (hashed >= NUMBER)] = 0
        numeric = np.add.reduceat(digit.astype(np.int64), np.cumsum(size) - size) * 2 >= size
        hashed[numeric] = NUMBER
        longer = (size > 1) | numeric
        position.append(first[longer])
        length.append(size[longer])
        word.append(hashed[longer])
    position, length, word = (np.concatenate(x) for x in (position, length, word))
    order = np.argsort(position, kind="stable")
    position, length, word = position[order], length[order], word[order]
    starts = np.searchsorted(position, np.append(0, ends))
    return Words(word, np.minimum(length, MOST_LETTERS), number[line_of_unit[position]], starts, lines)
