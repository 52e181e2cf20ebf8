"""Wu-Manber search for many patterns at once, in lock-step over a whole array of letters.

A window as long as the shortest pattern slides over the text; the block of letters at its end looks up how far the window may jump
without missing a pattern (block shift table). Where the shift is 0, the window is looked up among the patterns' windows
(suffix-hash buckets, here an exact 60-bit code in a sorted array) and the rest of each pattern is compared directly. Instead of one
window, thousands of lanes advance together, each over its own stretch of the text.
"""

from __future__ import annotations

import numpy as np

WINDOW = 12  # letters; 12 classes of 5 bits are one 60-bit code
BLOCK = 4
LANE = 256


def window_codes(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 60-bit code of the WINDOW letters ending at each of ``ends``."""
    code = np.zeros(len(ends), np.int64)
    for k in range(WINDOW - 1, -1, -1):
        code = (code << 5) | letters[ends - k]
    return code


def _block(letters) -> np.ndarray:
    code = np.zeros(len(letters[0]), np.int32)
    for x in letters:
        code = (code << 5) | x
    return code


class WuManber:
    def __init__(self, patterns: list[np.ndarray]) -> None:
        """``patterns``: arrays of classes 1..31, each at least WINDOW long; equal patterns are found once each."""
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        if len(patterns) and self.lengths.min() < WINDOW:
            raise ValueError(f"a pattern needs at least {WINDOW} letters")
        width = int(self.lengths.max(initial=WINDOW))
        self.padded = np.zeros((len(patterns), width), np.uint8)
        for row, p in zip(self.padded, patterns):
            row[: len(p)] = p
        self.shift = np.full(1 << (5 * BLOCK), WINDOW - BLOCK + 1, np.uint8)
        head = self.padded[:, :WINDOW].astype(np.int64)
        for end in range(BLOCK - 1, WINDOW):
            code = np.zeros(len(patterns), np.int64)
            for k in range(end - BLOCK + 1, end + 1):
                code = (code << 5) | head[:, k]
            np.minimum.at(self.shift, code, WINDOW - 1 - end)
        self.prefix = np.zeros(1 << (5 * BLOCK), bool)
        self.prefix[_block(head.T[:BLOCK])] = True
        codes = window_codes(head.reshape(-1), np.arange(len(patterns)) * WINDOW + WINDOW - 1)
        self.by_code = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[self.by_code], return_index=True)
        self.first = np.append(first, len(patterns))

    def windows(self, letters: np.ndarray) -> np.ndarray:
        """Ends of the windows whose shift is 0 and whose first block begins a pattern."""
        n = len(letters)
        if n < WINDOW or not len(self.codes):
            return np.empty(0, np.int64)
        at = np.arange(WINDOW - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        wide = letters.astype(np.int32)
        found = []
        while len(at):
            code = wide[at]
            for k in range(1, BLOCK):
                code = code | (wide[at - k] << (5 * k))
            jump = self.shift[code]
            still = at[jump == 0]
            head = _block([wide[still - (WINDOW - 1) + k] for k in range(BLOCK)])
            found.append(still[self.prefix[head]])
            at = at + np.maximum(jump, 1)
            go = at < stop
            if not go.all():
                at, stop = at[go], stop[go]
        return np.concatenate(found)

    def search(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``letters``, pattern) of every occurrence."""
        ends = self.windows(letters)
        if not len(ends):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        code = window_codes(letters.astype(np.int64), ends)
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[slot] == code
        ends, slot = ends[hit], slot[hit]
        many = self.first[slot + 1] - self.first[slot]
        start = np.repeat(ends - (WINDOW - 1), many)
        offset = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
        pattern = self.by_code[np.repeat(self.first[slot], many) + offset]
        for k in range(WINDOW, self.padded.shape[1]):
            longer = self.lengths[pattern] > k
            if not longer.any():
                break
            inside = start + k < len(letters)
            same = letters[np.minimum(start + k, len(letters) - 1)] == self.padded[pattern, k]
            ok = ~longer | (inside & same)
            start, pattern = start[ok], pattern[ok]
        return start, pattern
