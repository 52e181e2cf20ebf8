"""Evaluation items standing in training pages.

Wu-Manber search finds every occurrence of an item's letter windows in the pages' letter streams; around these exact pieces the
page is compared with the item letter by letter, tolerating misread, lost and added letters, and pieces that continue each other across
whole interposed lines (adverts, headings, lines of another column) are joined. A page leaks an item if the joined pieces cover
``min_words`` consecutive words of it.

All items share one set of windows: a window is found once, however many items hold it, and items of equal letters are compared once.
One exact window is enough for a page and an item to be looked at: the pieces around all hits are made for all items at once, and only
where pieces that may continue each other span ``min_words`` words are page and item compared letter by letter.

Only the items (a stated set, searched in blocks of about BLOCK_LETTERS letters) travel to the tasks; pages are read once per block, never
shuffled or sent to the driver, and never cut. Blocks change nothing: stock instructions are counted over the whole set.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import column
from skyloom.llm.letters import Letters, reading_order, to_letters
from skyloom.llm.wumanber import WINDOW, WuManber
from skyloom.runtime import materialize, ship_package, spread

#: Letters of items searched at once (a longer item is a block of its own): their tables take some 30 bytes a letter in every worker.
BLOCK_LETTERS = 2_000_000
MIN_WORDS = 15
#: A first sentence standing in so many items is a stock instruction.
STOCK_ITEMS = 3
#: UTF-16 units of text handled at once.
CHUNK_UNITS = 1_500_000
#: Letters of no item between two items.
EDGE = 64
#: With more pieces a page and an item are looked at by themselves.
MANY_PIECES = 32
#: Possible links between pieces looked at together; a page and an item with more are compared letter by letter without.
LINKS_AT_ONCE = 4_000_000
#: Places of windows in items looked at together (or one page's, if it has more).
PLACES_AT_ONCE = 1_500_000
#: Letters: drift inside a piece; damaged letters between two pieces of a line; letters lost around an interposed line; distance from a
#: line's end or start that counts as at it.
DRIFT, DAMAGED, LOST, AT_EDGE = 3, 24, 6, 4
#: A first sentence of fewer words is no instruction ("Mr.").
STOCK_WORDS = 4

_WORD = re.compile(r"[^\W_]+")


class Items:
    """Items prepared for the search: letters, the word of each letter, windows. ``ids[i]``: all items that read as text i."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids: list[list[int]] = []
        self.letters, self.word = [], []
        same: dict[tuple[bytes, bytes], int] = {}
        for item_id, text in rows:
            if item_id is None or not text:
                continue
            words = _WORD.findall(text)
            if not words:
                continue
            # all words in one stream, so that pairs of letters merge as they do on pages
            whole = to_letters([" ".join(words)])
            begin = np.cumsum([0, *[len(w.encode("utf-16-le", "surrogatepass")) // 2 + 1 for w in words]])
            word = np.searchsorted(begin, whole.unit, side="right") - 1
            i = same.setdefault((whole.codes.tobytes(), word.tobytes()), len(self.ids))
            if i == len(self.ids):
                self.ids.append([])
                self.letters.append(whole.codes)
                self.word.append(word)
            self.ids[i].append(item_id)
        # the window at each word start
        found: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (codes, word) in enumerate(zip(self.letters, self.word)):
            for p in np.flatnonzero(np.diff(word, prepend=-1)).tolist():
                if p + WINDOW <= len(codes):
                    found[codes[p : p + WINDOW].tobytes()].append((i, p))
        keys = list(found)
        self.search = WuManber([np.frombuffer(k, np.uint8) for k in keys])
        self.first = np.cumsum([0, *[len(found[k]) for k in keys]])
        places = np.array([x for k in keys for x in found[k]], np.int64).reshape(-1, 2)
        self.item, self.place = places[:, 0], places[:, 1]
        self.bytes = [c.tobytes() for c in self.letters]
        # all items one after the other, EDGE letters of no code between them
        gap = np.full(EDGE, 255, np.uint8)
        self.all = np.concatenate([gap, *[x for c in self.letters for x in (c, gap)]])
        self.all_words = np.concatenate([gap.astype(np.int64), *[x for w in self.word for x in (w, gap)]])
        sizes = np.array([len(c) for c in self.letters], np.int64)
        self.begin = np.cumsum([EDGE, *(sizes + EDGE)])[:-1]
        self.end = self.begin + sizes
        self.fours = _fours(self.all)
        self.longest = int(sizes.max(initial=0))


def _sentence(text: str) -> str:
    head = re.split(r"(?<=[.!?:])\s|\n", text.strip(), maxsplit=1)[0]
    return " ".join(_WORD.findall(head.lower()))


def without_first_sentence(text: str) -> str:
    parts = re.split(r"(?<=[.!?:])\s|\n", text.strip(), maxsplit=1)
    return parts[1] if len(parts) > 1 else ""


_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))


def _extend(s: bytes, q: int, t: bytes, p: int, way: int) -> tuple[int, int]:
    """From letter q of the page and p of the item on (way 1) or back (-1) as far as they go on alike; the last alike letters + way."""
    n, m = len(s), len(t)
    while 0 <= q < n and 0 <= p < m:
        if s[q] == t[p]:
            q += way
            p += way
            continue
        for dq, dp in _STEPS:
            a, b = q + way * dq, p + way * dp
            if way > 0:
                x, y = s[a : a + 4], t[b : b + 4]
            else:
                x, y = s[max(0, a - 3) : a + 1] if a >= 0 else b"", t[max(0, b - 3) : b + 1] if b >= 0 else b""
            # four alike letters, or all that are left of the item
            if len(y) and (x == y if len(y) == 4 else (x[: len(y)] if way > 0 else x[-len(y) :]) == y and len(y) >= 2):
                q, p = a, b
                break
        else:
            break
    return q, p


def _alike(a: bytes, b: bytes) -> bool:
    """Whether ``a`` can be a damaged ``b``: their edit distance is at most two fifths of the longer."""
    most = max(len(a), len(b)) * 2 // 5
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _pieces(s: bytes, t: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(page start, page end, item start, item end) of maximal alike stretches around the exact hits (page, item) of WINDOW letters."""
    out: list[tuple[int, int, int, int]] = []
    n = WINDOW
    for q, p in hits:
        # a hit inside an earlier stretch, on its diagonal, adds nothing
        if any(a <= q and q + n <= b and c <= p and p + n <= d and abs((q - a) - (p - c)) <= DRIFT + (b - a) // 20 for a, b, c, d in out[-6:]):
            continue
        b, d = _extend(s, q + n, t, p + n, 1)
        a, c = _extend(s, q - 1, t, p - 1, -1)
        out.append((a + 1, b, c + 1, d))
    return sorted(set(out))


def _words_covered(pieces: list[tuple[int, int, int, int]], s: bytes, t: bytes, word: np.ndarray, line_of: np.ndarray, line_first: np.ndarray, line_last: np.ndarray) -> int:
    """Most consecutive item words covered by pieces that continue each other."""

    def _at_break(q: int) -> bool:
        """Whether a line ends or begins within AT_EDGE letters (a piece may go on a little by chance)."""
        k = line_of[min(q, len(line_of) - 1)]
        return q - line_first[k] <= AT_EDGE or line_last[k] + 1 - q <= AT_EDGE

    best = 0
    recent: list[tuple[int, int, int, int]] = []  # page end, item start of the whole run, item end, piece's item start
    far: dict[tuple[int, int], int] = {}  # runs that only go on across interposed lines: (piece's item start, item end) -> item start of the run
    for q0, q1, p0, p1 in pieces:
        begin = p0
        at_start = _at_break(q0)
        near = []
        for run in recent:
            e, b, d, own = run
            missing, between = p0 - d, q0 - e  # item letters and page letters between the two pieces
            if between > DAMAGED + LOST:
                if _at_break(e):
                    far[own, d] = min(b, far.get((own, d), b))
                continue
            near.append(run)
            if b >= begin or p1 <= d or p0 <= own or missing > DAMAGED or between < missing - LOST:
                continue
            if between <= max(missing, 0) + LOST if missing <= 0 or between <= 0 else _alike(s[e:q0], t[d:p0]):
                begin = b
            elif missing <= LOST and at_start and _at_break(e):
                begin = b
        recent = near
        if at_start:
            for (own, d), b in far.items():
                if b < begin and d < p1 and own < p0 and p0 - d <= LOST:
                    begin = b
        recent.append((q1, begin, p1, p0))
        best = max(best, _whole_words(begin, p1, word))
    return best


def _whole_words(p0: int, p1: int, word: np.ndarray) -> int:
    """Words of which most letters lie in item letters p0..p1-1."""
    first, last = int(word[p0]), int(word[p1 - 1])
    n = last - first + 1
    for w, inside in ((first, lambda a, b: b - p0), (last, lambda a, b: p1 - a)):
        a, b = bisect.bisect_left(word, w), bisect.bisect_right(word, w)
        if inside(a, b) * 2 <= b - a:
            n -= 1
    return max(n, 0)


def search_pages(pages: list[str], items: Items, min_words: int = 1) -> Iterator[tuple[int, int, int]]:
    """(index of page, index of item, words covered) for every page and item that share an exact piece and may reach ``min_words``."""
    letters = to_letters(pages)
    start, pattern = items.search.search(letters.codes)
    inside = letters.text[start] == letters.text[np.minimum(start + WINDOW - 1, len(letters.text) - 1)] if len(start) else np.empty(0, bool)
    start, pattern = start[inside], pattern[inside]
    if not len(start):
        return
    order = np.argsort(start, kind="stable")
    start, pattern = start[order], pattern[order]
    looks = _Looks(letters, items)
    for a, b in _runs(letters.text[start], items.first[pattern + 1] - items.first[pattern]):
        yield from _found(looks, start[a:b], pattern[a:b], min_words)


def _runs(page: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Hits of whole pages, as many as make up to PLACES_AT_ONCE places."""
    edge = np.append(np.flatnonzero(np.diff(page)) + 1, len(page))  # ends of pages
    sums = np.cumsum(many)[edge - 1]
    a = done = 0
    for k, b in enumerate(edge.tolist()):
        if k + 1 == len(edge) or sums[k + 1] - done > PLACES_AT_ONCE:
            yield a, b
            a, done = b, int(sums[k])


def _fours(codes: np.ndarray) -> np.ndarray:
    """At each letter the code of it and the three after it; NOTHING's places in front and behind match no letters of the other side."""
    wide = codes.astype(np.int32)
    out = wide.copy()
    for k in range(1, 4):
        out[:-k] |= wide[k:] << (8 * k)
    return out


class _Looks:
    """The pages and items as arrays with margins, so that looking a little beyond an end is no error and finds nothing alike."""

    def __init__(self, letters: Letters, items: Items) -> None:
        self.letters, self.items = letters, items
        self.s = np.concatenate([np.zeros(EDGE, np.uint8), letters.codes, np.zeros(EDGE, np.uint8)])
        self.s4, self.t4 = _fours(self.s), items.fours
        line = np.cumsum(letters.units == 10)[letters.unit]
        new = np.ones(len(line), bool)
        new[1:] = (np.diff(line) > 0) | (np.diff(letters.text) > 0)
        self.line_start = np.append(np.flatnonzero(new), len(line))  # first letter of each line that has any

    def extend(self, q: np.ndarray, p: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """_extend for many places at once: one past the last alike letters, or one before the first. May run on into the next page."""
        q, p = q + EDGE, p.copy()
        s, t, s4, t4 = self.s, self.items.all, self.s4, self.t4
        back = 0 if way > 0 else 3
        active = np.arange(len(q))
        while len(active):
            a, b = q[active], p[active]
            going = np.arange(len(active))
            x, y = a, b
            while len(going):  # exactly alike letters
                alike = s[x] == t[y]
                a[going], b[going] = x, y
                going, x, y = going[alike], x[alike] + way, y[alike] + way
            on = np.zeros(len(active), bool)
            for dq, dp in _STEPS:
                left = np.flatnonzero(~on)
                x, y = a[left] + way * dq, b[left] + way * dp
                hit = s4[x - back] == t4[y - back]
                left = left[hit]
                a[left], b[left], on[left] = x[hit], y[hit], True
            q[active], p[active] = a, b
            active = active[on]
        return q - EDGE, p

    def at_break(self, q: np.ndarray) -> np.ndarray:
        """Whether a line ends or begins within AT_EDGE letters."""
        k = np.clip(np.searchsorted(self.line_start, q, side="right") - 1, 0, len(self.line_start) - 2)
        return (q - self.line_start[k] <= AT_EDGE) | (self.line_start[k + 1] - q <= AT_EDGE)


def _packed_keys(pair: np.ndarray, diagonal: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, int, int] | None:
    """One sortable number each, and the bits of its two lower parts; None if 63 bits don't do."""
    low, mid = int(p.max()).bit_length(), int(diagonal.max()).bit_length()
    if int(pair.max()).bit_length() + mid + low > 63:
        return None
    return (pair << (mid + low)) | (diagonal << low) | p, mid, low


def _found(looks: _Looks, start: np.ndarray, pattern: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int]]:
    """What search_pages gives, from all hits of some pages.

    Hits become maximal pieces, all at once; pieces that may continue each other are linked, and only a page and an item whose linked
    pieces span ``min_words`` words are compared letter by letter. The links leave out nothing that _words_covered would join.
    """
    letters, items = looks.letters, looks.items
    many = items.first[pattern + 1] - items.first[pattern]
    which = items.first[pattern].repeat(many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    page = letters.text[start].astype(np.int64)
    first_page, n_items = int(page[0]), len(items.ids)
    item, p = items.item[which], items.place[which]
    pair = (page - first_page).repeat(many) * n_items + item
    # the diagonal: where on the page the item would begin
    diagonal = (start - letters.starts[page]).repeat(many) - p + items.longest
    packed = _packed_keys(pair, diagonal, p)
    if packed is None:
        half = int(np.searchsorted(page, (page[0] + page[-1] + 1) // 2))
        if half in (0, len(page)):
            raise ValueError("a page is too long to be searched for so many items")
        yield from _found(looks, start[:half], pattern[:half], min_words)
        yield from _found(looks, start[half:], pattern[half:], min_words)
        return
    keys, mid, low = packed
    keys.sort()
    diagonal_of, p = keys >> low, keys & ((1 << low) - 1)
    # hits that touch on one diagonal are one run of alike letters
    new = np.ones(len(keys), bool)
    new[1:] = (diagonal_of[1:] != diagonal_of[:-1]) | (p[1:] - p[:-1] > WINDOW)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(keys)) - 1
    pair = diagonal_of[head] >> mid
    item = pair % n_items
    begin, end = items.begin[item], items.end[item]
    shift = (diagonal_of[head] & ((1 << mid) - 1)) - items.longest + letters.starts[first_page + pair // n_items] - begin  # page letter - item letter
    b, d = looks.extend(p[tail] + WINDOW + begin + shift, p[tail] + WINDOW + begin, 1)
    a, c = looks.extend(p[head] - 1 + begin + shift, p[head] - 1 + begin, -1)
    a, c = a + 1, c + 1
    # near an item's ends fewer alike letters are enough to go on
    d, c = np.where(end - d < 6, end, d), np.where(c - begin < 6, begin, c)
    # places are below 2^31, as pages and items come in limited parts
    hopeful = _may_reach(looks, pair, *(x.astype(np.int32) for x in (a, b, c, d)), min_words)
    if not len(hopeful):
        return
    pair_of = keys >> (mid + low)
    at = -1
    for own, f, l in zip(hopeful.tolist(), np.searchsorted(pair_of, hopeful).tolist(), np.searchsorted(pair_of, hopeful, side="right").tolist()):
        k, i = first_page + own // n_items, own % n_items
        if k != at:
            at = k
            low_, high = int(letters.starts[k]), int(letters.starts[k + 1])
            s = letters.codes[low_:high].tobytes()
            x, y = np.searchsorted(looks.line_start, [low_, high])
            line_start = looks.line_start[x : y + 1] - low_
            line_of = np.repeat(np.arange(y - x), np.diff(line_start))
            line_first, line_last = line_start[:-1], line_start[1:] - 1
        places = p[f:l]
        on_page = (diagonal_of[f:l] & ((1 << mid) - 1)) - items.longest + places
        order = np.argsort(on_page, kind="stable")
        pieces = _pieces(s, items.bytes[i], list(zip(on_page[order].tolist(), places[order].tolist())))
        yield k, i, _words_covered(pieces, s, items.bytes[i], items.word[i], line_of, line_first, line_last)


def _parts(edge: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in parts of about LINKS_AT_ONCE possible links."""
    part = np.cumsum(size * size) // LINKS_AT_ONCE
    for k in np.unique(part):
        yield edge[part == k], size[part == k]


def _links(looks: _Looks, edge: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): piece j may continue piece i of the same pair; pairs begin at ``edge`` and have ``size`` pieces each."""
    n = size * size
    wide = np.repeat(size.astype(np.int32), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    first = np.repeat(edge.astype(np.int32), n)
    return _linked(looks, first + at // wide, first + at % wide, a, b, c, d)


def _links_of_many(looks: _Looks, e: int, m: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """_links of one pair with many pieces: those near each other on the page, and those at breaks; None if these are too many as well."""
    own = e + np.argsort(a[e : e + m], kind="stable")
    low = np.searchsorted(a[own], b[own] - (d[own] - c[own]) - LOST)
    n = np.searchsorted(a[own], b[own] + DAMAGED + LOST, side="right") - low
    ends, begins = own[looks.at_break(b[own])], own[looks.at_break(a[own])]
    if n.sum() + len(ends) * len(begins) > LINKS_AT_ONCE:
        return None
    i = np.concatenate([np.repeat(own, n), np.repeat(ends, len(begins))])
    j = np.concatenate([own[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.tile(begins, len(ends))])
    return _linked(looks, i, j, a, b, c, d)


def _linked(looks: _Looks, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of possible links those that _words_covered may join."""
    following = (c[j] - d[i] <= DAMAGED) & (c[j] > c[i])
    i, j = i[following], j[following]
    missing, between = c[j] - d[i], a[j] - b[i]
    inside = (missing > 0) & (between > 0)
    # what lies between must be as long as what is missing, as far as _words_covered wants it
    near = np.where(inside, (between <= DAMAGED + LOST) & (np.abs(between - missing) <= np.maximum(between, missing) * 2 // 5), between <= np.maximum(missing, 0) + LOST)
    linked = (d[j] > d[i]) & (between >= missing - LOST) & (near | (missing <= LOST))
    i, j, near = i[linked], j[linked], near[linked]
    near[~near] = looks.at_break(b[i[~near]]) & looks.at_break(a[j[~near]])
    return i[near], j[near]


def _may_reach(looks: _Looks, pair: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, min_words: int) -> np.ndarray:
    """The pairs whose pieces (page a..b, item c..d, sorted by pair) may together cover ``min_words`` words."""
    words = looks.items.all_words
    span = lambda c, d: words[d - 1] - words[c] + 1
    sure = span(c, d) >= min_words
    reached = [pair[sure]]
    edge = np.flatnonzero(np.diff(pair, prepend=-1))
    size = np.diff(np.append(edge, len(pair)))
    done = np.logical_or.reduceat(sure, edge)
    open_ = ~done & (size > 1) & (size <= MANY_PIECES)
    links = [_links(looks, e, m, a, b, c, d) for e, m in _parts(edge[open_], size[open_])]
    for k in np.flatnonzero(~done & (size > MANY_PIECES)).tolist():
        found = _links_of_many(looks, int(edge[k]), int(size[k]), a, b, c, d)
        if found is None:
            reached.append(pair[edge[k : k + 1]])
        else:
            links.append(found)
    i, j = (np.concatenate(x) for x in zip(*links)) if links else (edge[:0], edge[:0])
    begin = c.copy()
    while len(i):
        before = begin[j]
        np.minimum.at(begin, j, begin[i])
        if (begin[j] == before).all():
            break
    reached.append(pair[j[span(begin[j], d[j]) >= min_words]])
    return np.unique(np.concatenate(reached))


def _blocks(pages: list[str], limit: int) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(pages):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(pages):
        yield begin, len(pages)


def _searcher(items: Items, doc_id: str, text: str, boxes: str | None, min_words: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = reading_order(batch.column(text), batch.column(boxes) if boxes else None)
            ids = batch.column(doc_id)
            docs, found, words = [], [], []
            for a, b in _blocks(pages, CHUNK_UNITS):
                for k, i, n in search_pages(pages[a:b], items, min_words=min_words):
                    if n >= min_words:
                        for item_id in items.ids[i]:
                            docs.append(a + k)
                            found.append(item_id)
                            words.append(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs, pa.int64())), pa.array(found, pa.int64()), pa.array(words, pa.int32())], names=["doc_id", "item_id", "n_words"])

    return search


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("head", pa.array([_sentence(t) for t in batch.column("text").to_pylist()], pa.string()))


def _prepared(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, text, stock): the distinct items, and whether the text begins with a stock instruction, counted over the whole set."""
    clean = items.select(column(item_id).cast("long").alias("item_id"), column(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    headed = materialize(clean.mapInArrow(_heads, "item_id long, text string, head string"))
    stock = headed.groupBy("head").agg(F.count_distinct("text").alias("n")).where((F.col("n") >= STOCK_ITEMS) & (F.size(F.split("head", " ")) >= STOCK_WORDS))
    return headed.join(stock, "head", "left").select("item_id", "text", F.col("n").isNotNull().alias("stock"))


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items without their stock instructions, in blocks of about BLOCK_LETTERS; at least one block, which may be empty."""
    block, size, n = [], 0, 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, without_first_sentence(r.text) if r.stock else r.text))
        size += len(r.text) + EDGE
        if size > BLOCK_LETTERS:
            yield block
            block, size, n = [], 0, n + 1
    if block or not n:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words): each page holding at least ``min_words`` consecutive words of an item, and the longest such run.

    Words count without case, accents and punctuation and in reading order (by ``boxes`` if given). A stock instruction in front of an
    item belongs to no passage. Items shorter than ``min_words`` words never match. NULL or empty texts, and items with a NULL id,
    match nothing; documents with a NULL id are reported under NULL; a repeated row is reported again. Items with equal texts are
    all reported. ``min_words`` below 5 is refused: fewer words hold too few letter windows for the search to be complete.
    """
    if min_words < 5:
        raise ValueError("min_words must be at least 5")
    source = documents.select(column(doc_id).alias("doc_id"), column(text).alias("text"), *([column(boxes).alias("boxes")] if boxes else []))
    source = spread(source.where(F.length("text") > 0))
    kind = documents.schema[doc_id].dataType.simpleString()
    ship_package(documents.sparkSession)
    found: list[DataFrame] = []
    for rows in _item_blocks(_prepared(items, item_id, item_text)):
        if found:  # one block at a time: its letters leave the driver before the next
            found[-1] = materialize(found[-1])
        found.append(source.mapInArrow(_searcher(Items(rows), "doc_id", "text", "boxes" if boxes else None, min_words), f"doc_id {kind}, item_id long, n_words int"))
    return reduce(DataFrame.unionByName, found)
