"""Pages stuffed with keywords, addresses or product tags.

1. Pages become streams of word numbers, once; every later step reads these.
2. Word rates of each language are counted over distinct texts, then again without the pages that stand out against them (so stuffed pages
   don't make their words look like prose). A page is compared with rates that leave out its own words.
3. Each page's lines are ranked by their divergence: how much more often than in the language the page uses their words. The half of the lines
   that departs most has its own rank-frequency curve: SQL windows rank its words and fit log frequency against log rank.
4. A page is flagged if its half's slope, residual, divergence or peak (the largest divergence of one word) lies far outside those of ordinary
   pages of the same language and comparable length.
5. An exact check follows: more than half of the lines must consist of overused words. It only settles that it is more than half; listings and
   articles are told apart by the curves.

Pages are tokenised once and not shuffled unless more than BROADCAST_ROWS texts repeat; what moves is text hashes, word counts,
pre-aggregated per batch, and a few numbers a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.numeric import column
from skyloom.llm.wordstream import ADDRESS, NUMBER, TAG, Words, to_words
from skyloom.runtime import bounded, materialize, ship_package, spread

#: Words making up at least this share of a language's words are known to its model: at most 1 / LEAST_RATE words a language.
LEAST_RATE = 1e-4
#: A language has a model of its own with this share of all words or so many words, the most frequent ones first. All pages are one more.
LEAST_LANGUAGE, LEAST_WORDS, MOST_MODELS = 0.01, 5_000, 64
#: Rate given to words a model doesn't know.
FLOOR = 1e-5
#: A word is overused on a page if it occurs at least three times (addresses: two) and so many times more often than in the language.
EXCESS, EXCESS_COUNT = 5.0, 3
#: A line is stuffed if overused words hold this share of its letters, addresses alone this share, or an overused word comes twice.
LINE_LETTERS, LINE_ADDRESS = 0.6, 0.35
#: Flags: how far beyond the ordinary median, in the measure itself and at least in median deviations.
FAR = {"slope": -1.1, "residual": 0.5, "divergence": 2.4, "peak": 1.05}
DEVIATIONS = 4.0
#: Ordinary pages a group needs; a smaller one gives way to a wider one, at last to the exact check alone.
GROUP = 30
#: What prose looks like, for the first look at pages, before there are groups.
USUAL = {"divergence": 0.7, "peak": 0.1}
#: UTF-16 units of text, and words, handled at once.
CHUNK_UNITS, CHUNK_WORDS = 1_000_000, 300_000


def language_key(lang: str | None) -> str:
    key = (lang or "").strip().lower()
    return key if key not in ("", "und", "unknown") else "und"


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    begin = 0
    ends = np.cumsum(sizes)
    while begin < len(sizes):
        before = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield begin, end
        begin = end


_STREAM = "lang string, word binary, letters binary, line_words binary"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's words, their letters and how many words each line has, as packed numbers (int32, uint8, uint32)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        parts: list[list[bytes]] = [[], [], []]
        for a, b in _chunks(np.array([len(t) for t in texts], np.int64), CHUNK_UNITS):
            w = to_words(texts[a:b])
            per_line = np.bincount(w.line, minlength=int(w.lines.sum())).astype(np.uint32)
            line_start = np.append(0, np.cumsum(w.lines))
            letters = w.letters.astype(np.uint8)
            for k in range(b - a):
                x, y = w.starts[k], w.starts[k + 1]
                parts[0].append(w.word[x:y].tobytes())
                parts[1].append(letters[x:y].tobytes())
                parts[2].append(per_line[line_start[k] : line_start[k + 1]].tobytes())
        lang = pa.array([language_key(x) for x in batch.column("lang").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash")), lang, *(pa.array(p, pa.binary()) for p in parts)], names=["doc_id", "text_hash", "lang", "word", "letters", "line_words"])


def _numbers(blobs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    rows = blobs.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // size for r in rows], np.int64)


def _stream_words(batch: pa.RecordBatch) -> Words:
    word, n = _numbers(batch.column("word"), np.int32)
    letters, _ = _numbers(batch.column("letters"), np.uint8)
    per_line, lines = _numbers(batch.column("line_words"), np.uint32)
    return Words(word, letters, np.repeat(np.arange(len(per_line)), per_line), np.append(0, np.cumsum(n)), lines)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHUNK_WORDS words."""
    for batch in batches:
        for a, b in _chunks(pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False) // 4, CHUNK_WORDS):
            yield batch.slice(a, b - a)


_COUNTS = "lang string, word int, n long"


def _count_batch(words: Words, lang: np.ndarray, pages: np.ndarray) -> pa.RecordBatch:
    """(lang, word, n) of some pages together."""
    names, own = np.unique(lang, return_inverse=True)
    page = np.repeat(np.arange(len(lang)), np.diff(words.starts))
    keep = pages[page]
    key = (own[page[keep]].astype(np.int64) << 32) | (words.word[keep].astype(np.int64) & 0xFFFFFFFF)
    found, n = np.unique(key, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names.astype(object)[found >> 32], pa.string()), pa.array((found & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("lang").to_pylist(), object).astype(str) if batch.num_rows else np.empty(0, "U1")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _count_batch(_stream_words(batch), _labels(batch), np.asarray(batch.column("first").to_numpy(zero_copy_only=False), bool))


class Languages:
    """Word rates of the languages with a model, as one matrix of counts."""

    def __init__(self, counts: dict[str, dict[int, int]], totals: dict[str, int]) -> None:
        self.names = sorted(counts)
        self.words = np.array(sorted({w for c in counts.values() for w in c}), np.int32)
        self.total = np.array([max(1, totals[x]) for x in self.names], float)
        self.count = np.zeros((len(self.words) + 1, len(self.names)), np.float32)
        for j, name in enumerate(self.names):
            own = counts[name]
            self.count[np.searchsorted(self.words, np.array(list(own), np.int32)), j] = list(own.values())

    def rows(self, word: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, word)
        return np.where(self.words[np.minimum(at, len(self.words) - 1)] == word, at, len(self.words)) if len(self.words) else np.zeros(len(word), np.int64)

    def rate(self, row: np.ndarray, language: np.ndarray | int, less: np.ndarray | float = 0.0, words: np.ndarray | float = 0.0) -> np.ndarray:
        """Rates without ``less`` occurrences among ``words`` words, the page's own."""
        return np.maximum((self.count[row, language] - less) / np.maximum(self.total[language] - words, 1.0), FLOOR)


def profiles(words: Words, lang: np.ndarray, models: Languages) -> dict[str, object]:
    """What is measured of each page; pages without words have n_words 0 and no curve."""
    pages = len(lang)
    n = np.diff(words.starts)
    page = np.repeat(np.arange(pages), n)
    key = (page.astype(np.int64) << 32) | (words.word.astype(np.int64) & 0xFFFFFFFF)
    seen, own, f = np.unique(key, return_inverse=True, return_counts=True)
    of, word = seen >> 32, (seen & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    p = f / n[of]
    row = models.rows(word)
    # the language the page is closest to
    best, fit = np.zeros(pages, np.int64), np.full(pages, -np.inf)
    whole = np.zeros(pages)
    np.add.at(whole, of, p * np.log(p))
    for j, name in enumerate(models.names):
        counted = (lang == name) | (name == "*")
        own_words = np.where(counted, n, 0)
        good = np.bincount(of, p * np.log(models.rate(row, j, np.where(counted[of], f, 0), own_words[of])), minlength=pages)
        best = np.where(good > fit, j, best)
        fit = np.maximum(fit, good)
    names = np.array(models.names, object)
    counted = (names[best] == lang) | (names[best] == "*")
    q = models.rate(row, best[of], np.where(counted[of], f, 0), np.where(counted, n, 0)[of])
    # numbers are as frequent as they are: lists of prices and hours are ordinary matter
    plain = word == NUMBER
    over = np.where((f > 1) & ~plain, np.maximum(0.0, np.log(np.maximum(f - 1, 1) / n[of] / q)), 0.0)
    # divergence of each line, and the half of the page's lines that diverges most
    letters = words.letters.astype(float)
    n_lines = int(words.lines.sum())
    weight = np.bincount(words.line, letters, minlength=n_lines)
    diverges = np.bincount(words.line, letters * over[own], minlength=n_lines) / np.maximum(weight, 1)
    line_page = np.repeat(np.arange(pages), words.lines)
    order = np.lexsort((-diverges, line_page))
    rank = np.empty(n_lines, np.int64)
    rank[order] = np.arange(n_lines) - np.repeat(np.cumsum(words.lines) - words.lines, words.lines)
    chosen = (rank <= np.repeat(words.lines // 2, words.lines))[words.line]
    f_half = np.bincount(own[chosen], minlength=len(seen))
    n_half = np.bincount(of, f_half, minlength=pages)
    p_half = f_half / np.maximum(n_half, 1)[of]
    part = np.where((f_half > 1) & ~plain, p_half * np.log(np.maximum(p_half, 1e-300) / q), 0.0)
    peak = np.zeros(pages)
    np.maximum.at(peak, of, part)
    # the exact check
    overused = ((f >= EXCESS_COUNT) | (word == ADDRESS) & (f > 1)) & (p >= EXCESS * q) & ~plain
    heavy = overused[own]
    share = np.bincount(words.line, letters * heavy, minlength=n_lines)
    addresses = np.bincount(words.line, letters * (heavy & (words.word == ADDRESS)), minlength=n_lines)
    twice = np.zeros(n_lines, bool)
    # short words may come twice by chance; a mark of tags has one letter
    strong = heavy & ((letters > 2) | (words.word == TAG))
    where, count = np.unique((words.line[strong].astype(np.int64) << 32) | (words.word[strong].astype(np.int64) & 0xFFFFFFFF), return_counts=True)
    twice[(where[count > 1] >> 32).astype(np.int64)] = True
    per_line = np.bincount(words.line, minlength=n_lines)
    stuffed = twice | ((per_line > 1) | (addresses > 0)) & (share >= LINE_LETTERS * weight) & (share > 0) | (addresses >= LINE_ADDRESS * weight) & (addresses > 0)
    return {
        "language": names[best] if len(names) else np.full(pages, "*", object),
        "n_words": n,
        "n_half": n_half.astype(np.int64),
        "divergence": np.bincount(of, part, minlength=pages),
        "peak": peak,
        "classes": _classes(of, f_half, pages),
        "page_divergence": whole - np.where(n > 0, fit, 0.0),
        "page_classes": _classes(of, f, pages),
        "n_lines": words.lines,
        "n_stuffed": np.bincount(line_page, stuffed, minlength=pages).astype(np.int64),
    }


def _classes(page: np.ndarray, f: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words occur how often: offsets of the pages, frequency, words of that frequency; frequencies descend."""
    used = f > 0
    key, n = np.unique((page[used].astype(np.int64) << 32) | (0xFFFFFFFF - f[used]), return_counts=True)
    return np.searchsorted(key >> 32, np.arange(pages + 1)), 0xFFFFFFFF - (key & 0xFFFFFFFF), n


_FREQUENCIES = pa.list_(pa.struct([("f", pa.int64()), ("n", pa.int64())]))
_PROFILE = {
    "language": pa.string(),
    "n_words": pa.int64(),
    "n_half": pa.int64(),
    "divergence": pa.float64(),
    "peak": pa.float64(),
    "classes": _FREQUENCIES,
    "page_divergence": pa.float64(),
    "page_classes": _FREQUENCIES,
    "n_lines": pa.int64(),
    "n_stuffed": pa.int64(),
}


def _list_of(classes: tuple[np.ndarray, np.ndarray, np.ndarray], keep: np.ndarray) -> pa.Array:
    offsets, f, n = classes
    whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(f, pa.int64()), pa.array(n, pa.int64())], names=["f", "n"]))
    return whole.take(pa.array(keep))


def _profiler(models: Languages):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = profiles(_stream_words(batch), _labels(batch), models)
            keep = np.flatnonzero(found["n_words"])
            cols = [_list_of(v, keep) if isinstance(v, tuple) else pa.array(v[keep], _PROFILE[k]) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep)) for c in ("doc_id", "text_hash", "page")), *cols], names=["doc_id", "text_hash", "page", *found])

    return profile


def _outstanding(models: Languages):
    """Word counts of the pages that stand out, to be taken from all counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, lang = _stream_words(batch), _labels(batch)
            found = profiles(words, lang, models)
            out = (found["n_stuffed"] * 2 > found["n_lines"]) | np.logical_or.reduce([found[m] > usual + FAR[m] for m, usual in USUAL.items()])
            yield _count_batch(words, lang, out & np.asarray(batch.column("first").to_numpy(zero_copy_only=False), bool))

    return count


def _models(counted: DataFrame) -> Languages:
    """Models from (lang, word, n)."""
    counted = materialize(counted.where("n > 0"))
    labels = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in labels.orderBy(F.desc("n"), "lang").limit(MOST_MODELS + 1).collect()}
    total = counted.agg(F.sum("n")).first()[0] or 0
    own = {x: n for x, n in list(totals.items()) if x != "und" and (n >= LEAST_LANGUAGE * total or n >= LEAST_WORDS)}
    # at most 1 / LEAST_RATE words for each of at most MOST_MODELS languages
    least = F.lit(None).cast("double")
    for x, n in own.items():
        least = F.when(F.col("lang") == x, float(LEAST_RATE * n)).otherwise(least)
    counts: dict[str, dict[int, int]] = {"*": {}, **{x: {} for x in own}}
    for r in counted.where(F.col("n") >= least).collect():
        counts[r.lang][r.word] = r.n
    for r in counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_RATE * total).collect():
        counts["*"][r.word] = r.n
    return Languages(counts, {"*": total, **own})


def language_models(streams: DataFrame) -> Languages:
    """Word rates per language label and over all pages; pages standing out against the first rates are left out of the second.

    ``streams``: lang, the packed words, text_hash, page. A repeated text counts once under each of its labels.
    """
    again = materialize(streams.groupBy("text_hash", "lang").agg(F.count(F.lit(1)).alias("copies"), F.min("page").alias("counts")).where("copies > 1").drop("copies"))
    marked = streams.join(bounded(again, again.count()), ["text_hash", "lang"], "left")
    marked = marked.select("lang", "word", "letters", "line_words", (F.col("counts").isNull() | (F.col("counts") == F.col("page"))).alias("first"))
    counted = materialize(marked.mapInArrow(_count, _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    out = marked.mapInArrow(_outstanding(_models(counted)), _COUNTS).select("lang", "word", (-F.col("n")).alias("n"))
    return _models(counted.unionByName(out).groupBy("lang", "word").agg(F.sum("n").alias("n")))


def fitted(points: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and residual of the line through log frequencies over log ranks, from (keys, f, n): n words occur f times each.

    Every word is one point; words of one frequency share their mean log rank. 0 where all words are equally frequent.
    """
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x, y = F.log(F.col("ahead") + (F.col("n") + 1) / 2), F.log("f")
    sums = points.withColumn("ahead", ahead).select(*keys, F.col("n").cast("double").alias("n"), x.alias("x"), y.alias("y")).groupBy(*keys)
    fit = sums.agg(F.sum("n").alias("m"), *[F.sum(F.expr(f"n * {e}")).alias(a) for a, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("sxy", "x * y"), ("syy", "y * y"))])
    vx, vy, vxy = (F.expr(e) for e in ("sxx / m - sx / m * sx / m", "syy / m - sy / m * sy / m", "sxy / m - sx / m * sy / m"))
    fit = fit.select(*keys, vx.alias("vx"), vy.alias("vy"), vxy.alias("vxy"))
    flat = F.col("vx") <= 1e-12
    slope = F.when(flat, 0.0).otherwise(F.col("vxy") / F.when(~flat, F.col("vx")))
    residual = F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.col("vxy") * F.col("vxy") / F.when(~flat, F.col("vx")))))
    return fit.select(*keys, slope.alias("slope"), residual.alias("residual"))


def _profiled(documents: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    ship_package(documents.sparkSession)
    pages = documents.where(F.length(column(text)) > 0)
    pages = pages.select(column(doc_id).alias("doc_id"), F.xxhash64(column(text)).alias("text_hash"), column(text).alias("text"), column(lang).cast("string").alias("lang"))
    kind = documents.schema[doc_id].dataType.simpleString()
    streams = spread(pages).mapInArrow(_streams, f"doc_id {kind}, text_hash long, {_STREAM}")
    streams = materialize(streams.withColumn("page", F.monotonically_increasing_id()))  # ids may be NULL or repeated
    frequencies = "array<struct<f:long,n:long>>"
    shape = ", ".join(f"{k} {frequencies if v == _FREQUENCIES else {pa.string(): 'string', pa.int64(): 'long', pa.float64(): 'double'}[v]}" for k, v in _PROFILE.items())
    return materialize(streams.mapInArrow(_profiler(language_models(streams)), f"doc_id {kind}, text_hash long, page long, {shape}"))


def page_curves(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", half: bool = False) -> DataFrame:
    """One row per page with words: (doc_id, text_hash, language, length_class, n_words, slope, residual, divergence, peak, n_lines, n_stuffed).

    The curve is the whole page's, or (``half``) that of the half of its lines that departs most from the language. ``divergence`` is the
    page's from the language, or that of the half's repeated words; ``peak`` always the half's.
    """
    profiled = _profiled(documents, doc_id, text, lang)
    classes = "classes" if half else "page_classes"
    fit = fitted(profiled.select("page", F.explode(classes).alias("c")).select("page", "c.f", "c.n"), ["page"])
    out = profiled.join(fit, "page").withColumn("length_class", F.floor(F.log2("n_words")).cast("int"))
    divergence = F.col("divergence" if half else "page_divergence").alias("divergence")
    return out.select("doc_id", "text_hash", "language", "length_class", "n_words", "slope", "residual", divergence, "peak", "n_lines", "n_stuffed")


def flagged(curves: DataFrame) -> DataFrame:
    """``curves`` (of halves) with ``flag``: whether a measure lies far outside those of ordinary pages; NULL if there are too few of these."""
    ordinary = materialize(curves.where(F.col("n_stuffed") * 2 <= F.col("n_lines")).dropDuplicates(["text_hash"]).select("language", "length_class", *FAR))
    middle = lambda among, by, tag="": among.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{tag}pages"), *[F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"{tag}{m}") for m in FAR])
    everything = middle(ordinary, []).first()
    near = ordinary.withColumn("length_class", F.explode(F.array(*[F.col("length_class") + i for i in (-1, 0, 1)])))
    # the page's own group, all languages at that length, the language at neighbouring lengths, everything: the first with enough pages counts
    wider = (("own_", ["language", "length_class"], ordinary), ("any_", ["length_class"], ordinary), ("near_", ["language", "length_class"], near))
    judged = curves
    for tag, by, among in wider:
        # at most 64 length classes for each language with a model
        side = F.broadcast(middle(among, by, tag))
        judged = judged.join(side, by, "left")
    flag = F.lit(False)
    for m, far in FAR.items():
        last = F.array(*[F.lit(x) for x in everything[m]]) if everything["pages"] >= GROUP else F.lit(None).cast("array<double>")
        q = F.coalesce(*[F.when(F.col(f"{tag}pages") >= GROUP, F.col(f"{tag}{m}")) for tag, *_ in wider], last)
        # half the interquartile range is a median deviation
        beyond = F.greatest(DEVIATIONS * (q[2] - q[0]) / 2, F.lit(abs(far)))
        flag |= (F.col(m) - q[1] if far > 0 else q[1] - F.col(m)) > beyond
    return judged.withColumn("flag", flag).select(*curves.columns, "flag")


def stuffed_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, language, slope, residual, divergence, peak, n_lines, n_stuffed) of the pages of which more than half of the lines are stuffed.

    Lines without any character but spaces don't count. NULL and empty pages, and pages without words, are never stuffed;
    unknown languages are judged by the closest known one; a repeated row is judged again, under its id. Where fewer than GROUP ordinary
    pages exist there is nothing to compare with, and the exact check decides alone.
    """
    judged = flagged(materialize(page_curves(documents, doc_id, text, lang, half=True)))
    sure = judged.where(F.coalesce("flag", F.lit(True)) & (F.col("n_stuffed") * 2 > F.col("n_lines")))
    return sure.select(F.col("doc_id").alias(doc_id), "language", *FAR, "n_lines", "n_stuffed")
