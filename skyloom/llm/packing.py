"""Texts into containers of a fixed number of tokens, with little unused room.

Bound-certified repacking: pieces are dealt to packing partitions, each packed best-fit decreasing; dual feasible functions give a lower
bound for each partition's number of containers. A partition that meets its bound is certified. Partitions with a gap exchange the
documents of their emptiest containers (pooled, dealt anew and packed again), as long as that saves containers.

Only sizes move: texts are read once to be counted.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import column
from skyloom.runtime import materialize, ship_file, ship_package, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Pieces packed in one task, on average.
PIECES = 20_000
ROUNDS = 4


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(where: Callable[[], str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(where()).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return count


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every row; NULL and empty texts have 0 tokens. The ``tokenizer``'s file need only be where the driver reads it."""
    kind = documents.schema[doc_id].dataType.simpleString()
    ship_package(documents.sparkSession)
    return spread(documents.select(column(doc_id).alias("doc_id"), column(text).alias("text"))).mapInArrow(_counter(ship_file(documents.sparkSession, tokenizer)), f"doc_id {kind}, tokens long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes 1..capacity): largest first, each into the fullest container with room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    room: dict[int, list[int]] = {}
    levels: list[int] = []
    n = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(levels, size)
        if at == len(levels):
            box, free = n, capacity
            n += 1
        else:
            free = levels[at]
            box = room[free].pop()
            if not room[free]:
                del room[free], levels[at]
        out[i] = box
        free -= size
        if free:
            if free not in room:
                room[free] = []
                bisect.insort(levels, free)
            room[free].append(box)
    return out


def room_needed(sizes: np.ndarray, capacity: int) -> float:
    """Containers' worth of room that no packing of ``sizes`` can do without: the best among three families of dual feasible functions.

    (a) the identity; (b) for each e: sizes above capacity - e count as full, below e as nothing; (c) for each k: sizes are rounded down to
    multiples of capacity / (k + 1) and scaled up to multiples of capacity / k. Sums are whole numbers.
    """
    if not len(sizes):
        return 0.0
    s = np.sort(sizes.astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(s)])
    best = int(upto[-1]) / capacity
    e = np.unique(s[s * 2 <= capacity])
    low, high = np.searchsorted(s, e, "left"), np.searchsorted(s, capacity - e, "right")
    if len(e):
        best = max(best, int(((len(s) - high) * capacity + upto[high] - upto[low]).max()) / capacity)
    best = max(best, int((s * 2 > capacity).sum()))
    for k in range(1, 21):
        times = (k + 1) * s
        weight = int(np.where(times % capacity == 0, s * k, times // capacity * capacity).sum())
        best = max(best, weight / (capacity * k))
    return best


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of ``sizes`` needs fewer containers."""
    return math.ceil(room_needed(sizes, capacity) - 1e-9)


def emptiest(free: np.ndarray, capacity: int, needed: float) -> np.ndarray:
    """Which containers a partition gives away: the emptiest ones, with twice the room by which it exceeds what it needs.

    That gap counts in fractions, so a partition whose number of containers is certified still gives its partly filled last ones.
    """
    out = np.zeros(len(free), bool)
    gap = len(free) - needed
    if gap > 1e-9:
        order = np.argsort(-free, kind="stable")
        ahead = np.cumsum(free[order]) - free[order]
        out[order] = (ahead < 2 * gap * capacity) & (free[order] > 0)
    return out


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["tokens"].to_numpy()
        box = best_fit_decreasing(sizes, capacity)
        needed = room_needed(sizes, capacity)
        moving = emptiest(capacity - np.bincount(box, weights=sizes).astype(np.int64), capacity, needed)
        return pd.DataFrame({"uid": group["uid"], "tokens": sizes, "part": group["part"], "box": box, "moving": moving[box]})

    return pack


def _packed(items: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    ship_package(items.sparkSession)
    parts = max(1, -(-n // PIECES))
    dealt = items.select("uid", "tokens", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)).alias("part"))
    packed = dealt.groupBy("part").applyInPandas(_packer(capacity), "uid long, tokens long, part long, box long, moving boolean")
    return materialize(packed.withColumn("turn", F.lit(turn)))


def _boxes(packed: DataFrame) -> int:
    return packed.groupBy("turn", "part").agg(F.countDistinct("box").alias("n")).agg(F.sum("n")).first()[0] or 0


def pack(sizes: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, piece, start, tokens, container): where each piece of each document goes.

    A document with more than ``capacity`` tokens is cut into full pieces and a rest (pieces 0, 1, ...; ``start`` is a piece's first token);
    no other is cut. Documents without tokens (or NULL sizes) take no room: piece 0 with 0 tokens and a NULL container. Repeated
    rows and NULL ids are items of their own. Containers never hold more than ``capacity`` tokens.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    size = F.coalesce(column(tokens).cast("long"), F.lit(0).cast("long"))
    pieces = sizes.select(column(doc_id).alias(doc_id), size.alias("_size"))
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(_size - 1) div {int(capacity)}"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("tokens", F.greatest(F.lit(0).cast("long"), F.least(F.lit(capacity), F.col("_size") - F.col("start"))))
    pieces = materialize(pieces.drop("_size").withColumn("uid", F.monotonically_increasing_id()))
    items = pieces.where(F.col("tokens") > 0)
    packed = _packed(items, items.count(), capacity, 0)
    settled = []
    for turn in range(1, ROUNDS + 1):
        settled.append(packed.where(~F.col("moving")))
        pool = packed.where(F.col("moving"))
        n = pool.count()
        if not n:
            break
        again = _packed(pool, n, capacity, turn)
        if _boxes(again) >= _boxes(pool):
            settled.append(pool)
            break
        packed = again
        if turn == ROUNDS:
            settled.append(packed)
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    # turn, partition and box as one number
    container = F.shiftleft(F.col("turn").cast("long"), 56) + F.shiftleft("part", 24) + F.col("box")
    return pieces.join(placed.select("uid", container.alias("container")), "uid", "left").select(doc_id, "piece", "start", "tokens", "container")


def bound_sums(capacity: int) -> list[str]:
    """The dual feasible functions of lower_bound with whole-table sums, as SQL sums over ``tokens``, each a lower bound times capacity."""
    sums = ["sum(tokens)", f"sum(CASE WHEN tokens * 2 > {capacity} THEN {capacity} ELSE 0 END)"]
    sums += [f"sum(CASE WHEN tokens > {capacity - e} THEN {capacity} WHEN tokens >= {e} THEN tokens ELSE 0 END)" for e in sorted({max(1, capacity * i // 32) for i in range(1, 17)})]
    sums += [f"sum(CASE WHEN ({k + 1} * tokens) % {capacity} = 0 THEN tokens * {k} ELSE ({k + 1} * tokens) div {capacity} * {capacity} END) / {k}" for k in range(1, 21)]
    return sums


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, a lower bound no packing can beat, and unused tokens."""
    items = packed.where(F.col("container").isNotNull())
    per = items.groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    boxes = per.agg(F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"), F.max("used").alias("fullest"))
    best = items.agg(F.greatest(*[F.ceil(F.expr(f"({s}) / {capacity}")) for s in bound_sums(capacity)]).alias("lower_bound"))
    row, low = boxes.first(), best.first()
    values = (row.n_pieces or 0, row.n_tokens or 0, row.n_containers or 0, int(low.lower_bound or 0), (row.n_containers or 0) * capacity - (row.n_tokens or 0))
    return packed.sparkSession.createDataFrame([values], "n_pieces long, n_tokens long, n_containers long, lower_bound long, unused_tokens long")


def _certificate(capacity: int):
    def certify(group: pd.DataFrame) -> pd.DataFrame:
        n, low = group["container"].nunique(), lower_bound(group["tokens"].to_numpy(), capacity)
        return pd.DataFrame({"turn": group["turn"].iloc[:1], "part": group["part"].iloc[:1], "pieces": [len(group)], "containers": [n], "bound": [low], "certified": [n == low]})

    return certify


def packing_certificates(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(turn, part, pieces, containers, bound, certified) of each packing partition as it is left: certified if no packing of its pieces needs fewer.

    A partition holds about PIECES pieces, packed in one task.
    """
    ship_package(packed.sparkSession)
    held = packed.where(F.col("container").isNotNull()).select("container", "tokens", F.shiftright("container", 56).alias("turn"), F.shiftright("container", 24).bitwiseAND(F.lit((1 << 32) - 1)).alias("part"))
    return held.groupBy("turn", "part").applyInPandas(_certificate(capacity), "turn long, part long, pieces long, containers long, bound long, certified boolean")


def packing_checks(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """What must hold of each document, whatever the packing: (doc_id, complete, cut_rightly, fits), repeated and NULL ids taken together.

    complete: its pieces have all its tokens, each once; cut_rightly: cut only above the capacity, into full pieces and a rest; fits: none of its
    containers holds more than the capacity.
    """
    load = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("_load"))
    cap = F.lit(int(capacity))
    full = F.col("start") == F.col("piece") * cap
    placed = packed.join(load, "container", "left").groupBy(column(doc_id).alias("_id")).agg(
        F.sum("tokens").alias("_placed"), F.count(F.lit(1)).alias("_pieces"), F.min(full & (F.col("tokens") <= cap)).alias("_right"), F.min(F.coalesce(F.col("_load") <= cap, F.lit(True))).alias("_fits"), F.sum(F.col("start") + F.col("tokens")).alias("_ends")
    )
    size = F.coalesce(column(tokens).cast("long"), F.lit(0).cast("long"))
    n = F.greatest(F.lit(1).cast("long"), F.ceil(size / cap))
    # pieces end at capacity, 2 * capacity, ... and at the size
    wanted = sizes.groupBy(column(doc_id).alias("_doc")).agg(F.sum(size).alias("_size"), F.sum(n).alias("_n"), F.sum(size + cap * (n - 1) * n / 2).cast("long").alias("_all_ends"))
    met = wanted.join(placed, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    complete = F.coalesce((F.col("_placed") == F.col("_size")) & (F.col("_ends") == F.col("_all_ends")), F.lit(False))
    right = F.coalesce((F.col("_pieces") == F.col("_n")) & F.col("_right"), F.lit(False))
    return met.select(F.col("_doc").alias(doc_id), complete.alias("complete"), right.alias("cut_rightly"), F.coalesce("_fits", F.lit(False)).alias("fits"))
