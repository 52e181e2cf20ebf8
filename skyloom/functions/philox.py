"""Random numbers by counter: Philox 2x32-10, the same for a counter and key on every run and layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of Philox 2x32 (Salmon et al. 2011): multiplier, key increment, rounds
MULTIPLIER, INCREMENT, ROUNDS = 0xD256D193, 0x9E3779B9, 10
LOW = 0xFFFFFFFF


def philox(counter: Column, key: int) -> Column:
    """The counter's random number under ``key``, a long in [0, 2^32); NULL for a NULL counter.

    The 64-bit product of a round is built from 16-bit halves, so nothing overflows. The rounds are one fold over the round keys: written
    as nested columns their common parts would double with each round when a filter is pushed down.
    """
    high, low = F.lit(MULTIPLIER >> 16).cast("long"), F.lit(MULTIPLIER & 0xFFFF).cast("long")
    x = counter.cast("long")
    keys = F.array(*[F.lit((key + i * INCREMENT) & LOW).cast("long") for i in range(ROUNDS)])

    def turn(state: Column, own: Column) -> Column:
        c0 = state["c0"]
        p = c0 * low
        t = c0 * high + F.shiftright(p, 16)
        return F.struct(
            F.shiftright(t, 16).bitwiseXOR(state["c1"]).bitwiseXOR(own).alias("c0"),
            F.shiftleft(t.bitwiseAND(0xFFFF), 16).bitwiseOR(p.bitwiseAND(0xFFFF)).alias("c1"),
        )

    start = F.struct(x.bitwiseAND(LOW).alias("c0"), F.shiftrightunsigned(x, 32).alias("c1"))
    return F.when(x.isNotNull(), F.aggregate(keys, start, turn)["c0"])
