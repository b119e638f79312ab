"""A Bloom filter of fixed size, built by aggregation and broadcast.

Its size is a constant, so it may be broadcast whatever it was built from. It only keeps rows back from a join
that would drop them anyway: when it fills up, more rows go to the join and results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from navloom.session import cut_lineage

#: 2**26 bits are 8 MB
BITS, WORDS = 1 << 26, 1 << 20
#: a key's bit places are these shifts of its 64 bits
SHIFTS = (0, 19, 38)


class Members:
    """The broadcast filter; `may_hold` answers for an array of 64-bit keys."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        at = None
        for shift in SHIFTS:  # each place is looked up only for the keys the places before let through
            p = ((keys if at is None else keys[at]) >> np.uint64(shift)) & np.uint64(BITS - 1)
            hit = np.flatnonzero((self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1))
            at = hit if at is None else at[hit]
        out = np.zeros(len(keys), bool)
        out[at] = True
        return out


def members(keys: DataFrame, column: str):
    """Broadcast filter of a 64-bit column. At most WORDS words come to the driver.

    The column must be spread evenly over 64 bits; ids go through xxhash64 on both sides. Tasks send bit places
    with a map-side `bit_or`.
    """
    bit = [F.shiftrightunsigned(column, s).bitwiseAND(F.lit(BITS - 1)) for s in SHIFTS]
    words = keys.select(F.explode(F.array(*bit)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(WORDS, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Members(bits))


def written_with(keys: DataFrame, column: str, make: Callable[[object], DataFrame]) -> DataFrame:
    """The written rows of `make(filter of the keys)`; the filter is let go once they are."""
    wanted = members(keys, column)
    rows = cut_lineage(make(wanted))
    wanted.destroy()
    return rows
