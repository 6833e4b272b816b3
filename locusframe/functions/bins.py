"""Hierarchical genome bins as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the binning scheme: finest bin 2^17, eight times wider per level.
SHIFTS = (17, 20, 23, 26)
OFFSETS = (4681, 585, 73, 9)
LIMIT = 1 << 29


def bin_of(start: Column, end: Column, zero_based: bool = False) -> Column:
    """The smallest bin that holds [start, end]; null where a coordinate is, 1 beyond the
    scheme's limit, for negative coordinates and for a closed start of 0."""
    s = start if zero_based else start - 1
    out = F.when(start.isNull() | end.isNull(), F.lit(None)).when((start >= LIMIT) | (end >= LIMIT) | (start < 0) | (end < 0), 1)
    for shift, offset in zip(SHIFTS, OFFSETS):
        out = out.when(F.shiftright(s, shift) == F.shiftright(end, shift), F.shiftright(s, shift) + offset)
    return out.otherwise(1).cast("int")


def bins_overlapping(start: Column, end: Column, zero_based: bool = False) -> Column:
    """All bins that can hold a feature overlapping [start, end], ascending."""
    s = F.greatest((start if zero_based else start - 1), F.lit(0))
    levels = [F.array(F.lit(1))]
    for k, o in reversed(list(zip(SHIFTS, OFFSETS))):
        levels.append(F.transform(F.sequence(F.shiftright(s, k), F.greatest(F.shiftright(end, k), F.shiftright(s, k))), _plus(o)))
    every = reduce(lambda a, b: F.concat(a, b), levels)
    beyond = (start >= LIMIT) | (end >= LIMIT) | (start < 0) | (end < 0)
    return F.when(start.isNull() | end.isNull(), F.lit(None)).when(beyond, F.array(F.lit(1))).otherwise(every)


def _plus(offset: int):
    return lambda x: (x + offset).cast("int")
