"""Rows by position: lists and slices over a dense position column."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors

#: Longer lists become a semi join.
INLINE = 1000


def positions(indices: Iterable[int], rows: int) -> list[int]:
    """The distinct positions in ascending order; raises for an empty list or one outside 0 to rows - 1."""
    found = sorted({int(i) for i in indices})
    if not found:
        raise ValueError(errors.NO_INDICES)
    for i in (found[0], found[-1]):
        if not 0 <= i < rows:
            raise errors.out_of_bounds(i, rows)
    return found


def at(df: DataFrame, wanted: list[int], position: str) -> DataFrame:
    """The rows at the positions, in ascending order."""
    if len(wanted) <= INLINE:
        return df.where(F.col(position).isin(wanted)).orderBy(position)
    spark = df.sparkSession
    ids = spark.createDataFrame(pa.table({position: pa.array(wanted, pa.int64())}))
    within = df.where(F.col(position).between(wanted[0], wanted[-1]))  # lets row groups be skipped
    return within.join(ids, position, "left_semi").orderBy(position)


def between(df: DataFrame, start: int, stop: int, step: int, position: str) -> DataFrame:
    """The rows of a Python slice with these resolved bounds, as a range predicate, in the slice's order."""
    if step > 0:
        inside = (F.col(position) >= start) & (F.col(position) < stop)
        return df.where(inside & ((F.col(position) - start) % step == 0)).orderBy(position)
    inside = (F.col(position) <= start) & (F.col(position) > stop)
    return df.where(inside & ((start - F.col(position)) % -step == 0)).orderBy(F.desc(position))
