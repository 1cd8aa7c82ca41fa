"""Functions of texts as Columns, called for a piece of an Arrow batch at a time.

What a text function makes of a batch takes many times the batch's memory until it is an Arrow array, so a task's Python
would follow the size of its batches. Pieces bound it: so many characters, or one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 18  # characters


def _size(x) -> int:
    if isinstance(x, str):
        return len(x) + 16
    if isinstance(x, np.ndarray) and x.dtype != object:
        return x.nbytes
    return sum(map(_size, x)) + 16 if isinstance(x, (list, tuple, np.ndarray)) else 16


def cuts(sizes, most: int) -> list[slice]:
    """Runs of rows of at most so much in all, or of one row."""
    out, lo, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and used + n > most:
            out.append(slice(lo, i))
            lo, used = i, 0
        used += n
    return [*out, slice(lo, i + 1)] if len(sizes) else out


def pieces(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """The same rows, piece by piece."""
    for rows in cuts([sum(map(_size, r)) for r in zip(*columns)], PIECE):
        yield tuple(c.iloc[rows].reset_index(drop=True) for c in columns)


def piecewise(fn, kind: str):
    """A pandas UDF of fn(*columns) -> Series, which judges each row by itself."""

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for p in pieces(s):
                yield fn(*p)

    def many(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            for p in pieces(*columns):
                yield fn(*p)

    def call(*columns: Column | str) -> Column:
        return F.pandas_udf(one if len(columns) == 1 else many, kind)(*columns)

    return call
