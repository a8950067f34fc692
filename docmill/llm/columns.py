"""Arrow UDFs around the code-point functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import SPACE, canonical, letters_and_digits, look_alikes
from .codepoints import keep, plain, slices, to_codepoints, to_strings

Rows = tuple[np.ndarray, np.ndarray]


def rewritten(column: pa.Array, rewrite: Callable[[np.ndarray, np.ndarray], Rows]) -> pa.Array:
    """The column with `rewrite` applied to its code points; null stays null."""
    column = plain(column)
    parts = []
    for lo, hi in slices(column):
        part = column[lo:hi]
        parts.append(to_strings(*rewrite(*to_codepoints(part)), np.asarray(part.is_valid())))
    return pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())


def without_space(cps: np.ndarray, offsets: np.ndarray, alike: bytes = b"") -> Rows:
    cps, offsets = canonical(cps, offsets, alike)
    return keep(cps, offsets, cps != SPACE)


def reduced(cps: np.ndarray, offsets: np.ndarray, alike: bytes = b"") -> Rows:
    return letters_and_digits(*canonical(cps, offsets, alike))


def _column(text: str | Column, rewrite: Callable[..., Rows]) -> Column:
    """The rewritten text, with the session's look-alikes."""
    rewrite = partial(rewrite, alike=look_alikes())

    @F.arrow_udf("string")
    def form(text: pa.Array) -> pa.Array:
        return rewritten(text, rewrite)

    return form(text)


def canonical_text(text: str | Column) -> Column:
    """Text in the one form of problem 1; null stays null, blank or invisible text becomes ''."""
    return _column(text, canonical)


def bare_text(text: str | Column) -> Column:
    """Canonical text without white space; null stays null."""
    return _column(text, without_space)


def reduced_text(text: str | Column) -> Column:
    """Canonical text in lower case, reduced to letters and digits; null stays null."""
    return _column(text, reduced)
