"""Problem 3: long texts as numbered pieces under a limit that end at natural places and overlap.

Method: dynamic programming over the boundary positions of a text. A piece from unit i (a sentence, or a part of one that is
over the limit) to unit j costs what its end cuts through, how far its length is from the limit, and what further units it
would have had room for; the cheapest way of all to the text's end is taken. All rows of a slice advance together, a unit a
step. With `room` far above the other costs (FULL) the cheapest way fills every piece, which is the rule of p3_found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import WHITE_SPACE
from .codepoints import plain, row_starts, slices, to_codepoints, to_strings

# What ends a sentence before white space, and white space that ends one by itself.
ENDS = ".!?。"
LINE_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"


class Costs(NamedTuple):
    room: float = 0.0  # for each further unit that the piece would have had room for
    sentence: float = 1.0  # for ending at a sentence's end within a line
    within: float = 20.0  # for ending within a sentence
    size: float = 10.0  # times the square of the unfilled share of the limit


#: Every piece takes as many units as fit, whatever it cuts through.
FULL = Costs(room=1e6)


class Units(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    kind: np.ndarray  # how the unit ends: 0 line or text, 1 sentence, 2 within a sentence


@lru_cache(1)
def _classes() -> np.ndarray:
    """1 white space, 3 line break, 4 sentence end, 0 the rest."""
    table = np.zeros(0x110000, np.uint8)
    table[[ord(c) for c in WHITE_SPACE]] = 1
    table[[ord(c) for c in LINE_BREAKS]] = 3
    table[[ord(c) for c in ENDS]] = 4
    return table


def units(cps: np.ndarray, offsets: np.ndarray, limit: int) -> Units:
    """Sentences of all rows, those over the limit cut at their last white space within it, or at it."""
    kind = _classes()[cps]
    first = row_starts(len(cps), offsets)
    space = (kind & 1).astype(bool)
    before = np.concatenate(([False], space[:-1])) & ~first
    last = np.append(first[1:], True) if len(cps) else first
    after = np.append(space[1:], False) & ~last
    run_start, run_end = np.flatnonzero(space & ~before), np.flatnonzero(space & ~after) + 1
    breaks = np.concatenate(([0], np.cumsum(kind == 3)))
    in_run = breaks[run_end] > breaks[run_start]
    at_edge = first[run_start] | last[run_end - 1]
    ends = (kind[np.maximum(run_start - 1, 0)] == 4) & ~first[run_start]
    cuts = in_run | at_edge | ends
    # Sentences are what lies between the runs that cut.
    step = np.zeros(len(cps) + 1, np.int32)
    step[run_start[cuts]] += 1
    step[run_end[cuts]] -= 1
    body = np.cumsum(step[:-1]) == 0
    start = np.flatnonzero(body & (np.concatenate(([True], ~body[:-1])) | first))
    end = np.flatnonzero(body & (np.append(~body[1:], True) | last)) + 1
    by_line = np.zeros(len(cps) + 1, bool)
    by_line[run_start[in_run]] = True
    by_line[offsets[1:]] = True
    by_line[run_start[at_edge & last[run_end - 1]]] = True
    how = np.where(by_line[end], 0, 1).astype(np.int8)
    inner_start, inner_end = run_start[~cuts], run_end[~cuts]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        short = end - start <= limit
        done.append((start[short], end[short], how[short]))
        start, end, how = start[~short], end[~short], how[~short]
        at = np.searchsorted(inner_start, start + limit, side="right") - 1
        ok = (at >= 0) & (inner_start[np.maximum(at, 0)] > start) if len(inner_start) else np.zeros(len(start), bool)
        to, then = start + limit, start + limit
        to[ok], then[ok] = inner_start[at[ok]], inner_end[at[ok]]
        done.append((start, to, np.full(len(start), 2, np.int8)))
        start = then
    start, end, how = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
    by = np.argsort(start, kind="stable")
    start = start[by]
    return Units(start, end[by], np.searchsorted(offsets, start, side="right") - 1, how[by])


def pieces(u: Units, limit: int, overlap: int, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, last unit and number in its row of each piece, in order."""
    n = len(u.start)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    index = np.arange(n)
    new = np.concatenate(([True], u.row[1:] != u.row[:-1]))
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    last = np.repeat(heads + sizes - 1, sizes)
    far = np.minimum(np.searchsorted(u.end, u.start + limit, side="right") - 1, last)
    # The first unit that still fits into a piece together with the unit after this one.
    fits = np.searchsorted(u.start, u.end[np.minimum(index + 1, n - 1)] - limit, side="left")

    def onward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the piece after [a, b] begins: at most `overlap` units back, and beyond a."""
        return np.minimum(np.maximum(np.maximum(a + 1, b + 1 - overlap), fits[b]), b + 1)

    cut = np.array([0.0, costs.sentence, costs.within])[u.kind]
    best, choice = np.zeros(n + 1), np.zeros(n, np.int64)
    order = np.argsort(last - index, kind="stable")
    steps = np.searchsorted((last - index)[order], np.arange(int(sizes.max()) + 1))
    for k in range(int(sizes.max())):
        i = order[steps[k] : steps[k + 1]]
        width = far[i] - i + 1
        begin = np.cumsum(width) - width
        a = np.repeat(i, width)
        b = a + np.arange(len(a)) - np.repeat(begin, width)
        cost = costs.room * (far[a] - b) + np.where(b == last[a], 0.0, cut[b] + costs.size * (1 - (u.end[b] - u.start[a]) / limit) ** 2 + best[onward(a, b)])
        least = np.minimum.reduceat(cost, begin)
        best[i] = least
        hit = np.flatnonzero(cost == np.repeat(least, width))
        choice[a[hit[::-1]]] = b[hit[::-1]]
    out: list[np.ndarray] = []
    at, seq = heads, 1
    while len(at):
        to = choice[at]
        out.append(np.stack([at, to, np.full(len(at), seq)]))
        more = to < last[at]
        at, to = at[more], to[more]
        at, seq = onward(at, to), seq + 1
    table = np.concatenate(out, axis=1)
    table = table[:, np.lexsort((table[2], table[0]))]
    by = np.lexsort((table[2], u.row[table[0]]))
    return tuple(table[:, by])


def split_sections(df: DataFrame, key: str, text: str, limit: int = 520, overlap: int = 1, costs: Costs = Costs(), with_text: bool = False) -> DataFrame:
    """(key, chunk_seq_in_section, total_chunks_in_section, start_pos, end_pos[, text]): each text in pieces of at most `limit` code points.

    Positions are code points from 0, ends exclusive, numbers from 1. A piece begins with up to `overlap` last units of the one
    before, as many as fit together with the unit that follows them. A text of at most `limit` is one piece, from its first to
    its last character that isn't white space. Null and blank texts have no pieces; repeated keys each have their own; a text
    without any white space is cut every `limit` code points. Runs where the rows are, without a shuffle.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, chunk_seq_in_section int, total_chunks_in_section int, start_pos int, end_pos int" + ", text string" * with_text

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), plain(batch.column(1))
            for lo, hi in slices(texts):
                cps, offsets = to_codepoints(texts[lo:hi])
                u = units(cps, offsets, limit)
                a, b, seq = pieces(u, limit, overlap, costs)
                row, start, end = u.row[a], u.start[a], u.end[b]
                total = np.bincount(row, minlength=hi - lo)[row] if len(row) else row
                out = [keys.take(pa.array(row + lo)), pa.array(seq, pa.int32()), pa.array(total, pa.int32()), pa.array(start - offsets[row], pa.int32()), pa.array(end - offsets[row], pa.int32())]
                if with_text:
                    length = end - start
                    to = np.concatenate(([0], np.cumsum(length)))
                    at = np.arange(to[-1]) + np.repeat(start - to[:-1], length)
                    out.append(to_strings(cps[at], to).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, [key, "chunk_seq_in_section", "total_chunks_in_section", "start_pos", "end_pos"] + ["text"] * with_text)

    return df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(split, schema)
