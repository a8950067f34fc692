"""Problem 6: passages of held-out items within the documents of a corpus.

Method: winnowing. Of each window of WINDOW consecutive hashes of K characters the least is kept; two texts that share K +
WINDOW - 1 characters share a window, so a kept hash. The kept hashes of corpus and items are joined; what meets is extended
along its diagonal to the whole shared run, whose length decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import BROADCAST_ROWS, staged
from .canonical import look_alikes
from .codepoints import plain, slices, to_codepoints
from .columns import reduced, reduced_text

K = 16
RUN = 30


def hashes(cps: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k code points from each position on."""
    n = max(len(cps) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    wide = cps.astype(np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def winnowed(cps: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's kept hashes, and the rows' offsets among them; rows shorter than k + window - 1 have none."""
    h = hashes(cps, k)
    if len(h) < window:
        return h[:0], np.zeros(len(offsets), np.int64)
    n = len(h) - window + 1
    least, width = h, 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.arange(n) + (k + window - 1) <= offsets[1:][row]
    least, row = least[:n][whole], row[whole]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    return least[new], np.searchsorted(row[new], np.arange(len(offsets)))


def fingerprints(text: str | Column, run: int = RUN, k: int = K) -> Column:
    """array<bigint> of the winnowed hashes of a text's reduced form; empty for null text and for shorter forms than `run`."""

    alike = look_alikes()

    @F.arrow_udf("array<bigint>")
    def kept(text: pa.Array) -> pa.Array:
        text, parts = plain(text), []
        for lo, hi in slices(text):
            values, ends = winnowed(*reduced(*to_codepoints(text[lo:hi]), alike), k, run - k + 1)
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return kept(text)


def _meetings(ours: np.ndarray, theirs: np.ndarray, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal hashes at which the neighbours `mine` and `other` differ; -1 is a neighbour that isn't there."""
    order = np.argsort(theirs, kind="stable")
    lo, hi = (np.searchsorted(theirs[order], ours, side=s) for s in ("left", "right"))
    hit = np.flatnonzero(hi > lo)
    # By hash: few distinct neighbours on either side, so equal ones are passed over without being paired.
    by_hash: dict[int, np.ndarray] = {}
    for i in hit[np.unique(ours[hit], return_index=True)[1]]:
        by_hash[int(ours[i])] = order[lo[i] : hi[i]]
    a, b = [], []
    grouped = hit[np.lexsort((mine[hit], ours[hit]))]
    cut = np.flatnonzero((np.diff(ours[grouped]) != 0) | (np.diff(mine[grouped]) != 0)) + 1
    for own in np.split(grouped, cut) if len(grouped) else []:
        there = by_hash[int(ours[own[0]])]
        there = there[(other[there] != mine[own[0]]) | (other[there] < 0)]
        if len(there):
            a.append(np.repeat(own, len(there)))
            b.append(np.tile(there, len(own)))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def longest_run(a: np.ndarray, b: np.ndarray, k: int, run: int, block: int = 1 << 16) -> int:
    """Length of the longest run that a and b share, if it has `run` code points; found from shared hashes of k.

    A run is known by its two ends: equal hashes whose neighbours before, or after, differ. On one diagonal they follow each
    other, so the k-th begin and the k-th end are one run, and what lies between is never listed: a letter that is repeated
    throughout costs its length, not the square of it. A long text is taken in blocks that overlap by the other's length, in
    which every run lies whole.
    """
    if len(a) < len(b):
        a, b = b, a
    step = max(block, 2 * len(b))
    return max((_longest(a[lo : lo + step + len(b)], b, k, run) for lo in range(0, max(len(a) - len(b), 1), step)), default=0)


def _longest(a: np.ndarray, b: np.ndarray, k: int, run: int) -> int:
    ha, hb = hashes(a, k), hashes(b, k)
    if not len(ha) or not len(hb):
        return 0
    x, y = a.astype(np.int64), b.astype(np.int64)
    begin = _meetings(ha, hb, np.append(-1, x)[: len(ha)], np.append(-1, y)[: len(hb)])
    end = _meetings(ha, hb, np.append(x, -1)[k:], np.append(y, -1)[k:])
    ordered = lambda at: (by := np.lexsort((at[0], at[0] - at[1])), at[0][by], at[1][by])[1:]
    (i, j), (to, _) = ordered(begin), ordered(end)
    length = to - i + k
    for r in np.argsort(-length):
        n = length[r]
        if n < run:
            return 0
        if (a[i[r] : i[r] + n] == b[j[r] : j[r] + n]).all():
            return int(n)
    return 0


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, k: int = K) -> DataFrame:
    """(doc_id, item_id, run_length): documents that share a run of `run` or more letters and digits with an item.

    Both texts count in the form of problem 1, in lower case, reduced to letters and digits. Null texts and shorter ones match
    nothing. Ids that repeat with different texts count as one document each way: a pair comes once, with its longest run.
    The items' hashes and the pairs found are broadcast only after a count, and shuffled beyond BROADCAST_ROWS.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("doc_text"))
    i = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("item_text"))
    held = staged(i.select("item", F.explode(F.array_distinct(fingerprints("item_text", run, k))).alias("h")), "p6-items")
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    found = d.select("doc", F.explode(fingerprints("doc_text", run, k)).alias("h")).join(held, "h").select("doc", "item").distinct()
    found = staged(found, "p6-pairs")
    small = found.count() <= BROADCAST_ROWS
    texts = d.join(F.broadcast(found) if small else found, "doc")
    both = texts.join(i, "item").select("doc", "item", "doc_text", "item_text")
    # As many tasks as there are cores: the pairs of a few leaking sources may stand close together.
    both = both.repartition(spark.sparkContext.defaultParallelism * 2) if small else both

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = plain(batch.column(2)), []
            b, to = to_codepoints(plain(batch.column(3)))
            for lo, hi in slices(texts):
                a, at = to_codepoints(texts[lo:hi])
                lengths += [longest_run(a[at[i - lo] : at[i - lo + 1]], b[to[i] : to[i + 1]], k, run) for i in range(lo, hi)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32())], ["doc", "item", "run_length"])
            yield out.filter(np.array(lengths, np.int32) >= run)

    kinds = f"doc {d.schema['doc'].dataType.simpleString()}, item {i.schema['item'].dataType.simpleString()}, run_length int"
    spans = both.select("doc", "item", reduced_text("doc_text"), reduced_text("item_text")).mapInArrow(extend, kinds)
    return spans.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("run_length").alias("run_length"))
