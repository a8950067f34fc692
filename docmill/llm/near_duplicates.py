"""Problem 2: nearly the same texts, over all rows.

Method: byte-position inverted index with count filtering. Each distinct text has a signature in which every byte position is
a random draw from its 5-character stretches (a min-hash, reduced to a byte), so two texts of similarity s agree in each
position with probability s. One byte alone is no key (a list would hold 1/256 of all texts), so a posting is a run of `width`
neighbouring positions with the bytes in them. Every meeting of two texts in a list counts `width` shared bytes; the tally of
a pair is their sum over all lists, and pairs below the minimum go. What remains is verified on the whole texts. Exact copies
are one class before all that, however many they are.

The minimum and the number of runs follow from the threshold and the number of texts (`plan`): a pair at the threshold is
missed with a probability of at most MISS, and one above it far less often, at every size of the collection. `exact` asks for
an index that misses none: by the rarest stretches of each text, of which two texts that are near enough share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.staging import BROADCAST_ROWS, staged
from .codepoints import counts_before, plain, slices, to_codepoints
from .columns import bare_text
from .leaks import hashes

SHINGLE = 5
MISS = 2e-5
#: Share of the sampled texts from which a posting list is hot, and how many texts are sampled to find such lists (which decides
#: how the work is spread, not what is found).
HOT, HOT_SAMPLE = 0.002, 100_000
#: Tasks over which a hot list is spread.
SALTS = 32
#: Bytes of postings that a task is to take, and tasks at most.
TASK_BYTES, TASKS = 32 << 20, 20_000
#: Bytes of text signed at once; the arrays of a permutation stay in a core's cache.
CACHED = 1 << 18


class Plan(NamedTuple):
    width: int  # byte positions of a run
    runs: int
    least: int  # shared runs that a pair must have

    @property
    def positions(self) -> int:
        return self.width * self.runs

    @property
    def minimum(self) -> int:
        """Shared bytes of the tally."""
        return self.width * self.least


def missed(p: Plan, similarity: float) -> float:
    """The probability that a pair of this similarity shares fewer runs than the least."""
    hit = similarity**p.width
    return sum(math.comb(p.runs, k) * hit**k * (1 - hit) ** (p.runs - k) for k in range(p.least))


def plan(threshold: float, texts: int, least: int = 2) -> Plan:
    """Wider runs for more texts, so that chance meetings stay in proportion to them; as many runs as keep MISS."""
    width = max(4, math.ceil(math.log10(max(texts, 1))) - 2)
    runs = least
    while missed(Plan(width, runs, least), threshold) > MISS:
        runs += 1
    return Plan(width, runs, least)


def signatures(cps: np.ndarray, offsets: np.ndarray, positions: int, seed: int = 7) -> np.ndarray:
    """[row, position] bytes; rows of fewer than SHINGLE code points have zeros."""
    h = hashes(cps, SHINGLE)
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
    inside = np.arange(len(h)) + SHINGLE <= row_end
    # The stretches of the rows, end to end.
    to = counts_before(np.concatenate([inside, np.zeros(len(cps) - len(h), bool)]), offsets)
    h = (h[inside] >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(offsets) - 1, positions), np.uint8)
    full = np.flatnonzero(to[1:] > to[:-1])
    if not len(full):
        return out
    draw = np.random.default_rng(seed).integers(0, 1 << 32, (positions, 2), dtype=np.uint32)
    drawn = np.empty_like(h)
    for k, (a, b) in enumerate(draw):
        np.multiply(h, a | 1, out=drawn)
        np.bitwise_xor(drawn, drawn >> np.uint32(15), out=drawn)
        np.multiply(drawn, b | 1, out=drawn)
        least = np.minimum.reduceat(drawn, to[full])
        out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


class NearDuplicates(NamedTuple):
    """Links between the texts' classes, with each copy's class; by (tbl, id, digest), tables as numbered by `tables`."""

    rows: DataFrame  # t, id, digest: every row with a text
    links: DataFrame  # t, a, b, da, db, similarity: representatives (smallest ids) of different texts, with their digests; a < b
    copies: DataFrame  # t, id, digest, rep: rows whose form equals that of a row with a smaller id
    tables: list[str]

    def name(self) -> F.Column:
        return F.element_at(F.array(*map(F.lit, self.tables)), F.col("t") + 1)


def _forms(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    parts = [df.select(F.lit(k).alias("t"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("form")) for k, (df, key, text) in enumerate(tables.values())]
    rows = reduce(DataFrame.unionAll, parts).where("id is not null and form is not null")
    return rows.withColumn("form", bare_text("form")).where("form != ''").withColumn("digest", F.unhex(F.md5("form")))


def _stretches(column: pa.Array) -> list[np.ndarray]:
    """The distinct stretches of each row, as sorted hashes."""
    cps, offsets = to_codepoints(plain(column))
    h = hashes(cps, SHINGLE)
    return [np.unique(h[a : max(b - SHINGLE + 1, a)]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(plain(batch.column(5)), CACHED):
                part = batch.slice(lo, hi - lo)
                ours, theirs = _stretches(part.column(5)), _stretches(part.column(6))
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(ours, theirs, strict=True)], float)
                union = np.array([len(x) + len(y) for x, y in zip(ours, theirs, strict=True)]) - both
                out = pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(both / np.maximum(union, 1))], ["t", "a", "b", "da", "db", "similarity"])
                yield out.filter(pa.array(both >= threshold * union - 1e-9))

    return verify


def _postings(texts: DataFrame, p: Plan) -> DataFrame:
    """(t, id, key): the runs of every text's signature; the key holds table, place and bytes of a run."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = plain(batch.column(2))
            for lo, hi in slices(forms, CACHED):
                row = signatures(*to_codepoints(forms[lo:hi]), p.positions)
                data = pa.Array.from_buffers(pa.binary(p.positions), hi - lo, [None, pa.py_buffer(row.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], data], ["t", "id", "signature"])

    signed = staged(texts.mapInArrow(sign, "t int, id bigint, signature binary"), "p2-signatures")
    runs = signed.select("t", "id", "signature", F.explode(F.sequence(F.lit(0), F.lit(p.runs - 1))).alias("run"))
    return runs.select("t", "id", F.xxhash64("t", "run", F.substring("signature", F.col("run") * p.width + 1, F.lit(p.width))).alias("key"))


def _pairs(lists: DataFrame, salts: int = 1) -> DataFrame:
    """(t, a, b): every meeting of two texts in a list; a list of one side is spread over `salts` tasks, the other repeated."""
    x, y = lists.select("key", "t", F.col("id").alias("a")), lists.select("key", F.col("t").alias("u"), F.col("id").alias("b"))
    if salts > 1:
        x = x.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
        y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = x.join(y, ["key", "salt"] if salts > 1 else ["key"])
    return met.where((F.col("a") < F.col("b")) & (F.col("t") == F.col("u"))).select("t", "a", "b")


def _tallied(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(t, a, b): pairs whose tally of shared bytes reaches the minimum."""
    p = plan(threshold, n)
    postings = _postings(texts, p)
    # Lists that a sample of the texts shows to be hot are salted and never stand in one task.
    sampled = min(1.0, HOT_SAMPLE / max(n, 1))
    hot = postings.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(sampled * (1 << 20))) if sampled < 1 else postings
    hot = staged(hot.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(200, HOT * sampled * n)).select("key"), "p2-hot")
    some = not hot.isEmpty()
    rest = postings.join(F.broadcast(hot), "key", "left_anti") if some else postings
    # Most runs occur once; what stays is a small part of the postings.
    tasks = min(max(-(-n * p.runs * 32 // TASK_BYTES), 1), TASKS)
    rest = rest.repartition(max(tasks, texts.sparkSession.sparkContext.defaultParallelism), "key")
    shared = rest.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n")
    met = _pairs(staged(shared, "p2-shared"))
    if some:
        met = met.unionAll(_pairs(postings.join(F.broadcast(hot), "key", "left_semi"), SALTS))
    tally = met.groupBy("t", "a", "b").agg((F.count("*") * p.width).alias("shared"))
    return tally.where(F.col("shared") >= p.minimum).select("t", "a", "b")


def _sharing_rare(texts: DataFrame, threshold: float) -> DataFrame:
    """(t, a, b): a superset of the pairs of at least `threshold`, without a miss; more meetings than by `_tallied`.

    Of n stretches, a text near enough to another shares at least ceil(threshold * n) with it, so one of its n - that + 1 rarest.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = plain(batch.column(2))
            for lo, hi in slices(forms, CACHED):
                sets = _stretches(forms[lo:hi])
                size = np.array([len(x) for x in sets], np.int32)
                at = pa.array(np.repeat(np.arange(lo, hi), size))
                every = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(size, size)), pa.array(every)], ["t", "id", "size", "h"])

    posts = staged(texts.mapInArrow(cut, "t int, id bigint, size int, h bigint"), "p2-stretches")
    posts = posts.join(posts.groupBy("t", "h").agg(F.count("*").alias("n")), ["t", "h"])
    place = F.row_number().over(Window.partitionBy("t", "id").orderBy("n", "h"))
    rare = posts.withColumn("k", place).where(F.col("k") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1)
    rare = staged(rare.where("n > 1").select("t", "id", "size", "h"), "p2-rare")
    x = rare.select("t", "h", F.col("id").alias("a"), F.col("size").alias("m"))
    y = rare.select("t", "h", F.col("id").alias("b"), F.col("size").alias("n"))
    near = (F.col("a") < F.col("b")) & (F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-9)
    return x.join(y, ["t", "h"]).where(near).select("t", "a", "b").distinct()


def near_duplicates(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = 0.8, exact: bool = False) -> NearDuplicates:
    """Classes of equal texts and links of at least `threshold` between them, for tables given as (table, id, text column).

    Texts count in the form of problem 1 without white space; similarity is the share of common stretches of five characters
    among all of both. Null ids, null and blank texts do not count. Texts of under five characters have no stretch and are only
    equal or not. Rows that repeat an id and its text count once; an id with several texts has the links of all of them. No link
    is listed that isn't there; one at the threshold is missed with a probability of MISS, with `exact` none is.
    """
    base = staged(_forms(tables), "p2-forms")
    slim = base.select("t", "id", "digest")
    several = slim.groupBy("t", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = slim.join(several, ["t", "digest"]).where("id != rep").select("t", "id", "digest", "rep").distinct()
    copies = staged(copies, "p2-copies")
    one_each = base.join(_small(copies.select("t", "id", "digest")), ["t", "id", "digest"], "left_anti")
    texts = one_each.where(F.length("form") >= SHINGLE).select("t", "id", "form")
    pairs = staged(_sharing_rare(texts, threshold) if exact else _tallied(texts, base.count(), threshold), "p2-pairs")
    ends = staged(pairs.select("t", F.col("a").alias("id")).union(pairs.select("t", F.col("b").alias("id"))).distinct(), "p2-ends")
    forms = one_each.join(_small(ends), ["t", "id"], "left_semi")
    left = forms.select("t", F.col("id").alias("a"), F.col("digest").alias("da"), F.col("form").alias("form_a"))
    right = forms.select("t", F.col("id").alias("b"), F.col("digest").alias("db"), F.col("form").alias("form_b"))
    both = pairs.join(left, ["t", "a"]).join(right, ["t", "b"]).select("t", "a", "b", "da", "db", "form_a", "form_b")
    verified = both.mapInArrow(_verify(threshold), "t int, a bigint, b bigint, da binary, db binary, similarity double")
    return NearDuplicates(slim, verified.dropDuplicates(["t", "a", "b", "da", "db"]), copies, list(tables))


def _small(df: DataFrame) -> DataFrame:
    """A staged table broadcast after a count; shuffled beyond BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def all_pairs(found: NearDuplicates) -> DataFrame:
    """(tbl, id_a, id_b): every pair of rows that are equal or linked, copies written out; id_a < id_b."""
    links = staged(found.links.select("t", "a", "b", "da", "db"), "p2-links")
    copies = found.copies
    of_a = links.join(copies.select("t", F.col("rep").alias("a"), F.col("digest").alias("da"), "id"), ["t", "a", "da"]).select("t", F.col("id").alias("a"), "b", "da", "db")
    links = links.unionByName(of_a)
    of_b = links.join(copies.select("t", F.col("rep").alias("b"), F.col("digest").alias("db"), "id"), ["t", "b", "db"]).select("t", "a", F.col("id").alias("b"))
    links = links.select("t", "a", "b").unionByName(of_b)
    within = copies.select("t", F.col("rep").alias("a"), F.col("id").alias("b"))
    c = copies.select("t", "digest", F.col("id").alias("b"))
    among = copies.select("t", "digest", F.col("id").alias("a")).join(c, ["t", "digest"]).where("a < b").select("t", "a", "b")
    pairs = links.unionByName(within).unionByName(among).where("a != b")
    pairs = pairs.select(found.name().alias("tbl"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    # Only ids with several texts can be paired twice.
    texts = found.rows.distinct().groupBy("t", "id").agg(F.count("*").alias("n")).where("n > 1")
    return pairs if texts.isEmpty() else pairs.distinct()


def groups(found: NearDuplicates) -> DataFrame:
    """(tbl, id, group_id, n_links): one row for each row with a text; the group's smallest id, and the links of its text.

    Rows are in one group if links or equality lead from one to the other. Links count those of the row's class of equal texts.
    """
    links = staged(found.links.select("t", "a", "b", "da", "db"), "p2-links")
    node = lambda c: F.struct("t", F.col(c).alias("id"))
    same = found.copies.select(node("rep").alias("a"), node("id").alias("b"))
    edges = links.select(node("a").alias("a"), node("b").alias("b")).union(same)
    roots = components(edges, "a", "b").select("node.t", "node.id", F.col("root.id").alias("root"))
    ends = links.select("t", F.col("a").alias("rep"), F.col("da").alias("digest")).union(links.select("t", F.col("b").alias("rep"), F.col("db").alias("digest")))
    degree = ends.groupBy("t", "rep", "digest").agg(F.count("*").alias("n_links"))
    rows = found.rows.join(roots, ["t", "id"], "left").join(found.copies, ["t", "id", "digest"], "left").withColumn("rep", F.coalesce("rep", "id"))
    rows = rows.join(degree, ["t", "rep", "digest"], "left")
    return rows.select(found.name().alias("tbl"), "id", F.coalesce("root", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
