"""Aggregates over cases: distributions, agreement, calibration, intervals, frontiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import BROADCAST_ROWS, small, staged


#: Stretches of a group's values that are sorted apart from each other.
CELLS = 64


def _counted(df: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """(by..., v, k): the distinct values of each group and how many rows have each; null and NaN do not count."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    return staged(rows.groupBy(*by, "v").agg(F.count("*").alias("k")), "counts")


def _groups(counts: DataFrame, by: list[str]) -> int:
    return counts.select(*by).distinct().count() if by else 1


def _ranked(counts: DataFrame, by: list[str], value: str, weight: str, groups: int, cells: int = CELLS) -> DataFrame:
    """counts with `before`: the weight of all lesser values of the group.

    Values are cut into cells at approximate quantiles of the distinct ones; running sums go over the cells and then within
    each, so no group's values stand in one task or one buffer.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / cells for k in range(1, cells)], 1000).alias("_cuts"))
    placed = _with(counts, cuts, by, groups).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*by, "_cell").agg(F.sum(weight).alias("_n"))
    sums = sums.withColumn("_first", F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_n")).drop("_n")
    within = F.sum(weight).over(Window.partitionBy(*by, "_cell").orderBy(value))
    return _with(placed, sums, [*by, "_cell"], groups * cells).withColumn("before", F.col("_first") + within - F.col(weight)).drop("_cell", "_first")


def ranked_counts(df: DataFrame, by: list[str], value: str | Column, cells: int = CELLS) -> DataFrame:
    """(by..., v, k, before): the distinct values of each group, how many rows have each and how many have a lesser one.

    Rows become counts first, so equal values cost one row. Null and NaN values do not count; null groups are a group.
    """
    counts = _counted(df, by, value)
    return _ranked(counts, by, "v", "k", _groups(counts, by), cells)


def _with(df: DataFrame, few: DataFrame, on: list[str], rows: int) -> DataFrame:
    """df with the columns of a table that has at most `rows` rows, one for each value of `on`; nulls are equal. Broadcast if they are few."""
    named = few.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in few.columns if c not in on))
    named = F.broadcast(named) if rows <= BROADCAST_ROWS else named
    joined = df.join(named, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]) if on else df.crossJoin(named)  # one row
    return joined.drop(*(f"_on_{c}" for c in on))


def percentiles(df: DataFrame, by: list[str], value: str | Column, shares: tuple[float, ...], nearest: bool = False, places: int | None = None) -> DataFrame:
    """(by..., n, total, pX...): percentiles of each group's values, interpolated or the nearest rank (nothing in between).

    `nearest`: the smallest value that at least this share of the values does not exceed. total is the values' sum.
    """
    counts = _counted(df, by, value)
    groups = _groups(counts, by)
    sizes = counts.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("v") * F.col("k")).alias("total"))
    at = lambda pos: F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("k")), F.col("v")))
    cuts = []
    for p in shares:
        if nearest:
            out = at(F.greatest(F.ceil(F.col("n") * p - 1e-9), F.lit(1)) - 1)
        else:
            pos = (F.col("n") - 1) * p
            low, high, part = at(F.floor(pos)), at(F.ceil(pos)), F.first(pos - F.floor(pos))
            out = low + (high - low) * part
        cuts.append((F.round(out, places) if places is not None else out).alias(f"p{p * 100:g}"))
    return _with(_ranked(counts, by, "v", "k", groups), sizes, by, groups).groupBy(*by, "n", "total").agg(*cuts)


def distribution(df: DataFrame, by: list[str], value: str, places: int = 6) -> DataFrame:
    """(by..., n, mean, p10, p50, p90, p95) of the values that aren't null or NaN; groups without any have no row."""
    out = percentiles(df, by, value, (0.1, 0.5, 0.9, 0.95), places=places)
    return out.select(*by, "n", F.round(F.col("total") / F.col("n"), places).alias("mean"), "p10", "p50", "p90", "p95")


def slices(df: DataFrame, by: list[str]) -> DataFrame:
    """df once over all rows and once by each column of `by`: adds (slice, value) and drops `by`."""
    each = [F.struct(F.lit("overall").alias("slice"), F.lit(None).cast("string").alias("value"))]
    each += [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by]
    kept = [c for c in df.columns if c not in by]
    return df.select(*kept, F.explode(F.array(*each)).alias("_s")).select("_s.*", *kept)


def sliced(df: DataFrame, by: list[str], metrics: list[Column]) -> DataFrame:
    """Metrics over all rows and by each single column of `by`, in one pass: (slice, value, metrics...)."""
    return slices(df, by).groupBy("slice", "value").agg(*metrics)


def sliced_distribution(df: DataFrame, by: list[str], value: str, places: int = 6) -> DataFrame:
    """(slice, value, n, mean, p10, p50, p90, p95) over all rows and by each single column of `by`."""
    measured = df.select(*by, F.col(value).alias("_measured"))
    return distribution(slices(measured, by), ["slice", "value"], "_measured", places)


def by_labels(df: DataFrame, labels: str, metrics: list[Column]) -> DataFrame:
    """Metrics by each label of an array column, and over all rows as `overall`; a row counts once in each of its labels."""
    every = F.array_union(F.array(F.lit("overall")), F.coalesce(F.col(labels), F.array().cast("array<string>")))
    return df.withColumn("label", F.explode(every)).groupBy("label").agg(*metrics)


def calibration(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(by..., n, ece, brier): expected calibration error over equal bins and Brier score; confidences outside [0, 1] don't count."""
    conf, hit = F.col(confidence).cast("double"), F.col(correct).cast("double")
    rows = df.where(conf.between(0, 1) & hit.isNotNull()).select(*by, conf.alias("c"), hit.alias("h"))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)))
    binned = rows.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.avg("c").alias("c"), F.avg("h").alias("h"), F.sum((F.col("c") - F.col("h")) ** 2).alias("b"))
    gap = F.sum(F.col("k") * F.abs(F.col("h") - F.col("c"))) / F.sum("k")
    return binned.groupBy(*by).agg(F.sum("k").alias("n"), F.round(gap, 6).alias("ece"), F.round(F.sum("b") / F.sum("k"), 6).alias("brier"))


def confusion(df: DataFrame, truth: str, given: str, labels: list[str]) -> DataFrame:
    """One row a label of `truth`, one column a label of `given`, with zeros where nothing fell."""
    known = df.where(F.col(truth).isin(labels) & F.col(given).isin(labels))
    counts = known.groupBy(F.col(truth).alias("truth")).pivot(given, labels).count()
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    return every.join(counts, "truth", "left").na.fill(0)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two label columns; null rows don't count; 1 or 0 where chance agreement is complete."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    # The cells are as few as pairs of labels.
    side_a = cells.groupBy(F.col("a").alias("x")).agg(F.sum("k").alias("ka"))
    side_b = cells.groupBy(F.col("b").alias("x")).agg(F.sum("k").alias("kb"))
    chance = side_a.join(side_b, "x").agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0)).alias("both"))
    total = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    value = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return total.crossJoin(chance).select("n", F.round(po, 6).alias("agreement"), F.round(value, 6).alias("kappa"))  # one row each


def average_ranks(df: DataFrame, by: list[str], value: str, rank: str, cells: int = CELLS) -> DataFrame:
    """(by..., v, k, rank): each group's distinct values with their counts and their rank from 1, ties at their average."""
    return ranked_counts(df, by, value, cells).withColumn(rank, F.col("before") + (F.col("k") + 1) / 2).drop("before")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., n, rho): correlation of average ranks; null where a side has one value only.

    Rows that are equal in both values are one row with a count before ranks are joined to them.
    """
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    pairs = staged(rows.groupBy(*by, "x", "y").agg(F.count("*").alias("w")), "pairs")
    groups, ranked = _groups(pairs, by), pairs
    for c in ("x", "y"):
        counts = pairs.groupBy(*by, c).agg(F.sum("w").alias("w"))
        ranks = _ranked(counts, by, c, "w", groups).select(*by, c, (F.col("before") + (F.col("w") + 1) / 2).alias(f"r{c}"))
        ranks = staged(ranks, "ranks")
        ranked = _with(ranked, ranks, [*by, c], ranks.count())
    total = F.sum("w")
    # Ranks from 1 to n have their mean at (n + 1) / 2.
    ranked = _with(ranked, pairs.groupBy(*by).agg(((total + 1) / 2).alias("m")), by, groups)
    dx, dy = F.col("rx") - F.col("m"), F.col("ry") - F.col("m")
    rho = F.try_divide(F.sum(F.col("w") * dx * dy), F.sqrt(F.sum(F.col("w") * dx * dx)) * F.sqrt(F.sum(F.col("w") * dy * dy)))
    return ranked.groupBy(*by).agg(total.alias("n"), F.round(rho, 6).alias("rho"))


def skyline(df: DataFrame, cost: str, gain: str, cells: int = CELLS) -> DataFrame:
    """Rows that no other row beats (no more cost and no less gain, one of them strictly); equal rows stay together.

    Each cost keeps its best gain. Costs are cut into cells at approximate quantiles; a cost survives if its gain is above the
    best of all cells before and of all lower costs in its own. The few survivors are joined to the rows.
    """
    kept = df.where(F.col(cost).isNotNull() & F.col(gain).isNotNull())
    best = staged(kept.groupBy(F.col(cost).cast("double").alias("_c")).agg(F.max(gain).alias("_g")), "best")
    cuts = best.agg(F.percentile_approx("_c", [k / cells for k in range(1, cells)], 1000).alias("_cuts"))
    best = best.crossJoin(F.broadcast(cuts)).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col("_c")))).drop("_cuts")  # one row
    tops = best.groupBy("_cell").agg(F.max("_g").alias("_top"))
    tops = tops.withColumn("_lower", F.max("_top").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")  # one row a cell
    own = F.max("_g").over(Window.partitionBy("_cell").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    beaten = F.greatest("_lower", own)
    front = _with(best, tops, ["_cell"], cells).withColumn("_beaten", beaten)
    front = staged(front.where("_beaten is null or _g > _beaten").select("_c", "_g"), "front")
    return kept.join(small(front), (F.col(cost).cast("double") == F.col("_c")) & (F.col(gain) == F.col("_g")), "left_semi")


#: Multipliers and modulus of the draws: two rounds of a congruence, which any engine can compute in 64 bits.
PRIME, FIRST, SECOND, THIRD = 2_147_483_647, 48_271, 69_621, 16_807
#: Resamples of an interval, and from how many draws of a row on the rest has a probability under 1e-6.
RESAMPLES, MOST = 1000, 9


def draws(key: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """[key, resample] counts of a Poisson distribution of mean 1, from keys and numbers alone."""
    x = (np.mod(key, PRIME)[:, None] * FIRST + (resamples[None, :] + seed) * SECOND) % PRIME
    x = (x * x % PRIME * THIRD + resamples[None, :] * FIRST + seed) % PRIME
    x = (x * x % PRIME * SECOND + np.mod(key, PRIME)[:, None]) % PRIME
    return np.searchsorted(poisson_cuts(), x / float(PRIME), side="right").astype(float)


def poisson_cuts() -> np.ndarray:
    """Up to which share of the draws a row is left out, counts once, twice ..."""
    return np.round(np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(MOST)]), 9)


def bootstrap_mean(df: DataFrame, by: list[str], key: str, value: str, resamples: int = RESAMPLES, alpha: float = 0.05, seed: int = 17) -> DataFrame:
    """(by..., n, mean, ci_lo, ci_hi): percentile interval of the mean by a Poisson bootstrap.

    Each row draws its count in every resample from its key (an integer; rows with equal keys draw alike), so the interval is
    the same however rows are placed, and two values of one row are resampled together. Tasks hold one row of sums a group; no
    group is gathered anywhere. Null and NaN values do not count.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*by, F.col(key).cast("bigint").alias("_h"), F.col(value).cast("double").alias("_v")).where("_h is not null")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    kinds = f"{kinds}, " if by else ""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        every, schema = np.arange(resamples, dtype=np.int64), None
        for batch in batches:
            pdf, schema = batch.to_pandas(), batch.schema
            groups = pdf.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(pdf))}
            h, v = pdf["_h"].to_numpy(), pdf["_v"].to_numpy()
            for name, at in groups.items():
                name = name if isinstance(name, tuple) else (name,)
                total = held.setdefault(name, np.zeros((2, resamples + 1)))
                for lo in range(0, len(at), 512):
                    i = at[lo : lo + 512]
                    drawn = np.hstack([draws(h[i], every, seed), np.ones((len(i), 1))])  # the last resample is the sample itself
                    total += np.stack([v[i] @ drawn, drawn.sum(axis=0)])
        for name, total in held.items():
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({**{c: [x] * (resamples + 1) for c, x in zip(by, name, strict=True)}, "b": np.arange(resamples + 1, dtype=np.int32), "s": total[0], "n": total[1]}),
                schema=pa.schema([*(schema.field(c) for c in by), ("b", pa.int32()), ("s", pa.float64()), ("n", pa.float64())]),
                preserve_index=False,
            )

    part = rows.mapInArrow(sums, f"{kinds}b int, s double, n double")
    means = part.groupBy(*by, "b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"), F.sum("n").alias("n"))
    own = F.col("b") == resamples
    cut = lambda p: F.percentile(F.when(~own, F.col("m")), F.lit(p))  # noqa: E731  # one value a resample
    return means.groupBy(*by).agg(
        F.max(F.when(own, F.col("n"))).cast("bigint").alias("n"),
        F.round(F.max(F.when(own, F.col("m"))), 6).alias("mean"),
        F.round(cut(alpha / 2), 6).alias("ci_lo"),
        F.round(cut(1 - alpha / 2), 6).alias("ci_hi"),
    )


def paired_interval(pairs: DataFrame, by: list[str], key: str, base: str, candidate: str, seeds: tuple[int, ...] = (17,), alpha: float = 0.05) -> DataFrame:
    """(by..., n, mean_diff, ci_lo, ci_hi): interval of candidate - base over rows that have both; bounds averaged over seeds.

    A row draws once for both of its values, which is resampling the pairs.
    """
    diff = pairs.withColumn("_d", F.col(candidate) - F.col(base))
    each = [bootstrap_mean(diff, by, key, "_d", alpha=alpha, seed=s) for s in seeds]
    every = reduce(DataFrame.unionAll, each)
    return every.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean_diff"), F.round(F.avg("ci_lo"), 6).alias("ci_lo"), F.round(F.avg("ci_hi"), 6).alias("ci_hi"))


def claim_verdict(n: Column, mean: Column, lo: Column, hi: Column, claimed: Column, min_sample: int = 30, tolerance: float = 0.005) -> Column:
    """What a claimed difference comes to: no_pairs, small_sample, interval_holds_zero, wrong_sign, off_by_too_much or holds."""
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "no_pairs")
        .when(n < min_sample, "small_sample")
        .when((lo <= 0) & (hi >= 0), "interval_holds_zero")
        .when(F.signum(mean) != F.signum(claimed), "wrong_sign")
        .when(F.abs(mean - claimed) > tolerance, "off_by_too_much")
        .otherwise("holds")
    )


def paired(df: DataFrame, pair: list[str], run: str, base: str, candidate: str, value: str) -> DataFrame:
    """(pair..., base, candidate, diff): rows that both runs have, once each by their mean; null values don't count."""
    kept = df.where(F.col(run).isin(base, candidate) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    wide = kept.groupBy(*pair).agg(F.avg(F.when(F.col(run) == base, F.col(value))).alias("base"), F.avg(F.when(F.col(run) == candidate, F.col(value))).alias("candidate"))
    return wide.where("base is not null and candidate is not null").withColumn("diff", F.col("candidate") - F.col("base"))


def regressions(rates: DataFrame, other: DataFrame, key: str, metrics: list[str], threshold: float) -> DataFrame:
    """(key, metric, base, head, delta): metrics that fell by more than the threshold, of the keys that both have."""
    long = lambda df, name: df.unpivot([key], metrics, "metric", name)
    both = long(rates, "base").join(long(other, "head"), [key, "metric"])
    return both.withColumn("delta", F.round(F.col("head") - F.col("base"), 6)).where(F.col("delta") < -threshold)


def budget_check(measured: DataFrame, budgets: DataFrame, key: str, value: str, limit: str) -> DataFrame:
    """(key, value, limit, verdict): violation, pass, or orphan where one side is missing."""
    both = measured.join(budgets, key, "full_outer")
    verdict = F.when(F.col(value).isNull() | F.col(limit).isNull(), "orphan").when(F.col(value) > F.col(limit), "violation").otherwise("pass")
    return both.select(key, value, limit, verdict.alias("verdict"))


def transitions(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """(from_state, to_state, n): how often one state follows another within a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = df.select(F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state"))
    return moved.where("from_state is not null and to_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def spread_over(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., runs, mean, stdev, lowest, highest, spread) of one value a run; stdev is the sample's, 0 for one run."""
    return df.groupBy(*by).agg(
        F.count(value).alias("runs"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)), 4).alias("stdev"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"), (F.max(value) - F.min(value)).alias("spread"),
    )


def stability(df: DataFrame, case: str, state: str, runs: int) -> DataFrame:
    """(distinct_states, cases): how many states a case has over the runs; a run without it counts as a state of its own."""
    per = df.groupBy(case).agg(F.count_distinct(F.coalesce(state, F.lit("none"))).alias("d"), F.count("*").alias("there"))
    return per.groupBy((F.col("d") + (F.col("there") < runs).cast("int")).alias("distinct_states")).agg(F.count("*").alias("cases"))


def change_shares(df: DataFrame, by: list[str], delta: str, least: float = 1e-9) -> DataFrame:
    """(by..., n, improved, unchanged, regressed, mean_delta) and the shares of each; null deltas do not count."""
    d = F.col(delta)
    up, down = F.count_if(d > least), F.count_if(d < -least)
    out = df.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), up.alias("improved"), down.alias("regressed"), F.round(F.avg(d), 6).alias("mean_delta"))
    out = out.withColumn("unchanged", F.col("n") - F.col("improved") - F.col("regressed"))
    return out.select(*by, "n", "improved", "unchanged", "regressed", "mean_delta", *(F.round(F.col(c) / F.col("n"), 6).alias(f"share_{c}") for c in ("improved", "unchanged", "regressed")))


def histogram(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """(by..., bin, n): rows by half-open bins between the edges, the last one closed; values outside and nulls do not count."""
    v, last = F.col(value), len(edges) - 2
    place = F.lit(None).cast("int")
    for k in range(last, -1, -1):
        inside = (v >= edges[k]) & ((v <= edges[k + 1]) if k == last else (v < edges[k + 1]))
        place = F.when(inside, k).otherwise(place)
    return df.withColumn("bin", place).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def crosstab_shares(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share): counts of each combination and their share of the row's."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(row)), 6))


def silent_band(n: Column, floor: float = 5e-4) -> Column:
    """Differences under this are none: half a case, at least the floor."""
    return F.when(n > 0, F.greatest(F.lit(floor), 0.5 / n)).otherwise(F.lit(floor))


def composition_drift(counts: DataFrame, other: DataFrame, by: list[str], worse: str, better: str, threshold: float = 0.10) -> DataFrame:
    """(by..., outcome, base, head, delta): shares of outcomes that moved to the worse by more than the threshold.

    counts: (by..., outcome, n). Groups that one side lacks have no rows.
    """

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = F.sum("n")
        part = lambda o: F.round(F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)) / total, 6).alias(o)
        return df.groupBy(*by).agg(part(worse), part(better)).unpivot(by, [worse, better], "outcome", name)

    both = shares(counts, "base").join(shares(other, "head"), [*by, "outcome"]).withColumn("delta", F.round(F.col("head") - F.col("base"), 6))
    return both.where(F.when(F.col("outcome") == worse, F.col("delta") > threshold).otherwise(F.col("delta") < -threshold))


def frontier_picks(df: DataFrame, cost: str, gain: str, lower: str, floor: float) -> DataFrame:
    """(pick, cost, gain): the cheapest row whose lower bound is above the floor, the cheapest whose gain is, the best gain of all."""
    row = F.struct(cost, gain)
    cheap = lambda c: F.min(F.when(F.col(c) > floor, row))
    best = df.agg(cheap(lower).alias("sweet_spot"), cheap(gain).alias("cheapest_above_floor"), F.max(F.struct(gain, (-F.col(cost)).alias("c"))).alias("m"))
    picks = best.select("sweet_spot", "cheapest_above_floor", F.struct((-F.col("m.c")).alias(cost), F.col(f"m.{gain}").alias(gain)).alias("ceiling"))
    names = ["sweet_spot", "cheapest_above_floor", "ceiling"]
    long = picks.select(F.explode(F.array(*(F.struct(F.lit(x).alias("pick"), F.col(x).alias("r")) for x in names))).alias("x"))
    return long.where("x.r is not null").select("x.pick", F.col(f"x.r.{cost}").alias(cost), F.col(f"x.r.{gain}").alias(gain))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null for under two rows and where one has a single value."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
