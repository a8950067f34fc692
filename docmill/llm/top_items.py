"""Problem 4: the N best items of every group, with a fixed order among equal scores.

Method: partition lower bounds. The N-th best score that one partition finds in a group bounds the group's N-th best from
below; the highest such bound of each group is joined to the rows, rows under it are filtered, the survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import BROADCAST_ROWS, staged

#: A hot group's rows meet their bound in so many tasks.
SALTS = 16
#: Rows that a task holds at most while it looks for bounds.
HELD = 1 << 18


def _local_bounds(names: list[str], n: int, held: int = HELD):
    """Per stretch of a partition: each group's n-th best score, of the groups that have n rows there.

    A stretch ends where more than `held` rows would have to be kept; a bound that a stretch gives holds for the whole table,
    and a group that gets none is only filtered less.
    """

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []

        def best() -> tuple[pd.DataFrame, pd.Series]:
            rows = pd.concat(parts, ignore_index=True).sort_values("score", ascending=False, kind="stable")
            place = rows.groupby(names, sort=False).cumcount()
            return rows[place < n], place[place < n]

        size = kept = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, held):
                part = batch.slice(lo, held)
                parts.append(part.to_pandas())
                size += part.num_rows
                if size <= max(2 * kept, held // 4):
                    continue
                rows, place = best()
                if len(rows) > held // 2:
                    yield pa.RecordBatch.from_pandas(rows[place == n - 1], preserve_index=False)
                    parts, size, kept = [], 0, 0
                else:
                    parts, size, kept = [rows], len(rows), len(rows)
        if parts:
            rows, place = best()
            yield pa.RecordBatch.from_pandas(rows[place == n - 1], preserve_index=False)

    return bounds


def top_items(df: DataFrame, groups: list[str], score: str, tie: str, n: int, same: list[str] | None = None) -> DataFrame:
    """(groups..., tie): the n rows of each group with the highest score, equal scores by the smaller tie column.

    Rows with a null in a group column, or a null or NaN score, do not count. Rows equal in the `same` columns (null equals
    null) count once, as the one with the smallest `tie`. Rows that repeat a tie value as well stand in no fixed order among
    themselves. Groups of fewer than n rows come out whole; an empty table gives an empty result.
    """
    g = [f"g{i}" for i in range(len(groups))]
    s = [f"s{i}" for i in range(len(same or []))]
    rows = df.select(
        *(F.col(c).alias(a) for c, a in zip(groups, g, strict=True)),
        *(F.col(c).alias(a) for c, a in zip(same or [], s, strict=True)),
        F.col(tie).alias("tie"),
        F.col(score).cast("double").alias("score"),
    ).where(" and ".join(f"{c} is not null" for c in [*g, "score"]) + " and not isnan(score)")
    if same:
        # The shuffle on `same` also spreads every group evenly over the partitions that set the bounds.
        rows = rows.groupBy(*s).agg(F.min(F.struct("tie", "score", *g)).alias("r")).select("r.*")
        rows = staged(rows.select(*g, "tie", "score"), "p4-rows")
    rows = rows.select(*g, "tie", "score")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in g)
    local = rows.select(*g, "score").mapInArrow(_local_bounds(g, n), f"{kinds}, score double")
    bounds = staged(local.groupBy(*g).agg(F.max("score").alias("bound")), "p4-bounds")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS)).cast("int"))
    if bounds.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(bounds), g, "left")
    else:
        met = rows.join(bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*g, "salt"], "left")
    survivors = met.where("bound is null or score >= bound")
    best_first = [F.col("score").desc(), F.col("tie").asc()]
    part = Window.partitionBy(*g, "salt").orderBy(*best_first)
    whole = Window.partitionBy(*g).orderBy(*best_first)
    return (
        survivors.withColumn("k", F.row_number().over(part))
        .where(F.col("k") <= n)
        .withColumn("k", F.row_number().over(whole))
        .where(F.col("k") <= n)
        .select(*(F.col(a).alias(c) for a, c in zip(g, groups, strict=True)), F.col("tie").alias(tie))
    )
