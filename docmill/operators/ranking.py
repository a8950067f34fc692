"""Ranks, top k, fusion and coverage as window functions. What keeps k rows a group is salted; what ranks all rows sorts each group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, tie: str, rank: str = "rank", salts: int = 32) -> DataFrame:
    """The first k rows of each group with their rank from 1; `tie` spreads a group over tasks that each keep k of it.

    `order` should end in something unique. Null groups are a group of their own.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= k).drop("_k", "_salt")
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)


def reciprocal_rank_fusion(df: DataFrame, by: list[str], item: str, channels: list[str], k: int = 60) -> DataFrame:
    """Adds rrf: the channels' 1 / (k + rank), rank from 0 by score and then item, both descending; 1 is the best possible.

    Channels count rounded to 4 digits, null as 0. A row stands for one item of its group.
    """
    total = F.lit(0.0)
    for c in channels:
        w = Window.partitionBy(*by).orderBy(F.round(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 4).desc(), F.col(item).desc())
        total = total + 1.0 / (k + F.row_number().over(w) - 1)
    return df.withColumn("rrf", F.round(total * k / len(channels), 6))


def balanced_top_k(df: DataFrame, by: list[str], target: str, targets: list[str], score: str, tie: str, k: int, min_per_target: int = 1, salts: int = 32) -> DataFrame:
    """The k best rows of each group, of which every target has min_per_target (at most k // targets) if it has them.

    Result order: score, then rows chosen for their target in the order of `targets`, then `tie`; as column rank.
    """
    least = min(max(1, min_per_target), max(1, k // max(1, len(targets))))
    at = F.array_position(F.array(*map(F.lit, targets)), F.col(target))
    best = [F.col(score).desc_nulls_last(), F.col(tie).asc()]
    # A first pass by salt leaves what can be among a group's k or a target's first ones.
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    of_all, of_target = (F.row_number().over(Window.partitionBy(*by, *more, "_salt").orderBy(*best)) for more in ([], [target]))
    df = salted.withColumn("_a", of_all).withColumn("_b", of_target).where((F.col("_a") <= k) | (F.col("_b") <= least)).drop("_salt", "_a", "_b")
    place = F.row_number().over(Window.partitionBy(*by, target).orderBy(*best))
    df = df.withColumn("_first", F.when((at > 0) & (place <= least), 0).otherwise(1)).withColumn("_at", F.when(F.col("_first") == 0, at).otherwise(0))
    chosen = F.row_number().over(Window.partitionBy(*by).orderBy("_first", F.col(score).desc_nulls_last(), "_at", tie))
    df = df.withColumn("_k", chosen).where(F.col("_k") <= k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), "_first", "_at", tie))
    return df.withColumn("rank", rank).drop("_first", "_at", "_k")


def reassembled_parents(hits: DataFrame, by: list[str], parent: str, chunk: str, score: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Best hit of each parent section, with the ids of all its hits and the parent's columns (null where it is missing)."""
    best = hits.groupBy(*by, parent).agg(
        F.max(F.struct(F.col(score).alias("s"), F.col(chunk).alias("c"))).alias("_best"),
        F.count("*").alias("n_hits"),
    )
    best = best.select(*by, parent, F.col("_best.s").alias("score"), F.col("_best.c").alias("best_chunk"), "n_hits")
    joined = best.join(parents.withColumnRenamed(parent_key, "_key"), F.col(parent) == F.col("_key"), "left")
    return joined.withColumn("parent_missing", F.col("_key").isNull()).drop("_key")


def reranked(df: DataFrame, by: list[str], score: str, tie: str, rescore: Column, n: int = 30) -> DataFrame:
    """Rows of each group in a new order: the first n by `rescore`, the rest after them as they were; as column rank."""
    before = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie))
    df = df.withColumn("_before", before)
    head = F.when(F.col("_before") <= n, rescore)
    order = [(F.col("_before") <= n).desc(), head.desc_nulls_last(), F.col("_before")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("_before")
