"""Turns in order: recent history, references to earlier turns, chains of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IMPLICIT_REFERENCES, contains_any
from ..plans.staging import staged

TURNS = 12


def recent_turns(df: DataFrame, by: list[str], order: list[str], value: str, n: int = TURNS) -> DataFrame:
    """Adds turn_no and recent: the last n values up to this turn, the oldest first; nulls are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    recent = F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))
    return df.withColumn("turn_no", F.row_number().over(w)).withColumn("recent", recent)


def resolved_references(df: DataFrame, by: list[str], order: list[str], text: str, entity: str) -> DataFrame:
    """Adds resolved_entity: a turn's own entity, else for a turn that refers back the last one named before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(entity, ignorenulls=True).over(w)
    return df.withColumn("resolved_entity", F.coalesce(entity, F.when(contains_any(text, IMPLICIT_REFERENCES), before)))


def chain_depth(df: DataFrame, key: str, parent: str, longest: int = 16) -> DataFrame:
    """(key, depth): steps from a row to the end of its chain of parents, at most `longest`; a parent that isn't there ends it.

    A key that repeats with several parents has the smallest. Pointers are doubled, so a chain of 16 takes four joins; rows on a cycle come out at `longest`.
    """
    rows = df.select(F.col(key).alias("k"), F.col(parent).alias("p")).groupBy("k").agg(F.min("p").alias("p"))
    known = rows.select(F.col("k").alias("pk"))
    links = rows.join(known, F.col("p") == F.col("pk"), "left").select("k", F.col("pk").alias("to"), F.when(F.col("pk").isNotNull(), 1).otherwise(0).alias("d"))
    links = staged(links, "chain")
    reach = 1
    while reach < longest:
        far = links.select(F.col("k").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        links = links.join(far, "to", "left").select("k", F.col("to2").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        links = staged(links, "chain")
        reach *= 2
    return links.select(F.col("k").alias(key), F.least("d", F.lit(longest)).alias("depth"))


def states(df: DataFrame, by: list[str], order: list[str], entity: str, confidence: str, n: int = TURNS, floor: float = 0.70) -> DataFrame:
    """Adds to each turn turn_no, active, context_entity and context_confidence: what the conversation is about by then.

    Entities named in the last n turns with a confidence of `floor` or more are active. The one named last is the context, with
    at least .85, or at most .65 where several are active.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    recent = w.rowsBetween(-(n - 1), 0)
    sure = F.when(F.col(confidence) >= floor, F.col(entity))
    active = F.size(F.array_distinct(F.collect_list(sure).over(recent)))  # at most n
    last, known = F.last(sure, ignorenulls=True).over(recent), F.last(F.when(sure.isNotNull(), F.col(confidence)), ignorenulls=True).over(recent)
    out = df.withColumn("turn_no", F.row_number().over(w)).withColumn("active", active).withColumn("context_entity", last).withColumn("_c", known)
    level = F.when(F.col("active") > 1, F.least(F.col("_c"), F.lit(0.65))).when(F.col("active") == 1, F.greatest(F.col("_c"), F.lit(0.85)))
    return out.withColumn("context_confidence", level).drop("_c")
