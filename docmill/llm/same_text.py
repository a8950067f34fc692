"""Problem 1: texts that print alike in different characters.

Method: Arrow text is copied to numpy code-point arrays; lookup tables, expansion offsets and vectorised composition
(canonical.py) bring it to one form. Equal prints are equal strings then, so pairs come from joins on a digest of the form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import small, staged
from .columns import canonical_text

#: Tasks over which the copies of one spelling are spread.
SALTS = 16


def canonical_rows(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(tbl, id, text): every text of the named tables, given as (table, id column, text column), in the one form.

    Null texts stay null; blank and invisible ones become ''. Ids are taken as they are, repeated rows stay.
    """
    parts = [
        df.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
        for name, (df, key, text) in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts).withColumn("text", canonical_text("text"))


def same_print_pairs(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(tbl, id_a, id_b): pairs of rows of one table whose stored texts differ and print alike; id_a < id_b.

    A pair comes once, however often its rows repeat. Null and blank texts have no pairs; nor have exact copies of each other,
    of which each pairs with every other spelling. Spellings are paired before rows are, and a spelling's copies are salted.
    """
    parts = [
        df.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("stored"))
        for name, (df, key, text) in tables.items()
    ]
    # Table and text in one digest, so that what is joined holds nothing but digests and ids.
    digest = lambda c: F.unhex(F.md5(F.concat("tbl", F.lit("\0"), F.col(c))))
    rows = (
        reduce(DataFrame.unionAll, parts)
        .where(F.col("stored").isNotNull())
        .withColumn("form", canonical_text("stored"))
        .where("form != ''")
        .select("tbl", "id", digest("form").alias("form"), digest("stored").alias("stored"))
    )
    rows = staged(rows, "p1-digests")
    spellings = rows.groupBy("form", "stored").agg(F.count("*").alias("copies"))
    several = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    spellings = spellings.join(several, "form", "left_semi")
    a, b = (spellings.select("form", F.struct("copies", "stored").alias(c)) for c in "ab")
    # Of two spellings, a is the one with more copies.
    pairs = staged(a.join(b, "form").where("a > b").select(F.col("a.stored").alias("a"), F.col("b.stored").alias("b")), "p1-spellings")
    # Only rows of such spellings go on; to find them a list of spellings is sent out if it is short.
    spelled = small(staged(pairs.select(F.explode(F.array("a", "b")).alias("stored")).distinct(), "p1-spelled"))
    own = rows.select("tbl", "id", "stored").join(spelled, "stored", "left_semi")
    many = own.select("tbl", F.col("stored").alias("a"), F.col("id").alias("x")).join(pairs, "a")
    few = own.select(F.col("stored").alias("b"), F.col("id").alias("y")).join(pairs, "b")
    # A spelling's many copies are spread over SALTS tasks, each of which sees all of the fewer ones.
    many = many.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = many.join(few, ["a", "b", "salt"]).where("x != y")
    return met.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
