"""Health of chunk collections and overlap of queries with a held-out set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_grams, collapsed, ends_mid_sentence, jaccard
from ..plans.staging import BROADCAST_ROWS, staged
from .statistics import percentiles

NEAR_EMPTY = 50
# Fixed value: what a converter leaves where a table stood within a table.
NESTED_TABLE = r"\[중첩 테이블 #[0-9]+\]"


def chunk_health(df: DataFrame, by: list[str], text: str, doc: str) -> DataFrame:
    """(by..., chunks, documents, length percentiles, empty and near-empty counts, share of cut sentences, marks of nested tables)."""
    # Numbers first: the distinct count doubles the rows, which should not hold texts then.
    length = F.coalesce(F.length(text), F.lit(0))
    cut = F.when(length > 0, ends_mid_sentence(text).cast("double"))
    rows = df.select(*by, F.col(doc).alias("_doc"), length.alias("_length"), cut.alias("_cut"), F.coalesce(F.regexp_count(text, F.lit(NESTED_TABLE)), F.lit(0)).alias("_nested"))
    rows = staged(rows, "lengths")
    length = F.col("_length")
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.count_distinct("_doc").alias("documents"),
        F.max(length).alias("longest"),
        F.round(F.avg(length), 6).alias("mean"),
        F.count_if(length == 0).alias("empty"),
        F.count_if((length > 0) & (length < NEAR_EMPTY)).alias("near_empty"),
        F.round(F.avg("_cut"), 6).alias("mid_sentence_share"),
        F.sum("_nested").alias("nested_tables"),
    )
    cuts = percentiles(rows, by, "_length", (0.5, 0.95)).select(*(F.col(c).alias(f"_on_{c}") for c in by), "p50", "p95")
    return counted.join(cuts, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by]).select(*counted.columns, "p50", "p95")


def contaminated(queries: DataFrame, query: str, text: str, held_out: DataFrame, held_text: str, threshold: float = 0.70) -> DataFrame:
    """(query, similarity): queries whose trigrams overlap with those of a held-out text by the threshold or more, at their best.

    Prefix filter: two sets that overlap so much share one of the rarest n - ceil(threshold n) + 1 of either, so only these meet
    in a join, and only pairs that met are compared. Trigrams that no held-out text has are the rarest and lead nowhere. Texts
    that are equal but for case and white space count as 1, and so do blank ones.
    """
    q = queries.select(F.col(query).alias("q"), F.coalesce(F.lower(collapsed(text)), F.lit("")).alias("t"))
    h = held_out.where(F.col(held_text).isNotNull()).select(F.lower(collapsed(held_text)).alias("t")).distinct()
    blank = q.where("t = ''").select("q", F.lit(1.0).alias("similarity"))
    same = q.join(h, "t").select("q", F.lit(1.0).alias("similarity"))
    ours = staged(q.where("t != ''").select("q", char_grams("t").alias("g")), "query-grams").where(F.size("g") > 0)
    theirs = h.select(F.xxhash64("t").alias("h"), char_grams("t").alias("g")).where(F.size("g") > 0)
    held = theirs.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held

    def rarest(df: DataFrame, key: str) -> DataFrame:
        grams = df.select(key, F.size("g").alias("size"), F.explode("g").alias("x")).join(held, "x", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x")))
        lists = grams.groupBy(key, "size").agg(order.alias("o"))
        prefix = F.slice("o", 1, (F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1).cast("int"))
        return lists.select(key, F.explode(F.filter(prefix, lambda s: s["n"] > 0)).alias("s")).select(key, F.col("s.x").alias("x"))

    met = rarest(ours, "q").join(rarest(theirs, "h"), "x").select("q", "h").distinct()
    both = met.join(ours, "q").join(theirs.withColumnRenamed("g", "g2"), "h")
    near = both.select("q", jaccard("g", "g2").alias("similarity")).where(F.col("similarity") >= threshold)
    every = blank.unionAll(same).unionAll(near)
    return every.groupBy(F.col("q").alias(query)).agg(F.round(F.max("similarity"), 6).alias("similarity"))
