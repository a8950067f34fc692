"""Queries read for what they ask, evidence held against it: topics, documents, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPARISON_CUES, contains_any, tokens
from .matching import GENERIC, REDUCED, STRICT

# Floors of a verdict.
LEAST_SCORE, LEAST_MATCHED, LEAST_SHARE, AMBIGUOUS = 0.18, 2, 0.5, 0.05
TOPICS = 8


def query_topics(text: str | Column, most: int = TOPICS) -> Column:
    """The first few words of a query that can be looked for: two characters or more, none that every tender has."""
    words = F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*GENERIC) & ~t.startswith("기관"))
    return F.slice(F.array_distinct(words), 1, most)


def requested_agencies(text: str | Column) -> Column:
    """Agencies that a query names as 기관 X, in order, X in capitals if it is Latin."""
    text = F.col(text) if isinstance(text, str) else text
    names = F.regexp_extract_all(text, F.lit("기관[ \\t]*([A-Za-z0-9]+|[가-힣]+)"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda n: F.concat(F.lit("기관 "), F.when(n.rlike("^[A-Za-z0-9]+$"), F.upper(n)).otherwise(n))))


def document_matches(matches: DataFrame, query: str, docs: DataFrame, doc: str, fields: tuple[str, ...]) -> DataFrame:
    """(query, doc, confidence, stage): the documents that bear a matched value, with the surest match of each.

    stage: strict or reduced by the confidence, null under both floors.
    """
    bears = docs.where(F.col(doc).isNotNull()).select(F.col(doc), *(F.col(f).cast("string") for f in fields)).unpivot([doc], list(fields), "field", "value")
    bears = bears.where("value is not null").withColumn("value", F.trim("value")).distinct()
    best = matches.join(bears, ["field", "value"]).groupBy(query, doc).agg(F.max("confidence").alias("confidence"))
    stage = F.when(F.col("confidence") >= STRICT, "strict").when(F.col("confidence") >= REDUCED, "reduced")
    return best.withColumn("stage", stage)


def ambiguity(found: DataFrame, query: str, doc: str, within: float = AMBIGUOUS) -> DataFrame:
    """(query, top_score, candidates, ambiguous): how many documents are matched nearly as surely as the best one; from `document_matches`."""
    kept = found.where(F.col("confidence") >= REDUCED).withColumn("top_score", F.max("confidence").over(Window.partitionBy(query)))
    near = F.count_if(F.col("confidence") >= F.col("top_score") - within - 1e-9)
    return kept.groupBy(query, "top_score").agg(near.alias("candidates")).withColumn("ambiguous", F.col("candidates") > 1)


def filters(found: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, stage, doc): the documents that a search is kept to at each stage; the reduced ones hold the strict ones too."""
    strict = found.where(F.col("confidence") >= STRICT).select(query, F.lit("strict").alias("stage"), doc)
    return strict.unionAll(found.where(F.col("confidence") >= REDUCED).select(query, F.lit("reduced").alias("stage"), doc))


def stage_sequence(found: DataFrame, query: str, queries: DataFrame) -> DataFrame:
    """(query, stage, attempt): the stages that each query's search goes through; reduced only where it has more documents than strict."""
    counts = found.groupBy(query).agg(F.count_if(F.col("confidence") >= STRICT).alias("_s"), F.count_if(F.col("confidence") >= REDUCED).alias("_r"))
    n = queries.select(query).distinct().join(counts, query, "left").na.fill(0, ["_s", "_r"])
    every = F.array(F.when(F.col("_s") > 0, F.lit("strict")), F.when(F.col("_r") > F.col("_s"), F.lit("reduced")), F.lit("relaxed"))
    return n.select(query, F.posexplode(F.array_compact(every)).alias("attempt", "stage")).withColumn("attempt", F.col("attempt") + 1)


def verify(evidence: DataFrame, by: list[str], score: str, text: str, topics: str, partial: str | None = None, target: str | None = None) -> DataFrame:
    """(by..., n, top_score, topics, matched, verified, reason): whether evidence is good enough and speaks of all that is asked.

    The best score must reach LEAST_SCORE and every topic stand in some row's text. Where `partial` is true (a last attempt), two
    topics and half of them are enough, counted in rows where `target` is true, if there are any for the whole. Topics are looked
    for row by row, so no group's texts are put together. A group without topics needs the score alone.
    """
    rows = evidence.withColumn("_x", F.lower(text)).withColumn("_t", F.explode_outer(topics))
    said = F.coalesce(F.col("_x").contains(F.lower("_t")), F.lit(False))
    aimed = F.col(target) if target else F.lit(True)
    per = rows.groupBy(*by, "_t").agg(
        F.max(said).alias("_m"), F.max(said & aimed).alias("_a"), F.count("*").alias("_n"), F.max(score).alias("_s"), F.max(F.col(partial) if partial else F.lit(False)).alias("_p"),
    )
    out = per.groupBy(*by).agg(
        F.max("_n").alias("n"), F.max("_s").alias("top_score"), F.count("_t").cast("int").alias("topics"), F.count_if(F.col("_m") & F.col("_t").isNotNull()).cast("int").alias("matched"),
        F.count_if(F.col("_a") & F.col("_t").isNotNull()).alias("_aimed"), F.max("_p").alias("_p"),
    )
    low, whole = F.coalesce(F.col("top_score") < LEAST_SCORE, F.lit(True)), F.col("matched") >= F.col("topics")
    some = F.col("_p") & (F.col("_aimed") >= LEAST_MATCHED) & (F.col("_aimed") >= LEAST_SHARE * F.col("topics"))
    reason = F.when(low, "low_top_score").when(whole, "grounded").when(some, "partial_topic_grounding").otherwise("topic_not_grounded")
    return out.withColumn("reason", reason).withColumn("verified", ~low & (whole | some)).drop("_aimed", "_p")


def supporting(evidence: DataFrame, by: list[str], order: list[Column], text: str, topics: str, n: int = 2) -> DataFrame:
    """The first n rows of each group that speak of a topic, of all rows where none does or nothing is asked."""
    speaks = (F.size(topics) == 0) | F.exists(topics, lambda t: F.lower(text).contains(F.lower(t)))
    marked = evidence.withColumn("_speaks", F.coalesce(speaks, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_speaks").desc(), *order))
    some = F.max("_speaks").over(Window.partitionBy(*by))
    kept = marked.withColumn("_k", place).withColumn("_some", some).where((F.col("_k") <= n) & (F.col("_speaks") | ~F.col("_some")))
    return kept.drop("_speaks", "_k", "_some")


def query_kind(text: str | Column, agencies: Column, context: Column | None = None) -> Column:
    """comparison where a query compares or joins several agencies, follow_up where it rests on its context, else single_doc."""
    compares = contains_any(text, COMPARISON_CUES) | ((agencies > 1) & contains_any(text, ("와", "과", "및", ",", "/")))
    kind = F.when(compares, "comparison")
    return (kind.when(context, "follow_up") if context is not None else kind).otherwise("single_doc")
