"""Lexical and dense search of a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import unit_hash
from ..functions.vectors import bigram_features, feature_sign, feature_slot
from ..plans.staging import small, staged
from .ranking import top_k

K1, B = 1.5, 0.75
#: Queries that are sent to the tasks at once; rows and queries that are multiplied at once.
QUERY_BLOCK, QUERY_SLICE, ROW_SLICE = 4096, 512, 2048


class SearchIndex(NamedTuple):
    """What lexical searches read: postings of all documents, and how many there are and how long on average."""

    postings: DataFrame  # doc, n, term, tf
    corpus: DataFrame  # docs, avg_n: one row


def search_index(docs: DataFrame, doc: str, tokens: str, folder: str | None = None) -> SearchIndex:
    """The index of all documents, for many searches; written to `folder`, else staged. Null token lists are empty."""
    sizes = docs.select(F.col(doc).alias("doc"), F.coalesce(F.size(tokens), F.lit(0)).alias("n"), F.col(tokens).alias("tokens"))
    corpus = sizes.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"))
    # The terms of a document are counted where it stands; the shuffle brings those of a term together.
    postings = sizes.select("doc", "n", F.explode("tokens").alias("term")).groupBy("doc", "n", "term").agg(F.count("*").alias("tf"))
    if folder is None:
        return SearchIndex(staged(postings, "postings"), staged(corpus, "corpus"))
    postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    corpus.write.mode("overwrite").parquet(f"{folder}/corpus")
    return read_search_index(docs.sparkSession, folder)


def read_search_index(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/corpus"))


def bm25(index: SearchIndex | DataFrame, doc: str, doc_tokens: str, queries: DataFrame, query: str, query_tokens: str, k: int | None) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query, all that score without k; ties go to the smaller doc.

    The documents come as an index, or as a table whose tokens are read once and not kept. Terms of a query count once.
    Statistics cover all documents. Only postings of the queries' terms are read on: a filter in front of the shuffle, by
    broadcast if they are few. Queries without a known term have no rows.
    """
    terms = queries.select(F.col(query), F.explode(F.array_distinct(query_tokens)).alias("term"))
    asked = small(staged(terms.select("term").distinct(), "asked"))
    if isinstance(index, SearchIndex):
        tf, corpus = index.postings.join(asked, "term", "left_semi"), index.corpus
    else:
        sizes = index.select(F.col(doc).alias("doc"), F.coalesce(F.size(doc_tokens), F.lit(0)).alias("n"), F.col(doc_tokens).alias("tokens"))
        # One row of sizes a document stands beside its asked terms, so tokens are made once.
        said = sizes.select("doc", "n", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("tokens", F.array().cast("array<string>")))).alias("term"))
        said = said.join(asked.withColumn("known", F.lit(True)), "term", "left").where("term is null or known")
        tf = staged(said.groupBy("doc", "n", "term").agg(F.count("*").alias("tf")), "postings")
        corpus = tf.where("term is null").agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"))
        tf = tf.where("term is not null")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").crossJoin(F.broadcast(corpus))  # one row: the corpus
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select(query, "term", idf.alias("idf"), "avg_n")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    scored = tf.join(weights, "term").groupBy(query, "doc").agg(F.round(F.sum(part), 6).alias("score"))
    if k is None:
        return scored.select(query, F.col("doc").alias(doc), "score")
    best = top_k(scored, [query], [F.col("score").desc(), F.col("doc").asc()], k, tie="doc")
    return best.select(query, F.col("doc").alias(doc), "score", "rank")


def hashed_features(df: DataFrame, key: str, tokens: str, dim: int = 384) -> DataFrame:
    """(key, slot, weight): signed feature hashing of tokens and bigrams, of length 1; only slots that aren't 0."""
    features = df.select(F.col(key), F.explode(bigram_features(tokens)).alias("f"))
    slots = features.groupBy(key, feature_slot(F.col("f"), dim).alias("slot")).agg(F.sum(feature_sign(F.col("f"))).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return slots.where("w != 0").select(key, "slot", (F.col("w") / length).alias("weight"))


def _best(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller key; sorts only what can be among them."""
    if score.shape[1] > 4 * k:
        floor = np.partition(score, -k, axis=1)[:, -k].min()  # no row loses one of its k best
        some = (score >= floor).any(axis=0)
        if some.sum() < score.shape[1]:
            score, keys = score[:, some], keys[:, some]
    order = np.lexsort((keys, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)


def dense_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, score, rank): the k rows with the highest cosine to each query, ties to the smaller key.

    Queries go to the tasks in blocks of bounded size, one scan of the rows each; with several blocks each one's result is
    written and its queries are let go before the next. A task multiplies slices of rows and queries and keeps k rows a query.
    Null vectors and vectors of length 0 have no cosine and do not count; vectors of another length raise.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query).cast("bigint").alias("q"), F.col(query_vector).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(ids) // QUERY_SLICE)
            for whole in batches:
                for lo in range(0, whole.num_rows, ROW_SLICE):
                    batch = whole.slice(lo, ROW_SLICE)
                    keys = batch.column(0).to_numpy()
                    x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    size = np.linalg.norm(x, axis=1)
                    keys, x = keys[size > 0], x[size > 0] / size[size > 0, None]
                    for s in range(len(best)):
                        score = np.round(matrix[s * QUERY_SLICE : (s + 1) * QUERY_SLICE] @ x.T, 6)
                        own = np.broadcast_to(keys, score.shape)
                        if best[s] is not None:
                            score, own = np.hstack([best[s][0], score]), np.hstack([best[s][1], own])
                        best[s] = _best(score, own, k)
            for s, found in enumerate(best):
                if found is not None:
                    part = ids[s * QUERY_SLICE : (s + 1) * QUERY_SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, found[0].shape[1])), pa.array(found[1].ravel()), pa.array(found[0].ravel())], ["q", "k", "score"])

        return run

    parts = []
    for i in range(blocks):
        own = asked.where(F.col("block") == i).select("q", "v").collect()  # at most about `block` queries
        if not own:
            continue
        matrix = np.array([r["v"] for r in own], float)
        size = np.linalg.norm(matrix, axis=1)
        ids = np.array([r["q"] for r in own], np.int64)[size > 0]
        shared = spark.sparkContext.broadcast((ids, matrix[size > 0] / size[size > 0, None]))
        found = top_k(rows.mapInArrow(search(shared), "q bigint, k bigint, score double"), ["q"], [F.col("score").desc(), F.col("k").asc()], k, tie="k")
        if blocks > 1:
            found = staged(found, "dense")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "q bigint, k bigint, score double, rank int").toDF(query, key, "score", "rank")
    return reduce(DataFrame.unionAll, parts).select(F.col("q").alias(query), F.col("k").alias(key), "score", "rank")


def lexical_similarity(query_tokens: Column, topics: Column, text: Column, tokens: Column) -> Column:
    """Share of the query's tokens in the chunk (0.55) and of its topics in the chunk's text (0.45)."""
    overlap = F.size(F.array_intersect(query_tokens, tokens)) / F.greatest(F.lit(1), F.size(F.array_distinct(query_tokens)))
    hits = F.size(F.filter(topics, lambda t: F.lower(text).contains(F.lower(t)))) / F.greatest(F.lit(1), F.size(topics))
    return F.when((F.size(query_tokens) == 0) & (F.size(topics) == 0), 0.0).otherwise(F.least(F.lit(1.0), 0.55 * overlap + 0.45 * hits))


def combined_score(dense: Column, lexical: Column, metadata: Column | None = None, rerank: bool = True) -> Column:
    """Dense alone without reranking; .70 dense + .30 lexical; with metadata .60, .25 and .15; rounded to 4 digits."""
    if not rerank:
        score = dense
    elif metadata is None:
        score = 0.70 * dense + 0.30 * lexical
    else:
        score = 0.60 * dense + 0.25 * lexical + 0.15 * metadata
    return F.round(score, 4)


def random_score(query: Column, chunk: Column) -> Column:
    """[0, 1) that depends on query and chunk alone."""
    return unit_hash(F.concat(query, F.lit("\0"), chunk))


def filtered_or_all(df: DataFrame, doc_ids: list[str] | None = None, agencies: list[str] | None = None, projects: list[str] | None = None) -> DataFrame:
    """Rows of the documents, else rows of an agency or project; all rows without a filter or where none is left."""
    if doc_ids:
        kept = df.where(F.col("doc_id").isin(doc_ids))
    elif agencies or projects:
        kept = df.where(F.col("agency").isin(agencies or []) | F.col("project").isin(projects or []))
    else:
        return df.withColumn("fallback_used", F.lit(False))
    return df.withColumn("fallback_used", F.lit(True)) if kept.isEmpty() else kept.withColumn("fallback_used", F.lit(False))


def hard_negatives(ranked: DataFrame, query: str, doc: str, own_doc: str, first: int, last: int, n: int) -> DataFrame:
    """n rows a query from the given ranks, of other documents than its own; drawn by a hash, alike on any run."""
    pool = ranked.where(F.col("rank").between(first, last) & (F.col(doc) != F.col(own_doc)))
    draw = unit_hash(F.concat_ws("|", F.col(query).cast("string"), F.col(doc).cast("string")))
    place = F.row_number().over(Window.partitionBy(query).orderBy(draw, doc, "rank"))
    return pool.withColumn("draw", place).where(F.col("draw") <= n)


def counts_length(tokens: Column) -> Column:
    """Euclidean length of a list's word counts; an m-th repeat adds 2m - 1 to the sum of squares."""
    zero = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["w"].eqNullSafe(w), s["run"] + 1).otherwise(0)
        return F.struct(w.alias("w"), run.alias("run"), (s["sum"] + 2 * run + 1).alias("sum"))

    return F.sqrt(F.aggregate(F.array_sort(tokens), zero, step)["sum"].cast("double"))


def shared_words(queries: DataFrame, query: str, query_tokens: str, docs: DataFrame, doc: str, doc_tokens: str) -> DataFrame:
    """(query, doc, overlap, cosine): of pairs with a word in common, the share of the query's words that the document has, and the cosine of their counts.

    Only words of a query leave the scan of the documents, each document's length goes with them.
    """
    # Lengths in a step of their own: beside an explode they would be taken for every word.
    ours = queries.select(query, F.size(F.array_distinct(query_tokens)).alias("_words"), counts_length(F.col(query_tokens)).alias("_q"), F.col(query_tokens).alias("_t"))
    ours = ours.select(query, "_words", "_q", F.explode("_t").alias("w"))
    ours = staged(ours.groupBy(query, "_words", "_q", "w").agg(F.count("*").alias("a")), "asked-words")
    asked = small(staged(ours.select("w").distinct(), "asked"))
    said = docs.select(doc, counts_length(F.col(doc_tokens)).alias("_s"), F.col(doc_tokens).alias("_t"))
    said = said.select(doc, "_s", F.explode("_t").alias("w")).join(asked, "w", "left_semi")
    theirs = said.groupBy(doc, "_s", "w").agg(F.count("*").alias("b"))
    met = theirs.join(ours, "w").groupBy(query, doc, "_words", "_q", "_s").agg(F.sum(F.col("a") * F.col("b")).alias("_d"), F.count("*").alias("_n"))
    return met.select(query, doc, (F.col("_n") / F.col("_words")).alias("overlap"), (F.col("_d") / (F.col("_q") * F.col("_s"))).alias("cosine"))


def at_keys(vectors: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted keys only; raises when read if one isn't there."""
    keys = wanted.select(F.col(key).alias("_k")).distinct()
    found = keys.join(vectors, F.col("_k") == F.col(key), "left")
    there = F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit("no row with key "), F.col("_k").cast("string")))).otherwise(F.col(key))
    return found.select(there.alias(key), *(c for c in vectors.columns if c != key))


def candidates(found: DataFrame, query: str, stages: DataFrame, docs: DataFrame, doc: str, row: str) -> DataFrame:
    """(query, stage, attempt, rows, kept, fallback): how many rows a search looks at in each stage; all of them where a filter leaves none."""
    per = docs.groupBy(doc).agg(F.count(row).alias("_n"))
    kept = found.join(per, doc).groupBy(query, "stage").agg(F.sum("_n").alias("kept"))
    total = docs.agg(F.count(row).alias("rows"))
    out = stages.join(kept, [query, "stage"], "left").crossJoin(F.broadcast(total))  # one row of the total
    filtered = F.coalesce("kept", F.lit(0)) > 0
    return out.select(query, "stage", "attempt", F.when(filtered, F.col("kept")).otherwise(F.col("rows")).alias("rows"), (~filtered & (F.col("stage") != "relaxed")).alias("fallback"))


def at_stages(rows: DataFrame, query: str, doc: str, stages: DataFrame, allowed: DataFrame) -> DataFrame:
    """rows once for every stage that their query's search goes through, with stage and attempt.

    A stage keeps to its allowed documents, to all where none of them has a row.
    """
    inside = rows.join(allowed, [query, doc])
    reached = inside.select(query, "stage").distinct()
    free = stages.join(reached, [query, "stage"], "left_anti")
    whole = rows.join(free, query)
    kept = inside.join(stages, [query, "stage"])
    return kept.select(*rows.columns, "stage", "attempt").unionAll(whole.select(*rows.columns, "stage", "attempt"))


def within_reach(rows: DataFrame, by: list[str], score: str, k: Column, gain: float, tie: str, most: int) -> DataFrame:
    """Rows that can be among the first k of their group once each score has grown by 0 up to `gain`; k is at most `most`.

    The k-th best score as it is bounds the k-th best later one from below, so a row further than `gain` under it is out.
    """
    best = top_k(rows.withColumn("_want", k), by, [F.col(score).desc(), F.col(tie)], most, tie)
    floor = best.groupBy(*by).agg(F.min(F.when(F.col("rank") == F.col("_want"), F.col(score))).alias("_floor"))
    return rows.join(floor, by).where(F.col("_floor").isNull() | (F.col(score) + gain >= F.col("_floor"))).drop("_floor")


def staged_search(scored: DataFrame, query: str, row: str, score: str, first_k: int, later_k: int) -> DataFrame:
    """scored with rank: the best rows of every stage; the first attempt takes first_k rows, later ones later_k at least."""
    k = F.when(F.col("attempt") == 1, first_k).otherwise(max(first_k, later_k))
    best = top_k(scored, [query, "stage"], [F.col(score).desc(), F.col(row)], max(first_k, later_k), row)
    return best.where(F.col("rank") <= k)


def first_verified(verdicts: DataFrame, query: str) -> DataFrame:
    """(query, stage, attempt, verified, reason, retries): the first attempt that was verified, else the last one."""
    order = F.struct((~F.col("verified")).alias("a"), F.when(F.col("verified"), F.col("attempt")).otherwise(-F.col("attempt")).alias("b"))
    best = verdicts.groupBy(query).agg(F.min_by(F.struct("stage", "attempt", "verified", "reason"), order).alias("_b"))
    return best.select(query, "_b.*", (F.col("_b.attempt") - 1).alias("retries"))


def cross_score(raw: Column, sigmoid: bool = True) -> Column:
    """A rescorer's output within [0, 1]: by the logistic function, else cut off; null and NaN are 0."""
    x = F.coalesce(F.nanvl(raw.cast("double"), F.lit(0.0)), F.lit(0.0)) if not sigmoid else raw.cast("double")
    if not sigmoid:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(1 / (1 + F.exp(-x)))
