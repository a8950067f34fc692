"""Retrieval and answer metrics by case, and their aggregates by run and slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PARTICLES, TOKEN, compact, folded, strip

# Categories of failures, in the order in which they are looked for.
FAILURES = (
    "verifier_false_negative",
    "verifier_false_positive",
    "retrieval_miss",
    "planner_under_decomposition",
    "generator_hallucination",
    "context_dilution",
    "unknown",
)


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the gold items within the first k; null without gold, 0 for nothing retrieved."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) / F.size(F.array_distinct(gold)))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 / rank of the first gold item, 0 if there is none among the ranked; null without gold."""
    at = F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull()))
    return F.when(F.size(gold) > 0, F.coalesce(1.0 / at, F.lit(0.0)))


def ndcg_at(ranked: Column, gold: Column, k: int) -> Column:
    """Binary gain over the ideal order, discounted by log2; null without gold."""
    gains = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(gold)), F.lit(k))), lambda i: 1.0 / F.log2(i + 1.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(gold) > 0, total(gains) / total(ideal))


def ranking_metrics(df: DataFrame, ranked: str, gold: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Adds recall@k for each k, mrr and ndcg@10 of the ranked ids against the gold ids."""
    r, g = F.col(ranked), F.col(gold)
    for k in ks:
        df = df.withColumn(f"recall_at_{k}", recall_at(r, g, k))
    return df.withColumn("mrr", reciprocal_rank(r, g)).withColumn("ndcg_at_10", ndcg_at(r, g, 10))


def ranked_metrics(df: DataFrame, by: list[str], item: str, rank: str, gold: DataFrame, gold_by: list[str], ks: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """(by..., recall_at_k..., mrr, ndcg_at_depth) of rows that have a rank from 1, against (gold_by..., item); no lists are gathered.

    Groups without gold have no row; those that found none of it have zeros.
    """
    wanted = gold.select(*gold_by, item).distinct()
    sizes = wanted.groupBy(*gold_by).agg(F.count("*").alias("_n"))
    groups = df.select(*by).distinct().join(sizes, gold_by)
    hits = df.join(wanted, [*gold_by, item], "left_semi")
    gain = F.sum(F.when(F.col(rank) <= depth, 1.0 / F.log2(F.col(rank) + 1.0)))
    found = hits.groupBy(*by).agg(*(F.count_if(F.col(rank) <= k).alias(f"_{k}") for k in ks), F.min(rank).alias("_first"), gain.alias("_gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = groups.join(found, by, "left")
    recalls = [(F.coalesce(f"_{k}", F.lit(0)) / F.col("_n")).alias(f"recall_at_{k}") for k in ks]
    return out.select(*by, *recalls, F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"), (F.coalesce("_gain", F.lit(0.0)) / ideal).alias(f"ndcg_at_{depth}"))


def bag_scores(left: DataFrame, right: DataFrame, key: str, items: str) -> DataFrame:
    """(key, common, n_left, n_right, precision, recall, f1) of two multisets of array elements by key, repeats counted."""
    count = lambda df, n: df.select(key, F.explode(items).alias("x")).groupBy(key, "x").agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), [key, "x"], "full_outer").na.fill(0, ["l", "r"])
    sums = both.groupBy(key).agg(F.sum(F.least("l", "r")).alias("common"), F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    p, r = F.try_divide("common", "n_left"), F.try_divide("common", "n_right")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return sums.select(key, "common", "n_left", "n_right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)


def failed(answerable: Column, accuracy: Column, abstained: Column, evidence: Column) -> Column:
    """An answerable case without full accuracy; another that isn't an abstention without evidence."""
    return F.when(answerable, ~F.coalesce(accuracy == 1.0, F.lit(False))).otherwise(~(abstained & (F.size(evidence) == 0)))


def failure_category(answerable: Column, accuracy: Column, abstained: Column, evidence: Column, expected: Column, term_match: Column, query_type: Column, attempts: Column, alignment: Column) -> Column:
    """The first category that fits a failed case; null for the others."""
    first = (
        F.when(~answerable & ~abstained, FAILURES[0])
        .when(answerable & abstained & term_match, FAILURES[1])
        .when(answerable & (F.size(expected) > 0) & ~F.arrays_overlap(expected, evidence), FAILURES[2])
        .when(query_type.isin("comparison", "multi_hop") & (attempts <= 1), FAILURES[3])
        .when(alignment < 0.5, FAILURES[4])
        .otherwise(FAILURES[6])
    )
    return F.when(failed(answerable, accuracy, abstained, evidence), first)


def category_counts(df: DataFrame, category: str, every: tuple[str, ...]) -> DataFrame:
    """(category, n, share): counts with zeros for categories that have none."""
    known = df.sparkSession.createDataFrame([(x,) for x in every], f"{category} string")
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    out = known.join(counts, category, "left").na.fill(0, ["n"])
    total = df.agg(F.count(category).alias("total"))
    return out.crossJoin(F.broadcast(total)).select(category, "n", F.round(F.coalesce(F.try_divide("n", "total"), F.lit(0.0)), 6).alias("share"))  # one row of total


def abstention_outcome(abstained: Column, has_evidence: Column) -> Column:
    return F.when(abstained & ~has_evidence, "correct_refusal").when(abstained, "boundary_partial").otherwise("incorrect_answer")


def gauge(value: Column, floor: Column) -> Column:
    """(value - floor) / (1 - floor); null where the floor is 1."""
    return F.try_divide(value - floor, 1 - floor)


def retry_effect(cases: DataFrame, by: list[str], accuracy: str, retries: str, verified: str) -> DataFrame:
    """(by..., with_retry, without_retry, recovery, residual, resolution, lift): what further attempts brought.

    Of cases with an accuracy: recovery is its mean over those retried, residual what is left to 1, resolution the share of them
    whose last attempt was verified, lift the distance to the mean of those not retried. Null where no case was retried.
    """
    again = F.coalesce(F.col(retries), F.lit(0)) > 0
    mean = lambda x, c: F.avg(F.when(c, x))
    a = F.col(accuracy).cast("double")
    out = cases.where(a.isNotNull()).groupBy(*by).agg(
        F.count_if(again).alias("with_retry"), F.count_if(~again).alias("without_retry"), mean(a, again).alias("_r"), mean(a, ~again).alias("_b"),
        F.round(mean(F.col(verified).cast("double"), again), 6).alias("resolution"),
    )
    r = F.col("_r")
    return out.select(*by, "with_retry", "without_retry", F.round(r, 6).alias("recovery"), F.round(1 - r, 6).alias("residual"), "resolution", F.round(r - F.col("_b"), 6).alias("lift"))


def retry_precision(run: DataFrame, base: DataFrame, case: str, accuracy: str, retries: str) -> DataFrame:
    """(triggered, warranted, needless, precision): retries of one run by whether the other, without any, was wrong there."""
    kept = run.where((F.coalesce(F.col(retries), F.lit(0)) > 0) & F.col(accuracy).isNotNull()).select(case)
    both = kept.join(base.where(F.col(accuracy).isNotNull()).select(case, F.col(accuracy).alias("_a")), case)
    wrong = F.count_if(F.col("_a") < 1.0)
    return both.agg(F.count("*").alias("triggered"), wrong.alias("warranted"), (F.count("*") - wrong).alias("needless"), F.round(F.try_divide(wrong, F.count("*")), 6).alias("precision"))


def attempts(cases: DataFrame, by: list[str], retries: str, verified: str) -> DataFrame:
    """(by..., attempts, n, verify_rate): cases by how many attempts they took (1, 2, 3+) and how many were verified."""
    kind = F.when(F.coalesce(F.col(retries), F.lit(0)) == 0, "1").when(F.col(retries) == 1, "2").otherwise("3+")
    return cases.groupBy(*by, kind.alias("attempts")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(verified).cast("double")), 6).alias("verify_rate"))


def gold_chunks(cases: DataFrame, case: str, docs: str, terms: str, chunks: DataFrame, chunk: str, doc: str, text: str, given: str | None = None) -> DataFrame:
    """(case, chunk): chunks of a case's documents whose text holds one of its terms; the list in `given` instead, where there is one.

    Cases without documents or terms have none. Terms count as they are written; empty ones do not.
    """
    named = F.size(F.coalesce(F.col(given), F.array().cast("array<string>"))) > 0 if given else F.lit(False)
    wanted = cases.where(~named).select(case, F.explode(F.array_distinct(docs)).alias("_doc"), F.filter(terms, lambda t: t != "").alias("_terms")).where(F.size("_terms") > 0)
    met = wanted.join(chunks.select(F.col(chunk).alias("_chunk"), F.col(doc).alias("_doc"), F.col(text).alias("_text")), "_doc")
    found = met.where(F.exists("_terms", lambda t: F.col("_text").contains(t))).select(case, F.col("_chunk").alias(chunk))
    if given:
        found = found.unionAll(cases.where(named).select(case, F.explode(given).alias(chunk)))
    return found.distinct()


def cell_scores(golden: DataFrame, extracted: DataFrame, table: list[str], row: str, column: str, text: str, row_span: str, column_span: str, least: float = 0.9, form: Callable[[Column], Column] = folded) -> DataFrame:
    """(table..., tp, fp, fn, precision, recall, f1, merged, preserved): cells of tables that both sides have, by their place.

    A cell is right if its text is at least so similar to that of the golden cell in its place, both in `form` (compatibility form without case). merged counts golden cells over
    several rows or columns, preserved those whose spans came out the same. Of several cells in one place the last text counts.
    """
    at = [*table, row, column]

    def cells(df: DataFrame, name: str) -> DataFrame:
        one = df.groupBy(*at).agg(F.max(F.struct(text, row_span, column_span)).alias("_cell"))
        spans = [F.coalesce(F.col(f"_cell.{c}"), F.lit(1)).alias(f"{name}_{o}") for c, o in ((row_span, "rows"), (column_span, "columns"))]
        return one.select(*at, F.col(f"_cell.{text}").alias(f"{name}_text"), *spans, F.lit(1).alias(name))

    both = cells(golden, "_g").join(cells(extracted, "_e"), at, "full_outer")
    text_of = lambda c: form(F.coalesce(c, F.lit("")))
    both = both.withColumn("_near", text_similarity(text_of("_g_text"), text_of("_e_text")) >= least)
    right = F.col("_g").isNotNull() & F.col("_e").isNotNull() & F.col("_near")
    merged = (F.col("_g_rows") > 1) | (F.col("_g_columns") > 1)
    kept = merged & (F.col("_g_rows") == F.col("_e_rows")) & (F.col("_g_columns") == F.col("_e_columns"))
    sums = both.groupBy(*table).agg(
        F.count_if(right).alias("tp"), F.count("_g").alias("_g"), F.count("_e").alias("_e"), F.count_if(merged).alias("merged"), F.count_if(kept).alias("preserved"),
    ).where("_g > 0 and _e > 0")
    sums = sums.withColumn("fp", F.col("_e") - F.col("tp")).withColumn("fn", F.col("_g") - F.col("tp"))
    return sums.select(*table, "tp", "fp", "fn", *precision_recall("tp", "fp", "fn"), "merged", "preserved")


def precision_recall(tp: str, fp: str, fn: str, places: int = 4) -> list[Column]:
    """precision, recall and f1 of counts; 1 where there was nothing to find and nothing was found."""
    p = F.coalesce(F.try_divide(F.col(tp), F.col(tp) + F.col(fp)), F.when(F.col(fn) == 0, 1.0).otherwise(0.0))
    r = F.coalesce(F.try_divide(F.col(tp), F.col(tp) + F.col(fn)), F.when(F.col(fp) == 0, 1.0).otherwise(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, places).alias("precision"), F.round(r, places).alias("recall"), F.round(f1, places).alias("f1")]


def key_scores(golden: DataFrame, extracted: DataFrame, key: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of the keys of two tables, each counted once."""
    both = golden.select(*key).distinct().withColumn("g", F.lit(1)).join(extracted.select(*key).distinct().withColumn("e", F.lit(1)), key, "full_outer")
    tp = F.count_if(F.col("g").isNotNull() & F.col("e").isNotNull()).alias("tp")
    sums = both.agg(tp, F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("e").isNull()).alias("fn"))
    return sums.select("tp", "fp", "fn", *precision_recall("tp", "fp", "fn"))


def compared_cells(left: DataFrame, right: DataFrame, table: list[str], row: str, column: str, text: str, samples: int = 50) -> DataFrame:
    """(table..., cells, equal, only_left, only_right, equal_share, differing): two readings of the same tables; `differing` the first places."""
    at = [*table, row, column]
    side = lambda df, name: df.groupBy(*at).agg(F.max(text).alias(name))
    both = side(left.withColumn(text, F.coalesce(text, F.lit(""))), "_l").join(side(right.withColumn(text, F.coalesce(text, F.lit(""))), "_r"), at, "full_outer")
    differs = ~F.col("_l").eqNullSafe(F.col("_r"))
    place = F.concat_ws(":", F.col(row).cast("string"), F.col(column).cast("string"))
    w = Window.partitionBy(*table).orderBy(differs.desc(), row, column)
    both = both.withColumn("_k", F.row_number().over(w))
    some = F.array_sort(F.collect_list(F.when(differs & (F.col("_k") <= samples), F.struct(F.col("_k").alias("k"), place.alias("p")))))  # at most `samples`
    out = both.groupBy(*table).agg(F.count("*").alias("cells"), F.count_if(~differs).alias("equal"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), some.alias("_s"))
    return out.select(*table, "cells", "equal", "only_left", "only_right", F.round(F.col("equal") / F.col("cells"), 6).alias("equal_share"), F.transform("_s", lambda x: x["p"]).alias("differing"))


def claim_support(claim: Column, citation: Column, least: float = 0.5) -> Column:
    """Whether a text cited for a claim holds it, or at least half of its words of two characters or more; false for blank texts."""
    ours, theirs = compact(claim), compact(citation)
    words = alignment_words(claim)
    share = F.size(F.filter(words, lambda w: F.array_contains(alignment_words(citation), w))) / F.size(words)
    within = (ours != "") & theirs.contains(ours)
    return F.coalesce((strip(claim) != "") & (strip(citation) != "") & (within | ((F.size(words) > 0) & (share >= least))), F.lit(False))


def alignment_words(x: Column) -> Column:
    """Words in lower case, longer than one character and no particles, in order; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(TOKEN.lower().replace("a-za-z", "a-z")), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*PARTICLES))


def claim_alignment(claims: DataFrame, case: str, target: str, claim: str, cited: str, evidence: DataFrame, chunk: str, text: str, doc: str, specs: DataFrame | None = None) -> DataFrame:
    """(case, checked, aligned, alignment): how many claims of a case the text they cite supports.

    claims: one row a claim and cited chunk (null cites nothing). A claim without a citation, whose chunks are not in the case's
    evidence, or whose text they do not support, is not aligned; so are claims and missing targets against `specs` (case, target,
    expected_docs): a claim for a target must cite one of its documents, and every target must have a claim.
    """
    named = evidence.select(F.col(case).alias("_case"), F.col(chunk).alias("_chunk"), F.col(text).alias("_text"), F.col(doc).alias("_doc"))
    met = claims.join(named, (F.col(case) == F.col("_case")) & (F.col(cited) == F.col("_chunk")), "left")
    # A claim cites few chunks.
    joined = met.groupBy(case, target, claim).agg(F.array_sort(F.collect_list(F.when(F.col("_chunk").isNotNull(), F.struct("_chunk", F.coalesce("_text", F.lit("")).alias("_text"), "_doc")))).alias("_c"))
    cited_text = F.array_join(F.transform("_c", lambda c: c["_text"]), " ")
    scored = joined.withColumn("_ok", (F.size("_c") > 0) & claim_support(F.col(claim), cited_text))
    if specs is not None:
        wanted = specs.select(F.col(case).alias("_case"), F.col(target).alias("_target"), "expected_docs")
        scored = scored.join(wanted, (F.col(case) == F.col("_case")) & (F.col(target) == F.col("_target")), "left")
        right = F.col("expected_docs").isNull() | (F.size("expected_docs") == 0) | F.arrays_overlap("expected_docs", F.transform("_c", lambda c: c["_doc"]))
        scored = scored.withColumn("_ok", F.col("_ok") & F.coalesce(right, F.lit(False)))
        missing = specs.join(claims.select(case, target).distinct(), [case, target], "left_anti").select(case, F.lit(False).alias("_ok"))
        scored = scored.select(case, "_ok").unionAll(missing)
    out = scored.groupBy(case).agg(F.count("*").alias("checked"), F.count_if("_ok").alias("aligned"))
    return out.withColumn("alignment", F.round(F.col("aligned") / F.col("checked"), 6))


def row_score(must: Column, text: Column, aliases: Column, expected: Column, given: Column, abstained: Column, should_abstain: Column) -> list[Column]:
    """must_recall, alias_hit, abstention_right, doc_hit, precision and recall of documents, passed: the scores of one answer.

    Shares of nothing are null. An answer passes if it abstains where it should, and else if it has all that it must.
    """
    has = lambda t: F.lower(text).contains(F.lower(t))
    recall = F.when(F.size(must) > 0, F.size(F.filter(must, has)) / F.size(must))
    alias = F.when(F.size(aliases) > 0, F.exists(aliases, has))
    common = F.size(F.array_intersect(expected, given))
    precision = F.when(F.size(given) > 0, common / F.size(F.array_distinct(given)))
    found = F.when(F.size(expected) > 0, common / F.size(F.array_distinct(expected)))
    passed = F.when(should_abstain, abstained).otherwise(~abstained & (F.coalesce(recall, F.lit(1.0)) == 1.0))
    return [
        F.round(recall, 6).alias("must_recall"), alias.alias("alias_hit"), (abstained == should_abstain).alias("abstention_right"), F.when(F.size(expected) > 0, common > 0).alias("doc_hit"),
        F.round(precision, 6).alias("precision"), F.round(found, 6).alias("recall"), passed.alias("passed"),
    ]


def disagreements(df: DataFrame, case: str, judge: str, first: str, second: str, status: str) -> DataFrame:
    """(first_status, second_status, n, share): how two judges differ on the cases that both have; share of all these cases."""
    own = lambda name, out: df.where(F.col(judge) == name).select(case, F.col(status).alias(out))
    both = own(first, "first_status").join(own(second, "second_status"), case)
    counts = both.groupBy("first_status", "second_status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    out = counts.crossJoin(F.broadcast(total)).where("first_status != second_status")  # one row of the total
    return out.select("first_status", "second_status", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def has_error(*metrics: Column) -> Column:
    """Whether any of the metrics that are there is under 1."""
    found = F.lit(False)
    for m in metrics:
        found = found | F.coalesce(m < 1.0, F.lit(False))
    return found
