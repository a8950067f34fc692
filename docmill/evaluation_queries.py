"""Queries of the evaluation operators: cases, runs, tables and claims made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import evaluation, ingest, statistics
from .plans.staging import staged
from .queries import _sql_bootstrap
from .registry import COMPACT, query, sql_strip, sql_tokens, table

# One case a run and query: retries are further answers, accuracy the share of rows that still have their text.
_CASES = """SELECT run_name, query_id, count(*) AS n, count(text) / count(*)::DOUBLE AS accuracy, count(DISTINCT answer_id) - 1 AS retries,
    max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS best, count(DISTINCT doc_id) AS docs, max(CASE WHEN isnan(score) THEN NULL ELSE score END) >= 0.5 AS verified,
    CASE WHEN count(DISTINCT doc_id) > 5 THEN 'comparison' ELSE 'single_doc' END AS kind, min(answered_at) AS answered_at, sum(length(text)) AS chars FROM answer WHERE query_id IS NOT NULL GROUP BY 1, 2"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "answer").where("query_id is not null")
    best = F.max(F.when(~F.isnan("score"), F.col("score")))
    return rows.groupBy("run_name", "query_id").agg(
        F.count("*").alias("n"), (F.count("text") / F.count("*")).alias("accuracy"), (F.count_distinct("answer_id") - 1).alias("retries"), best.alias("best"),
        F.count_distinct("doc_id").alias("docs"), (best >= 0.5).alias("verified"), F.when(F.count_distinct("doc_id") > 5, "comparison").otherwise("single_doc").alias("kind"),
        F.min("answered_at").alias("answered_at"), F.sum(F.length("text")).alias("chars"),
    )


@query(
    f"""WITH c AS ({_CASES}) SELECT run_name, count(*) FILTER (WHERE retries > 0) AS with_retry, count(*) FILTER (WHERE retries = 0) AS without_retry,
    round(avg(accuracy) FILTER (WHERE retries > 0), 6) AS recovery, round(1 - avg(accuracy) FILTER (WHERE retries > 0), 6) AS residual, round(avg(verified::INT) FILTER (WHERE retries > 0), 6) AS resolution,
    round(avg(accuracy) FILTER (WHERE retries > 0) - avg(accuracy) FILTER (WHERE retries = 0), 6) AS lift FROM c GROUP BY 1"""
)
def eval_retry_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retry_effect(_cases(spark, sf_dir), ["run_name"], "accuracy", "retries", "verified")


@query(
    f"""WITH c AS ({_CASES}), j AS (SELECT b.accuracy FROM c a JOIN c b USING (query_id) WHERE a.run_name = 'full' AND b.run_name = 'naive_baseline' AND a.retries > 0)
    SELECT count(*) AS triggered, count(*) FILTER (WHERE accuracy < 1) AS warranted, count(*) FILTER (WHERE accuracy >= 1) AS needless, round(count(*) FILTER (WHERE accuracy < 1) / nullif(count(*), 0)::DOUBLE, 6) AS precision FROM j"""
)
def eval_retry_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries of the run `full`, by whether the baseline was wrong on the same query."""
    cases = staged(_cases(spark, sf_dir), "cases")
    return evaluation.retry_precision(cases.where("run_name = 'full'"), cases.where("run_name = 'naive_baseline'"), "query_id", "accuracy", "retries")


@query(f"WITH c AS ({_CASES}) SELECT run_name, CASE WHEN retries = 0 THEN '1' WHEN retries = 1 THEN '2' ELSE '3+' END AS attempts, count(*) AS n, round(avg(verified::INT), 6) AS verify_rate FROM c GROUP BY 1, 2")
def eval_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attempts(_cases(spark, sf_dir), ["run_name"], "retries", "verified")


@query(
    f"""WITH c AS ({_CASES}), d AS (SELECT a.kind, a.best - b.best AS d FROM c a JOIN c b USING (query_id) WHERE a.run_name = 'full' AND b.run_name = 'no_rerank' AND a.best IS NOT NULL AND b.best IS NOT NULL),
    s AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE d > 1e-9) AS improved, count(*) FILTER (WHERE d < -1e-9) AS regressed, round(avg(d), 6) AS mean_delta FROM d GROUP BY 1)
    SELECT kind, n, improved, n - improved - regressed AS unchanged, regressed, mean_delta, round(improved / n::DOUBLE, 6) AS share_improved, round((n - improved - regressed) / n::DOUBLE, 6) AS share_unchanged, round(regressed / n::DOUBLE, 6) AS share_regressed FROM s"""
)
def eval_rerank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores with and without reranking, by the kind of query."""
    cases = staged(_cases(spark, sf_dir).where("run_name in ('full', 'no_rerank')"), "cases")
    plain = cases.where("run_name = 'no_rerank'").select("query_id", F.col("best").alias("plain"))
    both = cases.where("run_name = 'full'").join(plain, "query_id").withColumn("delta", F.col("best") - F.col("plain"))
    return statistics.change_shares(both, ["kind"], "delta")


@query(
    """WITH t AS (SELECT avg(t) AS t FROM (SELECT user_id, sum(value) AS t FROM events GROUP BY 1))
    SELECT event_type AS stage, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95,
        round(avg(value) / any_value(t), 6) AS share_of_whole FROM events, t GROUP BY 1"""
)
def eval_stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of their users' work: each one's distribution and its mean by the mean of the whole."""
    events = table(spark, sf_dir, "events")
    whole = events.groupBy("user_id").agg(F.sum("value").alias("t")).agg(F.avg("t").alias("t"))
    found = statistics.percentiles(events, ["event_type"], "value", (0.1, 0.5, 0.9, 0.95), places=4).crossJoin(F.broadcast(whole))  # one row
    mean = F.col("total") / F.col("n")
    return found.select(F.col("event_type").alias("stage"), "n", F.round(mean, 4).alias("mean"), "p10", "p50", "p90", "p95", F.round(mean / F.col("t"), 6).alias("share_of_whole"))


@query(
    """WITH e AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS cold FROM events),
    s AS (SELECT cold, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM e GROUP BY 1)
    SELECT CASE WHEN cold THEN 'cold' ELSE 'warm' END AS cohort, n, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p50 - (SELECT p50 FROM s WHERE NOT cold), 4) AS p50_over_warm FROM s"""
)
def eval_cold_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user against all later ones."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("event_id").alias("first"))
    rows = events.join(first, "user_id").select(F.when(F.col("event_id") == F.col("first"), "cold").otherwise("warm").alias("cohort"), "value")
    found = staged(statistics.percentiles(rows, ["cohort"], "value", (0.5, 0.95)), "cohorts")
    warm = found.where("cohort = 'warm'").select(F.col("p50").alias("w"))
    return found.crossJoin(F.broadcast(warm)).select("cohort", "n", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round(F.col("p50") - F.col("w"), 4).alias("p50_over_warm"))  # one row


@query("SELECT run_name, least(floor(score * 5), 4)::INT AS bin, count(*) AS n FROM answer WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) GROUP BY 1, 2")
def eval_confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in five bins, the last one closed."""
    rows = table(spark, sf_dir, "answer").where("score is not null and not isnan(score)")
    return statistics.histogram(rows, ["run_name"], "score", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


@query(
    f"""WITH c AS ({_CASES}), p AS (SELECT * FROM c WHERE best IS NOT NULL)
    SELECT run_name, count(*) AS n, round(count(*) FILTER (WHERE accuracy >= 0.5 AND best >= 0.5) / count(*)::DOUBLE, 6) AS both_high, round(count(*) FILTER (WHERE accuracy >= 0.5 AND best < 0.5) / count(*)::DOUBLE, 6) AS held_only,
        round(count(*) FILTER (WHERE accuracy < 0.5 AND best >= 0.5) / count(*)::DOUBLE, 6) AS best_only, round(count(*) FILTER (WHERE accuracy < 0.5 AND best < 0.5) / count(*)::DOUBLE, 6) AS both_low,
        round(covar_pop(accuracy, best) / nullif(stddev_pop(accuracy) * stddev_pop(best), 0), 5) AS pearson FROM p GROUP BY 1"""
)
def eval_evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by whether their text is held and their evidence is good, and how the two go together."""
    a, b = F.col("accuracy") >= 0.5, F.col("best") >= 0.5
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return _cases(spark, sf_dir).where("best is not null").groupBy("run_name").agg(
        F.count("*").alias("n"), share(a & b).alias("both_high"), share(a & ~b).alias("held_only"), share(~a & b).alias("best_only"), share(~a & ~b).alias("both_low"),
        F.round(statistics.pearson("accuracy", "best"), 5).alias("pearson"),
    )


_STATUS = "CASE WHEN accuracy >= 0.9 THEN 'supported' WHEN accuracy >= 0.5 THEN 'partial' ELSE 'insufficient' END"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(_cases(spark, sf_dir).withColumn("status", F.expr(_STATUS)), "cases")


@query(
    f"""WITH c AS (SELECT *, {_STATUS} AS status FROM ({_CASES})), k AS (SELECT run_name, status, count(*) AS k FROM c GROUP BY 1, 2)
    SELECT status, count(*) AS runs, round(avg(k), 4) AS mean, round(coalesce(stddev_samp(k), 0), 4) AS stdev, min(k) AS lowest, max(k) AS highest, max(k) - min(k) AS spread FROM k GROUP BY 1"""
)
def eval_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each status comes in a run, over the runs."""
    counts = _statuses(spark, sf_dir).groupBy("run_name", "status").agg(F.count("*").alias("k"))
    return statistics.spread_over(counts, ["status"], "k")


@query(
    f"""WITH c AS (SELECT *, {_STATUS} AS status FROM ({_CASES})), p AS (SELECT query_id, count(DISTINCT status) + (count(*) < (SELECT count(DISTINCT run_name) FROM c))::INT AS distinct_states FROM c GROUP BY 1)
    SELECT distinct_states, count(*) AS cases FROM p GROUP BY 1"""
)
def eval_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by how many statuses they have over the runs; a run without them is one more."""
    cases = _statuses(spark, sf_dir)
    return statistics.stability(cases, "query_id", "status", cases.select("run_name").distinct().count())


@query(
    f"""WITH c AS (SELECT *, {_STATUS} AS status FROM ({_CASES})), j AS (SELECT a.status AS first_status, b.status AS second_status FROM c a JOIN c b USING (query_id) WHERE a.run_name = 'full' AND b.run_name = 'naive_baseline')
    SELECT first_status, second_status, count(*) AS n, round(count(*) / (SELECT count(*) FROM j)::DOUBLE, 6) AS share FROM j WHERE first_status <> second_status GROUP BY 1, 2"""
)
def eval_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.disagreements(_statuses(spark, sf_dir), "query_id", "run_name", "full", "naive_baseline", "status")


_PAIRS = f"WITH c AS ({_CASES}) SELECT a.kind, substr(a.query_id, 6)::BIGINT AS h, a.best AS other, b.best AS base FROM c a JOIN c b USING (query_id) WHERE a.run_name = 'full' AND b.run_name = 'naive_baseline' AND a.best IS NOT NULL AND b.best IS NOT NULL"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = staged(_cases(spark, sf_dir).where("best is not null").withColumn("h", F.expr("cast(substring(query_id, 6) as bigint)")), "cases")
    base = cases.where("run_name = 'naive_baseline'").select("query_id", F.col("best").alias("base"))
    return cases.where("run_name = 'full'").select("query_id", "h", "kind", F.col("best").alias("other")).join(base, "query_id")


_TWO = " UNION ALL ".join(f"SELECT * FROM ({_sql_bootstrap(f'SELECT kind, h, other - base AS v FROM ({_PAIRS})', 'kind', seed)})" for seed in (17, 29))


@query(f"SELECT kind, max(n)::BIGINT AS n, max(mean) AS mean_diff, round(avg(ci_lo), 6) AS ci_lo, round(avg(ci_hi), 6) AS ci_hi FROM ({_TWO}) GROUP BY 1")
def eval_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better the run `full` is than the baseline on the queries of both, with bounds averaged over two seeds."""
    return statistics.paired_interval(staged(_pairs(spark, sf_dir), "pairs"), ["kind"], "h", "base", "other", (17, 29))


@query(
    f"""WITH i AS ({_sql_bootstrap(f"SELECT kind, h, other - base AS v FROM ({_PAIRS})", "kind")})
    SELECT kind, claimed::DOUBLE AS claimed, n, CASE WHEN coalesce(n, 0) = 0 THEN 'no_pairs' WHEN n < 10 THEN 'small_sample' WHEN ci_lo <= 0 AND ci_hi >= 0 THEN 'interval_holds_zero'
        WHEN sign(mean) <> sign(claimed) THEN 'wrong_sign' WHEN abs(mean - claimed) > 0.005 THEN 'off_by_too_much' ELSE 'holds' END AS verdict FROM (VALUES ('comparison', 0.05), ('single_doc', -0.02), ('follow_up', 0.1)) v(kind, claimed) LEFT JOIN i USING (kind)"""
)
def eval_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claimed differences come to against the intervals."""
    found = statistics.paired_interval(staged(_pairs(spark, sf_dir), "pairs"), ["kind"], "h", "base", "other")
    claims = spark.createDataFrame([("comparison", 0.05), ("single_doc", -0.02), ("follow_up", 0.1)], "kind string, claimed double")
    c = F.col
    verdict = statistics.claim_verdict(c("n"), c("mean_diff"), c("ci_lo"), c("ci_hi"), c("claimed"), min_sample=10)
    return claims.join(found, "kind", "left").select("kind", "claimed", "n", verdict.alias("verdict"))


# Each query's terms are the words of the headings it was answered from, its documents those of the run `full`.
_WANTED = f"""SELECT query_id, list_distinct(list(doc_id) FILTER (WHERE run_name = 'full' AND doc_id IS NOT NULL)) AS docs,
    list_distinct(flatten(list({sql_tokens('section')}))) AS terms FROM answer WHERE query_id IS NOT NULL AND section IS NOT NULL GROUP BY 1"""
_CHUNKS = "SELECT DISTINCT chunk_id, doc_id, text FROM answer WHERE text IS NOT NULL AND chunk_id IS NOT NULL AND doc_id IS NOT NULL"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "answer").where("query_id is not null and section is not null").select("query_id", "run_name", "doc_id", "section").distinct()
    rows = rows.withColumn("w", text.tokens("section"))
    docs = F.array_compact(F.collect_set(F.when(F.col("run_name") == "full", F.col("doc_id"))))  # a query's documents and the words of its headings
    return rows.groupBy("query_id").agg(docs.alias("docs"), F.array_distinct(F.flatten(F.collect_set("w"))).alias("terms"))


@query(f"SELECT DISTINCT query_id, chunk_id FROM ({_WANTED}) w, LATERAL (SELECT unnest(docs) AS doc_id) d JOIN ({_CHUNKS}) c ON c.doc_id = d.doc_id WHERE len(list_filter(terms, lambda t: contains(text, t))) > 0")
def eval_gold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents that a query should lead to, which hold one of its terms."""
    chunks = table(spark, sf_dir, "answer").where("text is not null and chunk_id is not null and doc_id is not null").select("chunk_id", "doc_id", "text").distinct()
    return evaluation.gold_chunks(_wanted(spark, sf_dir), "query_id", "docs", "terms", chunks, "chunk_id", "doc_id", "text")


_WORDS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+|[가-힣]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{p}'" for p in text.PARTICLES) + "], w))"
_FIRST = f"string_split(regexp_replace({sql_strip('text')}, '([.!?。])[ \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{3000}}]+', '\\1' || chr(1), 'g'), chr(1))[1]"


@query(
    f"""WITH k AS (SELECT query_id, doc_id, chunk_id, {_FIRST} AS claim, parent_section_id AS cited FROM (SELECT DISTINCT query_id, doc_id, chunk_id, text, parent_section_id FROM answer WHERE text IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL AND run_name = 'full')),
    e AS (SELECT section_id, arg_min(text, section_uid) AS t FROM rfp_sections WHERE text IS NOT NULL GROUP BY 1),
    v AS (SELECT query_id, doc_id, claim, string_agg(t, ' ' ORDER BY section_id) AS t FROM (SELECT DISTINCT query_id, doc_id, claim, section_id, t FROM k LEFT JOIN e ON cited = section_id) GROUP BY 1, 2, 3),
    s AS (SELECT query_id, t IS NOT NULL AND ({COMPACT.format('claim')} <> '' AND contains({COMPACT.format('t')}, {COMPACT.format('claim')})
        OR len({_WORDS.format('claim')}) > 0 AND len(list_filter({_WORDS.format('claim')}, lambda w: list_contains({_WORDS.format('t')}, w))) / len({_WORDS.format('claim')})::DOUBLE >= 0.5) AS ok FROM v)
    SELECT query_id, count(*) AS checked, count(*) FILTER (WHERE ok) AS aligned, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS alignment FROM s GROUP BY 1"""
)
def eval_claim_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first sentence of each chunk of the run `full` stands in the section that it is said to come from."""
    rows = table(spark, sf_dir, "answer").where("text is not null and query_id is not null and doc_id is not null and run_name = 'full'")
    claims = rows.select("query_id", "doc_id", text.sentences("text")[0].alias("claim"), F.col("parent_section_id").alias("cited")).distinct()
    sections = table(spark, sf_dir, "rfp_sections").where("text is not null").groupBy("section_id").agg(F.min_by("text", "section_uid").alias("section_text"))
    evidence = claims.select("query_id", "cited").distinct().join(sections, F.col("cited") == F.col("section_id")).select("query_id", F.col("section_id").alias("chunk"), "section_text", F.lit("").alias("of"))
    return evaluation.claim_alignment(claims, "query_id", "doc_id", "claim", "cited", evidence, "chunk", "section_text", "of")


# Words as cells of a table: a row a line, the first delivery against the second. A word's span follows from its length.
_CELLS = """SELECT section_id, r::INT AS r, (generate_subscripts(w, 1) - 1)::INT AS c, unnest(w) AS x FROM (SELECT section_id, generate_subscripts(l, 1) - 1 AS r, string_split(unnest(l), ' ') AS w FROM
    (SELECT section_id, string_split(arg_min(text, section_uid), chr(10)) AS l FROM rfp_sections WHERE text IS NOT NULL AND delivery_no = {} GROUP BY 1))"""
_BOTH = f"""SELECT coalesce(g.section_id, e.section_id) AS section_id, coalesce(g.r, e.r) AS r, coalesce(g.c, e.c) AS c, g.x AS gx, e.x AS ex FROM ({_CELLS.format(1)}) g FULL JOIN ({_CELLS.format(2)}) e ON g.section_id = e.section_id AND g.r = e.r AND g.c = e.c"""
_SPAN = "1 + length({}) % 3"
# Edit distance by characters (DuckDB's is by bytes): under ten characters nearly equal is equal, under twenty one edit is allowed.
_PREFIX = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, 1, i) = substr({1}, 1, i)))"
_REST = f"substr({{0}}, {_PREFIX} + {{2}}) = substr({{1}}, {_PREFIX} + {{3}})"
_SIMILAR = f"({{0}} = {{1}} OR greatest(length({{0}}), length({{1}})) >= 10 AND ({' OR '.join(_REST.format('{0}', '{1}', a, b) for a, b in ((2, 2), (2, 1), (1, 2)))}))"


def _delivered(spark: SparkSession, sf_dir: str, no: int) -> DataFrame:
    rows = table(spark, sf_dir, "rfp_sections").where(f"text is not null and delivery_no = {no}").groupBy("section_id").agg(F.min_by("text", "section_uid").alias("text"))
    lines = rows.select("section_id", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    cells = lines.select("section_id", "r", F.posexplode(F.split("line", " ")).alias("c", "x"))
    return cells.withColumn("rows", 1 + F.length("x") % 3).withColumn("columns", F.lit(1))


_PRF = "round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, (fn = 0)::INT), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, (fp = 0)::INT), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 1), 4) AS f1"


@query(
    f"""WITH b AS ({_BOTH}), f AS (SELECT *, lower(nfc_normalize(gx)) AS gl, lower(nfc_normalize(ex)) AS el FROM b),
    s AS (SELECT section_id, count(*) FILTER (WHERE gx IS NOT NULL AND ex IS NOT NULL AND {_SIMILAR.format('gl', 'el')}) AS tp, count(gx) AS g, count(ex) AS e,
        count(*) FILTER (WHERE gx IS NOT NULL AND {_SPAN.format('gx')} > 1) AS merged, count(*) FILTER (WHERE gx IS NOT NULL AND ex IS NOT NULL AND {_SPAN.format('gx')} > 1 AND {_SPAN.format('gx')} = {_SPAN.format('ex')}) AS preserved FROM f GROUP BY 1 HAVING count(gx) > 0 AND count(ex) > 0),
    t AS (SELECT *, e - tp AS fp, g - tp AS fn FROM s)
    SELECT section_id, tp, fp, fn, {_PRF}, merged, preserved FROM t"""
)
def eval_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of a section as tables of words: cells in the same place with nearly the same text (composed, in lower case)."""
    return evaluation.cell_scores(_delivered(spark, sf_dir, 1), _delivered(spark, sf_dir, 2), ["section_id"], "r", "c", "x", "rows", "columns", form=lambda x: F.lower(text.composed(x)))


@query(f"WITH g AS (SELECT DISTINCT section_id FROM rfp_sections WHERE delivery_no = 1), e AS (SELECT DISTINCT section_id FROM rfp_sections WHERE delivery_no = 2), t AS (SELECT count(g.section_id) FILTER (WHERE e.section_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.section_id IS NULL) AS fp, count(*) FILTER (WHERE e.section_id IS NULL) AS fn FROM g FULL JOIN e ON g.section_id = e.section_id) SELECT tp, fp, fn, {_PRF} FROM t")
def eval_tables_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that a second delivery brought again."""
    rows = table(spark, sf_dir, "rfp_sections")
    return evaluation.key_scores(rows.where("delivery_no = 1"), rows.where("delivery_no = 2"), ["section_id"])


@query(
    f"""WITH b AS ({_BOTH}), d AS (SELECT *, gx IS DISTINCT FROM ex AS df FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY df DESC, r, c) AS k FROM d)
    SELECT section_id, count(*) AS cells, count(*) FILTER (WHERE NOT df) AS equal, count(*) FILTER (WHERE ex IS NULL) AS only_left, count(*) FILTER (WHERE gx IS NULL) AS only_right,
        round(count(*) FILTER (WHERE NOT df) / count(*)::DOUBLE, 6) AS equal_share, coalesce(string_agg(r || ':' || c, ',' ORDER BY k) FILTER (WHERE df AND k <= 50), '') AS differing FROM k GROUP BY 1"""
)
def eval_cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.compared_cells(_delivered(spark, sf_dir, 1), _delivered(spark, sf_dir, 2), ["section_id"], "r", "c", "x")
    return found.withColumn("differing", F.array_join("differing", ","))


_ROWS = f"""WITH w AS ({_WANTED}), a AS (SELECT query_id, run_name, string_agg(text, ' ' ORDER BY evidence_id) AS t, list_distinct(list(doc_id) FILTER (WHERE doc_id IS NOT NULL)) AS given, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS best FROM answer WHERE query_id IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT run_name, query_id, terms, coalesce(docs, []) AS docs, coalesce(given, []) AS given, coalesce(t, '') AS t, t IS NULL AS abstained, coalesce(best, 0) < 0.18 AS should FROM a JOIN w USING (query_id)),
    m AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(lower(t), lower(x)))) / len(terms)::DOUBLE END AS must, len(list_intersect(docs, given)) AS common FROM j)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "answer").where("query_id is not null")
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("evidence_id", "text"))))  # one answer's rows
    best = F.max(F.when(~F.isnan("score"), F.col("score")))
    answers = rows.groupBy("query_id", "run_name").agg(texts.alias("t"), F.array_compact(F.collect_set("doc_id")).alias("given"), best.alias("best"))
    answers = answers.withColumn("t", F.array_join(F.transform("t", lambda x: x["text"]), " ")).join(_wanted(spark, sf_dir), "query_id")
    c = F.col
    scores = evaluation.row_score(c("terms"), c("t"), c("terms"), c("docs"), c("given"), c("t") == "", F.coalesce(c("best"), F.lit(0.0)) < 0.18)
    return answers.select("run_name", "query_id", *scores)


@query(
    f"""{_ROWS} SELECT run_name, query_id, round(must, 6) AS must_recall, CASE WHEN len(terms) > 0 THEN must > 0 END AS alias_hit, abstained = should AS abstention_right, CASE WHEN len(docs) > 0 THEN common > 0 END AS doc_hit,
    round(common / nullif(len(given), 0)::DOUBLE, 6) AS precision, round(common / nullif(len(docs), 0)::DOUBLE, 6) AS recall, CASE WHEN should THEN abstained ELSE NOT abstained AND coalesce(must, 1) = 1 END AS passed FROM m"""
)
def eval_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(
    f"""{_ROWS}, r AS (SELECT run_name, must, common / nullif(len(given), 0)::DOUBLE AS p, CASE WHEN should THEN abstained ELSE NOT abstained AND coalesce(must, 1) = 1 END AS passed FROM m)
    SELECT CASE WHEN GROUPING(run_name) = 0 THEN 'run_name' ELSE 'overall' END AS slice, run_name AS value, count(*) AS n, round(avg(passed::INT), 4) AS pass_rate, round(avg(round(must, 6)), 4) AS must_recall, round(avg(round(p, 6)), 4) AS precision FROM r GROUP BY GROUPING SETS ((), (run_name))"""
)
def eval_row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the rows' scores, over all and by run."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return statistics.sliced(_scored(spark, sf_dir), ["run_name"], [F.count("*").alias("n"), mean("passed").alias("pass_rate"), mean("must_recall").alias("must_recall"), mean("precision").alias("precision")])


@query(f"WITH c AS ({_CASES}) SELECT run_name, count(*) AS n, count(*) FILTER (WHERE coalesce(accuracy < 1, false) OR coalesce(best < 1, false)) AS with_error, sum(chars)::BIGINT AS cost FROM c GROUP BY 1")
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with any metric under 1, and what a run cost; null where nothing is known."""
    wrong = evaluation.has_error(F.col("accuracy"), F.col("best"))
    return _cases(spark, sf_dir).groupBy("run_name").agg(F.count("*").alias("n"), F.count_if(wrong).alias("with_error"), F.sum("chars").alias("cost"))


_POINTS = f"SELECT run_name, avg(chars)::DOUBLE AS cost, avg(best) AS gain, avg(best) - 1.96 * stddev_samp(best) / sqrt(count(best)) AS lower FROM ({_CASES}) WHERE best IS NOT NULL AND chars IS NOT NULL GROUP BY 1"


@query(
    f"""WITH p AS ({_POINTS}) SELECT 'sweet_spot' AS pick, round(min(cost), 4) AS cost, round(arg_min(gain, cost), 6) AS gain FROM p WHERE lower > 0.3 HAVING count(*) > 0
    UNION ALL SELECT 'cheapest_above_floor', round(min(cost), 4), round(arg_min(gain, cost), 6) FROM p WHERE gain > 0.3 HAVING count(*) > 0 UNION ALL SELECT 'ceiling', round(arg_max(cost, gain), 4), round(max(gain), 6) FROM p HAVING count(*) > 0"""
)
def eval_frontier_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest runs above a floor and the best one; a run costs its mean number of characters."""
    cases = _cases(spark, sf_dir).where("best is not null and chars is not null")
    points = cases.groupBy("run_name").agg(F.avg("chars").alias("cost"), F.avg("best").alias("gain"), (F.avg("best") - 1.96 * F.stddev_samp("best") / F.sqrt(F.count("best"))).alias("lower"))
    found = statistics.frontier_picks(points, "cost", "gain", "lower", 0.3)
    return found.select("pick", F.round("cost", 4).alias("cost"), F.round("gain", 6).alias("gain"))


_OUTCOME = "CASE WHEN accuracy = 0 AND docs = 0 THEN 'correct_refusal' WHEN accuracy < 0.5 THEN 'boundary_partial' ELSE 'incorrect_answer' END"


@query(
    f"""WITH o AS (SELECT kind, substr(query_id, 6)::BIGINT % 2 AS half, {_OUTCOME} AS outcome FROM ({_CASES})),
    s AS (SELECT kind, half, round(count(*) FILTER (WHERE outcome = 'incorrect_answer') / count(*)::DOUBLE, 6) AS incorrect_answer, round(count(*) FILTER (WHERE outcome = 'correct_refusal') / count(*)::DOUBLE, 6) AS correct_refusal FROM o GROUP BY 1, 2),
    u AS (UNPIVOT s ON incorrect_answer, correct_refusal INTO NAME outcome VALUE v)
    SELECT a.kind, a.outcome, a.v AS base, b.v AS head, round(b.v - a.v, 6) AS delta FROM u a JOIN u b ON a.kind = b.kind AND a.outcome = b.outcome AND a.half = 0 AND b.half = 1 WHERE CASE WHEN a.outcome = 'incorrect_answer' THEN b.v - a.v > 0.01 ELSE b.v - a.v < -0.01 END"""
)
def eval_outcome_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes whose share of the odd queries is worse than of the even ones, by kind."""
    cases = _cases(spark, sf_dir).withColumn("outcome", F.expr(_OUTCOME)).withColumn("half", F.expr("cast(substring(query_id, 6) as bigint) % 2"))
    counts = staged(cases.groupBy("half", "kind", "outcome").agg(F.count("*").alias("n")), "outcomes")
    return statistics.composition_drift(counts.where("half = 0"), counts.where("half = 1"), ["kind"], "incorrect_answer", "correct_refusal", 0.01)


_FORMATS = "SELECT doc_id, max(lower(file_format)) AS format FROM rfp_documents WHERE doc_id IS NOT NULL AND file_format IS NOT NULL GROUP BY 1"


@query(
    f"""WITH f AS ({_FORMATS}), a AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM answer WHERE doc_id IS NOT NULL),
    q AS (SELECT quantile_cont(n, 0.3333) AS lo, quantile_cont(n, 0.6667) AS hi FROM a),
    j AS (SELECT coalesce(x.format, y.format, 'unknown') AS format, CASE WHEN n <= lo THEN 'short' WHEN n <= hi THEN 'medium' ELSE 'long' END AS size FROM a LEFT JOIN f x ON x.doc_id = a.doc_id LEFT JOIN f y ON y.doc_id = regexp_replace(a.doc_id, '-[^-]*$', ''), q)
    SELECT format, size, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY format)::DOUBLE, 6) AS share FROM j GROUP BY 1, 2"""
)
def eval_format_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by its document's format, found by its id or else by that without its last part, and by thirds of length."""
    formats = table(spark, sf_dir, "rfp_documents").where("doc_id is not null and file_format is not null").groupBy("doc_id").agg(F.max(F.lower("file_format")).alias("format"))
    rows = table(spark, sf_dir, "answer").where("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    cuts = statistics.percentiles(rows, [], "n", (0.3333, 0.6667)).toDF("rows", "total", "lo", "hi").drop("rows", "total")
    found = ingest.looked_up(rows, "doc_id", formats, "doc_id", "format", F.regexp_replace("doc_id", "-[^-]*$", ""))
    size = F.when(F.col("n") <= F.col("lo"), "short").when(F.col("n") <= F.col("hi"), "medium").otherwise("long")
    sized = found.crossJoin(F.broadcast(cuts)).select(F.coalesce("format", F.lit("unknown")).alias("format"), size.alias("size"))  # one row
    return statistics.crosstab_shares(sized, "format", "size")


@query(
    """WITH c AS (SELECT DISTINCT unnest(target_doc_ids) AS doc_id FROM eval_items), r AS (SELECT doc_row_id, d.doc_id, c.doc_id IS NOT NULL AS covered FROM rfp_documents d LEFT JOIN c USING (doc_id) WHERE d.doc_id IS NOT NULL)
    SELECT doc_id, covered, row_number() OVER (ORDER BY covered, doc_row_id)::INT AS place FROM r QUALIFY place <= 20"""
)
def eval_uncovered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents to write cases for: those that no item asks about, in order of delivery, then the others."""
    covered = table(spark, sf_dir, "eval_items").select(F.explode("target_doc_ids").alias("doc_id")).distinct()
    return ingest.uncovered_first(table(spark, sf_dir, "rfp_documents").where("doc_id is not null"), covered, "doc_id", "doc_row_id", 20).select("doc_id", "covered", "place")


@query("SELECT item_id, CASE WHEN ('0x' || substr(sha1(text), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'val' ELSE 'train' END AS part FROM prompt_injection_ko WHERE text IS NOT NULL")
def eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation by a hash of the text, so that equal texts are on one side."""
    return table(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", ingest.hash_split("text", 0.2).alias("part"))


@query(
    f"""WITH m AS (SELECT strftime(answered_at, '%Y-%m') AS month, substr(query_id, 6)::BIGINT AS h, best AS v FROM ({_CASES}) WHERE best IS NOT NULL), b AS ({_sql_bootstrap("SELECT * FROM m", "month")})
    SELECT month, n, mean, ci_lo, ci_hi, round(mean - lag(mean) OVER (ORDER BY month), 6) AS change, abs(mean - lag(mean) OVER (ORDER BY month)) < greatest(5e-4, 0.5 / n) AS silent FROM b"""
)
def eval_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by month with their intervals, and whether a month differs from the one before by half a case at least."""
    rows = _cases(spark, sf_dir).where("best is not null").select(F.date_format("answered_at", "yyyy-MM").alias("month"), F.expr("cast(substring(query_id, 6) as bigint)").alias("h"), "best")
    found = statistics.bootstrap_mean(rows, ["month"], "h", "best")
    before = F.lag("mean").over(Window.orderBy("month"))  # one row a month
    change = F.col("mean") - before
    return found.select("month", "n", "mean", "ci_lo", "ci_hi", F.round(change, 6).alias("change"), (F.abs(change) < statistics.silent_band(F.col("n"))).alias("silent"))


@query(
    """SELECT doc_id, count(*) AS n, round(avg(CASE WHEN isnan(score) THEN NULL ELSE score END), 6) AS mean_score, round(avg(length(text)), 6) AS mean_length, count(*) FILTER (WHERE text IS NULL) AS redacted, count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS unscored FROM answer WHERE doc_id IS NOT NULL GROUP BY 1"""
)
def eval_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over what is there, and how much is not, by document."""
    s = F.when(~F.isnan("score"), F.col("score"))
    return table(spark, sf_dir, "answer").where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_score"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.count_if(F.col("text").isNull()).alias("redacted"), F.count_if(s.isNull()).alias("unscored"),
    )
