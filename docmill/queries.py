"""Queries of the core operators over the given tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry
from .functions import numbers, text, vectors
from .operators import dialogue, evaluation, ingest, layout, matching, quality, ranking, retrieval, statistics
from .plans.staging import spread, staged
from .registry import Query
from .streaming import windows

_SPACE, _STOP = registry.SPACE, registry.STOP
_query, _t, _sql_tokens, _sql_strip = registry.query, registry.table, registry.sql_tokens, registry.sql_strip


# ---------------------------------------------------------------- text


@_query(f"SELECT section_uid, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT section_uid, {_sql_tokens('text')} AS t FROM rfp_sections WHERE text IS NOT NULL)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(_t(spark, sf_dir, "rfp_sections").select("section_uid", "text")).where("text is not null").select("section_uid", text.tokens("text").alias("t"))
    return df.select("section_uid", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@_query(
    f"""SELECT section_uid, (i - 1)::INT AS sentence_no, s AS sentence FROM (
        SELECT section_uid, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
            SELECT section_uid, list_filter(list_transform(string_split(regexp_replace({_sql_strip('text')}, '([.!?。]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS l
            FROM rfp_sections WHERE text IS NOT NULL))"""
)
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "rfp_sections").where("text is not null")
    return df.select("section_uid", F.posexplode(text.sentences("text")).alias("sentence_no", "sentence"))


@_query(
    """SELECT section_uid, s AS start_pos, substr(text, s + 1, 260) AS piece FROM (
        SELECT section_uid, text, unnest(range(0, greatest(length(text), 1), 220))::INT AS s FROM rfp_sections
        WHERE length(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+|[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+$', '', 'g')) > 0
    ) WHERE s = 0 OR s + 40 < length(text)"""
)
def text_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "rfp_sections").select("section_uid", F.explode(text.fixed_windows("text", 260, 40)).alias("w"))
    return df.select("section_uid", F.col("w.start").alias("start_pos"), F.col("w.text").alias("piece"))


_LABELS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for label, p in text.INJECTIONS)


@_query(f"SELECT item_id, CASE WHEN len(p) > 0 THEN 'flagged' ELSE 'passed' END AS status, array_to_string(p, ',') AS patterns FROM (SELECT item_id, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS p FROM prompt_injection_ko)")
def text_injection_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "prompt_injection_ko").select("item_id", text.injection_labels("text").alias("p"))
    return df.select("item_id", F.when(F.size("p") > 0, "flagged").otherwise("passed").alias("status"), F.array_join("p", ",").alias("patterns"))


@_query(
    """SELECT doc_row_id, regexp_replace(regexp_replace(lower(nfc_normalize(agency)), '[^0-9a-z가-힣]+', '', 'g'), '^$', '') AS agency_compact,
       regexp_replace(regexp_replace(title, '^[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+|[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+', '-', 'g') AS title_slug FROM rfp_documents"""
)
def text_compact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "rfp_documents").select("doc_row_id", text.compact("agency").alias("agency_compact"), text.slug("title").alias("title_slug"))


# ---------------------------------------------------------------- ingestion


@_query(
    """WITH b AS (SELECT doc_row_id, regexp_extract(regexp_replace(budget, '[, ]', '', 'g'), '([0-9][0-9.천백십조억만]*)', 1) AS n, budget, published_on, file_format, source_path, notice_no, notice_round, agency, project_aliases FROM rfp_documents),
    p AS (SELECT *, regexp_extract(n, '^([0-9.]+)조', 1) AS jo, regexp_extract(n, '([0-9.]+)억', 1) AS eok, regexp_extract(n, '([0-9.천]+)만', 1) AS man, regexp_extract(n, '([0-9.]+)$', 1) AS one FROM b)
    SELECT doc_row_id,
        CASE WHEN notice_no IS NULL THEN regexp_extract(source_path, '([^/]+)\\.[^.]+$', 1) ELSE notice_no || CASE WHEN notice_round > 1 THEN '-' || notice_round ELSE '' END END AS canonical_id,
        coalesce(lower(file_format), lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1))) AS format,
        CASE WHEN n <> '' THEN CAST(coalesce(try_cast(jo AS DOUBLE), 0) * 1e12 + coalesce(try_cast(eok AS DOUBLE), 0) * 1e8
            + CASE WHEN man LIKE '%천%' THEN coalesce(try_cast(split_part(man, '천', 1) AS DOUBLE), 1) * 1000 + coalesce(try_cast(split_part(man, '천', 2) AS DOUBLE), 0) ELSE coalesce(try_cast(man AS DOUBLE), 0) END * 1e4
            + coalesce(try_cast(one AS DOUBLE), 0) AS BIGINT) END AS budget_won,
        CASE WHEN try_cast(replace(budget, ',', '') AS BIGINT) > 0 AND regexp_full_match(budget, '[0-9,]+') THEN try_cast(replace(budget, ',', '') AS BIGINT) END AS plain_budget,
        coalesce(try_strptime(published_on, '%Y-%m-%d'), try_strptime(published_on, '%Y.%m.%d'), try_strptime(published_on, '%Y%m%d'))::DATE AS published,
        regexp_replace(trim(agency), ' +', ' ', 'g') AS agency, coalesce(len(project_aliases), 0)::INT AS n_aliases
    FROM p"""
)
def ingest_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalized(_t(spark, sf_dir, "rfp_documents"))


_CHECKED = """SELECT *, CASE WHEN trim(coalesce(source_path, '')) = '' THEN 'missing_file_name' WHEN trim(coalesce(doc_id, '')) = '' THEN 'missing_doc_id'
    WHEN coalesce(lower(file_format), lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)), '') NOT IN ('pdf', 'hwp', 'hwpx', 'docx') THEN 'unsupported_file_format'
    WHEN row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at, doc_row_id) > 1 THEN 'duplicate_doc_id' END AS reason FROM rfp_documents"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.checked(_t(spark, sf_dir, "rfp_documents"), "doc_id", "source_path", "file_format", ["ingested_at", "doc_row_id"])


@_query(f"SELECT doc_row_id, CASE WHEN reason IS NULL THEN 'indexed' ELSE 'failed' END AS status, reason FROM ({_CHECKED})")
def ingest_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_row_id", "status", "reason")


@_query(
    f"""WITH c AS ({_CHECKED}), k AS (SELECT CASE WHEN reason IS NULL THEN 'indexed' ELSE 'failed' END AS status, reason, lower(file_format) AS format, doc_row_id FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY status, reason, format ORDER BY doc_row_id) AS n FROM k)
    SELECT status, reason, format, count(*) AS n, array_to_string(list(doc_row_id ORDER BY doc_row_id) FILTER (WHERE n <= 3), ',') AS examples FROM r GROUP BY status, reason, format"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _checked(spark, sf_dir).withColumn("format", F.lower("file_format"))
    out = ingest.ingestion_report(df, ["status", "reason", "format"], "doc_row_id")
    return out.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


_NAMED = "CASE WHEN doc_row_id % 4 = 0 THEN 'doc-' || doc_row_id % 3 || '-' || doc_row_id % 11 ELSE 'doc-' || doc_row_id % 3 END"


@_query(
    f"""WITH d AS (SELECT doc_row_id, {_NAMED} AS id, row_number() OVER (PARTITION BY {_NAMED} ORDER BY ingested_at, doc_row_id) AS n FROM rfp_documents),
    t AS (SELECT regexp_extract(id, '^(.*)-([0-9]+)$', 1) AS base, list(DISTINCT regexp_extract(id, '^(.*)-([0-9]+)$', 2)::INT) AS taken FROM d WHERE id LIKE 'doc-%-%' GROUP BY 1)
    SELECT doc_row_id, CASE WHEN n = 1 THEN id ELSE id || '-' || list_filter(range(2, n + coalesce(len(taken), 0) + 2), lambda x: NOT list_contains(coalesce(taken, []), x))[n - 1] END AS unique_id FROM d LEFT JOIN t ON base = id"""
)
def ingest_suffixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of few bases, some of which other rows have with a number already."""
    return ingest.suffixed_ids(_t(spark, sf_dir, "rfp_documents").withColumn("id", F.expr(_NAMED)), "id", ["ingested_at", "doc_row_id"]).select("doc_row_id", "unique_id")


@_query("SELECT section_id, section_uid, delivery_no FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY delivery_no DESC NULLS LAST, ingested_at DESC NULLS LAST, section_uid DESC) AS k FROM rfp_sections) WHERE k = 1")
def ingest_latest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest(_t(spark, sf_dir, "rfp_sections"), "section_id", ["delivery_no", "ingested_at", "section_uid"]).select("section_id", "section_uid", "delivery_no")


@_query(
    """SELECT strftime(coalesce(try_strptime(published_on, '%Y-%m-%d'), try_strptime(published_on, '%Y.%m.%d'), try_strptime(published_on, '%Y%m%d')), '%Y-%m') AS month,
       lower(file_format) AS format, count(*) AS n FROM rfp_documents GROUP BY 1, 2"""
)
def ingest_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(numbers.any_date("published_on"), "yyyy-MM").alias("month")
    return _t(spark, sf_dir, "rfp_documents").groupBy(month, F.lower("file_format").alias("format")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- search


_QUERIED = "SELECT item_id, text FROM prompt_injection_ko WHERE item_id % 100 = 0 AND text IS NOT NULL"


@_query(
    f"""WITH d AS (SELECT section_uid, {_sql_tokens('text')} AS t FROM rfp_sections),
    c AS (SELECT count(*) AS docs, avg(coalesce(len(t), 0)) AS avg_n FROM d),
    tf AS (SELECT section_uid, len(t) AS n, term, count(*) AS tf FROM (SELECT section_uid, t, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest({_sql_tokens('text')}) AS term FROM ({_QUERIED})),
    s AS (SELECT item_id, section_uid, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_n))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), c GROUP BY item_id, section_uid),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, section_uid) AS rank FROM s)
    SELECT item_id, section_uid, score FROM r WHERE rank <= 10"""
)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_t(spark, sf_dir, "rfp_sections").select("section_uid", "text")).select("section_uid", text.tokens("text").alias("tokens"))
    asked = _t(spark, sf_dir, "prompt_injection_ko").where("item_id % 100 = 0").select("item_id", text.tokens("text").alias("asked"))
    return retrieval.bm25(docs, "section_uid", "tokens", asked, "item_id", "asked", 10).select("item_id", "section_uid", "score")


@_query(
    f"""WITH t AS (SELECT item_id, {_sql_tokens('text')} AS t FROM prompt_injection_ko WHERE text IS NOT NULL),
    f AS (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS f FROM t),
    s AS (SELECT item_id, (('0x' || substr(md5(f), 1, 8))::BIGINT % 384)::INT AS slot, sum(CASE WHEN ('0x' || substr(md5(f), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM f GROUP BY 1, 2),
    n AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM s GROUP BY 1)
    SELECT item_id, slot, round((w / l)::DOUBLE, 6) AS weight FROM s JOIN n USING (item_id) WHERE w <> 0"""
)
def search_hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", text.tokens("text").alias("t"))
    return retrieval.hashed_features(df, "item_id", "t").withColumn("weight", F.round("weight", 6))


@_query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"""
)
def search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return retrieval.dense_top_k(e, "vec_id", "embedding", asked, "query_id", "asked", 10)


_HITS = "SELECT query_id, chunk_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS score, max(-chunk_seq_in_section) AS early, max(doc_id) AS doc_id, max(parent_section_id) AS parent_section_id, max(run_name) AS run_name FROM answer GROUP BY query_id, chunk_id"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score")
    rest = [F.max(c).alias(c) for c in ("doc_id", "parent_section_id", "run_name")]
    return _t(spark, sf_dir, "answer").groupBy("query_id", "chunk_id").agg(score, F.max(-F.col("chunk_seq_in_section")).alias("early"), *rest)


@_query(
    f"""WITH h AS ({_HITS}), r AS (SELECT query_id, chunk_id,
        row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 4) DESC, chunk_id DESC) - 1 AS a,
        row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(early::DOUBLE, 0), 4) DESC, chunk_id DESC) - 1 AS b FROM h)
    SELECT query_id, chunk_id, round((1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b)) * 60 / 2, 6) AS rrf FROM r"""
)
def search_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(_hits(spark, sf_dir), ["query_id"], "chunk_id", ["score", "early"]).select("query_id", "chunk_id", "rrf")


@_query(
    f"""WITH h AS ({_HITS}), p AS (SELECT *, list_position(['full', 'no_rerank', 'naive_baseline'], run_name) AS pos, row_number() OVER (PARTITION BY query_id, run_name ORDER BY score DESC NULLS LAST, chunk_id) AS k FROM h),
    f AS (SELECT *, CASE WHEN pos > 0 AND k <= 2 THEN 0 ELSE 1 END AS first, CASE WHEN pos > 0 AND k <= 2 THEN pos ELSE 0 END AS t FROM p),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, score DESC NULLS LAST, t, chunk_id) AS n FROM f)
    SELECT query_id, chunk_id, run_name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, first, t, chunk_id)::INT AS rank FROM c WHERE n <= 6"""
)
def search_balanced_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.balanced_top_k(_hits(spark, sf_dir), ["query_id"], "run_name", ["full", "no_rerank", "naive_baseline"], "score", "chunk_id", 6, 2)
    return best.select("query_id", "chunk_id", "run_name", "rank")


@_query(
    f"""WITH h AS ({_HITS}), b AS (SELECT query_id, parent_section_id, max(coalesce(score, -1)) AS score, arg_max(chunk_id, (coalesce(score, -1), chunk_id)) AS best_chunk, count(*) AS n_hits FROM h WHERE parent_section_id IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT section_id, max(section_uid) AS section_uid FROM rfp_sections GROUP BY 1)
    SELECT query_id, parent_section_id, score, best_chunk, n_hits, section_uid, section_id IS NULL AS parent_missing FROM b LEFT JOIN s ON parent_section_id = section_id"""
)
def search_parent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).where("parent_section_id is not null").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    parents = _t(spark, sf_dir, "rfp_sections").groupBy("section_id").agg(F.max("section_uid").alias("section_uid"))
    return ranking.reassembled_parents(hits, ["query_id"], "parent_section_id", "chunk_id", "score", parents, "section_id")


@_query("SELECT DISTINCT query_id, chunk_id, round(('0x' || substr(sha256(query_id || chr(0) || chunk_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS score FROM answer WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL")
def search_random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "answer").where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id").distinct()
    return df.withColumn("score", F.round(retrieval.random_score(F.col("query_id"), F.col("chunk_id")), 9))


_COMPACT = registry.COMPACT


@_query(
    f"""WITH t AS (SELECT DISTINCT field, value, {_COMPACT.format('value')} AS c, list_distinct({_sql_tokens('nfc_normalize(value)')}) AS tk FROM (SELECT 'agency' AS field, agency AS value FROM rfp_documents UNION ALL SELECT 'project', project FROM rfp_documents) WHERE value IS NOT NULL),
    q AS (SELECT item_id, {_COMPACT.format('text')} AS c, list_distinct({_sql_tokens('nfc_normalize(text)')}) AS tk FROM prompt_injection_ko WHERE text IS NOT NULL),
    m AS (SELECT item_id, field, value, length(t.c) >= 2 AND contains(q.c, t.c) AS whole, len(list_intersect(q.tk, t.tk)) AS n, len(t.tk) AS k FROM q, t WHERE t.c <> '')
    SELECT item_id, field, value, CASE WHEN whole THEN 1.0 ELSE round(least(0.89, 0.70 + 0.19 * n::DOUBLE / k), 3) END::DOUBLE AS confidence, CASE WHEN whole THEN 'compact_contains' ELSE 'partial_tokens' END AS match_type FROM m WHERE whole OR n >= 2"""
)
def match_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = matching.metadata_targets(_t(spark, sf_dir, "rfp_documents"))
    return matching.metadata_matches(_t(spark, sf_dir, "prompt_injection_ko"), "item_id", "text", targets)


_GENERIC = "[" + ", ".join(f"'{w}'" for w in matching.GENERIC) + "]"
_N = "nfc_normalize({})"


@_query(
    f"""WITH v AS (SELECT 'agency' AS field, {_sql_strip('agency')} AS value, NULL AS al FROM rfp_documents UNION ALL SELECT 'project', {_sql_strip('project')}, project_aliases FROM rfp_documents UNION ALL SELECT 'title', {_sql_strip('title')}, NULL FROM rfp_documents),
    a AS (SELECT field, value, list({_sql_strip('x')}) AS al FROM (SELECT field, value, unnest(al) AS x FROM v) WHERE {_sql_strip('x')} <> '' GROUP BY 1, 2),
    t AS (SELECT d.field, d.value, {_COMPACT.format(_N.format('d.value'))} AS c, {_sql_tokens(_N.format('d.value'))} AS tk, list_distinct(coalesce(a.al, [])) AS al FROM (SELECT DISTINCT field, value FROM v WHERE value <> '') d LEFT JOIN a ON a.field = d.field AND a.value = d.value),
    u AS (SELECT *, CASE WHEN len(list_filter(tk, lambda w: NOT list_contains({_GENERIC}, w))) > 0 THEN list_filter(tk, lambda w: NOT list_contains({_GENERIC}, w)) ELSE tk END AS core,
        CASE WHEN field = 'agency' THEN list_concat(list_filter(tk, lambda w: length(w) <= 4 AND regexp_matches(w, '[a-z0-9]')), CASE WHEN starts_with(c, '기관') AND length(c) > 2 THEN [substr(c, 3)] ELSE [] END) ELSE [] END AS ab,
        list_transform(al, lambda y: {{'c': {_COMPACT.format(_N.format('y'))}, 'tk': {_sql_tokens(_N.format('y'))}}}) AS ax FROM t),
    q AS (SELECT item_id, {_COMPACT.format(_N.format('text'))} AS qc, {_sql_tokens(_N.format('text'))} AS qt FROM prompt_injection_ko WHERE text IS NOT NULL),
    m AS (SELECT item_id, field, value, len(core) AS k, list_filter(core, lambda w: list_contains(qt, w)) AS o, length(c) >= 2 AND contains(qc, c) AS whole,
        len(list_filter(ax, lambda y: (y.c <> '' AND contains(qc, y.c)) OR (len(y.tk) > 0 AND list_has_all(qt, y.tk)))) > 0 AS named,
        len(list_filter(ab, lambda y: list_contains(qt, y) OR (length(y) >= 2 AND contains(qc, y)))) > 0 AS short FROM q, u),
    r AS (SELECT *, len(o) = 1 AND field IN ('project', 'title') AND k <= 2 AND length(o[1]) >= 3 AS single FROM m)
    SELECT DISTINCT item_id, field, value, CASE WHEN whole THEN 1.0 WHEN named THEN 0.92 WHEN short THEN 0.78 WHEN len(o) >= 2 THEN round(least(0.89, 0.70 + 0.19 * len(o)::DOUBLE / k), 3) ELSE 0.72 END::DOUBLE AS confidence,
    CASE WHEN whole THEN 'compact_contains' WHEN named THEN 'explicit_alias' WHEN short THEN 'abbreviation' ELSE 'partial_tokens' END AS match_type FROM r WHERE whole OR named OR short OR len(o) >= 2 OR single"""
)
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade but its fuzzy end, which is match_fuzzy: agencies, projects and titles, with the projects' aliases."""
    docs = _t(spark, sf_dir, "rfp_documents")
    return matching.cascade_matches(_t(spark, sf_dir, "prompt_injection_ko"), "item_id", "text", docs, aliases={"project": "project_aliases"})


@_query()
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that nearly spell a metadata value; no SQL has the ratio, so brute force tests it."""
    targets = matching.metadata_targets(_t(spark, sf_dir, "rfp_documents"))
    return matching.fuzzy_matches(_t(spark, sf_dir, "prompt_injection_ko"), "item_id", "text", targets)


@_query(
    """WITH p AS (SELECT * FROM (VALUES ('STANDARD', 1.0), ('STAN', 0.5), ('SMALL', 2.0), ('E', 3.0), ('ECONOMY', 4.0)) v(prefix, price))
    SELECT p_partkey, arg_max(prefix, length(prefix)) AS prefix, arg_max(price, length(prefix))::DOUBLE AS price FROM part LEFT JOIN p ON starts_with(p_type, prefix) GROUP BY p_partkey"""
)
def match_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("STANDARD", 1.0), ("STAN", 0.5), ("SMALL", 2.0), ("E", 3.0), ("ECONOMY", 4.0)], "prefix string, price double")
    return matching.longest_prefix(_t(spark, sf_dir, "part"), F.col("p_type"), prices, "prefix").select("p_partkey", "prefix", "price")


# ---------------------------------------------------------------- evaluation


_DIST = "count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95"


@_query(f"SELECT CASE WHEN GROUPING(event_type) = 0 THEN 'event_type' WHEN GROUPING(bucket) = 0 THEN 'bucket' ELSE 'overall' END AS slice, coalesce(event_type, bucket) AS value, {_DIST} FROM (SELECT event_type, (user_id % 5)::VARCHAR AS bucket, value FROM events) GROUP BY GROUPING SETS ((), (event_type), (bucket))")
def eval_sliced_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("bucket"), F.col("value").alias("latency"))
    return statistics.sliced_distribution(df, ["event_type", "bucket"], "latency", 6).select("slice", "value", "n", F.round("mean", 4).alias("mean"), "p50", "p95")


@_query(
    """WITH r AS (SELECT run_name, score AS c, CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END AS h FROM answer WHERE score BETWEEN 0 AND 1 AND NOT isnan(score)),
    b AS (SELECT run_name, least(floor(c * 10), 9) AS bin, count(*) AS k, avg(c) AS c, avg(h) AS h, sum((c - h) * (c - h)) AS b FROM r GROUP BY 1, 2)
    SELECT run_name, sum(k)::BIGINT AS n, round(sum(k * abs(h - c)) / sum(k), 6) AS ece, round(sum(b) / sum(k), 6) AS brier FROM b GROUP BY 1"""
)
def eval_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "answer").withColumn("held", F.col("text").isNotNull())
    return statistics.calibration(df, ["run_name"], "score", "held")


_SCREENED = f"SELECT label, CASE WHEN len(list_filter([{_LABELS}], lambda x: x IS NOT NULL)) > 0 THEN 'attack' ELSE 'benign' END AS given FROM prompt_injection_ko"


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "prompt_injection_ko").withColumn("given", F.when(F.size(text.injection_labels("text")) > 0, "attack").otherwise("benign"))


@_query(f"SELECT t.label AS truth, count(*) FILTER (WHERE given = 'attack') AS attack, count(*) FILTER (WHERE given = 'benign') AS benign FROM (VALUES ('attack'), ('benign')) t(label) LEFT JOIN ({_SCREENED}) s ON s.label = t.label GROUP BY 1")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.confusion(_screened(spark, sf_dir), "label", "given", ["attack", "benign"])


@_query(
    f"""WITH s AS (SELECT * FROM ({_SCREENED}) WHERE label IS NOT NULL), n AS (SELECT count(*) AS n, avg((label = given)::INT) AS po FROM s),
    a AS (SELECT label AS x, count(*) AS k FROM s GROUP BY 1), b AS (SELECT given AS x, count(*) AS k FROM s GROUP BY 1),
    c AS (SELECT coalesce(sum(a.k * b.k), 0) AS both_k FROM a JOIN b USING (x))
    SELECT n, round(po, 6) AS agreement, round((po - both_k / (n * n)) / (1 - both_k / (n * n)), 6) AS kappa FROM n, c"""
)
def eval_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.kappa(_screened(spark, sf_dir), "label", "given")


@_query(
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1"""
)
def eval_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spearman(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@_query(
    """WITH c AS (SELECT l_extendedprice, max(l_quantity) AS g FROM lineitem GROUP BY 1), s AS (SELECT *, max(g) OVER (ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem JOIN s USING (l_extendedprice) WHERE l_quantity = g AND (before IS NULL OR g > before)"""
)
def eval_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.skyline(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


_CUTS = "[" + ", ".join(f"{x:.9f}::DOUBLE" for x in statistics.poisson_cuts()) + "]"
_P, _A1, _A2, _A3 = statistics.PRIME, statistics.FIRST, statistics.SECOND, statistics.THIRD


def _sql_bootstrap(rows: str, by: str, seed: int = 17) -> str:
    """Intervals of the rows (by, h, v), by the same draws: (by, n, mean, ci_lo, ci_hi)."""
    return f"""SELECT {by}, max(n)::BIGINT AS n, round(max(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM (
        SELECT {by}, b, sum(v * w) / nullif(sum(w), 0) AS m, count(*) AS n, avg(v) AS mean FROM (
            SELECT {by}, b, v, len(list_filter({_CUTS}, lambda c: u >= c)) AS w FROM (
                SELECT {by}, b, v, ((y * y % {_P} * {_A2} + k) % {_P}) / {_P}::DOUBLE AS u FROM (
                    SELECT {by}, b, v, k, (x * x % {_P} * {_A3} + b * {_A1} + {seed}) % {_P} AS y FROM (
                        SELECT {by}, b, v, h % {_P} AS k, (h % {_P} * {_A1} + (b + {seed}) * {_A2}) % {_P} AS x FROM ({rows}), (SELECT unnest(range({statistics.RESAMPLES})) AS b))))) GROUP BY {by}, b) GROUP BY {by}"""


@_query(_sql_bootstrap("SELECT run_name, evidence_id AS h, score AS v FROM answer WHERE score IS NOT NULL AND NOT isnan(score)", "run_name"))
def eval_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each run with its interval; the draws follow from the rows' keys."""
    return statistics.bootstrap_mean(_t(spark, sf_dir, "answer"), ["run_name"], "evidence_id", "score")


@_query(
    """WITH k AS (SELECT query_id, chunk_id, run_name, avg(score) AS s FROM answer WHERE run_name IN ('naive_baseline', 'full') AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3)
    SELECT a.query_id, a.chunk_id, round(a.s, 4) AS base, round(b.s, 4) AS candidate FROM k a JOIN k b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND a.run_name = 'naive_baseline' AND b.run_name = 'full'"""
)
def eval_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.paired(_t(spark, sf_dir, "answer"), ["query_id", "chunk_id"], "run_name", "naive_baseline", "full", "score")
    return out.select("query_id", "chunk_id", F.round("base", 4).alias("base"), F.round("candidate", 4).alias("candidate"))


_RANKED = """SELECT query_id, run_name, list(chunk_id ORDER BY score DESC, chunk_id) AS ranked FROM
    (SELECT query_id, run_name, chunk_id, max(score) AS score FROM answer WHERE score IS NOT NULL AND NOT isnan(score) AND chunk_id IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@_query(
    f"""WITH r AS ({_RANKED}), g AS (SELECT query_id, ranked[1:3] AS gold FROM r WHERE run_name = 'full'),
    j AS (SELECT r.query_id, run_name, ranked, gold FROM r JOIN g USING (query_id))
    SELECT query_id, run_name,
        round(len(list_intersect(ranked[1:1], gold)) / len(gold)::DOUBLE, 6) AS recall_at_1, round(len(list_intersect(ranked[1:5], gold)) / len(gold)::DOUBLE, 6) AS recall_at_5,
        round(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(range(1, len(ranked) + 1), lambda i: CASE WHEN list_contains(gold, ranked[i]) THEN i END), lambda x: x IS NOT NULL)), 0), 6) AS mrr,
        round(coalesce(list_sum(list_transform(range(1, least(len(ranked), 10) + 1), lambda i: CASE WHEN list_contains(gold, ranked[i]) THEN 1.0::DOUBLE / log2(i + 1.0::DOUBLE) ELSE 0 END)), 0) / list_sum(list_transform(range(1, len(gold) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6) AS ndcg_at_10 FROM j"""
)
def eval_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the three best chunks of the run `full`."""
    rows = _t(spark, sf_dir, "answer").where("score is not null and not isnan(score) and chunk_id is not null and query_id is not null")
    rows = rows.groupBy("query_id", "run_name", "chunk_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", "run_name").orderBy(F.col("score").desc(), "chunk_id"))
    ranked = staged(rows.select("query_id", "run_name", "chunk_id", place.alias("rank")), "ranked")
    gold = ranked.where("run_name = 'full' and rank <= 3").select("query_id", "chunk_id")
    scored = evaluation.ranked_metrics(ranked, ["query_id", "run_name"], "chunk_id", "rank", gold, ["query_id"], (1, 5))
    return scored.select("query_id", "run_name", *(F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr", "ndcg_at_10")))


_DELIVERED = f"SELECT section_id, section_uid, {_sql_tokens('text')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY section_id, delivery_no ORDER BY section_uid) AS k FROM rfp_sections) WHERE k = 1 AND delivery_no = "


@_query(
    f"""WITH l AS (SELECT section_id, x, count(*) AS l FROM (SELECT section_id, unnest(t) AS x FROM ({_DELIVERED}1)) GROUP BY 1, 2), r AS (SELECT section_id, x, count(*) AS r FROM (SELECT section_id, unnest(t) AS x FROM ({_DELIVERED}2)) GROUP BY 1, 2),
    s AS (SELECT section_id, sum(least(coalesce(l, 0), coalesce(r, 0)))::BIGINT AS common, sum(coalesce(l, 0))::BIGINT AS n_left, sum(coalesce(r, 0))::BIGINT AS n_right FROM l FULL JOIN r USING (section_id, x) GROUP BY 1)
    SELECT section_id, common, n_left, n_right, round(common / nullif(n_left, 0)::DOUBLE, 6) AS precision, round(common / nullif(n_right, 0)::DOUBLE, 6) AS recall,
        round(CASE WHEN common > 0 THEN 2.0::DOUBLE * (common / n_left::DOUBLE) * (common / n_right::DOUBLE) / (common / n_left::DOUBLE + common / n_right::DOUBLE) ELSE 0 END, 6) AS f1 FROM s"""
)
def eval_redelivery_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the first and the second delivery of a section share."""
    rows = _t(spark, sf_dir, "rfp_sections").select("section_id", "delivery_no", "section_uid", "text")
    first = rows.groupBy("section_id", "delivery_no").agg(F.min_by(F.struct("text"), "section_uid").alias("s"))
    first = first.select("section_id", "delivery_no", text.tokens(F.col("s.text")).alias("t"))
    return evaluation.bag_scores(first.where("delivery_no = 1"), first.where("delivery_no = 2"), "section_id", "t")


@_query("SELECT a.p_partkey, round(CASE WHEN greatest(length(a.p_name), length(b.p_name)) > 0 THEN 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE ELSE 1 END, 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def eval_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return part.join(nxt, "p_partkey").select("p_partkey", F.round(evaluation.text_similarity(F.col("p_name"), F.col("next_name")), 6).alias("similarity"))


_CASES = """SELECT run_name, query_id, count(*) AS n, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS best, count(text) AS held, list_distinct(list(doc_id) FILTER (WHERE doc_id IS NOT NULL AND text IS NOT NULL)) AS docs,
    list_distinct(list(doc_id) FILTER (WHERE doc_id IS NOT NULL)) AS wanted FROM answer WHERE query_id IS NOT NULL GROUP BY 1, 2"""
_CATEGORY = """SELECT run_name, CASE WHEN answerable AND coalesce(accuracy = 1.0, false) THEN NULL WHEN NOT answerable AND abstained AND coalesce(len(docs), 0) = 0 THEN NULL
    WHEN NOT answerable AND NOT abstained THEN 'verifier_false_negative' WHEN answerable AND abstained AND held > 0 THEN 'verifier_false_positive'
    WHEN answerable AND len(wanted) > 0 AND coalesce(len(list_intersect(wanted, docs)), 0) = 0 THEN 'retrieval_miss' WHEN kind = 'comparison' AND n <= 1 THEN 'planner_under_decomposition'
    WHEN best < 0.5 THEN 'generator_hallucination' ELSE 'unknown' END AS category FROM (SELECT *, coalesce(best, 0) >= 0.18 AS answerable, held / n::DOUBLE AS accuracy, held = 0 AS abstained, CASE WHEN len(wanted) > 1 THEN 'comparison' ELSE 'single_doc' END AS kind FROM ({}))"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case a run and query; its lists hold one query's documents."""
    score = F.max(F.when(~F.isnan("score"), F.col("score")))
    docs = lambda c: F.array_compact(F.collect_set(c))
    cases = _t(spark, sf_dir, "answer").where("query_id is not null").groupBy("run_name", "query_id").agg(
        F.count("*").alias("n"), score.alias("best"), F.count("text").alias("held"),
        docs(F.when(F.col("text").isNotNull(), F.col("doc_id"))).alias("docs"), docs(F.col("doc_id")).alias("wanted"),
    )
    c = F.col
    category = evaluation.failure_category(
        F.coalesce(c("best"), F.lit(0.0)) >= 0.18, c("held") / c("n"), c("held") == 0, c("docs"), c("wanted"), c("held") > 0,
        F.when(F.size("wanted") > 1, "comparison").otherwise("single_doc"), c("n"), c("best"),
    )
    return cases.withColumn("category", category)


@_query(
    f"""WITH f AS ({_CATEGORY.format(_CASES)}), k AS (SELECT category, count(*) AS n FROM f WHERE category IS NOT NULL GROUP BY 1)
    SELECT c AS category, coalesce(n, 0) AS n, round(coalesce(n / nullif(sum(n) OVER (), 0)::DOUBLE, 0), 6) AS share FROM (SELECT unnest([{", ".join(f"'{x}'" for x in evaluation.FAILURES)}]) AS c) LEFT JOIN k ON c = category"""
)
def eval_failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.category_counts(_cases(spark, sf_dir), "category", evaluation.FAILURES)


@_query(
    f"""WITH c AS ({_CASES}), l AS (SELECT run_name, unnest(list_concat(['overall'], wanted)) AS label, held / n::DOUBLE AS share, held FROM c)
    SELECT label, count(*) AS cases, round(avg(share), 4) AS held_share, count(*) FILTER (WHERE held = 0) AS refused FROM l GROUP BY 1"""
)
def eval_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = [F.count("*").alias("cases"), F.round(F.avg(F.col("held") / F.col("n")), 4).alias("held_share"), F.count_if(F.col("held") == 0).alias("refused")]
    return statistics.by_labels(_cases(spark, sf_dir), "wanted", metrics)


_P95 = "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1"


@_query(f"SELECT coalesce(a.event_type, b.event_type) AS event_type, p95, ceiling::DOUBLE AS ceiling, CASE WHEN p95 IS NULL OR ceiling IS NULL THEN 'orphan' WHEN p95 > ceiling THEN 'violation' ELSE 'pass' END AS verdict FROM ({_P95}) a FULL JOIN (VALUES ('click', 100.0), ('view', 200.0), ('retired', 50.0)) b(event_type, ceiling) ON a.event_type = b.event_type")
def eval_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = statistics.percentiles(_t(spark, sf_dir, "events"), ["event_type"], "value", (0.95,), places=4).select("event_type", "p95")
    budgets = spark.createDataFrame([("click", 100.0), ("view", 200.0), ("retired", 50.0)], "event_type string, ceiling double")
    return statistics.budget_check(measured, budgets, "event_type", "p95", "ceiling")


_RATES = "SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM events WHERE user_id % 2 = {} GROUP BY 1"


@_query(
    f"""WITH a AS (UNPIVOT ({_RATES.format(0)}) ON mean, median INTO NAME metric VALUE v), b AS (UNPIVOT ({_RATES.format(1)}) ON mean, median INTO NAME metric VALUE v)
    SELECT event_type, metric, round(a.v, 4) AS base, round(b.v, 4) AS head FROM a JOIN b USING (event_type, metric) WHERE b.v - a.v < -0.5"""
)
def eval_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that fall from the even to the odd users by more than half a unit."""
    both = _t(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("half"), "event_type", "value")
    measured = statistics.percentiles(both, ["half", "event_type"], "value", (0.5,))
    rates = measured.select("half", "event_type", (F.col("total") / F.col("n")).alias("mean"), F.col("p50").alias("median"))
    half = lambda k: rates.where(F.col("half") == k).drop("half")
    out = statistics.regressions(half(0), half(1), "event_type", ["mean", "median"], 0.5)
    return out.select("event_type", "metric", F.round("base", 4).alias("base"), F.round("head", 4).alias("head"))


@_query(
    """WITH n AS (SELECT *, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+$', '', 'g') AS s FROM answer),
    e AS (SELECT *, regexp_replace(s, '[)\\]}"\\x27」』”’》〉】]+$', '', 'g') AS b FROM n)
    SELECT lower(chunking_strategy) AS strategy, count(*) AS chunks, count(DISTINCT doc_id) AS documents, quantile_cont(coalesce(length(text), 0), 0.5) AS p50, quantile_cont(coalesce(length(text), 0), 0.95) AS p95, max(coalesce(length(text), 0))::INT AS longest,
        round(avg(coalesce(length(text), 0)), 6) AS mean, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS empty, count(*) FILTER (WHERE length(text) > 0 AND length(text) < 50) AS near_empty,
        round(avg(CASE WHEN length(text) > 0 THEN (b <> '' AND NOT regexp_matches(b, '[.!?。…다음임함됨요]$'))::INT::DOUBLE END), 6) AS mid_sentence_share,
        sum(coalesce(len(regexp_extract_all(text, '\\[중첩 테이블 #[0-9]+\\]')), 0))::BIGINT AS nested_tables FROM e GROUP BY 1"""
)
def quality_chunk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(_t(spark, sf_dir, "answer").select("chunking_strategy", "text", "doc_id")).withColumn("strategy", F.lower("chunking_strategy"))
    return quality.chunk_health(df, ["strategy"], "text", "doc_id")


@_query(
    f"""WITH h AS ({_HITS}), r AS (SELECT query_id, chunk_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank, first_value(doc_id) OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS own FROM h WHERE doc_id IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ('0x' || substr(sha256(query_id || '|' || chunk_id), 1, 8))::BIGINT, chunk_id)::INT AS draw FROM r WHERE rank BETWEEN 3 AND 20 AND doc_id <> own)
    SELECT query_id, chunk_id, draw FROM p WHERE draw <= 3"""
)
def search_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks a query from ranks 3 to 20 that are of another document than the best one."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "chunk_id")
    hits = _hits(spark, sf_dir).where("doc_id is not null").withColumn("rank", F.row_number().over(w)).withColumn("own", F.first("doc_id").over(w))
    pool = hits.where(F.col("doc_id") != F.col("own")).drop("own").withColumn("own", F.lit(""))
    return retrieval.hard_negatives(pool, "query_id", "chunk_id", "own", 3, 20, 3).select("query_id", "chunk_id", "draw")


@_query(
    f"""WITH h AS ({_HITS}), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS n FROM h)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n <= 5 DESC, CASE WHEN n <= 5 THEN early END DESC NULLS LAST, n)::INT AS rank FROM b"""
)
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of each query in the order of their section, the others after them."""
    return ranking.reranked(_hits(spark, sf_dir), ["query_id"], "score", "chunk_id", F.col("early"), 5).select("query_id", "chunk_id", "rank")


@_query(f"SELECT DISTINCT field, value, {_COMPACT.format('value')} AS compact FROM (SELECT 'agency' AS field, agency AS value FROM rfp_documents UNION ALL SELECT 'project', project FROM rfp_documents) WHERE {_COMPACT.format('value')} <> ''")
def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.metadata_targets(_t(spark, sf_dir, "rfp_documents")).select("field", "value", "compact")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@_query(
    f"""WITH b AS (SELECT doc_row_id, lower(regexp_replace(title, '{_SPACE}+', '', 'g')) AS a, lower(regexp_replace(project, '{_SPACE}+', '', 'g')) AS b FROM rfp_documents WHERE title IS NOT NULL AND project IS NOT NULL),
    g AS (SELECT doc_row_id, CASE WHEN length(a) >= 3 THEN {_GRAMS.format('a')} ELSE [] END AS x, CASE WHEN length(b) >= 3 THEN {_GRAMS.format('b')} ELSE [] END AS y FROM b)
    SELECT doc_row_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0)::DOUBLE, 0), 6) AS overlap FROM g"""
)
def match_title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams that title and project share."""
    df = _t(spark, sf_dir, "rfp_documents").where("title is not null and project is not null")
    return df.select("doc_row_id", F.round(text.jaccard(text.char_grams("title"), text.char_grams("project")), 6).alias("overlap"))


@_query(
    """WITH s AS (SELECT doc_id, section_no, max(page_span[1]) AS a, max(page_span[2]) AS b FROM rfp_sections WHERE len(page_span) = 2 GROUP BY 1, 2)
    SELECT x.doc_id, x.section_no, round(greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 1) / ((x.b - x.a + 1) + (y.b - y.a + 1) - greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 1))::DOUBLE, 6) AS iou FROM s x JOIN s y ON x.doc_id = y.doc_id AND y.section_no = x.section_no + 1"""
)
def layout_page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that neighbouring sections share."""
    span = F.array(F.max(F.col("page_span")[0]), F.max(F.col("page_span")[1])).alias("span")
    s = _t(spark, sf_dir, "rfp_sections").where("size(page_span) = 2").groupBy("doc_id", "section_no").agg(span)
    nxt = s.select("doc_id", (F.col("section_no") - 1).alias("section_no"), F.col("span").alias("next_span"))
    return s.join(nxt, ["doc_id", "section_no"]).select("doc_id", "section_no", F.round(numbers.span_iou(F.col("span"), F.col("next_span")), 6).alias("iou"))


@_query(
    f"""SELECT section_uid, count(*) AS n_lines, count(*) FILTER (WHERE {_sql_strip('l')} = '') AS n_blank FROM (SELECT section_uid, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l FROM rfp_sections WHERE text IS NOT NULL) GROUP BY 1"""
)
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.lines(_t(spark, sf_dir, "rfp_sections"), "section_uid", "text")
    return rows.groupBy("section_uid").agg(F.count("*").alias("n_lines"), F.count_if(text.strip("line") == "").alias("n_blank"))


@_query(
    f"""SELECT run_name, CASE WHEN held = 0 AND coalesce(len(wanted), 0) = 0 THEN 'correct_refusal' WHEN held = 0 THEN 'boundary_partial' ELSE 'incorrect_answer' END AS outcome, count(*) AS n FROM ({_CASES}) WHERE coalesce(best, 0) < 0.5 GROUP BY 1, 2"""
)
def eval_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the cases whose best evidence is weak."""
    weak = _cases(spark, sf_dir).where(F.coalesce(F.col("best"), F.lit(0.0)) < 0.5)
    outcome = evaluation.abstention_outcome(F.col("held") == 0, F.size("wanted") > 0)
    return weak.groupBy("run_name", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@_query(
    """WITH r AS (SELECT run_name, avg(score) AS m FROM answer WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1)
    SELECT a.run_name, round((a.m - b.m) / (1 - b.m), 6) AS gauge FROM r a, r b WHERE b.run_name = 'naive_baseline'"""
)
def eval_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each run's mean score lies between the baseline's and 1."""
    means = _t(spark, sf_dir, "answer").where("score is not null and not isnan(score)").groupBy("run_name").agg(F.avg("score").alias("m"))
    floor = means.where("run_name = 'naive_baseline'").select(F.col("m").alias("floor"))
    return means.crossJoin(F.broadcast(floor)).select("run_name", F.round(evaluation.gauge(F.col("m"), F.col("floor")), 6).alias("gauge"))  # one row of floor


@_query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def eval_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.percentiles(_t(spark, sf_dir, "events"), ["event_type"], "value", (0.5, 0.95), nearest=True).select("event_type", "p50", "p95")


@_query(
    """WITH d AS (SELECT lower(chunking_strategy) AS strategy, doc_id, count(DISTINCT chunk_id) AS n FROM answer GROUP BY 1, 2)
    SELECT strategy, count(*) AS documents, round(avg(n), 6) AS mean_chunks, max(n) AS most_chunks, quantile_cont(n, 0.5) AS p50 FROM d GROUP BY 1"""
)
def quality_chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "answer").groupBy(F.lower("chunking_strategy").alias("strategy"), "doc_id").agg(F.count_distinct("chunk_id").alias("n"))
    per = staged(per, "chunks")
    most = per.groupBy(F.col("strategy").alias("s")).agg(F.max("n").alias("most_chunks"))
    found = statistics.percentiles(per, ["strategy"], "n", (0.5,)).join(most, F.col("s").eqNullSafe(F.col("strategy")))
    return found.select("strategy", F.col("n").alias("documents"), F.round(F.col("total") / F.col("n"), 6).alias("mean_chunks"), "most_chunks", "p50")


# ---------------------------------------------------------------- order and state


@_query(
    """WITH m AS (SELECT *, row_number() OVER w AS r, lag(event_type) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, sum(CASE WHEN r = 1 OR l IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM m)
    SELECT user_id, run_no::BIGINT AS run_no, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY 1, 2, 3"""
)
def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.runs(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS turn_no, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), ',') AS recent FROM events")
def order_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dialogue.recent_turns(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")
    return out.select("event_id", "turn_no", F.array_join("recent", ",").alias("recent"))


@_query("SELECT l AS from_state, event_type AS to_state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events) WHERE l IS NOT NULL GROUP BY 1, 2")
def order_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.transitions(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@_query(
    """WITH RECURSIVE t AS (SELECT event_id AS k, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events),
    c AS (SELECT k, p, 0 AS d FROM t UNION ALL SELECT c.k, t.p, d + 1 FROM c JOIN t ON c.p = t.k WHERE d < 16)
    SELECT k AS event_id, max(d)::INT AS depth FROM c GROUP BY 1"""
)
def order_chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each event in the chain of its user's earlier events of its type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = _t(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("parent"))
    return dialogue.chain_depth(rows, "event_id", "parent")


#: Arrivals of the event stream: triggers, which rows come late, and by how many triggers.
_TRIGGERS, _LATE, _BY = 5, "event_id % 97 = 5", 3


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in equal stretches of time, some of which come in a later stretch than their own; with batch and whether they are late."""
    events = _t(spark, sf_dir, "events").where("ts is not null")
    span = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"))
    at = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("lo")) * _TRIGGERS / (F.col("hi") - F.col("lo") + 1)), F.lit(_TRIGGERS - 1)).cast("int")
    late = F.expr(_LATE) & (F.col("own") + _BY < _TRIGGERS)
    rows = events.crossJoin(F.broadcast(span)).withColumn("own", at).withColumn("late", late)  # one row of the span
    return rows.withColumn("batch", F.when(F.col("late"), F.col("own") + _BY).otherwise(F.col("own"))).drop("lo", "hi", "own")


@_query(
    f"""WITH s AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, max(ts) AS newest FROM events),
    e AS (SELECT events.*, newest, least(((epoch_us(ts) - lo) * {_TRIGGERS}) // (hi - lo + 1), {_TRIGGERS - 1}) AS own FROM events, s)
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e
    WHERE NOT ({_LATE} AND own + {_BY} < {_TRIGGERS}) GROUP BY 1, 2, newest HAVING window_start + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as they close; rows that come days late are left out, and the last hours stay open."""
    stream = windows.arriving(_arrivals(spark, sf_dir), "batch", _TRIGGERS).withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.drained(windows.windowed(stream, "ts", ["event_type"], "value"), "windows")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@_query("SELECT user_id, count(*) AS turns, array_to_string(list(event_type ORDER BY ts)[-12:], ',') AS recent FROM events GROUP BY 1")
def stream_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns of every user after all triggers; late rows find their place among the earlier ones."""
    recent = windows.recent_by_user(windows.arriving(_arrivals(spark, sf_dir), "batch", _TRIGGERS), "user_id", "ts", "event_type")
    return windows.drained(recent, "recent", "update", "user_id").withColumn("recent", F.array_join("recent", ","))


@_query("SELECT q.vec_id, round(list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5) AS dot, round(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) AS length FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1")
def vectors_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = e.join(nxt, "vec_id")
    return both.select("vec_id", F.round(vectors.dot("embedding", "other"), 5).alias("dot"), F.round(vectors.norm("embedding"), 5).alias("length"))


def queries() -> dict[str, Query]:
    from . import evaluation_queries, retrieval_queries, source_queries  # noqa: F401  # they enter their own

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)
