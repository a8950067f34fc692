"""Queries of retrieval as one plan, of grounding, and of amounts, dates and structure within texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import amounts, text, vectors
from .operators import grounding, layout, matching, ranking, retrieval, statistics, wordsearch
from .plans import presets
from .plans.staging import BROADCAST_ROWS, spread, staged
from .registry import SPACE, SQL, query, sql_strip, sql_tokens, table

_FIELDS = ("agency", "project", "title")
_GENERIC = "[" + ", ".join(f"'{w}'" for w in matching.GENERIC) + "]"


def _sql_topics(column: str) -> str:
    """The first few distinct words, in order."""
    words = f"list_filter({sql_tokens(column)}, lambda t: length(t) > 1 AND NOT list_contains({_GENERIC}, t) AND NOT starts_with(t, '기관'))"
    return f"list_slice(list_filter({words}, lambda t, i: list_position({words}, t) = i), 1, {grounding.TOPICS})"


# ---------------------------------------------------------------- matches and documents

_DOCS = f"""WITH m AS ({SQL['match_cascade']}), b AS (SELECT DISTINCT doc_id, field, trim(value) AS value FROM (SELECT doc_id, 'agency' AS field, agency AS value FROM rfp_documents UNION ALL SELECT doc_id, 'project', project FROM rfp_documents UNION ALL SELECT doc_id, 'title', title FROM rfp_documents) WHERE doc_id IS NOT NULL AND value IS NOT NULL),
    d AS (SELECT item_id, doc_id, max(confidence) AS confidence FROM m JOIN b USING (field, value) GROUP BY 1, 2)"""


def _documents(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "rfp_documents")
    matches = matching.cascade_matches(asked, "item_id", "text", docs, fields=_FIELDS, aliases={"project": "project_aliases"})
    return grounding.document_matches(matches, "item_id", docs, "doc_id", _FIELDS)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prompt_injection_ko").where("item_id % 100 = 0 and text is not null").select("item_id", "text")


@query(f"{_DOCS} SELECT item_id, doc_id, confidence, CASE WHEN confidence >= 0.9 THEN 'strict' WHEN confidence >= 0.7 THEN 'reduced' END AS stage FROM d WHERE item_id % 100 = 0")
def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that queries lead to, each with its surest match."""
    return _documents(spark, sf_dir, _asked(spark, sf_dir))


@query(
    f"""{_DOCS}, t AS (SELECT *, max(confidence) OVER (PARTITION BY item_id) AS top_score FROM d WHERE confidence >= 0.7 AND item_id % 100 = 0)
    SELECT item_id, top_score, count(*) FILTER (WHERE confidence >= top_score - 0.05 - 1e-9) AS candidates, count(*) FILTER (WHERE confidence >= top_score - 0.05 - 1e-9) > 1 AS ambiguous FROM t GROUP BY 1, 2"""
)
def match_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.ambiguity(_documents(spark, sf_dir, _asked(spark, sf_dir)), "item_id", "doc_id")


_STAGES = f"""{_DOCS}, q AS (SELECT item_id, text FROM prompt_injection_ko WHERE item_id % 100 = 0 AND text IS NOT NULL), n AS (SELECT item_id, count(*) FILTER (WHERE confidence >= 0.9) AS s, count(*) FILTER (WHERE confidence >= 0.7) AS r FROM q LEFT JOIN d USING (item_id) GROUP BY 1),
    g AS (SELECT item_id, unnest(l) AS stage, generate_subscripts(l, 1)::INT AS attempt FROM (SELECT item_id, list_filter([CASE WHEN s > 0 THEN 'strict' END, CASE WHEN r > s THEN 'reduced' END, 'relaxed'], lambda x: x IS NOT NULL) AS l FROM n)),
    f AS (SELECT item_id, 'strict' AS stage, doc_id FROM d WHERE confidence >= 0.9 UNION ALL SELECT item_id, 'reduced', doc_id FROM d WHERE confidence >= 0.7)"""


@query(
    f"""{_STAGES}, k AS (SELECT item_id, stage, count(section_uid) AS kept FROM f JOIN rfp_sections USING (doc_id) GROUP BY 1, 2)
    SELECT item_id, stage, attempt, CASE WHEN coalesce(kept, 0) > 0 THEN kept ELSE (SELECT count(section_uid) FROM rfp_sections) END AS rows, coalesce(kept, 0) = 0 AND stage <> 'relaxed' AS fallback FROM g LEFT JOIN k USING (item_id, stage)"""
)
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections the search of a query looks at in each of its stages."""
    asked = staged(_asked(spark, sf_dir), "asked")
    found = staged(_documents(spark, sf_dir, asked), "found")
    stages = grounding.stage_sequence(found, "item_id", asked)
    return retrieval.candidates(grounding.filters(found, "item_id", "doc_id"), "item_id", stages, table(spark, sf_dir, "rfp_sections"), "doc_id", "section_uid")


_KIND = f"CASE WHEN {' OR '.join(f'''contains(text, '{c}')''' for c in text.COMPARISON_CUES)} OR (agencies > 1 AND ({' OR '.join(f'''contains(text, '{c}')''' for c in ('와', '과', '및', ',', '/'))})) THEN 'comparison' ELSE 'single_doc' END"


@query(
    f"""WITH m AS (SELECT item_id, count(DISTINCT value) AS agencies FROM ({SQL['match_cascade']}) WHERE field = 'agency' GROUP BY 1), q AS (SELECT item_id, text, coalesce(agencies, 0) AS agencies FROM prompt_injection_ko LEFT JOIN m USING (item_id) WHERE text IS NOT NULL)
    SELECT item_id, {_KIND} AS kind, array_to_string({_sql_topics('text')}, ',') AS topics, array_to_string(list_distinct(list_transform(regexp_extract_all(text, '기관[ \\t]*([A-Za-z0-9]+|[가-힣]+)', 1), lambda n: '기관 ' || CASE WHEN regexp_full_match(n, '[A-Za-z0-9]+') THEN upper(n) ELSE n END)), ',') AS requested, agencies,
        {' OR '.join(f'''contains(regexp_replace({sql_strip('text')}, '{SPACE}+', ' ', 'g'), '{p}')''' for p in text.IMPLICIT_REFERENCES)} AS refers_back FROM q"""
)
def match_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query asks for: its kind, topics, agencies by name and by match, and whether it refers to what was said before."""
    docs, asked = table(spark, sf_dir, "rfp_documents"), table(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", "text")
    per = matching.cascade_matches(asked, "item_id", "text", docs, fields=("agency",)).groupBy("item_id").agg(F.count_distinct("value").alias("agencies"))
    q = asked.join(per, "item_id", "left").na.fill(0, ["agencies"])
    return q.select(
        "item_id", grounding.query_kind("text", F.col("agencies")).alias("kind"), F.array_join(grounding.query_topics("text"), ",").alias("topics"), F.array_join(grounding.requested_agencies("text"), ",").alias("requested"), "agencies",
        text.contains_any(text.collapsed("text"), text.IMPLICIT_REFERENCES).alias("refers_back"),
    )


# ---------------------------------------------------------------- the search as one plan

_SCORED = f"""{_STAGES}, qt AS (SELECT item_id, text, {sql_tokens('text')} AS tk, {_sql_topics('text')} AS topics FROM q), st AS (SELECT section_uid, doc_id, text, {sql_tokens('text')} AS tk FROM rfp_sections),
    qc AS (SELECT item_id, w, count(*) AS a FROM (SELECT item_id, unnest(tk) AS w FROM qt) GROUP BY 1, 2), sc AS (SELECT section_uid, w, count(*) AS b FROM (SELECT section_uid, unnest(tk) AS w FROM st) GROUP BY 1, 2),
    ql AS (SELECT item_id, sqrt(sum(a * a)) AS l, count(*) AS n FROM qc GROUP BY 1), sl AS (SELECT section_uid, sqrt(sum(b * b)) AS l FROM sc GROUP BY 1),
    mt AS (SELECT item_id, section_uid, sum(a * b) AS d, count(*) AS n FROM qc JOIN sc USING (w) GROUP BY 1, 2),
    pr AS (SELECT item_id, section_uid, mt.n / ql.n::DOUBLE AS overlap, d / (ql.l * sl.l) AS cosine FROM mt JOIN ql USING (item_id) JOIN sl USING (section_uid)),
    sr AS (SELECT item_id, doc_id, section_uid, topics, st.text, round(0.60 * greatest(0, least(1, (cosine + 1) / 2)) + 0.25 * least(1, 0.55 * overlap + 0.45 * len(list_filter(topics, lambda t: contains(lower(st.text), lower(t)))) / greatest(1, len(topics))::DOUBLE) + 0.15 * coalesce(confidence, 0), 4) AS score
        FROM pr JOIN qt USING (item_id) JOIN st USING (section_uid) LEFT JOIN (SELECT * FROM d WHERE confidence >= 0.7) c USING (item_id, doc_id)),
    al AS (SELECT sr.*, stage, attempt, f.doc_id IS NOT NULL AS inside FROM sr JOIN g USING (item_id) LEFT JOIN f USING (item_id, stage, doc_id)),
    so AS (SELECT *, bool_or(inside) OVER (PARTITION BY item_id, stage) AS any_inside FROM al), ra AS (SELECT *, row_number() OVER (PARTITION BY item_id, stage ORDER BY score DESC, section_uid) AS rank FROM so WHERE inside OR NOT any_inside),
    ev AS (SELECT * FROM ra WHERE rank <= CASE WHEN attempt = 1 THEN 4 ELSE 8 END),
    la AS (SELECT item_id, max(attempt) AS last FROM g GROUP BY 1),
    tp AS (SELECT item_id, stage, attempt, last, t, bool_or(coalesce(contains(lower(text), lower(t)), false)) AS said, count(*) AS n, max(score) AS top FROM (SELECT ev.*, last, unnest(CASE WHEN len(topics) > 0 THEN topics ELSE [NULL] END) AS t FROM ev JOIN la USING (item_id)) GROUP BY 1, 2, 3, 4, 5),
    vd AS (SELECT item_id, stage, attempt, last, max(n) AS n, max(top) AS top_score, count(t)::INT AS topics, (count(*) FILTER (WHERE said AND t IS NOT NULL))::INT AS matched FROM tp GROUP BY 1, 2, 3, 4),
    ve AS (SELECT *, top_score >= 0.18 AND (matched >= topics OR (attempt = last AND matched >= 2 AND matched >= 0.5 * topics)) AS verified, CASE WHEN top_score < 0.18 THEN 'low_top_score' WHEN matched >= topics THEN 'grounded' WHEN attempt = last AND matched >= 2 AND matched >= 0.5 * topics THEN 'partial_topic_grounding' ELSE 'topic_not_grounded' END AS reason FROM vd)"""


def _read(asked: DataFrame) -> DataFrame:
    return staged(asked.withColumn("tk", text.tokens("text")).withColumn("topics", grounding.query_topics("text")), "asked")


def _evidence(spark: SparkSession, sf_dir: str, asked: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, stage, attempt, last, doc_id, section_uid, score, rank, topics, text) of all stages of all queries asked."""
    plan = presets.make_plan("full", "single_doc")
    sections = table(spark, sf_dir, "rfp_sections").select("section_uid", "doc_id", "text")
    stages = staged(grounding.stage_sequence(found, "item_id", asked), "stages")
    most = max(plan.top_k, presets.RETRY_TOP_K)
    near = staged(wordsearch.word_search(asked, "item_id", "tk", "topics", sections, "doc_id", "section_uid", "text", found, most), "near")
    best = retrieval.staged_search(wordsearch.at_stages(near, "item_id", stages), "item_id", "section_uid", "score", plan.top_k, presets.RETRY_TOP_K)
    last = stages.groupBy("item_id").agg(F.max("attempt").alias("last"))
    best = staged(best.join(asked.select("item_id", "topics"), "item_id").join(last, "item_id"), "best")
    # Only the few best rows get their texts, and bring the topics to them: texts are not moved again.
    few = best.count() * grounding.TOPICS <= BROADCAST_ROWS
    return (F.broadcast(best) if few else best.hint("merge")).join(sections, "section_uid")


def _some_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(_asked(spark, sf_dir))
    return staged(_evidence(spark, sf_dir, asked, staged(_documents(spark, sf_dir, asked), "found")), "evidence")


@query(f"{_SCORED.replace('WHERE item_id % 100 = 0 AND text IS NOT NULL', 'WHERE text IS NOT NULL')} SELECT item_id, stage, attempt, n, top_score, topics, matched, verified, reason FROM ve")
def verify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the evidence of every stage of every query: its best score, and whether it speaks of all that the query asks."""
    docs = table(spark, sf_dir, "rfp_documents")
    asked = _read(table(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", "text"))
    matches = staged(matching.cascade_matches(asked, "item_id", "text", docs, fields=_FIELDS, aliases={"project": "project_aliases"}), "matches")
    # 128 bits and a count stand for the matches of a query. Queries that nothing tells apart are searched once, matches that are the same looked up once.
    bits = [F.bit_xor(F.xxhash64(F.lit(n), "field", "value", "confidence")).alias(f"m{n}") for n in (1, 2)]
    marks = ["m1", "m2", "matches"]
    marked = asked.join(matches.groupBy("item_id").agg(*bits, F.count("*").alias("matches")), "item_id", "left").na.fill(0, marks)
    like = staged(wordsearch.alike(marked, "item_id", "tk", "topics", marks, table(spark, sf_dir, "rfp_sections"), "text"), "like")
    first = staged(marked.join(like.where("item_id = like"), "item_id", "left_semi").select("item_id", "tk", "topics", *marks), "first")
    same = first.where("matches > 0").groupBy(*marks).agg(F.min("item_id").alias("by"))
    by = staged(first.join(same, marks).select("item_id", "by"), "by")
    found = grounding.document_matches(matches.join(by.select(F.col("by").alias("item_id")).distinct(), "item_id", "left_semi"), "item_id", docs, "doc_id", _FIELDS)
    found = staged(by.join(found.withColumnRenamed("item_id", "by"), "by").drop("by"), "found")
    rows = _evidence(spark, sf_dir, first, found).withColumn("is_last", F.col("attempt") == F.col("last"))
    verdicts = grounding.verify(rows, ["item_id", "stage", "attempt"], "score", "text", "topics", partial="is_last")
    every = like.join(verdicts.withColumnRenamed("item_id", "like"), "like")
    return every.select("item_id", "stage", "attempt", "n", "top_score", "topics", "matched", "verified", "reason")


@query(
    f"""{_SCORED}, fi AS (SELECT item_id, stage, attempt, verified, reason FROM ve QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY NOT verified, CASE WHEN verified THEN attempt ELSE -attempt END) = 1)
    SELECT item_id, stage, attempt, verified, reason, attempt - 1 AS retries, section_uid, score, rank::INT AS rank FROM fi JOIN ev USING (item_id, stage, attempt)"""
)
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query's search ends with: the evidence of the first stage that is verified, else of the last."""
    rows = _some_evidence(spark, sf_dir)
    verdicts = grounding.verify(rows.withColumn("is_last", F.col("attempt") == F.col("last")), ["item_id", "stage", "attempt"], "score", "text", "topics", partial="is_last")
    final = retrieval.first_verified(verdicts, "item_id")
    return final.join(rows.select("item_id", "stage", "section_uid", "score", "rank"), ["item_id", "stage"]).select("item_id", "stage", "attempt", "verified", "reason", "retries", "section_uid", "score", "rank")


@query(
    f"""{_SCORED}, re AS (SELECT *, len(topics) = 0 OR len(list_filter(topics, lambda t: contains(lower(text), lower(t)))) > 0 AS speaks FROM ev WHERE stage = 'relaxed'),
    rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY speaks DESC, score DESC, section_uid) AS k, bool_or(speaks) OVER (PARTITION BY item_id) AS some_speak FROM re)
    SELECT item_id, section_uid, score FROM rk WHERE k <= 2 AND (speaks OR NOT some_speak)"""
)
def search_supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best pieces of evidence that speak of a topic."""
    rows = _some_evidence(spark, sf_dir).where("stage = 'relaxed'")
    return grounding.supporting(rows, ["item_id"], [F.col("score").desc(), F.col("section_uid")], "text", "topics").select("item_id", "section_uid", "score")


@query(
    f"""WITH p AS (SELECT item_id, {sql_tokens('p.text')} AS tk, {_sql_topics('p.text')} AS topics, s.text AS t, {sql_tokens('s.text')} AS st FROM prompt_injection_ko p JOIN rfp_sections s ON s.section_uid = p.item_id WHERE p.text IS NOT NULL AND s.text IS NOT NULL)
    SELECT item_id, round(CASE WHEN len(tk) = 0 AND len(topics) = 0 THEN 0 ELSE least(1, 0.55 * len(list_intersect(tk, st)) / greatest(1, len(list_distinct(tk)))::DOUBLE + 0.45 * len(list_filter(topics, lambda x: contains(lower(t), lower(x)))) / greatest(1, len(topics))::DOUBLE) END, 6)::DOUBLE AS lexical FROM p"""
)
def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each screened query against one section: the share of its words and topics there."""
    asked = table(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", text.tokens("text").alias("tk"), grounding.query_topics("text").alias("topics"))
    sections = table(spark, sf_dir, "rfp_sections").where("text is not null").select(F.col("section_uid").alias("item_id"), F.col("text").alias("t"), text.tokens("text").alias("st"))
    both = asked.join(sections, "item_id")
    return both.select("item_id", F.round(retrieval.lexical_similarity(F.col("tk"), F.col("topics"), F.col("t"), F.col("st")), 6).alias("lexical"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS length FROM embeddings WHERE vec_id % 100 = 7")
def search_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of given keys only."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.at_keys(e, "vec_id", e.where("vec_id % 100 = 7").select("vec_id")).select("vec_id", F.round(vectors.norm("embedding"), 5).alias("length"))


@query("SELECT evidence_id, round(CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE 1 / (1 + exp(-(score * 8 - 4))) END, 6) AS logistic, round(CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE greatest(0, least(1, score * 2 - 0.5)) END, 6) AS cut FROM answer")
def search_cross_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a rescorer within bounds, by either rule."""
    s = F.col("score")
    return table(spark, sf_dir, "answer").select("evidence_id", F.round(retrieval.cross_score(s * 8 - 4), 6).alias("logistic"), F.round(retrieval.cross_score(s * 2 - 0.5, sigmoid=False), 6).alias("cut"))


@query(
    f"""WITH t AS (SELECT item_id, {sql_tokens('text')} AS t FROM prompt_injection_ko WHERE text IS NOT NULL), f AS (SELECT item_id, map_from_entries(list_transform(list_distinct(t), lambda w: (w, len(list_filter(t, lambda x: x = w))))) AS m, t FROM t),
    j AS (SELECT a.item_id, list_sum(list_transform(list_intersect(list_distinct(a.t), list_distinct(b.t)), lambda w: a.m[w] * b.m[w])) AS d FROM f a JOIN f b ON b.item_id = a.item_id + 1)
    SELECT item_id, coalesce(d, 0)::DOUBLE AS dot FROM j"""
)
def search_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the word counts of neighbouring queries."""
    words = table(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", text.tokens("text").alias("t"))
    counts = F.map_from_entries(F.transform(F.array_distinct("t"), lambda w: F.struct(w, F.size(F.filter("t", lambda x: x == w)).cast("double"))))
    rows = words.select("item_id", counts.alias("m"))
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("m").alias("next"))
    return rows.join(nxt, "item_id").select("item_id", vectors.sparse_dot("m", "next").alias("dot"))


@query(
    """WITH v AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 8) AS a, list_slice(embedding::DOUBLE[], 9, 16) AS b FROM embeddings),
    p AS (SELECT x.vec_id, greatest(list_dot_product(x.a, y.a), list_dot_product(x.a, y.b)) + greatest(list_dot_product(x.b, y.a), list_dot_product(x.b, y.b)) AS s, (list_dot_product(x.a, y.a) + 1) / 2 AS d FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)
    SELECT vec_id, round(s, 4) AS max_sim, round(greatest(0, least(1, d)), 4) AS dense FROM p"""
)
def search_late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two short vectors of a row against the two of the next: the best of each, and the first pair's similarity."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8)).alias("v"))
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("n"))
    both = rows.join(nxt, "vec_id")
    return both.select("vec_id", F.round(vectors.max_sim("v", "n"), 4).alias("max_sim"), F.round(vectors.dense_similarity(F.col("v")[0], F.col("n")[0]), 4).alias("dense"))


# ---------------------------------------------------------------- texts

_MARK = "replace({}, '정도', chr(1) || chr(1))"
_FOUND = amounts.FOUND.replace("\\x01", "\x01").replace("'", "''")


def _sql_found(column: str, group: int) -> str:
    return f"list_transform(regexp_extract_all({_MARK.format(column)}, '{_FOUND}', {group}), lambda x: coalesce(x, ''))"


_AMOUNTS = f"SELECT section_uid, {_sql_found('text', 1)} AS ab, {_sql_found('text', 2)} AS rw, {_sql_found('text', 3)} AS nr FROM rfp_sections WHERE text IS NOT NULL"


@query(
    f"""WITH a AS (SELECT section_uid, unnest(rw) AS r, unnest(ab) AS b, unnest(nr) AS n, generate_subscripts(rw, 1) AS i FROM ({_AMOUNTS})),
    v AS (SELECT section_uid, i, rtrim(r, ' ') AS raw, {amounts.sql_amount('r')} AS value, b <> '' OR n <> '' AS approximate FROM a)
    SELECT section_uid, (row_number() OVER (PARTITION BY section_uid ORDER BY i) - 1)::INT AS place, raw, value, approximate FROM v WHERE value IS NOT NULL"""
)
def text_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount of money in the sections, read."""
    texts = spread(table(spark, sf_dir, "rfp_sections").select("section_uid", "text")).where("text is not null")
    rows = texts.select("section_uid", F.posexplode(amounts.amounts("text")).alias("place", "a"))
    return rows.select("section_uid", "place", "a.raw", "a.value", "a.approximate")


_DATE = amounts.DATE.replace("'", "''")
_G = [f"regexp_extract_all(text, '{_DATE}', {k})" for k in range(12)]
_YEAR = "coalesce(try_cast(g1 AS INT), CASE WHEN 2000 + try_cast(g4 AS INT) > 2031 THEN 1900 + try_cast(g4 AS INT) ELSE 2000 + try_cast(g4 AS INT) END, try_cast(g7 AS INT), 2026)"
_MONTH, _DAY = "coalesce(try_cast(g2 AS INT), try_cast(g5 AS INT), try_cast(g8 AS INT), try_cast(g10 AS INT))", "coalesce(try_cast(g3 AS INT), try_cast(g6 AS INT), try_cast(g9 AS INT), try_cast(g11 AS INT))"


@query(
    f"""WITH g AS (SELECT section_uid, generate_subscripts({_G[0]}, 1) AS i, {', '.join(f'unnest({_G[k]}) AS g{k}' for k in range(1, 12))} FROM rfp_sections WHERE text IS NOT NULL),
    d AS (SELECT section_uid, i, {_YEAR} AS y, {_MONTH} AS m, {_DAY} AS d, coalesce(g1, '') = '' AND coalesce(g7, '') = '' AS year_inferred FROM g)
    SELECT section_uid, (row_number() OVER (PARTITION BY section_uid ORDER BY i) - 1)::INT AS place, printf('%04d-%02d-%02d', y, m, d) AS iso, year_inferred FROM d WHERE m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31"""
)
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date in the sections, with 2026 for those without a year."""
    texts = spread(table(spark, sf_dir, "rfp_sections").select("section_uid", "text")).where("text is not null")
    rows = texts.select("section_uid", F.posexplode(amounts.dates("text", 2026)).alias("place", "d"))
    return rows.select("section_uid", "place", "d.iso", "d.year_inferred")


@query(
    f"""WITH a AS (SELECT doc_row_id, string_split_regex({_MARK.format('budget')}, '{_FOUND}') AS p, {_sql_found('budget', 1)} AS ab, {_sql_found('budget', 2)} AS rw, {_sql_found('budget', 3)} AS nr FROM rfp_documents WHERE budget IS NOT NULL),
    w AS (SELECT doc_row_id, p, list_transform(range(1, len(rw) + 1), lambda i: ab[i] || CASE WHEN {amounts.sql_amount('rw[i]')} IS NULL THEN rtrim(rw[i], ' ') WHEN ab[i] <> '' OR nr[i] <> '' THEN rtrim(rw[i], ' ') || ' [≈' || {amounts.sql_amount('rw[i]')} || ']' ELSE {amounts.sql_amount('rw[i]')}::VARCHAR END || substr(rw[i], length(rtrim(rw[i], ' ')) + 1) || nr[i]) AS x FROM a)
    SELECT doc_row_id, replace(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(x[i], '')), ''), chr(1) || chr(1), '정도') AS normalized FROM w"""
)
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets with their amounts as whole numbers."""
    return table(spark, sf_dir, "rfp_documents").where("budget is not null").select("doc_row_id", amounts.normalized_amounts("budget").alias("normalized"))


@query(
    f"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[/?INSTRUCTION_LIKE\\]', '[INPUT_MARKER]', 'g'), '{text.CHAT_TOKEN}', '[REDACTED_CHAT_TOKEN]', 'g'), '{text.ROLE_LINE}', '[INSTRUCTION_LIKE]\\1[/INSTRUCTION_LIKE]', 'g'), '{text.OVERRIDE_LINE}', '[INSTRUCTION_LIKE]\\1[/INSTRUCTION_LIKE]', 'g') AS text FROM prompt_injection_ko"""
)
def text_neutralized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with what looks like an instruction put in brackets."""
    return table(spark, sf_dir, "prompt_injection_ko").select("item_id", text.neutralized("text").alias("text"))


_AXES = ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in text.AXES)


@query(f"SELECT item_id, array_to_string(list_filter([{_AXES}], lambda x: x IS NOT NULL), ',') AS axes FROM prompt_injection_ko WHERE text IS NOT NULL")
def text_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prompt_injection_ko").where("text is not null").select("item_id", F.array_join(text.axes("text"), ",").alias("axes"))


_LINE = f"regexp_extract({sql_strip('text')}, '^([^\\r\\n]*)', 1)"
_NAMED = " OR ".join(f"contains(lower(l), '{w}')" for w in text.HEADING_WORDS)


@query(
    f"""WITH b AS (SELECT section_uid, {sql_strip(_LINE)} AS l FROM rfp_sections WHERE text IS NOT NULL), c AS (SELECT *, length(regexp_replace(l, '{SPACE}+', '', 'g')) AS n FROM b)
    SELECT section_uid, CASE WHEN regexp_matches(l, '{text.HEADING_START}') OR (n BETWEEN 1 AND 48 AND NOT contains(l, ':') AND NOT regexp_matches(l, '[.?!。]$') AND ({_NAMED})) THEN 'heading'
        WHEN contains(l, '|') OR contains(l, chr(9)) OR regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r] {{2,}}[^ \\t\\n\\x0B\\f\\r].* {{2,}}[^ \\t\\n\\x0B\\f\\r]') THEN 'table' ELSE 'text' END AS kind FROM c"""
)
def text_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rfp_sections").where("text is not null").select("section_uid", text.block_kind("text").alias("kind"))


_NOISY = "replace(replace(text, '. ', '. ' || chr(10) || '|-12-|' || chr(10)), ' ', CASE WHEN section_uid % 2 = 0 THEN '··········' ELSE ' ' END)"


@query(
    f"""WITH n AS (SELECT section_uid, regexp_replace(regexp_replace({_NOISY}, '·{{8,}}', ' ', 'g'), '\\.{{15,}}', ' ', 'g') AS x FROM rfp_sections WHERE text IS NOT NULL)
    SELECT section_uid, array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT regexp_full_match(l, '\\|+-[0-9]+-\\|+')), chr(10)) AS text FROM n"""
)
def text_contents_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections into which leaders and page numbers were put, without them."""
    noisy = F.expr(_NOISY.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "rfp_sections").where("text is not null").select("section_uid", text.without_contents_noise(noisy).alias("text"))


_ENDS = f"regexp_replace(regexp_replace(text, '(\\n[ \\t]*\\n[ \\t]*\\n[ \\t\\n]*)', '\\1' || chr(2), 'g'), '({text.BOUNDARY[4:]})', chr(2) || '\\1', 'g')"


@query(
    f"""WITH p AS (SELECT section_uid, text, string_split(regexp_replace(regexp_replace(text, '(\\n[ \\t]*\\n[ \\t]*\\n[ \\t\\n]*)', '\\1' || chr(2), 'g'), '(?m)({text.BOUNDARY[4:]})', chr(2) || '\\1', 'g'), chr(2)) AS p FROM rfp_sections WHERE length(text) >= 300),
    c AS (SELECT section_uid, length(text) AS n, list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x)))::INT) AS c FROM p)
    SELECT section_uid, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x > 0 AND x < n))), ',') AS cuts FROM c WHERE len(list_filter(c, lambda x: x > 0 AND x < n)) > 0"""
)
def text_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where further sections may begin within a section."""
    rows = table(spark, sf_dir, "rfp_sections").where("length(text) >= 300").select("section_uid", text.boundaries("text").alias("c"))
    return rows.where(F.size("c") > 0).select("section_uid", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("cuts"))


@query("SELECT doc_row_id, c AS letter, count(*)::INT AS n FROM (SELECT doc_row_id, unnest(string_split(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+', '', 'g'), '')) AS c FROM rfp_documents WHERE title IS NOT NULL) WHERE c <> '' GROUP BY 1, 2")
def text_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each character comes in a title."""
    rows = table(spark, sf_dir, "rfp_documents").where("title is not null")
    return rows.select("doc_row_id", F.explode(text.char_counts("title")).alias("letter", "n"))


@query(
    """WITH d AS (SELECT DISTINCT query_id, list_sort(list_distinct(list(run_name))) AS r FROM answer WHERE query_id IS NOT NULL GROUP BY query_id)
    SELECT query_id, array_to_string(r, '|') AS runs, len(r)::INT AS n FROM d"""
)
def text_joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as one string and read again."""
    rows = table(spark, sf_dir, "answer").where("query_id is not null").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("run_name")), "|").alias("runs"))
    return rows.select("query_id", "runs", F.size(text.pipe_values("runs")).alias("n"))
