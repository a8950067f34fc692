"""Queries of readers, writers, delivery checks, layout and dialogue: files are made from the given tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, text
from .operators import dialogue, ingest, layout, matching, quality, retrieval, statistics
from .plans.staging import spread, stage_dir, staged
from .registry import SPACE, SQL, query, sql_strip, sql_tokens, table
from .sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks

_TEXTS = "SELECT doc_id, list({'heading': heading, 'text': text} ORDER BY section_uid) AS s FROM rfp_sections WHERE doc_id IS NOT NULL GROUP BY 1"


@query(
    f"""WITH d AS (SELECT doc_id, arg_min(title, doc_row_id) AS title, arg_min(agency, doc_row_id) AS agency FROM rfp_documents WHERE doc_id IS NOT NULL GROUP BY 1), j AS (SELECT * FROM d JOIN ({_TEXTS}) USING (doc_id)),
    k AS (SELECT doc_id, title, agency, list_filter(s, lambda x: coalesce({sql_strip('x.text')}, '') <> '') AS s, right(doc_id, 1) IN ('1', '3', '5', '7', '9') AS plain FROM j)
    SELECT doc_id, CASE WHEN plain THEN title ELSE coalesce(title, doc_id) END AS title, CASE WHEN plain THEN '' ELSE coalesce(agency, '') END AS agency, CASE WHEN plain THEN 1 ELSE len(s) END::INT AS n_sections FROM k WHERE len(s) > 0 AND (NOT plain OR title IS NOT NULL)"""
)
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as whole files, every other one as text with its title on top and the others as JSON, read again."""
    sections = table(spark, sf_dir, "rfp_sections").where("doc_id is not null").select("doc_id", F.struct("section_uid", "heading", "text").alias("s"))
    parts = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # one document's sections, as its file holds them
    docs = table(spark, sf_dir, "rfp_documents").where("doc_id is not null").groupBy("doc_id").agg(F.min_by("title", "doc_row_id").alias("title"), F.min_by("agency", "doc_row_id").alias("agency"))
    rows = docs.join(parts, "doc_id").withColumn("plain", F.col("doc_id").rlike("[13579]$"))
    rows = rows.where(F.exists("s", lambda x: F.coalesce(text.strip(x["text"]), F.lit("")) != "") & (~F.col("plain") | F.col("title").isNotNull()))
    as_text = F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n"))
    as_json = F.to_json(F.struct("doc_id", "title", "agency", F.transform("s", lambda x: F.struct(x["heading"].alias("heading"), x["text"].alias("text"))).alias("sections")))
    files = rows.select(F.when(F.col("plain"), as_text).otherwise(as_json).alias("raw"), F.concat(F.lit("raw/"), "doc_id", F.when(F.col("plain"), ".md").otherwise(".json")).alias("source_path"))
    return readers.parsed_documents(files).select("doc_id", "title", "agency", F.size("sections").alias("n_sections"))


@query(
    f"""SELECT doc_row_id, CASE WHEN coalesce({sql_strip('notice_no')}, '') <> '' THEN regexp_replace({sql_strip('notice_no')}, '{SPACE}+', '-', 'g') || CASE WHEN notice_round > 1 THEN '-' || notice_round ELSE '' END ELSE regexp_extract(source_path, '([^/]+)\\.[^.]+$', 1) END AS doc_id,
    coalesce(lower(file_format), lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1))) AS format, CASE WHEN doc_row_id % 10 = 3 THEN NULL ELSE source_path END AS source_file, CASE WHEN doc_row_id % 10 = 3 THEN 'missing_file' END AS reason FROM rfp_documents
    WHERE source_path IS NOT NULL AND coalesce(lower(file_format), lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1))) IN ('pdf', 'hwp', 'hwpx', 'docx')"""
)
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery's manifest as CSV, read again and led to its files, of which one in ten is missing."""
    docs = table(spark, sf_dir, "rfp_documents").where("source_path is not null")
    name = F.concat(F.col("doc_row_id").cast("string"), F.lit("__"), F.regexp_extract("source_path", "([^/]+)$", 1))
    rows = docs.select(
        F.col("notice_no").alias("공고 번호"), F.col("notice_round").alias("공고 차수"), F.col("project").alias("사업명"), F.col("agency").alias("발주 기관"), F.col("file_format").alias("파일형식"),
        name.alias("파일명"), F.concat_ws("\n", "title", "budget").alias("텍스트"),
    )
    folder = _folder(spark, "manifest")
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(folder)
    files = docs.where("doc_row_id % 10 <> 3").select(F.concat(F.lit("files/"), name).alias("path"))
    found = ingest.documents_of_manifest(readers.read_manifest(spark, folder), files, "path")
    bare = lambda c: F.regexp_replace(c, "[0-9]+__", "")
    found = found.select(F.regexp_extract("파일명", "^([0-9]+)__", 1).cast("bigint").alias("doc_row_id"), bare(F.col("doc_id")).alias("doc_id"), "format", bare(F.col("source_file")).alias("source_file"), "reason")
    return found.where(F.col("format").isin(*ingest.FORMATS))


@query("SELECT qid, question_type, len(target_doc_ids)::INT AS targets, CASE WHEN item_id % 3 = 0 THEN 'T0001' END AS parent FROM eval_items")
def source_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items as JSON lines, read again as cases; blank parents are none."""
    parent = F.when(F.col("item_id") % 3 == 0, "T0001").otherwise(" ")
    rows = table(spark, sf_dir, "eval_items").select("qid", "question_type", "target_doc_ids", F.col("text").alias("question"), F.col("should_abstain"), parent.alias("parent_qid"))
    folder = _folder(spark, "cases")
    rows.write.json(folder)
    return readers.read_cases(spark, folder).select("qid", "question_type", F.size("target_doc_ids").alias("targets"), F.col("parent_qid").alias("parent"))


@query(
    """WITH m AS (SELECT 'run-' || run_name AS snapshot, count(*)::DOUBLE AS n, round(avg(CASE WHEN isnan(score) THEN NULL ELSE score END), 4) AS mean FROM answer WHERE run_name IS NOT NULL GROUP BY 1)
    SELECT snapshot, metric, value FROM (UNPIVOT m ON n, mean INTO NAME metric VALUE value)"""
)
def source_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's numbers as JSON, read again as a long table; what is no number is left out."""
    mean = F.round(F.avg(F.when(~F.isnan("score"), F.col("score"))), 4)
    per = table(spark, sf_dir, "answer").where("run_name is not null").groupBy("run_name").agg(F.count("*").alias("n"), mean.alias("mean"))
    files = per.select(F.to_json(F.struct("n", "mean", F.lit("abc").alias("note"))).alias("raw"), F.concat(F.lit("history/run-"), "run_name", F.lit(".json")).alias("source_path"))
    return readers.history(files)


@query(
    """SELECT 'documents' AS part, count(*) AS n, count(DISTINCT doc_id) AS keys FROM rfp_documents UNION ALL SELECT 'parent_sections', count(*), count(DISTINCT section_id) FROM rfp_sections
    UNION ALL SELECT 'chunks', count(*), count(DISTINCT chunk_id) FROM (SELECT DISTINCT chunk_id, text FROM answer WHERE text IS NOT NULL) UNION ALL SELECT 'index_info', 2, 2"""
)
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written and read again: the rows and keys of each of its tables."""
    folder = _folder(spark, "index")
    chunks = table(spark, sf_dir, "answer").where("text is not null").select("chunk_id", "text").distinct()
    writers.write_index(folder, table(spark, sf_dir, "rfp_documents"), table(spark, sf_dir, "rfp_sections"), chunks, {"backend": "hashing"})
    tables = readers.read_index(spark, folder)
    sized = lambda name, key: tables[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"))
    info = tables["index_info"].select(F.lit("index_info").alias("part"), F.size("info").cast("bigint").alias("n"), F.size(F.map_keys("info")).cast("bigint").alias("keys"))
    return sized("documents", "doc_id").unionAll(sized("parent_sections", "section_id")).unionAll(sized("chunks", "chunk_id")).unionAll(info)


@query(SQL["search_bm25"])
def source_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of `search_bm25` from an index that was written and read again."""
    docs = spread(table(spark, sf_dir, "rfp_sections").select("section_uid", "text")).select("section_uid", text.tokens("text").alias("tokens"))
    asked = table(spark, sf_dir, "prompt_injection_ko").where("item_id % 100 = 0").select("item_id", text.tokens("text").alias("asked"))
    index = retrieval.search_index(docs, "section_uid", "tokens", _folder(spark, "postings"))
    return retrieval.bm25(index, "section_uid", "tokens", asked, "item_id", "asked", 10).select("item_id", "section_uid", "score")


@query("SELECT run_name, query_id, count(DISTINCT doc_id)::INT AS ids, coalesce(string_agg(DISTINCT CASE WHEN doc_id IS NOT NULL THEN '<redacted>' END, ','), '') AS shown FROM answer WHERE query_id IS NOT NULL AND run_name IS NOT NULL GROUP BY 1, 2")
def sink_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces by run as JSON lines with their document ids masked, read again: as many marks as ids, and nothing else."""
    rows = table(spark, sf_dir, "answer").where("query_id is not null and run_name is not null")
    traces = rows.groupBy("run_name", "query_id").agg(F.array_compact(F.collect_set("doc_id")).alias("doc_ids"))
    folder = _folder(spark, "traces")
    writers.write_traces(traces, folder, "run_name", ("doc_ids",))
    back = spark.read.schema("query_id string, doc_ids array<string>, run_name string").json(folder)
    return back.select("run_name", "query_id", F.coalesce(F.size("doc_ids"), F.lit(0)).alias("ids"), F.coalesce(F.array_join(F.array_distinct("doc_ids"), ","), F.lit("")).alias("shown"))


@query("SELECT evidence_id, chunk_id, CASE WHEN isnan(score) THEN NULL ELSE round(score, 4) END AS score, 'answer,evidence' AS paths FROM answer")
def sink_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with private parts at every depth, without them."""
    score = F.when(~F.isnan("score"), F.round("score", 4)).alias("score")
    parts = F.struct(F.col("chunk_id"), score, F.col("doc_id").alias("_doc"), F.struct(F.col("run_name").alias("_run"), F.col("section").alias("gone")).alias("_parts"))
    rows = table(spark, sf_dir, "answer").select("evidence_id", F.array(parts).alias("evidence"), F.struct(F.col("answer_id").alias("answer"), F.col("text").alias("secret")).alias("answer"), F.lit(1).alias("_internal"))
    shown = writers.public(rows, drop=("secret",))
    if writers.forbidden_columns(shown, {"_doc", "_parts", "_internal", "secret"}):
        raise ValueError("private columns are left")
    paths = F.lit(",".join(sorted(c for c in shown.columns if c != "evidence_id")))
    return shown.select("evidence_id", F.col("evidence")[0]["chunk_id"].alias("chunk_id"), F.col("evidence")[0]["score"].alias("score"), paths.alias("paths"))


@query("SELECT qid FROM eval_items WHERE split = 'dev' UNION ALL SELECT DISTINCT qid FROM eval_items WHERE split = 'test' AND NOT should_abstain")
def sink_promoted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved cases joined to the known ones, twice; the second time adds nothing."""
    items = table(spark, sf_dir, "eval_items").select("qid", "split", "should_abstain")
    known, incoming = items.where("split = 'dev'"), items.where("split in ('dev', 'test')")
    once = staged(ingest.new_rows(known, incoming, "qid", ~F.col("should_abstain")), "cases")
    return ingest.new_rows(once, incoming, "qid", ~F.col("should_abstain")).select("qid")


@query("SELECT section_uid FROM rfp_sections ORDER BY sha256('7:' || section_uid), section_uid LIMIT 100")
def source_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred sections, drawn by a hash of their keys."""
    return ingest.sampled(table(spark, sf_dir, "rfp_sections").select("section_uid"), "section_uid", 100)


# ---------------------------------------------------------------- delivery checks


@query("SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(doc_row_id))[1:20], ',') AS rows FROM rfp_documents WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def ingest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.duplicate_groups(table(spark, sf_dir, "rfp_documents"), "doc_id", "doc_row_id")
    return found.select("doc_id", "n", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"))


@query(
    """WITH c AS (SELECT coalesce(agency, 'none') AS agency, count(*) AS n FROM rfp_documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, agency) AS k FROM c)
    SELECT CASE WHEN k <= 10 THEN agency ELSE 'others' END AS agency, sum(n)::BIGINT AS n FROM r GROUP BY 1"""
)
def ingest_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten agencies with most documents, all others as one."""
    return ingest.frequent_and_rest(table(spark, sf_dir, "rfp_documents"), "agency", 10)


@query("SELECT source, lower(coalesce(lang, 'none')) AS lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 6) AS share FROM documents GROUP BY 1, 2")
def ingest_text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents by where they come from, with their share there."""
    rows = table(spark, sf_dir, "documents").select("source", F.lower(F.coalesce("lang", F.lit("none"))).alias("lang"))
    return statistics.crosstab_shares(rows, "source", "lang")


@query(
    f"""SELECT doc_row_id, array_to_string(list_filter([CASE WHEN coalesce({sql_strip('agency')}, '') = '' THEN 'blank_agency' END, CASE WHEN coalesce({sql_strip('project')}, '') = '' THEN 'blank_project' END, CASE WHEN coalesce({sql_strip('budget')}, '') = '' THEN 'no_budget' END,
    CASE WHEN coalesce(ingested_at >= created_at, false) = false THEN 'arrived_early' END, CASE WHEN coalesce(len(project_aliases), 0) = 0 THEN 'no_aliases' END], lambda x: x IS NOT NULL), ',') AS warnings FROM rfp_documents"""
)
def ingest_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is odd about each delivered document, though it can be read."""
    there = lambda c: F.coalesce(text.strip(c), F.lit("")) != ""
    checks = {
        "blank_agency": there("agency"), "blank_project": there("project"), "no_budget": there("budget"), "arrived_early": F.col("ingested_at") >= F.col("created_at"),
        "no_aliases": F.size(F.coalesce("project_aliases", F.array().cast("array<string>"))) > 0,
    }
    return ingest.audited(table(spark, sf_dir, "rfp_documents"), checks).select("doc_row_id", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT event_id, ts::TIMESTAMP AS read FROM (SELECT event_id, date_trunc(CASE event_id % 4 WHEN 3 THEN 'day' WHEN 2 THEN 'minute' ELSE 'second' END, ts) AS ts FROM events)")
def ingest_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the events written in four ways, read again."""
    ts = F.col("ts").cast("timestamp")
    kinds = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
    written = F.coalesce(*(F.when(F.col("event_id") % 4 == k, F.date_format(ts, f)) for k, f in enumerate(kinds)))
    return table(spark, sf_dir, "events").select("event_id", numbers.any_timestamp(written).cast("timestamp_ntz").alias("read"))


@query("SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') AS hash FROM part")
def ingest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of a row's values as JSON."""
    return table(spark, sf_dir, "part").select("p_partkey", numbers.json_hash("p_brand", "p_size").alias("hash"))


@query(
    """WITH p AS (SELECT * FROM (VALUES ('STANDARD', 1.0, 2.0), ('STAN', 0.5, 1.0), ('SMALL', 2.0, 3.0), ('ECONOMY', 4.0, 8.0)) v(prefix, price_in, price_out)), b AS (SELECT p_partkey, arg_max(price_in, length(prefix)) AS i, arg_max(price_out, length(prefix)) AS o FROM part LEFT JOIN p ON starts_with(p_type, prefix) GROUP BY 1)
    SELECT p_partkey, round(((length(p_name) * 100 * i + p_size * 10 * o) / 1e6)::DOUBLE, 9) AS cost FROM b JOIN part USING (p_partkey)"""
)
def match_token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs at the prices of the longest prefix of a name; null where none is known."""
    prices = spark.createDataFrame([("STANDARD", 1.0, 2.0), ("STAN", 0.5, 1.0), ("SMALL", 2.0, 3.0), ("ECONOMY", 4.0, 8.0)], "prefix string, price_in double, price_out double")
    priced = matching.longest_prefix(table(spark, sf_dir, "part"), "p_type", prices, "prefix")
    cost = numbers.token_cost(F.length("p_name") * 100, F.col("p_size") * 10, F.col("price_in"), F.col("price_out"))
    return priced.select("p_partkey", F.round(cost, 9).alias("cost"))


# ---------------------------------------------------------------- layout

_SECTIONS = "SELECT doc_id, section_no, section_uid, heading, text, section_path FROM rfp_sections WHERE doc_id IS NOT NULL"


@query(
    f"""WITH s AS (SELECT doc_id, section_uid, section_no, {sql_strip('text')} AS b, coalesce({sql_strip('heading')}, '') AS h FROM ({_SECTIONS}) WHERE text IS NOT NULL),
    p AS (SELECT *, CASE WHEN lower(h) IN ('', '본문') THEN b ELSE h || chr(10) || b END AS x FROM s)
    SELECT doc_id, doc_id || '::section-001' AS section_id, count(*)::INT AS n_sections, md5({sql_strip("string_agg(x, chr(10) || chr(10) ORDER BY section_no NULLS FIRST, section_uid) FILTER (WHERE x <> '')")}) AS text_hash FROM p GROUP BY 1"""
)
def layout_fixed_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one section."""
    rows = table(spark, sf_dir, "rfp_sections").where("doc_id is not null and text is not null")
    found = layout.fixed_parents(rows, "doc_id", ["section_no", "section_uid"], "heading", "text")
    return found.select("doc_id", "section_id", "n_sections", F.md5("text").alias("text_hash"))


@query(
    f"""WITH w AS (SELECT section_uid, length(text) AS n, unnest(range(0, greatest(length(text), 1), 480)) AS s, text FROM rfp_sections WHERE length({sql_strip('text')}) > 0),
    k AS (SELECT section_uid, s, substr(text, s + 1, 520) AS t FROM w WHERE s = 0 OR s + 40 < n), r AS (SELECT *, row_number() OVER (PARTITION BY section_uid ORDER BY s) AS q, count(*) OVER (PARTITION BY section_uid) AS c FROM k)
    SELECT section_uid, printf('%d::chunk-%03d', section_uid, q) AS chunk_id, q::INT AS chunk_seq_in_section, c::INT AS total_chunks_in_section, s::INT AS start_pos, length(t)::INT AS chars FROM r"""
)
def layout_chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in fixed windows, as numbered records."""
    rows = layout.chunk_records(table(spark, sf_dir, "rfp_sections").withColumn("section_uid", F.col("section_uid").cast("string")), "section_uid", "text", 520, 40)
    return rows.select(F.col("section_uid").cast("bigint").alias("section_uid"), "chunk_id", "chunk_seq_in_section", "total_chunks_in_section", "start_pos", F.length("text").alias("chars"))


@query(f"SELECT doc_id, count(*) > 1 OR max((coalesce(len(section_path), 0) > 1 OR lower(coalesce({sql_strip('heading')}, '')) NOT IN ('', '본문'))::INT) = 1 AS structured FROM ({_SECTIONS}) GROUP BY 1")
def layout_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have sections worth the name."""
    return layout.structured(table(spark, sf_dir, "rfp_sections").where("doc_id is not null"), "doc_id", "heading", "section_path")


@query(
    """SELECT doc_id, min(section_no)::DOUBLE AS x0, min(page_span[1])::DOUBLE AS y0, (max(section_no) + 1)::DOUBLE AS x1, (max(page_span[2]) + 1)::DOUBLE AS y1, min(page_span[1])::INT AS first_page, max(page_span[1])::INT AS last_page, count(*)::INT AS n
    FROM rfp_sections WHERE doc_id IS NOT NULL AND len(page_span) = 2 AND section_no IS NOT NULL GROUP BY 1"""
)
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box and pages around all regions of a document; regions of odd boxes say nothing."""
    rows = table(spark, sf_dir, "rfp_sections").where("doc_id is not null and size(page_span) = 2 and section_no is not null")
    box = F.array(F.col("section_no"), F.col("page_span")[0], F.col("section_no") + 1, F.col("page_span")[1] + 1).cast("array<double>")
    good, odd = F.struct(F.col("page_span")[0].alias("page_number"), box.alias("bbox")), F.struct(F.lit(None).cast("int").alias("page_number"), F.slice(box, 1, 3).alias("bbox"))
    regions = rows.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array(good, odd))).alias("r"))  # one document's sections
    valid = regions.withColumn("r", layout.valid_regions("r"))
    pages = F.transform("r", lambda x: x["page_number"])
    out = valid.select("doc_id", layout.union_box(F.transform("r", lambda x: x["bbox"])).alias("b"), layout.page_spans(F.lit(None).cast("array<int>"), pages).alias("p"), F.size("r").alias("n"))
    return out.select("doc_id", *(F.col("b")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), F.col("p")[0].alias("first_page"), F.col("p")[1].alias("last_page"), "n")


# Lines as blocks; every fifth opens a section.
_LINES = "SELECT section_uid, unnest(l) AS line, (generate_subscripts(l, 1) - 1)::INT AS n FROM (SELECT section_uid, string_split(text, chr(10)) AS l FROM rfp_sections WHERE text IS NOT NULL AND NOT contains(text, chr(13)))"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "rfp_sections").where(F.col("text").isNotNull() & ~F.col("text").contains("\r"))
    return layout.lines(rows, "section_uid", "text").withColumn("kind", F.when(F.col("line_no") % 5 == 0, "heading").otherwise("text"))


@query(
    f"""WITH b AS (SELECT *, sum((n % 5 = 0)::INT) OVER (PARTITION BY section_uid ORDER BY n) AS k FROM ({_LINES}))
    SELECT section_uid, k::BIGINT AS section_no, min(line) FILTER (WHERE n % 5 = 0) AS heading, md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n % 5 <> 0), '')) AS text_hash FROM b GROUP BY 1, 2"""
)
def layout_block_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections put together from blocks."""
    found = layout.sections_of_blocks(_blocks(spark, sf_dir), "section_uid", "line_no", "kind", "line")
    return found.select("section_uid", "section_no", "heading", F.md5("text").alias("text_hash"))


@query(
    f"""WITH l AS (SELECT section_uid, n, '# - ' || line AS line FROM ({_LINES}) WHERE {sql_strip('line')} <> '' AND n % 7 <> 6 UNION ALL SELECT section_uid, n, '본문' FROM ({_LINES}) WHERE {sql_strip('line')} <> '' AND n % 7 = 6),
    r AS (SELECT *, sum((n % 7 = 6)::INT) OVER (PARTITION BY section_uid ORDER BY n) AS run FROM l), c AS (SELECT *, count(*) FILTER (WHERE n % 7 <> 6) OVER (PARTITION BY section_uid, run) AS bullets FROM r)
    SELECT section_uid, md5(string_agg(CASE WHEN n % 7 <> 6 AND bullets >= 3 THEN substr(line, 3) ELSE line END, chr(10) ORDER BY n)) AS text_hash FROM c GROUP BY 1"""
)
def layout_demoted_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made headings of bullets, but every seventh: runs of three and more lose their marks."""
    rows = _blocks(spark, sf_dir).where(text.strip("line") != "")
    marked = F.when(F.col("line_no") % 7 == 6, "본문").otherwise(F.concat(F.lit("# - "), "line"))
    per = rows.groupBy("section_uid").agg(F.array_sort(F.collect_list(F.struct("line_no", marked.alias("l")))).alias("ls"))  # one section's lines
    texts = per.select("section_uid", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))
    return layout.demoted_headings(texts, "section_uid", "text").select("section_uid", F.md5("text").alias("text_hash"))


@query(
    f"""WITH l AS (SELECT section_uid, n, n % 4 IN (1, 2) AND len(list_filter(string_split(line, ' '), lambda x: {sql_strip('x')} <> '')) >= 2 AS is_row, len(list_filter(string_split(replace(line, chr(9), '|'), ' '), lambda x: {sql_strip('x')} <> '')) AS c FROM ({_LINES}) WHERE NOT contains(line, '|') AND NOT contains(line, chr(9))),
    r AS (SELECT *, sum((NOT is_row)::INT) OVER (PARTITION BY section_uid ORDER BY n) AS run FROM l), t AS (SELECT section_uid, run, count(*) AS n_rows, max(c)::INT AS n_columns FROM r WHERE is_row GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT section_uid, row_number() OVER (PARTITION BY section_uid ORDER BY run)::INT AS table_no, n_rows, n_columns FROM t"""
)
def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found in lines, of which two in four were given bars between their words."""
    rows = _blocks(spark, sf_dir).where(~F.col("line").contains("|") & ~F.col("line").contains("\t"))
    barred = F.when((F.col("line_no") % 4).isin(1, 2), F.array_join(F.split("line", " "), "|")).otherwise(F.regexp_replace("line", " {2,}", " "))
    per = rows.groupBy("section_uid").agg(F.array_sort(F.collect_list(F.struct("line_no", barred.alias("l")))).alias("ls"))  # one section's lines
    texts = per.select("section_uid", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))
    return layout.table_candidates(texts, "section_uid", "text")


@query(
    f"""WITH f AS (SELECT section_uid, n, {sql_strip("regexp_extract(line, '^([^:：]{1,30})[:：](.+)$', 1)")} AS field, {sql_strip("regexp_extract(line, '^([^:：]{1,30})[:：](.+)$', 2)")} AS value FROM ({_LINES}))
    SELECT section_uid, n AS line_no, field, value FROM f WHERE field <> '' AND value <> ''"""
)
def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name a field and its value."""
    rows = table(spark, sf_dir, "rfp_sections").where(F.col("text").isNotNull() & ~F.col("text").contains("\r"))
    return layout.field_candidates(rows, "section_uid", "text")


@query(
    f"""WITH w AS (SELECT section_uid, n, lower(regexp_replace(substr(line, 3, 12), '[ \\t\\n\\r]+', ' ', 'g')) AS s, substr(line, 3, 12) AS snippet FROM ({_LINES}) WHERE n % 3 = 0 AND substr(line, 3, 12) <> ''),
    b AS (SELECT section_uid, n, lower(regexp_replace(line, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM ({_LINES}))
    SELECT w.section_uid, w.n AS line_no, min(b.n) AS block FROM w LEFT JOIN b ON b.section_uid = w.section_uid AND contains(t, s) GROUP BY 1, 2"""
)
def layout_found_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a section that holds what was cut out of one of its lines."""
    blocks = staged(_blocks(spark, sf_dir), "blocks")
    wanted = blocks.where("line_no % 3 = 0").select("section_uid", "line_no", F.substring("line", 3, 12).alias("snippet")).where("snippet != ''")
    return layout.found_blocks(wanted, ["section_uid"], "snippet", blocks, "line_no", "line").select("section_uid", "line_no", "block")


@query(
    """WITH e AS (SELECT DISTINCT doc_id, lower(file_format) AS f, agency AS v FROM rfp_documents WHERE doc_id IS NOT NULL AND file_format IS NOT NULL AND agency IS NOT NULL), a AS (SELECT DISTINCT doc_id, lower(file_format) AS f, CASE WHEN doc_row_id % 3 = 0 THEN substr(agency, 1, 2) WHEN doc_row_id % 3 = 1 THEN agency ELSE '다른 값' END AS v FROM rfp_documents WHERE doc_id IS NOT NULL AND file_format IS NOT NULL AND agency IS NOT NULL),
    m AS (SELECT e.doc_id, e.f, least(count(DISTINCT e.v), count(DISTINCT a.v)) AS m FROM e JOIN a ON e.doc_id = a.doc_id AND e.f = a.f AND (contains(e.v, a.v) OR contains(a.v, e.v)) GROUP BY 1, 2), s AS (SELECT doc_id, sum(m) AS m FROM m GROUP BY 1),
    x AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1), y AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1)
    SELECT x.doc_id, coalesce(m, 0)::BIGINT AS matched, x.n AS expected, y.n AS actual, round(coalesce(m, 0) / y.n::DOUBLE, 6) AS precision, round(coalesce(m, 0) / x.n::DOUBLE, 6) AS recall FROM x JOIN y USING (doc_id) LEFT JOIN s USING (doc_id)"""
)
def layout_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies by document and format against readings of them that are cut or wrong."""
    rows = table(spark, sf_dir, "rfp_documents").where("doc_id is not null and file_format is not null and agency is not null").withColumn("f", F.lower("file_format"))
    read = F.when(F.col("doc_row_id") % 3 == 0, F.substring("agency", 1, 2)).when(F.col("doc_row_id") % 3 == 1, F.col("agency")).otherwise("다른 값")
    return layout.field_scores(rows.select("doc_id", "f", F.col("agency").alias("v")), rows.select("doc_id", "f", read.alias("v")), "doc_id", "f", "v")


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE AS x0, l_quantity / 10 AS h FROM lineitem), a AS (SELECT l_orderkey, l_linenumber, x0 + 0.25 AS x0, h FROM b WHERE l_linenumber % 2 = 1),
    p AS (SELECT b.l_orderkey, b.x0, b.h, greatest(0, least(b.x0 + 1, a.x0 + 1) - greatest(b.x0, a.x0)) * least(b.h, a.h) AS i, b.h + a.h AS s FROM b JOIN a USING (l_orderkey)),
    m AS (SELECT l_orderkey, x0, h, max(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END) AS iou FROM p GROUP BY 1, 2, 3)
    SELECT b.l_orderkey, b.l_linenumber, round(iou, 6) AS best_iou, coalesce(iou >= 0.5, false) AS matched FROM b LEFT JOIN m USING (l_orderkey, x0, h)"""
)
def layout_box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of an order's lines against those of every other line, moved aside."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") / 10).alias("h"))
    box = lambda shift: F.array(F.col("x") + shift, F.lit(0.0), F.col("x") + 1 + shift, F.col("h")).alias("box")
    found = layout.box_scores(rows.select("l_orderkey", "l_linenumber", box(0.0)), rows.where("l_linenumber % 2 = 1").select("l_orderkey", box(0.25)), ["l_orderkey"], "box", 0.5)
    return found.select("l_orderkey", "l_linenumber", F.round("best_iou", 6).alias("best_iou"), "matched")


@query(
    """WITH e AS (SELECT DISTINCT doc_id, unnest(range(page_span[1], greatest(page_span[1], page_span[2]) + 1)) AS p FROM rfp_sections WHERE doc_id IS NOT NULL AND len(page_span) = 2 AND delivery_no = 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(page_span[1], greatest(page_span[1], page_span[2]) + 1)) AS p FROM rfp_sections WHERE doc_id IS NOT NULL AND len(page_span) = 2 AND section_no % 2 = 0)
    SELECT e.doc_id, count(*) AS expected_pages, count(c.p) AS found_pages, round(count(c.p) / count(*)::DOUBLE, 6) AS share FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY 1"""
)
def layout_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document's sections that every other section lies on."""
    rows = table(spark, sf_dir, "rfp_sections").where("doc_id is not null")
    return layout.page_scores(rows.where("delivery_no = 1"), rows.where("section_no % 2 = 0"), "doc_id", "page_span")


@query(
    """SELECT vec_id, round(greatest(0, least(10, a)), 2) AS x0, round(greatest(0, least(8, b)), 2) AS y0, round(greatest(0, least(10, c)), 2) AS x1, round(greatest(0, least(8, d)), 2) AS y1, greatest(0, least(1, e)) AS clamped
    FROM (SELECT vec_id, embedding[1]::DOUBLE * 100 AS a, embedding[2]::DOUBLE * 100 AS b, embedding[3]::DOUBLE * 100 AS c, embedding[4]::DOUBLE * 100 AS d, embedding[5]::DOUBLE AS e FROM embeddings)"""
)
def layout_clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as boxes, kept within their page."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice(e, 1, 4), lambda x: x * 100).alias("b"), numbers.clamp(e[4]).alias("clamped"))
    boxed = rows.withColumn("b", numbers.clamped_box(F.col("b"), 10.0, 8.0))
    return boxed.select("vec_id", *(F.col("b")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "clamped")


# ---------------------------------------------------------------- texts and dialogue


@query(
    f"""WITH s AS (SELECT section_uid, string_split(regexp_replace({sql_strip('text')}, '([.!?。]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS l, {sql_tokens('heading')} AS tp FROM rfp_sections WHERE text IS NOT NULL AND heading IS NOT NULL),
    u AS (SELECT section_uid, tp, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s), h AS (SELECT section_uid, x, i, 4 * len(list_filter(tp, lambda t: contains(lower(x), lower(t)))) AS hits FROM u WHERE {sql_strip('x')} <> '')
    SELECT section_uid, arg_max({sql_strip('x')}, (hits, -length({sql_strip('x')}), -i)) AS sentence FROM h GROUP BY 1"""
)
def text_best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of a section that says most of what its heading does."""
    rows = table(spark, sf_dir, "rfp_sections").where("text is not null and heading is not null").withColumn("tp", text.tokens("heading"))
    return rows.select("section_uid", text.best_sentence("text", "tp", "tp").alias("sentence")).where("sentence is not null")


@query(
    f"""SELECT doc_row_id, array_to_string(list_distinct_ordered, '|') AS aliases FROM (SELECT doc_row_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM
    (SELECT doc_row_id, list_filter(list_transform(regexp_split_to_array(array_to_string(project_aliases, ' ; ') || ', ' || project, '[,;/|]'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM rfp_documents WHERE project_aliases IS NOT NULL AND project IS NOT NULL))"""
)
def text_alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases written as one string, read again."""
    rows = table(spark, sf_dir, "rfp_documents").where("project_aliases is not null and project is not null")
    return rows.select("doc_row_id", F.array_join(text.aliases(F.concat(F.array_join("project_aliases", " ; "), F.lit(", "), "project")), "|").alias("aliases"))


@query(
    f"""SELECT section_uid, array_to_string(CASE WHEN len(p) > 0 THEN p ELSE [heading] END, '/') AS path, {' AND '.join(f"contains(lower(text), '{w}')" for w in ('를', '다.'))} AS holds_all, md5({sql_strip("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}) AS body
    FROM (SELECT *, list_filter(list_transform(string_split(coalesce(array_to_string(section_path, ' > '), ''), '>'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM rfp_sections WHERE text IS NOT NULL AND heading IS NOT NULL)"""
)
def text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths written as one string and read again, whether a text holds certain terms, and its lines in one notation."""
    rows = table(spark, sf_dir, "rfp_sections").where("text is not null and heading is not null")
    path = text.section_path(F.coalesce(F.array_join("section_path", " > "), F.lit("")), "heading")
    return rows.select("section_uid", F.array_join(path, "/").alias("path"), text.contains_all("text", F.array(F.lit("를"), F.lit("다."))).alias("holds_all"), F.md5(text.unix_lines("text")).alias("body"))


_PLANTED = "coalesce(text, '') || ' 연락처 010-1234-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || ' , 900101-1' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || ' , user.' || doc_id || '@mail.example.kr 끝'"
_EDGE, _OUT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(p, '{_EDGE}[0-9]{{6}}[- ]?[1-4][0-9]{{6}}{_OUT}', '\\1<rrn>\\2', 'g'), '{_EDGE}01[016789][- ]?[0-9]{{3,4}}[- ]?[0-9]{{4}}{_OUT}', '\\1<phone>\\2', 'g'),
        '{_EDGE}[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.+-]*@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.-]*[\\p{{L}}\\p{{N}}_]{_OUT}', '\\1<email>\\2', 'g') AS text FROM (SELECT doc_id, {_PLANTED} AS p FROM documents)"""
)
def text_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, to each of which a phone, a personal number and an address were added, redacted."""
    key = F.col("doc_id")
    last = lambda n, w: F.lpad((key % n).cast("string"), w, "0")
    planted = F.concat(F.coalesce("text", F.lit("")), F.lit(" 연락처 010-1234-"), last(10000, 4), F.lit(" , 900101-1"), last(1000000, 6), F.lit(" , user."), key.cast("string"), F.lit("@mail.example.kr 끝"))
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(planted).alias("text"))


def _sql_plain(column: str) -> str:
    return f"lower(regexp_replace({sql_strip(column)}, '{SPACE}+', ' ', 'g'))"


_GRAM = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@query(
    f"""WITH q AS (SELECT item_id, {_sql_plain("coalesce(text, '')")} AS t FROM prompt_injection_ko), h AS (SELECT DISTINCT {_sql_plain('text')} AS t FROM eval_items),
    a AS (SELECT item_id, t, CASE WHEN length(replace(t, ' ', '')) >= 3 THEN {_GRAM.format("replace(t, ' ', '')")} ELSE [] END AS g FROM q), b AS (SELECT t AS u, CASE WHEN length(replace(t, ' ', '')) >= 3 THEN {_GRAM.format("replace(t, ' ', '')")} ELSE [] END AS k FROM h),
    s AS (SELECT item_id, CASE WHEN t = '' OR t = u THEN 1.0 ELSE coalesce(len(list_intersect(g, k)) / nullif(len(g) + len(k) - len(list_intersect(g, k)), 0)::DOUBLE, 0) END AS s FROM a, b)
    SELECT item_id, round(max(s), 6)::DOUBLE AS similarity FROM s GROUP BY 1 HAVING max(s) >= 0.7"""
)
def quality_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened queries that overlap with held-out items."""
    asked = spread(table(spark, sf_dir, "prompt_injection_ko").select("item_id", "text"))
    return quality.contaminated(asked, "item_id", "text", table(spark, sf_dir, "eval_items"), "text")


_ENTITY = "nullif(regexp_extract(text, 'RFP-[0-9]+', 0), '')"


@query(
    f"""WITH t AS (SELECT item_id, source, {_ENTITY} AS entity, CASE WHEN item_id % 5 = 0 THEN 0.6 ELSE 0.75 + (item_id % 4) * 0.05 END::DOUBLE AS c FROM prompt_injection_ko),
    s AS (SELECT *, CASE WHEN c >= 0.7 THEN entity END AS sure FROM t), w AS (SELECT item_id, row_number() OVER o AS turn_no, len(list_distinct(list(sure) FILTER (WHERE sure IS NOT NULL) OVER r)) AS active, last_value(sure IGNORE NULLS) OVER r AS context_entity, last_value(CASE WHEN sure IS NOT NULL THEN c END IGNORE NULLS) OVER r AS k
        FROM s WINDOW o AS (PARTITION BY source ORDER BY item_id), r AS (PARTITION BY source ORDER BY item_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT item_id, turn_no::INT AS turn_no, coalesce(active, 0)::INT AS active, context_entity, round(CASE WHEN active > 1 THEN least(k, 0.65) WHEN active = 1 THEN greatest(k, 0.85) END, 4)::DOUBLE AS context_confidence FROM w"""
)
def dialogue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of one source as a conversation: what it is about after each turn."""
    rows = table(spark, sf_dir, "prompt_injection_ko").select("item_id", "source", F.nullif(F.regexp_extract("text", "RFP-[0-9]+", 0), F.lit("")).alias("entity"))
    rows = rows.withColumn("c", F.when(F.col("item_id") % 5 == 0, 0.6).otherwise(0.75 + (F.col("item_id") % 4) * 0.05))
    found = dialogue.states(rows, ["source"], ["item_id"], "entity", "c")
    return found.select("item_id", "turn_no", "active", "context_entity", F.round("context_confidence", 4).alias("context_confidence"))



@query(
    f"""WITH t AS (SELECT item_id, source, CASE WHEN item_id % 3 = 0 THEN {_ENTITY} END AS entity, CASE WHEN item_id % 2 = 0 THEN '그 사업 ' || text ELSE text END AS text FROM prompt_injection_ko)
    SELECT item_id, coalesce(entity, CASE WHEN {' OR '.join(f"contains(text, '{p}')" for p in text.IMPLICIT_REFERENCES)} THEN last_value(entity IGNORE NULLS) OVER (PARTITION BY source ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS resolved_entity FROM t"""
)
def dialogue_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that refer back take the entity that was named last."""
    entity = F.when(F.col("item_id") % 3 == 0, F.nullif(F.regexp_extract("text", "RFP-[0-9]+", 0), F.lit("")))
    said = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("그 사업 "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "prompt_injection_ko").select("item_id", "source", entity.alias("entity"), said.alias("text"))
    return dialogue.resolved_references(rows, ["source"], ["item_id"], "text", "entity").select("item_id", "resolved_entity")
