"""Documents, manifests, case lists and stored indexes as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfc, strip, unix_lines

# Columns of a delivery manifest, and those that must be there.
REQUIRED = ("공고 번호", "사업명", "발주 기관", "파일형식", "파일명", "텍스트")
OPTIONAL = ("공고 차수", "사업 금액", "공개 일자", "입찰 참여 시작일", "입찰 참여 마감일", "사업 요약")
SECTION = "struct<heading: string, text: string, section_path: array<string>, page_span: array<int>>"
DOCUMENT = f"doc_id string, title string, agency string, project string, metadata map<string,string>, text string, body string, sections array<{SECTION}>"
CASE = "qid string, question_type string, target_doc_ids array<string>, question string, gold_answer string, must_include array<string>, should_abstain boolean, parent_qid string"


def _stem(path: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.[^.]+$", "")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder's .json, .md and .txt files, by `parsed_documents`; raises for a folder without any."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_path"))
    if _documents_only(files).isEmpty():
        raise FileNotFoundError(f"no documents in {folder}")
    return parsed_documents(files)


def _documents_only(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("source_path", "([^/]+)$", 1)
    return files.where(name.rlike(r"(?i)\.(json|md|txt)$") & ~name.startswith(".") & ~name.isin("manifest.json", "README.md"))


def parsed_documents(files: DataFrame) -> DataFrame:
    """(doc_id, title, agency, project, metadata, sections, source_path) of whole files, given as (raw, source_path).

    Hidden files, manifest.json and README.md are left out. JSON: id and title default to the file's stem, sections without
    text go and a document without any has its body as one. Text: the title is the first line that isn't blank without its #,
    the body one section. Files without text go.
    """
    files, name = _documents_only(files), F.regexp_extract("source_path", "([^/]+)$", 1)
    stem = _stem(F.col("source_path"))
    parsed = F.from_json("raw", DOCUMENT)
    as_json = files.where(name.rlike(r"(?i)\.json$")).withColumn("d", parsed)
    kept = F.filter("d.sections", lambda s: F.coalesce(strip(s["text"]), F.lit("")) != "")
    whole = F.struct(F.lit("본문").alias("heading"), F.coalesce(strip("d.text"), strip("d.body")).alias("text"), F.lit(None).cast("array<string>").alias("section_path"), F.lit(None).cast("array<int>").alias("page_span"))
    kept = F.when(F.size(F.coalesce(kept, F.array().cast(f"array<{SECTION}>"))) > 0, kept).when(F.coalesce(whole["text"], F.lit("")) != "", F.array(whole)).otherwise(F.array())
    json_docs = as_json.select(
        F.coalesce("d.doc_id", stem).alias("doc_id"),
        F.coalesce("d.title", stem).alias("title"),
        F.coalesce("d.agency", F.lit("")).alias("agency"),
        F.coalesce("d.project", F.lit("")).alias("project"),
        F.coalesce("d.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        kept.cast(f"array<{SECTION}>").alias("sections"),
        "source_path",
    )
    body = unix_lines("raw")
    title = F.regexp_replace(F.regexp_extract(body, r"^([^\n]+)", 1), "^#+ *", "")
    section = F.struct(F.lit("본문").alias("heading"), body.alias("text"), F.lit(None).cast("array<string>").alias("section_path"), F.lit(None).cast("array<int>").alias("page_span"))
    text_docs = files.where(name.rlike(r"(?i)\.(md|txt)$") & (body != "")).select(
        stem.alias("doc_id"), title.alias("title"), F.lit("").alias("agency"), F.lit("").alias("project"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.array(section).cast(f"array<{SECTION}>").alias("sections"), "source_path",
    )
    return json_docs.where(F.size("sections") > 0).unionByName(text_docs)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A delivery manifest: CSV in UTF-8 with or without a mark, quoted line breaks, all columns as strings; raises if one is missing."""
    header = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path).limit(0)
    names = [c.lstrip("﻿") for c in header.columns]
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.select(*(strip(F.col(f"`{c}`")).alias(c) for c in names))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, key, length, modified): the files below a folder, without reading them; key is the composed file name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return rows.select("path", nfc(F.regexp_extract("path", "([^/]+)$", 1)).alias("key"), "length", F.col("modificationTime").alias("modified"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; a blank parent is none. Raises for a qid that repeats."""
    rows = read_jsonl(spark, path, CASE).withColumn("parent_qid", F.nullif(strip("parent_qid"), F.lit("")))
    again = rows.groupBy("qid").count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"repeated qid: {[r[0] for r in again]}")
    return rows


def read_history(spark: SparkSession, glob: str) -> DataFrame:
    """(snapshot, metric, value): numbers of all snapshot files, which are ordered by name."""
    return history(spark.read.text(glob, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_path")))


def history(files: DataFrame) -> DataFrame:
    """(snapshot, metric, value) of whole snapshot files, given as (raw, source_path); values that are no numbers are left out."""
    rows = files.select(_stem(F.col("source_path")).alias("snapshot"), F.from_json("raw", "map<string,string>").alias("m"))
    long = rows.select("snapshot", F.explode("m").alias("metric", "raw")).withColumn("value", F.col("raw").try_cast("double"))
    return long.where("value is not null").select("snapshot", "metric", "value")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a stored index; raises if it has no chunks."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("documents", "parent_sections", "chunks", "index_info")}
    if tables["chunks"].isEmpty():
        raise ValueError(f"no chunks in {folder}")
    return tables
