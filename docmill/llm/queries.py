"""The queries of the numbered problems over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoded
from .language import WITHIN, document_languages, language_segments, mislabelled_segments
from .leaks import leaked
from .near_duplicates import NearDuplicates, all_pairs, groups, near_duplicates
from .same_text import canonical_rows, same_print_pairs
from .split import FULL, split_sections
from .top_items import top_items


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {
        "rfp_sections": (_table(spark, sf_dir, "rfp_sections"), "section_uid", "text"),
        "prompt_injection_ko": (_table(spark, sf_dir, "prompt_injection_ko"), "item_id", "text"),
    }


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_print_pairs(_texts(spark, sf_dir))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, text): every text in the one form."""
    return canonical_rows(_texts(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    answer = _table(spark, sf_dir, "answer").where("embedding_idx is not null and text is not null")
    chunks = answer.groupBy("embedding_idx").agg(F.first("text").alias("text"))  # a chunk always has the same text
    sections = _table(spark, sf_dir, "rfp_sections")
    return near_duplicates({"rfp_sections": (sections, "section_uid", "text"), "answer": (chunks, "embedding_idx", "text")}, threshold=0.7)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(_near(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, group_id, n_links): the group of nearly the same text that each row belongs to."""
    return groups(_near(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _table(spark, sf_dir, "rfp_sections").where(F.length("text") > 520)  # only these are asked for
    return split_sections(long, "section_uid", "text", 520, overlap=1, costs=FULL).drop("total_chunks_in_section")


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_uid, chunk_seq_in_section, total_chunks_in_section, start_pos, end_pos, text): every section in pieces of even size, up to two sentences shared."""
    return split_sections(_table(spark, sf_dir, "rfp_sections"), "section_uid", "text", 520, overlap=2, with_text=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(_table(spark, sf_dir, "answer"), ["doc_id", "parent_section_id"], "score", "evidence_id", 5, same=["answer_id", "chunk_id"])


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled_segments(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", _table(spark, sf_dir, "lang_samples"))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, n_segments): all segments of all documents."""
    docs, samples = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "lang_samples")
    found = language_segments(docs, "doc_id", "text", samples)
    return found.select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "n_segments")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, start_pos, end_pos): as p7_segments, but a line may hold several languages."""
    docs, samples = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "lang_samples")
    found = language_segments(docs, "doc_id", "text", samples, within=WITHIN)
    return found.select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "start_pos", "end_pos")


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, confidence, n_segments): the language of every document with letters."""
    found = document_languages(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "lang_samples"))
    return found.withColumn("confidence", F.round("confidence", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_groups, p3_found, p3_chunks, p4_found, p5_ids, p6_found, p7_found, p7_segments, p7_spans, p7_documents)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say; the other problems are tested against brute force, round trips and held-out accuracy."""
    return {
        "p4_found": """
            WITH one AS (
                SELECT doc_id, parent_section_id, evidence_id, score,
                       row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY evidence_id) AS copy
                FROM answer
                WHERE doc_id IS NOT NULL AND parent_section_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY doc_id, parent_section_id ORDER BY score DESC, evidence_id) AS k
                FROM one WHERE copy = 1
            )
            SELECT doc_id, parent_section_id, evidence_id FROM ranked WHERE k <= 5
        """,
    }
