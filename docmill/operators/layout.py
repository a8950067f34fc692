"""Runs, lines and sections: gaps and islands, paths, unit-wise restructuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import box_iou
from ..functions.text import field_candidate, fixed_windows, section_path, strip, table_cells, table_line


def runs(df: DataFrame, by: list[str], order: list[str], kind: str) -> DataFrame:
    """(by..., run_no, kind, n, first, last): stretches of rows of one kind, by the first column of `order`."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("_new", changed).withColumn("run_no", F.sum("_new").over(w))
    first, last = F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    return marked.groupBy(*by, "run_no", kind).agg(F.count("*").alias("n"), first, last)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) from 0, blank ones too."""
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\r\n|[\n\r]")).alias("line_no", "line"))


def demoted_headings(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, text): headings that are bullets (`# - x`) in runs of three or more lose their #, blank lines between them allowed."""
    bullet = F.col("line").rlike(r"^#{1,6} +[-*•○□] *\S")
    rows = lines(df, key, text).withColumn("b", bullet).withColumn("blank", strip("line") == "")
    w = Window.partitionBy(key).orderBy("line_no")
    broken = F.sum(F.when(~F.col("b") & ~F.col("blank"), 1).otherwise(0)).over(w)
    rows = rows.withColumn("run", broken)
    n = F.sum(F.col("b").cast("int")).over(Window.partitionBy(key, "run"))
    fixed = F.when(F.col("b") & (n >= least), F.regexp_replace("line", "^#+ +", "")).otherwise(F.col("line"))
    rows = rows.withColumn("fixed", fixed)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "fixed"))).alias("ls")).select(key, F.array_join(F.transform("ls", lambda x: x["fixed"]), "\n").alias("text"))


def sections_of_blocks(blocks: DataFrame, doc: str, order: str, kind: str, text: str) -> DataFrame:
    """(doc, section_no, heading, text): a heading opens a section, the blocks after it are its text."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = blocks.withColumn("section_no", F.sum((F.col(kind) == "heading").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(F.col(kind) != "heading", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    head = F.min_by(text, F.when(F.col(kind) == "heading", F.col(order)))
    grouped = rows.groupBy(doc, "section_no").agg(head.alias("heading"), body.alias("b"))
    return grouped.select(doc, "section_no", "heading", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))


def numbered_sections(docs: DataFrame, doc: str, sections: str) -> DataFrame:
    """(doc, section_id, section_no, heading, section_path, text): the sections with text, numbered with those without."""
    rows = docs.select(F.col(doc), F.posexplode(sections).alias("at", "s"))
    heading = F.coalesce(F.nullif(strip(F.col("s.heading")), F.lit("")), F.concat(F.lit("section-"), (F.col("at") + 1).cast("string")))
    out = rows.select(
        doc,
        F.format_string("%s::section-%03d", F.col(doc), F.col("at") + 1).alias("section_id"),
        (F.col("at") + 1).alias("section_no"),
        heading.alias("heading"),
        strip(F.col("s.text")).alias("text"),
    )
    return out.where("text != ''").withColumn("section_path", section_path(F.lit(None).cast("string"), "heading"))


def page_spans(spans: Column, pages: Column) -> Column:
    """The given span, else from the first to the last page of the regions; null without either."""
    return F.coalesce(F.when(F.size(spans) == 2, spans), F.when(F.size(pages) > 0, F.array(F.array_min(pages), F.array_max(pages))))


def table_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, n_rows, n_columns): runs of two or more lines that look like rows of a table with two or more cells."""
    rows = lines(df, key, text).withColumn("is_row", table_line("line") & (F.size(table_cells("line")) >= 2))
    rows = rows.withColumn("cells", F.size(table_cells("line")))
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(w)).where("is_row")
    tables = rows.groupBy(key, "run").agg(F.count("*").alias("n_rows"), F.max("cells").alias("n_columns")).where("n_rows >= 2")
    return tables.withColumn("table_no", F.row_number().over(Window.partitionBy(key).orderBy("run"))).select(key, "table_no", "n_rows", "n_columns")


def field_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, field, value) of lines `field: value`."""
    rows = lines(df, key, text).withColumn("f", field_candidate("line")).where("f is not null")
    return rows.select(key, "line_no", F.col("f.key").alias("field"), F.col("f.value").alias("value"))


def fixed_parents(sections: DataFrame, doc: str, order: list[str], heading: str, text: str, weak: tuple[str, ...] = ("", "본문")) -> DataFrame:
    """(doc, section_id, heading, text, n_sections): each document as one section, its sections under their headings in order.

    Headings in `weak` are left out. A document's sections are put together in one row, as is asked for.
    """
    title = F.coalesce(strip(heading), F.lit(""))
    body = F.when(F.lower(title).isin(*weak), strip(text)).otherwise(F.concat(title, F.lit("\n"), strip(text)))
    rows = sections.select(F.col(doc), F.struct(*order, body.alias("_b")).alias("_s")).where("_s._b is not null")
    parts = rows.groupBy(doc).agg(F.array_sort(F.collect_list("_s")).alias("_p"))
    joined = F.array_join(F.filter(F.transform("_p", lambda s: s["_b"]), lambda b: b != ""), "\n\n")
    return parts.select(doc, F.concat(F.col(doc), F.lit("::section-001")).alias("section_id"), F.lit("문서 전체").alias("heading"), strip(joined).alias("text"), F.size("_p").alias("n_sections"))


def chunk_records(sections: DataFrame, section: str, text: str, size: int, overlap: int) -> DataFrame:
    """(section, chunk_id, chunk_seq_in_section, total_chunks_in_section, start_pos, text): windows of a section's text as numbered records."""
    pieces = fixed_windows(text, size, overlap)
    rows = sections.select(F.col(section), F.size(pieces).alias("total_chunks_in_section"), F.posexplode(pieces).alias("k", "w"))
    seq = F.col("k") + 1
    chunk_id = F.format_string("%s::chunk-%03d", F.col(section), seq)
    return rows.select(section, chunk_id.alias("chunk_id"), seq.alias("chunk_seq_in_section"), "total_chunks_in_section", F.col("w.start").alias("start_pos"), F.col("w.text").alias("text"))


def structured(sections: DataFrame, doc: str, heading: str, path: str, weak: tuple[str, ...] = ("", "본문")) -> DataFrame:
    """(doc, structured): whether a document has several sections, a deep path, or one heading that says something."""
    says = ~F.lower(F.coalesce(strip(heading), F.lit(""))).isin(*weak)
    per = sections.groupBy(doc).agg(F.count("*").alias("_n"), F.max((F.size(F.coalesce(path, F.array().cast("array<string>"))) > 1) | says).alias("_s"))
    return per.select(doc, ((F.col("_n") > 1) | F.col("_s")).alias("structured"))


def valid_regions(regions: str | Column) -> Column:
    """Regions as (page_number, bbox): boxes of other than four numbers are dropped, and regions that then say nothing."""
    kept = F.transform(regions, lambda r: F.struct(r["page_number"].alias("page_number"), F.when(F.size(r["bbox"]) == 4, r["bbox"]).alias("bbox")))
    return F.filter(kept, lambda r: r["page_number"].isNotNull() | r["bbox"].isNotNull())


def union_box(boxes: Column) -> Column:
    """The least box around all boxes [x0, y0, x1, y1] of an array; null without any."""
    low = lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))
    high = lambda k: F.array_max(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, F.array(low(0), low(1), high(2), high(3)))


def found_blocks(wanted: DataFrame, key: list[str], snippet: str, blocks: DataFrame, order: str, text: str) -> DataFrame:
    """wanted with `block`: the first block of its key whose text holds the snippet, white space and case aside; null without one."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[ \t\n\r]+", " "))
    met = wanted.select(*key, F.col(snippet).alias("_w")).distinct().where("_w != ''").join(blocks.select(*key, F.col(order).alias("_o"), F.col(text).alias("_t")), key)
    first = met.where(plain(F.col("_t")).contains(plain(F.col("_w")))).groupBy(*key, "_w").agg(F.min("_o").alias("block"))
    return wanted.join(first.withColumnRenamed("_w", snippet), [*key, snippet], "left")


def field_scores(expected: DataFrame, actual: DataFrame, doc: str, field: str, value: str) -> DataFrame:
    """(doc, matched, expected, actual, precision, recall): fields whose values agree or contain one another, each used once.

    Of the fields of one key the k-th agreeing pair counts up to the smaller number of both sides' distinct values.
    """
    own = expected.select(doc, field, F.col(value).alias("_e")).distinct()
    theirs = actual.select(doc, field, F.col(value).alias("_a")).distinct()
    agree = (F.col("_e") == F.col("_a")) | F.col("_a").contains(F.col("_e")) | F.col("_e").contains(F.col("_a"))
    met = own.join(theirs, [doc, field]).where(agree)
    per = met.groupBy(doc, field).agg(F.least(F.count_distinct("_e"), F.count_distinct("_a")).alias("_m")).groupBy(doc).agg(F.sum("_m").alias("matched"))
    sizes = own.groupBy(doc).agg(F.count("*").alias("expected")).join(theirs.groupBy(doc).agg(F.count("*").alias("actual")), doc, "full_outer").na.fill(0, ["expected", "actual"])
    out = sizes.join(per, doc, "left").na.fill(0, ["matched"])
    return out.select(doc, "matched", "expected", "actual", F.round(F.try_divide("matched", "actual"), 6).alias("precision"), F.round(F.try_divide("matched", "expected"), 6).alias("recall"))


def box_scores(expected: DataFrame, actual: DataFrame, on: list[str], box: str, least: float) -> DataFrame:
    """expected with best_iou and matched: the best overlap with a box of the same key; null and false without one."""
    theirs = actual.select(*on, F.col(box).alias("_b"))
    met = expected.select(*on, box).distinct().join(theirs, on).withColumn("_i", box_iou(F.col(box), F.col("_b")))
    best = met.groupBy(*on, box).agg(F.max("_i").alias("best_iou"))
    return expected.join(best, [*on, box], "left").withColumn("matched", F.coalesce(F.col("best_iou") >= least, F.lit(False)))


def page_scores(expected: DataFrame, cited: DataFrame, doc: str, span: str) -> DataFrame:
    """(doc, expected_pages, found_pages, share): the pages of a document's expected spans that its cited spans hold."""
    pages = lambda df: df.where(F.size(span) == 2).select(doc, F.explode(F.sequence(F.col(span)[0], F.greatest(F.col(span)[0], F.col(span)[1]))).alias("_p")).distinct()
    both = pages(expected).join(pages(cited).withColumn("_c", F.lit(1)), [doc, "_p"], "left")
    out = both.groupBy(doc).agg(F.count("*").alias("expected_pages"), F.count("_c").alias("found_pages"))
    return out.withColumn("share", F.round(F.col("found_pages") / F.col("expected_pages"), 6))
