"""Delivered rows to documents: ids, checks, duplicates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import any_date, plain_budget, won
from ..functions.text import collapsed, nfc, slug, strip

# Formats that are read.
FORMATS = ("pdf", "hwp", "hwpx", "docx")


def canonical_doc_id(notice: str | Column, round_no: str | Column, file_name: str | Column) -> Column:
    """notice[-round], else the file's stem as a slug; round 1 and null are left out."""
    n = slug(notice)
    stem = slug(F.regexp_replace(F.regexp_extract(F.col(file_name) if isinstance(file_name, str) else file_name, "([^/]+)$", 1), r"\.[^.]+$", ""))
    r = F.col(round_no) if isinstance(round_no, str) else round_no
    suffix = F.when(r > 1, F.concat(F.lit("-"), r.cast("string")))
    return F.when(n != "", F.concat(n, F.coalesce(suffix, F.lit("")))).otherwise(F.when(stem != "", stem))


def file_format(declared: str | Column, path: str | Column) -> Column:
    """The declared format in lower case, else the file's extension."""
    d = F.lower(strip(declared))
    extension = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.when(d != "", d), F.when(extension != "", extension))


def normalized(df: DataFrame) -> DataFrame:
    """Documents with amounts, dates, format and names in one notation beside their id."""
    return df.select(
        "doc_row_id",
        canonical_doc_id("notice_no", "notice_round", "source_path").alias("canonical_id"),
        file_format("file_format", "source_path").alias("format"),
        won("budget").alias("budget_won"),
        plain_budget("budget").alias("plain_budget"),
        any_date("published_on").alias("published"),
        collapsed("agency").alias("agency"),
        F.coalesce(F.size("project_aliases"), F.lit(0)).alias("n_aliases"),
    )


def checked(df: DataFrame, doc_id: str, path: str, declared: str, arrival: list[str]) -> DataFrame:
    """Adds status and reason: the first check that a row fails, in this order.

    missing_file_name, missing_doc_id, unsupported_file_format, duplicate_doc_id (all but the first to arrive).
    """
    order = F.row_number().over(Window.partitionBy(doc_id).orderBy(*arrival))
    reason = (
        F.when(F.coalesce(strip(path), F.lit("")) == "", "missing_file_name")
        .when(F.coalesce(strip(doc_id), F.lit("")) == "", "missing_doc_id")
        .when(~F.coalesce(file_format(declared, path).isin(*FORMATS), F.lit(False)), "unsupported_file_format")
        .when(order > 1, "duplicate_doc_id")
    )
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "indexed").otherwise("failed"))


def suffixed_ids(df: DataFrame, doc_id: str, arrival: list[str], out: str = "unique_id") -> DataFrame:
    """Adds an id that no other row has: repeats get -2, -3 ... in order of arrival, past ids that are taken already.

    The k-th free number of a base lies between two numbers that are taken: each of them moves the repeats beyond it by one, so
    taken number m, the i-th of its base, is passed by all repeats from m - i + 1 on. Repeats are joined to the last that they pass.
    """
    n = F.row_number().over(Window.partitionBy(doc_id).orderBy(*arrival))
    rows = df.withColumn("_n", n)
    again = rows.where("_n > 1").groupBy(F.col(doc_id).alias("_base")).agg(F.max("_n").alias("_most"))
    taken = df.select(F.regexp_extract(doc_id, "^(.*)-([0-9]+)$", 1).alias("_base"), F.regexp_extract(doc_id, "^(.*)-([0-9]+)$", 2).alias("_s"))
    taken = taken.withColumn("_m", F.col("_s").try_cast("int")).where("_m >= 2 and _s = string(_m)").select("_base", "_m").distinct()
    passed = taken.join(again, "_base").withColumn("_i", F.row_number().over(Window.partitionBy("_base").orderBy("_m")))
    passed = passed.withColumn("_from", F.col("_m") - F.col("_i") + 1).where("_from <= _most").groupBy("_base", "_from").agg(F.max("_i").alias("_i"))
    w = Window.partitionBy(doc_id).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = passed.select(F.col("_base").alias(doc_id), F.col("_from").alias("_at"), F.lit(0).alias("_kind"), "_i")
    numbered = rows.withColumn("_at", F.col("_n")).withColumn("_kind", F.lit(1)).withColumn("_i", F.lit(None).cast("int"))
    both = numbered.unionByName(marks, allowMissingColumns=True).withColumn("_i", F.last("_i", ignorenulls=True).over(w)).where("_kind = 1")
    free = F.col("_n") + F.coalesce("_i", F.lit(0))
    return both.withColumn(out, F.when(F.col("_n") == 1, F.col(doc_id)).otherwise(F.concat(doc_id, F.lit("-"), free.cast("string")))).drop("_n", "_i", "_at", "_kind")


def ingestion_report(df: DataFrame, by: list[str], example: str, examples: int = 3) -> DataFrame:
    """(by..., n, examples): counts with the smallest few example ids of each."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(example))
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    few = df.withColumn("_k", place).where(F.col("_k") <= examples).groupBy(*by).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    on = [F.col(f"c.{b}").eqNullSafe(F.col(f"f.{b}")) for b in by]
    return counted.alias("c").join(few.alias("f"), on).select("c.*", "f.examples")


def latest(df: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """The row of each key that stands last by the columns of `newest`."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in newest))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def resolved_files(rows: DataFrame, name: str, files: DataFrame, path: str) -> DataFrame:
    """Rows with the path of their file: by its exact name, else by an equal name in composed form, the smallest path first."""
    base = F.regexp_extract(path, "([^/]+)$", 1)
    listed = files.select(F.col(path).alias("_path"), base.alias("_file")).withColumn("_key", nfc("_file"))
    names = rows.select(F.col(name).alias("_name")).where("_name is not null").distinct().withColumn("_key", nfc("_name"))
    met = names.join(listed, "_key")
    best = met.groupBy("_name").agg(F.min(F.struct((F.col("_file") != F.col("_name")).alias("_other"), "_path")).alias("_b"))
    return rows.join(best, F.col(name) == F.col("_name"), "left").select(*(rows[c] for c in rows.columns), F.col("_b._path").alias("source_file"))


def new_rows(known: DataFrame, incoming: DataFrame, key: str, approved: Column) -> DataFrame:
    """The known rows and those approved rows whose key is new; a second time adds nothing."""
    fresh = incoming.where(approved).join(known.select(key), key, "left_anti").dropDuplicates([key])
    return known.unionByName(fresh, allowMissingColumns=True)


def looked_up(rows: DataFrame, key: str, known: DataFrame, known_key: str, value: str, otherwise: Column) -> DataFrame:
    """Rows with the value that is known for their key, else for the key that `otherwise` makes of it; null without either."""
    first = known.select(F.col(known_key).alias("_k1"), F.col(value).alias("_v1"))
    second = known.select(F.col(known_key).alias("_k2"), F.col(value).alias("_v2"))
    found = rows.withColumn("_other", otherwise).join(first, F.col(key) == F.col("_k1"), "left").join(second, F.col("_other") == F.col("_k2"), "left")
    return found.select(*(rows[c] for c in rows.columns), F.coalesce("_v1", "_v2").alias(value))


def uncovered_first(rows: DataFrame, covered: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows, with covered and place: those whose key isn't covered in their order, then the others."""
    known = covered.select(F.col(key).alias("_k")).distinct()
    marked = rows.join(known, F.col(key) == F.col("_k"), "left").withColumn("covered", F.col("_k").isNotNull()).drop("_k")
    first = marked.orderBy("covered", order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("covered", order)))  # n rows


def hash_split(text: str | Column, share: float, names: tuple[str, str] = ("train", "val")) -> Column:
    """The side that a text falls on by its hash alone: `share` of all texts on the second."""
    at = F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return F.when(at < share, names[1]).otherwise(names[0])


def sampled(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows that depend on their keys and the seed alone, in a fixed order."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def duplicate_groups(df: DataFrame, key: str, row: str, examples: int = 20) -> DataFrame:
    """(key, n, rows): the keys that several rows have, with the first few of their row numbers."""
    w = Window.partitionBy(key).orderBy(row)
    several = df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w))
    out = several.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col(row)))).alias("rows"))
    return out.where("n > 1")


def frequent_and_rest(df: DataFrame, by: str, n: int, rest: str = "others") -> DataFrame:
    """(by, n): how often each of the n most frequent values comes, ties by value, and all others as one; null counts as a value."""
    counts = df.groupBy(F.coalesce(by, F.lit("none")).alias(by)).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.col("n").desc(), by).limit(n).withColumn("_k", F.col(by))
    marked = counts.join(F.broadcast(first.select(by, "_k")), by, "left")  # n rows
    return marked.groupBy(F.coalesce("_k", F.lit(rest)).alias(by)).agg(F.sum("n").alias("n"))


def audited(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds warnings: the names of all checks that a row fails, in their order; a check whose condition is null is failed."""
    failed = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    return df.withColumn("warnings", F.array_compact(failed))


def documents_of_manifest(manifest: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The manifest's rows with doc_id, format, the path of their file and a reason for those that can't be read."""
    rows = resolved_files(manifest, "파일명", files, path)
    doc_id = canonical_doc_id("공고 번호", F.col("공고 차수").try_cast("int"), "파일명")
    rows = rows.withColumn("doc_id", doc_id).withColumn("format", file_format("파일형식", "파일명"))
    reason = F.when(F.coalesce(F.col("파일명"), F.lit("")) == "", "missing_file_name").when(~F.col("format").isin(*FORMATS), "unsupported_file_format").when(F.col("source_file").isNull(), "missing_file")
    return rows.withColumn("reason", reason)
