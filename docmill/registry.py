"""Where the core's queries are entered, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL that several queries share. White space is spelled out, for the engines' classes differ.
SPACE = r"[ \t\n\x0B\f\r\x{A0}\x{3000}]"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
COMPACT = "regexp_replace(lower(nfc_normalize({})), '[^0-9a-z가-힣]+', '', 'g')"


def sql_tokens(column: str) -> str:
    stem = f"regexp_replace(lower(x), '{text.PARTICLE_TAIL}', '\\1')"
    return f"list_filter(list_transform(regexp_extract_all({column}, '{text.TOKEN}'), lambda x: {stem}), lambda x: x <> '' AND NOT list_contains({STOP}, x))"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"
