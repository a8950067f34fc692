"""Queries against metadata values: exact, by alias, by common words, and by similar phrases."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import compact, composed, nfc, strip, tokens
from ..plans.staging import BROADCAST_ROWS, staged

STRICT, REDUCED = 0.90, 0.70
#: Characters of a compact value that lead from a query to it.
KEY = 3
# Words that tell no value from another.
GENERIC = "rfp 사업 용역 구축 고도화 개발 운영 정보 시스템".split()


def metadata_targets(docs: DataFrame, fields: tuple[str, ...] = ("agency", "project")) -> DataFrame:
    """(field, value, compact, tokens): distinct values of the metadata columns; blank ones go."""
    rows = docs.select(*(F.col(f).cast("string") for f in fields)).unpivot([], list(fields), "field", "value")
    rows = rows.where("value is not null").dropDuplicates(["field", "value"])
    return rows.withColumn("compact", compact("value")).withColumn("tokens", tokens(composed("value"))).where("compact != ''")


def _grams(text: F.Column) -> F.Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - KEY + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(KEY))))


def metadata_matches(queries: DataFrame, query: str, text: str, targets: DataFrame) -> DataFrame:
    """(query, field, value, confidence, match_type): how each query names a target, its surest way only.

    compact_contains 1.0: the value stands within the query, white space and marks aside. partial_tokens: two or more common
    words, .70 + .19 of their share, at most .89. No query meets every target: the first KEY characters of a value lead from
    the queries' stretches to it, common words by equality; values shorter than KEY characters are led to by all of theirs.
    """
    q = queries.where(F.col(text).isNotNull()).select(F.col(query).alias("q"), compact(text).alias("qc"), tokens(composed(text)).alias("qt"))
    t = targets.select("field", "value", "compact", F.array_distinct("tokens").alias("tokens"))
    long = t.where(F.length("compact") >= KEY).withColumn("key", F.substring("compact", 1, KEY))
    contains = (
        q.select("q", "qc", F.explode(_grams(F.col("qc"))).alias("key")).join(long, "key").where(F.col("qc").contains(F.col("compact")))
        .select("q", "field", "value", F.lit(1.0).alias("confidence"), F.lit("compact_contains").alias("match_type"))
    )
    short = t.where(F.length("compact") == KEY - 1).withColumn("key", F.col("compact"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("qc") - 1, F.lit(1))), lambda i: F.substring(F.col("qc"), i, F.lit(KEY - 1)))
    contains_short = (
        q.select("q", F.explode(F.array_distinct(pairs)).alias("key")).join(short, "key")
        .select("q", "field", "value", F.lit(1.0).alias("confidence"), F.lit("compact_contains").alias("match_type"))
    )
    words = q.select("q", F.explode(F.array_distinct("qt")).alias("word"))
    wanted = t.select("field", "value", F.size("tokens").alias("size"), F.explode("tokens").alias("word"))
    common = words.join(wanted, "word").groupBy("q", "field", "value", "size").agg(F.count("*").alias("n"))
    sure = F.least(F.lit(0.89), 0.70 + 0.19 * F.col("n") / F.col("size"))
    partial = common.where("n >= 2").select("q", "field", "value", F.round(sure, 3).alias("confidence"), F.lit("partial_tokens").alias("match_type"))
    every = reduce(DataFrame.unionAll, [contains, contains_short, partial])
    best = every.groupBy("q", "field", "value").agg(F.max(F.struct("confidence", "match_type")).alias("m"))
    return best.select(F.col("q").alias(query), "field", "value", "m.confidence", "m.match_type")


def explicit_aliases(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(field, value, alias): the distinct aliases that documents list for a field's value; columns: field -> its array of aliases."""
    each = [docs.select(F.lit(f).alias("field"), strip(F.col(f).cast("string")).alias("value"), F.explode(c).alias("alias")) for f, c in columns.items()]
    return reduce(DataFrame.unionAll, each).where("value != ''").withColumn("alias", strip("alias")).where("alias != ''").distinct()


def cascade_matches(queries: DataFrame, query: str, text: str, docs: DataFrame, fields: tuple[str, ...] = ("agency", "project", "title"), aliases: dict[str, str] | None = None) -> DataFrame:
    """(query, field, value, confidence, match_type): the first way in which a query names a value of the metadata.

    In this order: compact_contains 1.0, the value (two characters or more) stands within the query. explicit_alias .92, one of its
    aliases does, or all of an alias's words are the query's. abbreviation .78, for an agency: a short word of it with a Latin letter
    or digit, or what follows 기관 in its name. partial_tokens: of the words that aren't generic (of all, if all are) two or more are
    the query's, .70 + .19 of their share, at most .89; or one of three characters or more, of at most two, in a project or title, .72.
    Texts count in NFC. A value has the aliases of all documents that bear it. Pairs meet as in `metadata_matches`; the last way of
    the reference, by similar phrases, is `fuzzy_matches`.
    """
    # All keys of a query stay in one partition: where the values' keys are few enough to be sent out, no pair is shuffled.
    q = queries.where(F.col(text).isNotNull()).select(F.col(query).alias("q"), nfc(text).alias("x")).select("q", compact("x").alias("qc"), tokens("x").alias("qt")).repartition("q")
    values = docs.select(*(strip(F.col(f).cast("string")).alias(f) for f in fields)).unpivot([], list(fields), "field", "value").where("value != ''")
    named = explicit_aliases(docs, aliases) if aliases else None
    every = values if named is None else values.unionAll(named.select("field", "value"))
    every = staged(every.distinct().withColumn("v", F.monotonically_increasing_id()), "values")
    t = every.where(F.col("field").isin(*fields)).withColumn("x", nfc("value")).select("v", "field", compact("x").alias("compact"), tokens("x").alias("tokens"))
    core = F.filter("tokens", lambda w: ~w.isin(GENERIC))
    t = t.withColumn("core", F.when(F.size(core) > 0, core).otherwise(F.col("tokens")))

    def keys(n: int) -> F.Column:
        at = F.sequence(F.lit(1), F.length("qc") - n + 1)
        return F.when(F.length("qc") >= n, F.transform(at, lambda i: F.substring(F.col("qc"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def lead(names: DataFrame, way: int, key: F.Column, **more: F.Column) -> DataFrame:
        """(key, v, way, part, size, long, compact): what leads from queries to names; the words of a part count together."""
        kinds = {"part": "bigint", "size": "int", "long": "int", "compact": "string"}
        return names.select(key.alias("key"), "v", F.lit(way).alias("way"), *(more.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    def within(names: DataFrame, way: int) -> DataFrame:
        """Names whose compact form may stand within a query."""
        return lead(names.where("compact != ''"), way, F.concat(F.lit("c"), F.substring("compact", 1, KEY)), compact=F.col("compact"))

    def words(names: DataFrame, way: int, **more: F.Column) -> DataFrame:
        """Words that may be a query's."""
        return lead(names, way, F.concat(F.lit("w"), F.col("word")), **more)

    leads = [within(t.where(F.length("compact") >= 2), 1)]
    if named is not None:
        named = named.join(every, ["field", "value"]).withColumn("x", nfc("alias")).select("v", "alias", compact("x").alias("compact"), F.array_distinct(tokens("x")).alias("tokens"))
        each = named.select("v", F.xxhash64("alias").alias("part"), F.size("tokens").alias("size"), F.explode("tokens").alias("word"))
        leads += [within(named, 2), words(each, 2, part=F.col("part"), size=F.col("size"))]
    short = F.filter("tokens", lambda w: (F.length(w) <= 4) & w.rlike("[a-z0-9]"))
    rest = F.when(F.col("compact").startswith("기관") & (F.length("compact") > 2), F.array(F.expr("substring(compact, 3)"))).otherwise(F.array().cast("array<string>"))
    abbreviated = t.where("field = 'agency'").select("v", F.explode(F.array_union(short, rest)).alias("word"))
    leads += [within(abbreviated.select("v", F.col("word").alias("compact")).where(F.length("compact") >= 2), 3), words(abbreviated, 3)]
    wanted = t.select("v", "field", F.size("core").alias("size"), F.explode("core").alias("word"))
    alone = F.when(F.col("field").isin("project", "title") & (F.col("size") <= 2), F.length("word")).otherwise(0)
    leads.append(words(wanted, 4, size=F.col("size"), long=alone))
    leads = staged(reduce(DataFrame.unionAll, leads), "leads")

    grams = F.array_distinct(F.concat(*(keys(n) for n in range(1, KEY + 1))))
    said = F.concat(F.transform(grams, lambda k: F.concat(F.lit("c"), k)), F.transform(F.array_distinct("qt"), lambda w: F.concat(F.lit("w"), w)))
    met = q.select("q", "qc", F.explode(said).alias("key")).join(_sent(leads), "key").where(F.col("compact").isNull() | F.col("qc").contains(F.col("compact")))
    met = met.groupBy("q", "v", "way", "part", "size").agg(F.count("*").alias("n"), F.max("long").alias("long"))
    met = met.where("CASE way WHEN 2 THEN part IS NULL OR n = size WHEN 4 THEN n >= 2 OR long >= 3 ELSE true END")
    share = F.when(F.col("n") >= 2, F.round(F.least(F.lit(0.89), 0.70 + 0.19 * F.col("n") / F.col("size")), 3)).otherwise(0.72)
    best = met.groupBy("q", "v").agg(F.min(F.struct("way", F.when(F.col("way") == 4, share).alias("share"))).alias("m")).select("q", "v", "m.*")
    names, sure = ("compact_contains", "explicit_alias", "abbreviation", "partial_tokens"), (1.0, 0.92, 0.78)
    confidence = F.coalesce("share", F.array(*map(F.lit, sure))[F.least(F.col("way"), F.lit(len(sure))) - 1])
    best = best.select("q", "v", confidence.alias("confidence"), F.array(*map(F.lit, names))[F.col("way") - 1].alias("match_type"))
    return best.join(_sent(every), "v").select(F.col("q").alias(query), "field", "value", "confidence", "match_type")


def _sent(df: DataFrame) -> DataFrame:
    """A staged table to join with, broadcast after a count; beyond BROADCAST_ROWS both sides are shuffled.

    Never left to the planner, which takes what is exploded from a small file for small, and sends it all through the driver.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


@F.pandas_udf(DoubleType())
def matching_ratio(target: pd.Series, phrase: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, t, p).ratio() for t, p in zip(target, phrase, strict=True)])


def _numbered(text: str) -> F.Column:
    """A string's characters, each with its number among its equals, in a fixed order: a multiset as a set."""
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(F.col(text), i, F.lit(1)))
    return F.array_sort(F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string"))))


def fuzzy_matches(queries: DataFrame, query: str, text: str, targets: DataFrame, floor: float = REDUCED) -> DataFrame:
    """(query, field, value, confidence): every target that a query nearly spells, by its likest phrase; `floor` is above 0.

    Phrases are the query's stretches of as many tokens as the value has, one less or one more. No pair of ratio `floor` is lost:
    a ratio f of strings of a and b characters needs f * (a + b) / 2 common ones, so at least f / (2 - f) of either. Of the
    characters in a fixed order, the first a - need + 1 and b - need + 1 must then have one in common, which leads from phrases to
    values. What meets is held against the bound itself and only then scored. Equal phrases and equal values are scored once.
    """
    share = floor / (2 - floor)
    need = lambda n: F.greatest(F.ceil(share * n - 1e-9).cast("int"), F.lit(1))
    led = lambda c, n: F.slice(c, F.lit(1), n - need(n) + 1)

    named = targets.select("field", "value", F.array_join("tokens", "").alias("whole"), F.size("tokens").alias("words")).where("whole != ''")
    wholes = named.select("whole", "words").distinct().withColumn("a", F.length("whole"))
    wholes = wholes.withColumn("size", F.explode(F.sequence(F.greatest(F.col("words") - 1, F.lit(1)), F.col("words") + 1)))
    bounds = wholes.groupBy("size").agg(F.min(need(F.col("a"))).alias("least"), F.ceil(F.max("a") / share + 1e-9).alias("most"))

    q = queries.select(F.col(query).alias("q"), tokens(composed(text)).alias("qt")).where(F.size("qt") > 0)
    at = F.sequence(F.lit(1), F.size("qt") - F.col("size") + 1)
    said = q.crossJoin(F.broadcast(bounds)).where(F.size("qt") >= F.col("size"))
    said = said.select("q", "size", "least", "most", F.explode(F.transform(at, lambda i: F.array_join(F.slice("qt", i, F.col("size")), ""))).alias("phrase"))
    said = said.where(F.length("phrase").between(F.col("least"), F.col("most"))).select("q", "size", "phrase")

    p = said.select("size", "phrase").distinct().withColumn("b", F.length("phrase")).withColumn("pc", _numbered("phrase")).withColumn("pl", led("pc", F.col("b")))
    t = wholes.withColumn("tc", _numbered("whole")).withColumn("tl", led("tc", F.col("a")))
    met = p.withColumn("c", F.explode("pl")).join(t.withColumn("c", F.explode("tl")), ["size", "c"])
    # Pairs meet at each common leading character; the first one counts.
    met = met.where(F.col("c") == F.array_intersect("pl", "tl")[0]).where(2.0 * F.size(F.array_intersect("pc", "tc")) / (F.col("a") + F.col("b")) >= floor)
    scored = met.select("size", "phrase", "whole", "words", matching_ratio("whole", "phrase").alias("s")).where(F.col("s") >= floor)
    best = said.join(scored, ["size", "phrase"]).groupBy("q", "whole", "words").agg(F.max("s").alias("s")).join(named, ["whole", "words"])
    best = best.groupBy("q", "field", "value").agg(F.max("s").alias("s"))
    return best.select(F.col("q").alias(query), "field", "value", F.round(F.least(F.lit(0.84), F.col("s")), 3).alias("confidence"))


def at_stage(matches: DataFrame, stage: str) -> DataFrame:
    """Matches sure enough for a stage: strict .90, reduced .70, none for others."""
    floor = {"strict": STRICT, "reduced": REDUCED}.get(stage)
    return matches.where(F.col("confidence") >= floor) if floor else matches.limit(0)


def longest_prefix(df: DataFrame, text: str | F.Column, prices: DataFrame, prefix: str) -> DataFrame:
    """Rows with the columns of the longest prefix that their text begins with; null without one.

    By equality on every leading part of the text that is as long as some prefix, so no row meets every prefix; a text that many
    rows share is looked up once. A prefix that repeats stands once, with the greatest of its other columns.
    """
    text = F.col(text) if isinstance(text, str) else text
    others = [c for c in prices.columns if c != prefix]
    known = prices.where(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("_p")).agg(F.max(F.struct(prefix, *others)).alias("_b"))
    lengths = known.agg(F.collect_set(F.length("_p")).alias("_n"))
    texts = df.select(text.alias("_t")).where("_t is not null").distinct()
    parts = F.transform(F.filter("_n", lambda n: n <= F.length("_t")), lambda n: F.substring("_t", F.lit(1), n))
    hits = texts.crossJoin(F.broadcast(lengths)).select("_t", F.explode(parts).alias("_p")).join(known, "_p")  # one row of lengths
    best = hits.groupBy("_t").agg(F.max_by("_b", F.length("_p")).alias("_b"))
    return df.withColumn("_t", text).join(best, "_t", "left").select(*(f"`{c}`" for c in df.columns), *(F.col("_b")[c].alias(c) for c in prices.columns))
