"""Amounts of money and dates that stand within texts: found, read and rewritten, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import MYRIADS, UNITS, _small, two_digit_year
from .text import _c

# Digits and units of the notations, each with its plain form in the same place.
DIGITS = ("영공일이삼사오육칠팔구壹貳叄肆伍陸柒捌玖", "00123456789123456789")
SAME_UNITS = ("拾佰百仟千萬億兆", "십백백천천만억조")
ENVELOPES = ("일금", "원", "정", "元", "圓")
S = r"[ \t\n\x0B\f\r\x{A0}\x{3000}]*"
_BODY = rf"(?:[0-9,]+|[영공일이삼사오육칠팔구]){S}(?:[십백천]{S}(?:[0-9,]+|[영공일이삼사오육칠팔구]){S})*[십백천]?"
_HANJA = rf"[壹貳叄肆伍陸柒捌玖]{S}(?:[拾佰百仟千]{S}[壹貳叄肆伍陸柒捌玖]{S})*[拾佰百仟千]?"
_SUFFIX = rf"(?:{S}원{S}정|{S}원|{S}정)"
#: Amounts: in units with or without a suffix, plain with one, in Hanja, or with two commas at least. 정도 is no 정: see `amounts`.
AMOUNT = (
    rf"(?:일금{S})?(?:(?:{_BODY}{S}[만억조]{S})+{_SUFFIX}?|{_BODY}{_SUFFIX})|(?:{_HANJA}{S}[萬億兆]{S})+(?:{S}[元圓])?|{_HANJA}{S}[元圓]|[0-9]{{1,3}}(?:,[0-9]{{3}}){{2,}}(?:{S}원)?"
)
ABOUT, NEARLY = rf"(?:약|대략|~){S}", rf"{S}(?:\x01\x01|내외)"
FOUND = f"({ABOUT})?({AMOUNT})({NEARLY})?"
#: Dates: 2026년 3월 5일, '26.3.5, 2026-03-05 (also with . or /), 3월 5일.
DATE = rf"([0-9]{{4}})년{S}([0-9]{{1,2}})월{S}([0-9]{{1,2}})일|'([0-9]{{2}})\.([0-9]{{1,2}})\.([0-9]{{1,2}})|(?:^|[^0-9A-Za-z_가-힣])([0-9]{{4}})[-./]([0-9]{{1,2}})[-./]([0-9]{{1,2}})|(?:^|[^0-9])([0-9]{{1,2}})월{S}([0-9]{{1,2}})일"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.transform(F.array(x), f)[0]


def _bare(raw: Column) -> Column:
    """An amount's digits and units alone, in plain form."""
    out = raw
    for e in ENVELOPES:
        out = F.regexp_replace(out, e, "")
    out = F.regexp_replace(out, r"[, \t\n\x0B\f\r\x{A0}\x{3000}]", "")
    return F.translate(out, DIGITS[0] + SAME_UNITS[0], DIGITS[1] + SAME_UNITS[1])


def amount_value(raw: Column) -> Column:
    """bigint: what an amount comes to; null for none and for 0."""
    every = "".join(unit for unit, _ in MYRIADS)

    def value(number: Column) -> Column:
        total = let(F.regexp_extract(number, f"([^{every}]*)$", 1), _small)
        for unit, size in MYRIADS:
            total = total + let(F.regexp_extract(number, f"([^{every}]*){unit}", 1), _small) * size
        return F.nullif(F.round(total).cast("bigint"), F.lit(0))

    return let(_bare(raw), value)


def _marked(text: Column) -> Column:
    """정도 (nearly) out of the way of 정 (an amount's end), in the same length."""
    return F.replace(text, F.lit("정도"), F.lit("\x01\x01"))


def amounts(text: str | Column) -> Column:
    """array<struct<raw, value, approximate>>: the amounts of a text in their order, of two that begin together the longer."""
    text = _marked(_c(text))
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(FOUND), F.lit(k)).alias(n) for k, n in ((1, "about"), (2, "raw"), (3, "nearly"))))
    read = F.transform(parts, lambda p: F.struct(F.rtrim(p["raw"]).alias("raw"), amount_value(p["raw"]).alias("value"), ((p["about"] != "") | (p["nearly"] != "")).alias("approximate")))
    return F.filter(read, lambda a: a["value"].isNotNull())


def _iso(groups: list[Column], anchor: int | None) -> Column:
    """The date of a match's eleven groups; null for one that no calendar has, '' for one without a year."""
    year = F.coalesce(groups[0].try_cast("int"), two_digit_year(groups[3].try_cast("int"), anchor or 2026), groups[6].try_cast("int"), F.lit(anchor))
    month, day = (F.coalesce(*(groups[k].try_cast("int") for k in at)) for at in ((1, 4, 7, 9), (2, 5, 8, 10)))
    valid = month.between(1, 12) & day.between(1, 31)
    return F.when(valid, F.coalesce(F.format_string("%04d-%02d-%02d", year, month, day) if anchor else F.when(year.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day)), F.lit("")))


def dates(text: str | Column, anchor: int | None = None) -> Column:
    """array<struct<iso, year_inferred>>: the dates of a text in their order, as yyyy-MM-dd.

    Years of two digits are at most five beyond the anchor (2026 if none is given); a month and day alone take the anchor's
    year, without one their iso is ''.
    """
    groups = F.arrays_zip(*(F.regexp_extract_all(_c(text), F.lit(DATE), F.lit(k)).alias(f"g{k}") for k in range(1, 12)))
    read = F.transform(groups, lambda g: F.struct(_iso([g[f"g{k}"] for k in range(1, 12)], anchor).alias("iso"), ((g["g1"] == "") & (g["g7"] == "")).alias("year_inferred")))
    return F.filter(read, lambda d: d["iso"].isNotNull())


def normalized_amounts(text: str | Column) -> Column:
    """The text with its amounts as whole numbers; approximate ones stay, with the number after them in brackets."""
    marked = _marked(_c(text))
    parts = F.split(marked, FOUND, -1)
    found = F.arrays_zip(*(F.regexp_extract_all(marked, F.lit(FOUND), F.lit(k)).alias(n) for k, n in ((1, "about"), (2, "raw"), (3, "nearly"))))

    def written(p: Column) -> Column:
        raw = F.rtrim(p["raw"])
        gap = F.substring(p["raw"], F.length(raw) + 1, F.length(p["raw"]))
        near = (p["about"] != "") | (p["nearly"] != "")
        new = lambda v: F.when(v.isNull(), raw).when(near, F.concat(raw, F.lit(" [≈"), v.cast("string"), F.lit("]"))).otherwise(v.cast("string"))
        return F.concat(p["about"], let(amount_value(p["raw"]), new), gap, p["nearly"])

    rewritten = F.concat(F.transform(found, written), F.array(F.lit("")))
    out = F.array_join(F.flatten(F.zip_with(parts, rewritten, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.replace(out, F.lit("\x01\x01"), F.lit("정도"))


def normalized_dates(text: str | Column, anchor: int | None = None) -> Column:
    """The text with its dates as yyyy-MM-dd; those without a year stay as they are."""
    text = _c(text)
    parts = F.split(text, DATE, -1)
    whole = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))
    groups = F.arrays_zip(whole.alias("g0"), *(F.regexp_extract_all(text, F.lit(DATE), F.lit(k)).alias(f"g{k}") for k in range(1, 12)))

    def written(g: Column) -> Column:
        lead = F.regexp_extract(g["g0"], "^([^0-9'])", 1)
        new = lambda iso: F.when(F.coalesce(iso, F.lit("")) != "", F.concat(lead, iso)).otherwise(g["g0"])
        return let(_iso([g[f"g{k}"] for k in range(1, 12)], anchor), new)

    rewritten = F.concat(F.transform(groups, written), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(parts, rewritten, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def normalized_text(text: str | Column, anchor: int | None = None) -> Column:
    """Amounts and then dates in one notation; null stays null."""
    return let(normalized_amounts(text), lambda t: normalized_dates(t, anchor))


def forms(text: str | Column) -> Column:
    """A text and its normalized form, once if they are equal."""
    return F.array_distinct(F.array(_c(text), normalized_text(text)))


def sql_small(t: str) -> str:
    """SQL of a number under a myriad."""
    units = " + ".join(f"CASE WHEN contains({t}, '{u}') THEN coalesce(try_cast(regexp_extract({t}, '([0-9.]*){u}', 1) AS DOUBLE), 1) * {n} ELSE 0 END" for u, n in UNITS)
    return f"(coalesce(try_cast(regexp_extract({t}, '([0-9.]+)$', 1) AS DOUBLE), 0) + {units})"


def sql_amount(raw: str) -> str:
    """SQL of an amount's value."""
    bare = raw
    for e in ENVELOPES:
        bare = f"replace({bare}, '{e}', '')"
    bare = f"translate(regexp_replace({bare}, '[, \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{3000}}]', '', 'g'), '{DIGITS[0] + SAME_UNITS[0]}', '{DIGITS[1] + SAME_UNITS[1]}')"
    every = "".join(unit for unit, _ in MYRIADS)
    parts = [sql_small(f"regexp_extract({bare}, '([^{every}]*)$', 1)")] + [f"{sql_small(f'''regexp_extract({bare}, '([^{every}]*){u}', 1)''')} * {n}::DOUBLE" for u, n in MYRIADS]
    return f"nullif(round({' + '.join(parts)})::BIGINT, 0)"
