"""Text functions as Column expressions: whole-stage code, nothing per row in Python (but `nfc`, which Spark lacks)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words and endings of the Korean lexicon.
STOPWORDS = (
    "그럼 그 그리고 어떻게 알려줘 차이 차이는 차이를 비교 비교해줘 기관 요구 요구한 요구가 요구사항 조건 조건도 기능 목표 성능 초점 필수 그중 "
    "보여줘 어떤 누가 포함돼야 해 있나 무엇을 사용해 진행해 중심으로 시간 지표나 하는 것은 의 와 과 는 은 를 을 이 가 에 내 돼 무엇 뭐야 대한 "
    "있는 없는 되나요 습니까 인가요"
).split()
PARTICLES = "으로 에서 에게 도 만 나 과 와 의 은 는 이 가 을 를 로 에".split()
IMPLICIT_REFERENCES = ("그 기관", "그 사업", "그 시스템", "그 문서", "그 프로젝트", "해당 기관", "해당 사업", "해당 시스템", "이 기관", "이 사업", "그럼", "그중")
COMPARISON_CUES = ("차이", "비교", "각각", "대비")
# White space of either regular-expression engine, spelled out.
SPACE = r"[ \t\n\x0B\f\r\x{A0}\x{3000}]"
TOKEN = "[A-Za-z0-9]+|[가-힣]+"
# Fixed value: ranges that hold all characters that combine with others or are replaced by others in the composed form.
MAY_COMPOSE = (
    r"[\x{300}-\x{36f}\x{374}\x{37e}\x{387}\x{483}-\x{487}\x{591}-\x{1dff}\x{1f00}-\x{2001}\x{20d0}-\x{20ff}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}"
    r"\x{2adc}\x{2cef}-\x{2cf1}\x{2d7f}\x{2de0}-\x{2dff}\x{302a}-\x{302f}\x{3099}\x{309a}\x{a66f}-\x{abed}\x{f900}-\x{fb4f}\x{fe20}-\x{fe2f}\x{10000}-\x{2fa1f}]"
)
PARTICLE_TAIL = f"^([가-힣]{{2,}}?)(?:{'|'.join(PARTICLES)})+$"
# Patterns of personal data and what replaces them, in the order in which they apply.
PII = (
    (r"(?U)\b\d{6}[-\s]?[1-4]\d{6}\b", "<rrn>"),
    (r"(?U)\b01[016789][-\s]?\d{3,4}[-\s]?\d{4}\b", "<phone>"),
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<email>"),
)
# Labelled patterns of instructions within queries.
INJECTIONS = (
    ("ko-ignore-prior", r"이전\s*(지시|답변|시스템\s*(프롬프트|지시))[^\n]*?(무시|삭제|폐기|잊)"),
    ("ko-bypass-agency", r"발주\s*기관[^\n]*?(무시|상관\s*없|상관없)"),
    ("ko-reveal-system", r"(시스템\s*프롬프트|숨겨진\s*(규칙|지시|프롬프트))[^\n]*?(공개|드러내|보여)"),
    ("ko-role-override", r"(역할|페르소나|기본\s*규칙)[^\n]*?(잊|재설정|바꿔|버려)"),
    ("ko-rating-injection", r"이\s*문서[^\n]*?(평가\s*기준|점수)[^\n]*?(만점|최고|일등)"),
    ("ko-jailbreak-dan", r"DAN\s*(모드|를?\s*활성화|으로서|이란)"),
    ("ko-urgency-override", r"(원래\s*지시를?\s*(취소|무효|무시)|모든\s*제한을?\s*(해제|없애|제거))"),
    ("ko-reveal-instructions", r"(숨겨진\s*지시\s*사항|당신이\s*받은[^\n]*지시|시스템\s*지시를?\s*(출력|공개|알려))"),
    ("ko-reset-context", r"(이전|기존)\s*(규칙|지시)[^\n]*(유효하지\s*않|무효|더\s*이상)"),
    ("ko-unconstrained-ai", r"제한\s*(없는|없이)[^\n]*AI"),
    ("ko-frame-override", r"(교육|창작|연구|훈련\s*데이터|소설\s*속)[^\n]*(이전\s*(지시|제약|설정|규칙)[^\n]*(무시|없애|우회|삭제))"),
    ("ko-simulation-reset", r"(시뮬레이션\s*모드|이전[^\n]*(지시|설정)[^\n]*(삭제|초기화)[^\n]*새로)"),
    ("ko-original-override", r"원래\s*(지시|시스템)[^\n]*(무시|우회|삭제|잊)"),
    ("en-ignore-prior", r"(?i)ignore\s+(?:previous|prior|all\s+previous|the\s+system)\s+(?:instruction|prompt|answer|system|rules?)"),
    ("en-ignore-all-caps", r"(?i)IGNORE\s+ALL\s+(?:PREVIOUS\s+)?INSTRUCTIONS?"),
    ("en-reveal-system", r"(?i)(?:reveal|show|print)\s+(?:the\s+)?(?:system|hidden|internal)\s+prompt"),
    ("en-forget-context", r"(?i)forget\s+(?:everything|all\s+context|the\s+rules)"),
)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form; Spark has no function for it."""
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form without case; Spark has no function for it."""
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x).casefold())


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: str | Column) -> Column:
    """Stripped, inner white space as one space."""
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def composed(text: str | Column) -> Column:
    """Unicode's composed form; only texts that may not be in it leave the JVM."""
    text = _c(text)
    return F.coalesce(nfc(F.when(text.rlike(MAY_COMPOSE), text)), text)


def compact(text: str | Column) -> Column:
    """In composed form and lower case, letters a-z, digits and Hangul syllables only."""
    return F.regexp_replace(F.lower(composed(text)), "[^0-9a-z가-힣]+", "")


def stemmed(token: Column) -> Column:
    """A token in lower case, a Hangul one without the particles at its end (two syllables stay)."""
    # Few tokens end like a particle; only they meet the pattern.
    ends = F.substring(token, -1, 1).isin(*{p[-1] for p in PARTICLES}) & (F.length(token) > 2)
    return F.when(ends, F.regexp_replace(F.lower(token), PARTICLE_TAIL, "$1")).otherwise(F.lower(token))


def tokens(text: str | Column, stopwords: tuple[str, ...] | list[str] = STOPWORDS) -> Column:
    """Stemmed tokens without stop words, in order; null for null."""
    words = F.transform(F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0)), stemmed)
    return F.filter(words, lambda t: ~t.isin("", *stopwords))


def sentences(text: str | Column) -> Column:
    """Split after . ! ? 。 before white space; blank pieces go."""
    parts = F.split(strip(text), rf"(?<=[.!?。]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def fixed_windows(text: str | Column, size: int, overlap: int) -> Column:
    """array<struct<start, text>>: windows of `size` characters that overlap, the last may be shorter; none for blank text."""
    text = _c(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    starts = F.filter(starts, lambda i: (i == 0) | (i + overlap < F.length(text)))
    windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("text")))
    return F.when(F.length(strip(text)) > 0, windows)


def char_grams(text: str | Column, n: int = 3) -> Column:
    """Distinct stretches of n characters of the text without white space, in lower case."""
    bare = F.regexp_replace(F.lower(_c(text)), f"{SPACE}+", "")
    at = F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1)))
    return F.when(F.length(bare) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(bare, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Share of common elements of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union > 0, F.size(F.array_intersect(_c(a), _c(b))) / union).otherwise(0.0)


def aliases(text: str | Column) -> Column:
    """Values of a list in one string, split at , ; / or |, stripped and distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(_c(text), "[,;/|]"), strip), lambda x: x != ""))


def pipe_values(text: str | Column) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"\|"), strip), lambda x: x != "")


def section_path(path: str | Column, heading: str | Column) -> Column:
    """Parts of an `a > b` path, else the heading alone."""
    parts = F.filter(F.transform(F.split(_c(path), ">"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(_c(heading)))


def slug(text: str | Column) -> Column:
    return F.regexp_replace(strip(text), f"{SPACE}+", "-")


def unix_lines(text: str | Column) -> Column:
    return strip(F.regexp_replace(_c(text), "\r\n?", "\n"))


def redacted(text: str | Column) -> Column:
    """Personal numbers, phones and addresses replaced by tokens; a second time changes nothing."""
    out = _c(text)
    for pattern, token in PII:
        out = F.regexp_replace(out, pattern, token)
    return out


def injection_labels(text: str | Column) -> Column:
    """Labels of the patterns that occur, in their fixed order; an empty array for null."""
    found = F.array(*(F.when(_c(text).rlike(pattern), F.lit(label)) for label, pattern in INJECTIONS))
    return F.array_compact(found)


def contains_any(text: str | Column, terms: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | _c(text).contains(term)
    return found


def contains_all(text: str | Column, terms: str | Column) -> Column:
    """Whether all terms of an array occur, whatever their case; true for none."""
    return F.forall(_c(terms), lambda t: F.lower(_c(text)).contains(F.lower(t)))


def best_sentence(text: str | Column, topics: str | Column, words: str | Column) -> Column:
    """The sentence with most hits (3 a topic, 1 a word); then the shortest; then the first."""
    s = sentences(text)
    hits = lambda x, terms: F.size(F.filter(_c(terms), lambda t: F.lower(x).contains(F.lower(t))))
    scored = F.transform(s, lambda x, i: F.struct((3 * hits(x, topics) + hits(x, words)).alias("hits"), (-F.length(x)).alias("length"), (-i).alias("at"), x.alias("text")))
    return F.array_max(scored)["text"]


def ends_mid_sentence(text: str | Column) -> Column:
    """Whether a text, without closing brackets and quotes, ends in neither a sentence mark nor a usual final syllable."""
    end = F.regexp_replace(F.regexp_replace(_c(text), f"{SPACE}+$", ""), "[)\\]}\"'」』”’》〉】]+$", "")
    return (end != "") & ~end.rlike("[.!?。…다음임함됨요]$")


def table_line(line: str | Column) -> Column:
    return _c(line).rlike(r"\||\t|\S {2,}\S.* {2,}\S")


def table_cells(line: str | Column) -> Column:
    return F.filter(F.transform(F.split(_c(line), r"\||\t| {2,}"), strip), lambda x: x != "")


def field_candidate(line: str | Column) -> Column:
    """struct<key, value> of a `key: value` line, else null."""
    key, value = (strip(F.regexp_extract(_c(line), r"^([^:：]{1,30})[:：](.+)$", k)) for k in (1, 2))
    return F.when((key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


# What marks instructions within documents, and what takes its place.
CHAT_TOKEN = r"(?i)<\|(?:im_start|im_end|system|user|assistant|tool|begin_of_text|end_of_text|fim_[a-z_]+|endoftext)\|>"
ROLE_LINE = r"(?im)^([ \t]*(?:SYSTEM|ASSISTANT|USER|TOOL)[ \t]*:[ \t]*[^\n]+)$"
OVERRIDE_LINE = r"(?im)^([ \t]*(?:ignore|disregard|forget|override|bypass|skip)\b[^.\n]{0,80}?\b(?:instructions?|prompts?|rules?|directives?|system|guidance)\b[^\n]*)$"
LITERAL_MARKER = r"\[/?INSTRUCTION_LIKE\]"
# The axes of Korean tender texts, each with its pattern.
AXES = (
    ("currency", r"[0-9][0-9,]* *원|일금|[0-9]+ *[억만천백] *[원만천]?|[일이삼사오육칠팔구] *[억만천] *원?"),
    ("date", r"[0-9]{4} *[-./] *[0-9]{1,2} *[-./] *[0-9]{1,2}|[0-9]{4} *년 *[0-9]{1,2} *월|['‘’][0-9]{2} *[-./] *[0-9]{1,2}"),
    ("hanja", r"[㐀-䶿一-鿿]"),
    ("project_number", r"\[[가-힣A-Za-z]+\]|사업번호|입찰공고|사전공개|[A-Z0-9]{2,}-[A-Z0-9][A-Z0-9-]*"),
    ("abbreviation", r"\([A-Z]{2,6}\)|[A-Z]{2,6} *(?:구축|시스템|사업)"),
)
# How headings begin, and words that a short line is a heading by.
HEADING_START = r"^(제[ \t]*[0-9]+[ \t]*[장절]|[IVXLC]+\.|[0-9]+[).]|[가-힣]\.)"
HEADING_WORDS = ("제안요청", "사업개요", "사업 개요", "요구사항", "과업내용", "과업 내용", "입찰", "평가", "목차", "security requirements", "requirements")
# Where a section may begin: titles, numberings and headings at a line's start, or after two blank lines.
BOUNDARY = r"(?m)^[ \t]*(?:제[ \t]*[0-9]+[ \t]*[장조항편]|[0-9]+(?:\.[0-9]+)*[ \t]+|\([0-9가-힣]+\)[ \t]+|[가-힣]\.[ \t]+|#{1,6}[ \t]+[^ \t\n])"


def neutralized(text: str | Column) -> Column:
    """Lines that give instructions in brackets, chat tokens replaced; marks of that kind that were there before are renamed first."""
    out = F.regexp_replace(_c(text), LITERAL_MARKER, "[INPUT_MARKER]")
    out = F.regexp_replace(out, CHAT_TOKEN, "[REDACTED_CHAT_TOKEN]")
    for line in (ROLE_LINE, OVERRIDE_LINE):
        out = F.regexp_replace(out, line, "[INSTRUCTION_LIKE]$1[/INSTRUCTION_LIKE]")
    return out


def axes(text: str | Column) -> Column:
    """Names of the axes whose pattern occurs, in their fixed order."""
    return F.array_compact(F.array(*(F.when(_c(text).rlike(pattern), F.lit(name)) for name, pattern in AXES)))


def first_line(text: str | Column) -> Column:
    """The first line that isn't blank, stripped; '' without one."""
    return F.regexp_extract(strip(text), r"^([^\r\n]*)", 1)


def block_kind(text: str | Column) -> Column:
    """heading, table or text, by a block's first line."""
    line = strip(first_line(text))
    bare = F.regexp_replace(line, f"{SPACE}+", "")
    short = (F.length(bare) > 0) & (F.length(bare) <= 48) & ~line.contains(":") & ~line.rlike("[.?!。]$")
    named = short & contains_any(F.lower(line), HEADING_WORDS)
    return F.when(line.rlike(HEADING_START) | named, "heading").when(table_line(line), "table").otherwise("text")


def without_contents_noise(text: str | Column) -> Column:
    """Leaders of dots as one space, lines of page numbers left out."""
    out = F.regexp_replace(F.regexp_replace(_c(text), "·{8,}", " "), r"\.{15,}", " ")
    lines = F.filter(F.split(out, "\n"), lambda x: ~x.rlike(r"^\|+-[0-9]+-\|+$"))
    return F.when(out.isNotNull(), F.array_join(lines, "\n"))


def boundaries(text: str | Column, least: int = 300) -> Column:
    """array<int>: where a section may begin (from 0, without 0), in texts of `least` characters and more."""
    text = _c(text)
    ends = F.regexp_replace(F.regexp_replace(text, r"(\n[ \t]*\n[ \t]*\n[ \t\n]*)", "$1\x02"), BOUNDARY, "\x02$0")
    parts = F.split(ends, "\x02", -1)
    lengths = F.transform(parts, F.length)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    inner = F.array_distinct(F.filter(F.slice(starts, F.lit(1), F.size(parts) - 1), lambda p: (p > 0) & (p < F.length(text))))
    return F.when(F.length(text) >= least, inner).otherwise(F.array().cast("array<int>"))


def body_sections(text: str | Column, least: int = 80) -> Column:
    """array<struct<heading, text>>: the stretches between the boundaries, those under `least` characters joined to the one before.

    A text without two such stretches is one section.
    """
    text = _c(text)
    cuts = F.concat(F.array(F.lit(0)), boundaries(text), F.array(F.length(text)))
    pieces = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: strip(F.substring(text, a + 1, b - a)))
    empty = F.array().cast("array<string>")

    def merge(done: Column, piece: Column) -> Column:
        last = F.concat(F.element_at(done, -1), F.lit("\n"), piece)
        short = (F.size(done) > 0) & (F.length(piece) < least)
        return F.when(piece == "", done).when(short, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(last))).otherwise(F.concat(done, F.array(piece)))

    merged = F.aggregate(pieces, empty, merge)
    whole = F.array(F.struct(F.lit("본문").alias("heading"), text.alias("text")))
    return F.when(F.size(merged) < 2, whole).otherwise(F.transform(merged, lambda p: F.struct(F.substring(strip(first_line(p)), 1, 80).alias("heading"), p.alias("text"))))


def char_counts(text: str | Column) -> Column:
    """map<character, count> of a text without white space."""
    chars = F.filter(F.split(F.regexp_replace(_c(text), f"{SPACE}+", ""), ""), lambda c: c != "")
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.size(F.filter(chars, lambda x: x == c)))))
