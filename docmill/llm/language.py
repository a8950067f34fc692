"""Problem 7: the language of documents and of their parts, with a confidence.

Method: the script of each word narrows its candidates; words of alphabets are scored by n-grams of letters, words of Han
characters by their characters, with counts taken from labelled samples, which also say which languages there are and in
which scripts each is written. A Viterbi pass over the words' scores, with a penalty for each change of language, labels the
spans. Where a line is known to have one language, a change within it costs infinitely much, which is the same as the pass
over the sums of its words' scores; that is how it is computed then.

Confidences are the scores' softmax at a temperature that is fitted on held-out halves of the samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import WHITE_SPACE, canonical, look_alikes, lower_alnum
from .codepoints import plain, row_starts, slices, to_codepoints
from .split import LINE_BREAKS

# The languages with the usual spellings of their labels (codes of two and three letters, English names).
LABELS = {
    "ko": ("ko", "kor", "korean"),
    "en": ("en", "eng", "english"),
    "ja": ("ja", "jpn", "japanese"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
}
LATIN, HANGUL, KANA, HAN, OTHER = 1, 2, 3, 4, 5
# The scripts of these languages, for use without samples.
TYPICAL = {"ko": (HANGUL,), "en": (LATIN,), "ja": (KANA, HAN), "zh": (HAN,), "de": (LATIN,), "fr": (LATIN,), "es": (LATIN,)}
# Ranges of code points by script.
SCRIPTS = (
    (LATIN, ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    (HANGUL, ((0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3))),
    (KANA, ((0x3041, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF))),
    (HAN, ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF))),
)
#: Samples used at most for the counts (all of them are here); bounds what the driver holds.
SAMPLES = 10_000
BITS = 16
OUT = ["seg_no", "lang", "confidence", "start_pos", "end_pos", "n_segments", "doc_lang", "doc_confidence"]
#: A word speaks against a language with at most this much, an embedded Latin word with EMBEDDED against those of other scripts.
FLOOR, EMBEDDED, SWITCH = 6.0, 1.5, 3.0
#: What a change of language within a line costs where one is allowed, and EMBEDDED there: two such words are borrowed, three not.
WITHIN, BORROWED = 4.0, 3.0
EXCLUDED = 1e4
#: Share of its samples' letters from which a script counts as one of a language's own.
OWN = 0.2
#: Words of the pieces on which confidences are fitted.
PIECES = (1, 2, 4, 8, 16)


class Model(NamedTuple):
    langs: tuple[str, ...]
    own: np.ndarray  # [script, language]: in which scripts a language is written
    grams: np.ndarray  # [3 sizes of n-gram << BITS, alphabetic languages]: log of the smoothed share
    han: np.ndarray  # [1 << BITS, languages with Han]: likewise of single characters
    known: np.ndarray  # [1 << BITS]: the characters that some sample holds
    temperature: float
    alike: bytes

    @property
    def alphabetic(self) -> np.ndarray:
        return np.flatnonzero(self.own[LATIN] | self.own[OTHER])


def _scripts() -> np.ndarray:
    table = np.where(lower_alnum()[1], OTHER, 0).astype(np.uint8)
    table[0x30:0x3A] = 0
    for script, ranges in SCRIPTS:
        for a, b in ranges:
            table[a : b + 1][table[a : b + 1] > 0] = script
    import unicodedata

    for cp in np.flatnonzero(table == OTHER):
        if unicodedata.category(chr(cp))[0] == "N":
            table[cp] = 0
    table[0x30FC] = KANA
    return table


_SCRIPTS: np.ndarray | None = None


def scripts() -> np.ndarray:
    global _SCRIPTS
    if _SCRIPTS is None:
        _SCRIPTS = _scripts()
    return _SCRIPTS


def _grams(cps: np.ndarray, first: np.ndarray, script: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Positions of letters of alphabets; for n = 2, 3, 4 which of them have an n-gram within their word's bounds, and its slot."""
    low, n = lower_alnum()[0][cps].astype(np.uint32), len(cps)
    letter = (script == LATIN) | (script == OTHER)
    at = np.flatnonzero(letter)
    seq = np.where(letter, low, 0x20).astype(np.uint32)

    def near(step: int) -> np.ndarray:
        to = np.clip(at + step, 0, n - 1)
        same = (at + step >= 0) & (at + step < n)
        for k in range(1, step + 1):
            same &= ~first[np.clip(at + k, 0, n - 1)]
        if step < 0:
            same &= ~first[at]
        return np.where(same, seq[to], 0x20).astype(np.uint32)

    before, here, after, beyond = near(-1), seq[at], near(1), near(2)

    def slot(size: int, *chars: np.ndarray) -> np.ndarray:
        h = np.full(len(at), size * 0x9E37, np.uint32)
        for c in chars:
            h = (h ^ c) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (size - 2 << BITS) + (h >> np.uint32(32 - BITS)).astype(np.int64)

    always, inside = np.ones(len(at), bool), after != 0x20
    return at, [(always, slot(2, here, after)), (always, slot(3, before, here, after)), (inside, slot(4, before, here, after, beyond))]


def fit(samples: list[tuple[str, str]], calibrate: bool = True, alike: bytes = b"") -> Model:
    """Counts from (language, text) samples; bounded by the caller. Without samples only the scripts of TYPICAL decide."""
    seen = {x for x, _ in samples}
    langs = tuple([*(x for x in LABELS if x in seen), *sorted(seen - set(LABELS))]) or tuple(LABELS)
    texts = plain(pa.array([t for _, t in samples], pa.string()))
    code = np.array([langs.index(x) for x, _ in samples], np.int64)
    cps, offsets = canonical(*to_codepoints(texts), alike)
    first, script = row_starts(len(cps), offsets), scripts()[cps]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = np.zeros((OTHER + 1, len(langs)), bool)
    for k, lang in enumerate(langs):
        count = np.bincount(script[code[row] == k], minlength=OTHER + 1)[1:] if len(code) else np.zeros(OTHER)
        own[1:, k] = count >= OWN * max(count.sum(), 1)
        if not count.sum():
            own[list(TYPICAL.get(lang, (OTHER,))), k] = True
    model = Model(langs, own, np.zeros(0), np.zeros(0), np.zeros(0), 1.0, alike)
    alphabetic, eastern = model.alphabetic, np.flatnonzero(own[HAN])
    counts, han = np.full((3 << BITS, len(alphabetic)), 0.5), np.full((1 << BITS, len(eastern)), 0.5)
    at, grams = _grams(cps, first, script)
    for ok, slot in grams:
        for k, lang in enumerate(alphabetic):
            np.add.at(counts[:, k], slot[ok & (code[row[at]] == lang)], 1)
    for k, lang in enumerate(eastern):
        np.add.at(han[:, k], cps[(script == HAN) & (code[row] == lang)] & ((1 << BITS) - 1), 1)
    seen = (han > 0.5).any(axis=1)
    for size in range(3):
        part = counts[size << BITS : size + 1 << BITS]
        part /= part.sum(axis=0)
    model = model._replace(grams=np.log(counts).astype(np.float32), han=np.log(han / han.sum(axis=0)).astype(np.float32), known=seen | ~seen.any())
    return model._replace(temperature=_temperature(samples, alike)) if calibrate and len(samples) > 1 else model


def _pieces(samples: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Stretches of the samples of as many words as PIECES says; of characters, a few to a word, where no spaces are written."""
    out = []
    for lang, text in samples:
        words = text.split()
        if len(words) < max(2, len(text) // 20):
            words = [text[i : i + 3] for i in range(0, len(text), 3)]
        for n in PIECES:
            out += [(lang, " ".join(words[i : i + n])) for i in range(0, len(words) - n + 1, n)]
    return out


def piece_scores(model: Model, pieces: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Scores by language, by the root of their words, and the true language's number; pieces without letters are left out."""
    scores, words = line_scores(model, *canonical(*to_codepoints(plain(pa.array([t for _, t in pieces], pa.string()))), model.alike))
    true = np.array([model.langs.index(x) if x in model.langs else -1 for x, _ in pieces], np.int64)
    kept, words = (words != 0) & (true >= 0), np.abs(words)
    return scores[kept] / np.sqrt(words[kept])[:, None], true[kept]


def _temperature(samples: list[tuple[str, str]], alike: bytes) -> float:
    """The temperature that makes held-out pieces likeliest: each half of the samples is scored by counts from the other."""
    halves = samples[::2], samples[1::2]
    parts = [piece_scores(fit(a, False, alike), _pieces(b)) for a, b in (halves, halves[::-1])]
    parts = [(s, t) for s, t in parts if len(t)]

    def loss(temperature: float) -> float:
        total = 0.0
        for scores, true in parts:
            x = scores / temperature
            x = x - x.max(axis=1, keepdims=True)
            # A truth that scripts exclude is lost at any temperature.
            total += float(np.minimum(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), true], 50).sum())
        return total

    return min(np.geomspace(0.1, 10, 60), key=loss) if parts else 1.0


def line_scores(model: Model, cps: np.ndarray, offsets: np.ndarray, whole_lines: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of canonical lines, or words: the sum of their words' scores by language, and how many words they have.

    A word without evidence for any language does not count: one in a script that no sample is written in, or of Han characters
    that no sample holds. A line of such words alone has a score by its scripts and a count of -1.
    """
    script, first, lines = scripts()[cps], row_starts(len(cps), offsets), len(offsets) - 1
    langs, own = len(model.langs), model.own
    # Kana and Han are written without spaces: a run of both is one word here.
    kind = np.where(script == KANA, HAN, script)
    new = (kind > 0) & (first | np.concatenate(([True], kind[1:] != kind[:-1])))
    heads = np.flatnonzero(new)
    if not len(heads):
        return np.zeros((lines, langs)), np.zeros(lines, np.int64)
    word = np.cumsum(new) - 1
    of = kind[heads]
    score, told = np.full((len(heads), langs), -FLOOR), np.ones(len(heads), bool)
    score[(of == HANGUL)[:, None] & own[HANGUL]] = 0
    # Alphabets: their languages by n-grams.
    at, grams = _grams(cps, first, script)
    alphabetic = model.alphabetic
    if len(at) and len(alphabetic):
        points = np.zeros((len(at), len(alphabetic)), np.float32)
        for ok, slot in grams:
            points += model.grams[slot] * ok[:, None]
        starts = np.flatnonzero(np.concatenate(([True], word[at[1:]] != word[at[:-1]])))
        sums = np.add.reduceat(points, starts, axis=0)
        which = word[at[starts]]
        sums[~own[of[which]][:, alphabetic]] = -np.inf
        best = sums.max(axis=1, keepdims=True)
        sums -= np.where(np.isfinite(best), best, 0)
        score[which[of[which] == LATIN]] = -EMBEDDED if whole_lines else -BORROWED
        score[which[:, None], alphabetic] = np.maximum(sums, np.where(own[of[which]][:, alphabetic], -FLOOR, score[which[:, None], alphabetic]))
    # Kana is of the languages that have it; Han alone of those with Han, by its characters. Korean may hold Han.
    east = np.flatnonzero((script == HAN) | (script == KANA))
    eastern = np.flatnonzero(own[HAN])
    if len(east) and len(eastern):
        points = np.where((script[east] == HAN)[:, None], model.han[cps[east] & ((1 << BITS) - 1)], 0)
        starts = np.flatnonzero(np.concatenate(([True], word[east[1:]] != word[east[:-1]])))
        sums = np.add.reduceat(points, starts, axis=0)
        kana = np.add.reduceat(script[east] == KANA, starts, dtype=np.int64) > 0
        told[word[east[starts]]] = np.logical_or.reduceat((script[east] == KANA) | model.known[cps[east] & ((1 << BITS) - 1)], starts)
        which = word[east[starts]]
        sums -= sums.max(axis=1, keepdims=True)
        score[which[:, None], eastern] = np.where(kana[:, None], np.where(own[KANA][eastern], 0, -FLOOR), np.maximum(sums, -FLOOR))
        score[which[:, None], np.flatnonzero(own[HANGUL])] = -FLOOR / 2
    for k in (LATIN, HANGUL, HAN, OTHER):
        if not (own[k] | (own[KANA] if k == HAN else False)).any():
            score[of == k], told[of == k] = 0, False  # no language is written so
    line = np.searchsorted(offsets, heads, side="right") - 1
    # An empty line shares its offset with the next; the last of them holds the word.
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    out, words = np.zeros((lines, langs)), np.zeros(lines, np.int64)
    count = np.add.reduceat(told, starts, dtype=np.int64)
    score[~told & (np.repeat(count, np.diff(np.append(starts, len(line)))) > 0)] = 0
    out[line[starts]] = np.add.reduceat(score, starts, axis=0)
    if whole_lines:
        # A line has candidates by its scripts: none of its words is in one of theirs, so it isn't in that language. Latin
        # letters stand in texts of all languages, and a line without any may still be of one that uses them.
        has = np.stack([np.logical_or.reduceat(own[k][None, :] & (of == k)[:, None], starts, axis=0) for k in (HANGUL, HAN, OTHER)]).any(axis=0)
        kana = np.logical_or.reduceat(of == HAN, starts)[:, None] & own[KANA]
        out[line[starts]] -= EXCLUDED * ~(has | kana | own[LATIN])
    words[line[starts]] = np.where(count > 0, count, -1)
    return out, words


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: np.ndarray | float = SWITCH) -> np.ndarray:
    """The best language of each unit; units of one document stand together. All documents advance together.

    switch: what a change of language just before a unit costs.
    """
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64)
    switch = np.broadcast_to(switch, n)
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(heads, n))
    langs = np.arange(scores.shape[1])
    back = np.zeros(scores.shape, np.int64)
    total = scores.astype(float).copy()
    longest = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[longest], -np.arange(int(sizes.max())), side="left")  # documents longer than k
    for k in range(1, int(sizes.max())):
        i = heads[longest[: left[k]]] + k
        stay, best = total[i - 1], total[i - 1].argmax(axis=1)
        change = np.take_along_axis(stay, best[:, None], 1) - switch[i][:, None]
        back[i] = np.where(stay >= change, langs, best[:, None])
        total[i] += np.maximum(stay, change)
    label = np.zeros(n, np.int64)
    ends = heads + sizes - 1
    label[ends] = total[ends].argmax(axis=1)
    for k in range(1, int(sizes.max())):
        i = ends[longest[: left[k]]] - k
        label[i] = back[i + 1, label[i + 1]]
    return label


class Segments(NamedTuple):
    row: np.ndarray
    number: np.ndarray  # in its row, from 1
    code: np.ndarray  # of the model's languages
    confidence: np.ndarray
    start: np.ndarray  # code points of the row, as stored
    end: np.ndarray
    words: np.ndarray


def segments(model: Model, texts: pa.Array, within: float | None = None) -> Segments:
    """All segments of all rows; rows without letters have none. within: what a change of language within a line costs; None: it can't."""
    cps, offsets = to_codepoints(texts)
    breaks = np.isin(cps, [ord(c) for c in LINE_BREAKS])
    lines = np.unique(np.concatenate([offsets, np.flatnonzero(breaks) + 1]))
    cuts = lines if within is None else np.unique(np.concatenate([lines, _word_starts(cps)]))
    doc = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    scores, words = line_scores(model, *canonical(cps, cuts, model.alike), whole_lines=within is None)
    # Units that tell nothing belong to their neighbours like those without letters, unless their row has no others.
    told = np.zeros(len(offsets), bool)
    told[doc[words > 0]] = True
    has = (words > 0) | (words < 0) & ~told[doc]
    words = np.abs(words)
    scores, words, doc, start, end = scores[has], words[has], doc[has], cuts[:-1][has], cuts[1:][has]
    line = np.searchsorted(lines, start, side="right")
    same = np.concatenate(([False], line[1:] == line[:-1]))
    label = viterbi(scores, doc, SWITCH if within is None else np.where(same, within, SWITCH))
    if not len(label):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, np.zeros(0), none, none, none)
    heads = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))))
    doc_heads = np.flatnonzero(np.concatenate(([True], doc[heads[1:]] != doc[heads[:-1]])))
    sizes = np.diff(np.append(doc_heads, len(heads)))
    number = np.arange(len(heads)) - np.repeat(doc_heads, sizes) + 1
    count = np.add.reduceat(words, heads)
    total = np.add.reduceat(scores, heads, axis=0) / (model.temperature * np.sqrt(count))[:, None]
    share = np.exp(total - total.max(axis=1, keepdims=True))
    confidence = share[np.arange(len(heads)), label[heads]] / share.sum(axis=1)
    row, last = doc[heads], np.append(heads[1:], len(doc)) - 1
    return Segments(row, number, label[heads], confidence, start[heads] - offsets[row], end[last] - offsets[row], count)


def _word_starts(cps: np.ndarray) -> np.ndarray:
    """Where a word begins as stored: after white space, and where letters change between alphabets, Hangul and Han or kana.

    Han and kana are written without spaces; every two of them count as a word.
    """
    space = np.isin(cps, [ord(c) for c in WHITE_SPACE])
    script = scripts()[cps]
    kind = np.where(script == KANA, HAN, np.where(script == OTHER, LATIN, script))
    letter = np.flatnonzero(kind)
    change = letter[1:][kind[letter[1:]] != kind[letter[:-1]]]
    east = np.flatnonzero(kind == HAN)
    run = np.flatnonzero(np.concatenate(([True], np.diff(east) > 1))) if len(east) else east
    place = np.arange(len(east)) - np.repeat(run, np.diff(np.append(run, len(east))))
    return np.concatenate([np.flatnonzero(space[:-1] & ~space[1:]) + 1, change, east[place % 2 == 0]])


def label_code(label: str | Column, langs: tuple[str, ...] = ()) -> Column:
    """The code that a label names in a usual spelling (case, region, three letters, English name), else null.

    langs: further codes, which name themselves.
    """
    spelled = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]+)(?:[-_][A-Za-z0-9-_]+)?$", 1))
    names = LABELS | {x: (x,) for x in langs if x not in LABELS}
    return F.coalesce(*(F.when(spelled.isin(*spellings), F.lit(code)) for code, spellings in names.items()))


def sampled(samples: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model from at most SAMPLES rows, in the order of a hash of their texts; rows with a null are left out."""
    rows = samples.select(lang, text).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return fit([(r[0], r[1]) for r in rows.orderBy(F.xxhash64(text), lang).limit(SAMPLES).collect()], alike=look_alikes())


def language_segments(docs: DataFrame, key: str, text: str, samples: DataFrame | Model, keep: list[str] | None = None, within: float | None = None) -> DataFrame:
    """Every segment in one language: (key, keep..., seg_no, lang, confidence, start_pos, end_pos, n_segments, doc_lang, doc_confidence).

    The languages are those of the samples. With `within` None a line has one language and segments are consecutive lines; else
    words are labelled, and a change within a line costs so much (a change from line to line SWITCH). Lines and words without
    letters belong to their neighbours; positions are code points from 0, ends exclusive. doc_lang is the language with most
    words; doc_confidence is the share of the document's words in it, each counted by its segment's confidence. Null, empty and
    letterless texts have no segments; repeated keys each have their own. Without any sample only scripts decide. No shuffle.
    """
    model = samples if isinstance(samples, Model) else sampled(samples)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [key, *(keep or [])]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.langs, object)
        for batch in batches:
            texts = plain(batch.column(0))
            for lo, hi in slices(texts):
                s = segments(model, texts[lo:hi], within)
                by_lang, sure = np.zeros((hi - lo, len(names))), np.zeros((hi - lo, len(names)))
                np.add.at(by_lang, (s.row, s.code), s.words)
                np.add.at(sure, (s.row, s.code), s.words * s.confidence)
                main = by_lang.argmax(axis=1)
                doc_confidence = sure[np.arange(hi - lo), main] / np.maximum(by_lang.sum(axis=1), 1)
                count, at = np.bincount(s.row, minlength=hi - lo), pa.array(s.row + lo)
                own = [
                    pa.array(s.number, pa.int32()), pa.array(names[s.code], pa.string()), pa.array(s.confidence, pa.float64()), pa.array(s.start, pa.int32()), pa.array(s.end, pa.int32()),
                    pa.array(count[s.row], pa.int32()), pa.array(names[main[s.row]], pa.string()), pa.array(doc_confidence[s.row], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).take(at) for k in range(len(columns))), *own], [*columns, *OUT])

    kinds += ", seg_no int, lang string, confidence double, start_pos int, end_pos int, n_segments int, doc_lang string, doc_confidence double"
    return docs.where(F.col(text).isNotNull()).select(text, *columns).mapInArrow(label, kinds)


def document_languages(docs: DataFrame, key: str, text: str, samples: DataFrame | Model) -> DataFrame:
    """(key, lang, confidence, n_segments): the language of each document that has letters."""
    found = language_segments(docs, key, text, samples).where("seg_no = 1")
    return found.select(key, F.col("doc_lang").alias("lang"), F.col("doc_confidence").alias("confidence"), "n_segments")


def mislabelled_segments(docs: DataFrame, key: str, text: str, label: str, samples: DataFrame | Model) -> DataFrame:
    """(key, seg_no, lang): all segments of the documents whose label is missing or wrong or that hold several languages."""
    model = samples if isinstance(samples, Model) else sampled(samples)
    named = docs.select(F.col(key), F.col(text), label_code(F.col(label), model.langs).alias("named_lang"))
    found = language_segments(named, key, text, model, keep=["named_lang"])
    wrong = (F.col("n_segments") > 1) | F.col("named_lang").isNull() | (F.col("named_lang") != F.col("lang"))
    return found.where(wrong).select(key, "seg_no", "lang")
