"""One form for texts that print alike (problem 1), computed on numpy code-point arrays.

Every code point is looked up once: the table gives its expansion (full decomposition with look-alikes replaced; nothing for
invisible characters; one space for any white space). Runs of white space become one space, marks are put in canonical
order and composed with their letters, round by round over all rows at once. Circled, raised and lowered characters and
fractions keep their identity, as does letter case. Letters of other scripts that look like Latin ones come from Unicode's
data on confusable characters (`look_alikes`), which the driver reads and the tasks are handed.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import SparkSession

from .codepoints import keep, row_starts

# Characters that print like the Latin letters below them, in both rows in the same order. They stand before what
# Unicode's data says, and alone where a function is called without it.
LOOK_ALIKES = (
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),  # Greek
    ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝԚԜҮӀӏ", "ABESIJKMHOPCTYXaeopcyxsijhdqwQWYll"),  # Cyrillic
    ("ՍՏՕԼօհսոզ", "USOLohunq"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB"),  # Cherokee
)
# Hyphens and middle dots that print alike.
HYPHENS = "‐‑‒–⁃−˗﹘﹣－"
MIDDLE_DOTS = "·ᆞ•‧∙⋅⸱・ㆍ･"
# Unicode's White_Space, and blanks that are letters or symbols to Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "\u3164\uffa0\u2800"
# Characters without a print of their own beside those of the categories Cc and Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f"
# Kinds of compatibility decomposition whose characters print differently from what they decompose to.
DISTINCT = ("<circle>", "<super>", "<sub>", "<fraction>")

SPACE = 0x20
JAMO = range(0x3131, 0x318F)
LONG_S = 0x17F
S_BASE, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7
L_COUNT, V_COUNT, T_COUNT, S_COUNT = 19, 21, 28, 11172


class Tables(NamedTuple):
    first: np.ndarray  # first code point of the expansion
    length: np.ndarray  # of the expansion; 0 drops the character
    offset: np.ndarray  # where an expansion of several code points begins
    rest: np.ndarray  # these expansions, end to end
    order: np.ndarray  # canonical combining class
    pairs: np.ndarray  # (first << 21 | second), sorted
    composed: np.ndarray  # what the pair composes to
    second: np.ndarray  # letters that compose with the letter before them
    lone_jamo: np.ndarray  # jamo outside a syllable, as they are typed


def _expand(cp: int) -> tuple[int, ...]:
    """Full decomposition, short of characters that would print differently."""
    if S_BASE <= cp < S_BASE + S_COUNT or cp in JAMO or cp == LONG_S:
        return (cp,)
    parts = unicodedata.decomposition(chr(cp)).split()
    if not parts or parts[0] in DISTINCT or parts[:2] == ["<compat>", "0020"] and len(parts) > 2:
        return (cp,)
    return tuple(x for p in parts[parts[0][0] == "<" :] for x in _expand(int(p, 16)))


#: Scripts in which a reader of this text is at home, and Latin itself: their letters are none of another script's.
HOME = ("LATIN", "HANGUL", "CJK", "KATAKANA", "HIRAGANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH")


def look_alikes(spark: SparkSession | None = None) -> bytes:
    """Letters of other scripts that print like a single Latin letter, each with it: pairs of code points, four bytes each.

    By the skeletons of Unicode's confusable characters, from the ICU library that Spark ships; read once a session, on the
    driver. Where one skeleton stands for several Latin letters (I and l), capitals go to the capital. b"" without a JVM.
    """
    spark = spark or SparkSession.getActiveSession()
    sc = getattr(spark, "_sc", None)
    if sc is None:
        return b""
    if not hasattr(sc, "_docmill_look_alikes"):
        sc._docmill_look_alikes = _confusable_letters(sc._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton)
    return sc._docmill_look_alikes


def _confusable_letters(skeleton: Callable[[str], str]) -> bytes:
    ours: dict[str, dict[bool, str]] = {}
    for c in string.ascii_letters:
        ours.setdefault(skeleton(c), {})[c.isupper()] = c
    letters = [chr(cp) for cp in range(0x250, 0x32000) if unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(chr(cp)) and unicodedata.name(chr(cp), "HANGUL").split()[0] not in HOME]
    pairs = []
    for c, like in zip(letters, skeleton("\n".join(letters)).split("\n"), strict=True):
        if like in ours:
            of = ours[like]
            pairs.append((ord(c), ord(of.get(c.isupper()) or next(iter(of.values())))))
    return np.array(pairs, "<u4").tobytes()


@lru_cache(4)
def tables(more: bytes = b"") -> Tables:
    n = sys.maxunicode + 1
    first, length, offset, order = np.arange(n, dtype=np.uint32), np.ones(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.uint8)
    assigned = 0x32000  # beyond are private use, tags and variation selectors
    alike = {int(a): int(b) for a, b in np.frombuffer(more, "<u4").reshape(-1, 2)}
    alike |= {ord(a): ord(b) for theirs, ours in LOOK_ALIKES for a, b in zip(theirs, ours, strict=True)}
    alike |= dict.fromkeys(map(ord, HYPHENS), ord("-")) | dict.fromkeys(map(ord, MIDDLE_DOTS), 0xB7)
    rest: list[int] = []
    for cp in range(0xA0, assigned):
        if cp in alike:
            first[cp] = alike[cp]
            continue
        c = chr(cp)
        if unicodedata.decomposition(c):
            parts = tuple(alike.get(x, x) for x in _expand(cp))
            first[cp], length[cp], offset[cp] = parts[0], len(parts), len(rest)
            rest += parts
        order[cp] = unicodedata.combining(c)
        if unicodedata.category(c) == "Cf":
            length[cp] = 0
    length[: 0x20] = length[0x7F:0xA0] = 0
    for a, b in ((0xFE00, 0xFE10), (0xE0000, 0xE1000)):
        length[a:b] = 0
    for c in INVISIBLE:
        length[ord(c)] = 0
    for c in WHITE_SPACE + BLANKS:
        first[ord(c)], length[ord(c)] = SPACE, 1
    pairs = {}
    for cp in range(0xA0, assigned):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", chr(cp)):
            a, b = (int(x, 16) for x in parts)
            pairs[alike.get(a, a) << 21 | b] = cp if a not in alike else pairs.get(alike[a] << 21 | b, cp)
    # A look-alike letter with a mark composes as the letter that it looks like does.
    for cp in range(0xA0, assigned):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", chr(cp)) and int(parts[0], 16) not in alike:
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    keys = np.array(sorted(pairs), np.int64)
    second = np.zeros(n, bool)
    second[[int(k) & 0x1FFFFF for k in keys if order[int(k) & 0x1FFFFF] == 0]] = True
    lone = np.arange(n, dtype=np.uint32)
    for cp in reversed(JAMO):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and cp not in map(ord, MIDDLE_DOTS + BLANKS):
            lone[int(parts[1], 16)] = cp
    return Tables(first, length, offset, np.array(rest, np.uint32), order, keys, np.array([pairs[int(k)] for k in keys], np.uint32), second, lone)


def _pair(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a and b compose to, or 0."""
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    return np.where(t.pairs[at] == key, t.composed[at], 0).astype(np.uint32)


def _expanded(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = t.length[cps]
    if (length == 1).all():
        return t.first[cps], offsets
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    out = np.repeat(t.first[cps], length)
    for k in range(1, int(length.max(initial=0))):
        more = np.flatnonzero(length > k)
        out[ends[more] + k] = t.rest[t.offset[cps[more]] + k]
    return out, ends[offsets]


def _collapsed(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White space between words as one space, at a row's ends as none."""
    space = cps == SPACE
    if not space.any():
        return cps, offsets
    after = np.zeros(len(cps), bool)
    after[1:] = space[:-1]
    after |= row_starts(len(cps), offsets)
    cps, offsets = keep(cps, offsets, ~(space & after))
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    trailing = np.zeros(len(cps), bool)
    trailing[last[cps[last] == SPACE]] = True
    return keep(cps, offsets, ~trailing) if trailing.any() else (cps, offsets)


def _composed_marks(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    marks = np.flatnonzero(t.order[cps])
    if not len(marks):
        return cps, offsets
    cps, first = cps.copy(), row_starts(len(cps), offsets)
    # The marks of one letter stand side by side; marks at a row's start have no letter.
    new = np.concatenate(([True], np.diff(marks) > 1)) | first[marks]
    cps[marks] = cps[marks[np.lexsort((t.order[cps[marks]], np.cumsum(new)))]]
    order = t.order[cps[marks]]
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(marks)))
    has = ~first[marks[heads]]
    heads, count = heads[has], count[has]
    letter = marks[heads] - 1
    kept, highest = np.ones(len(cps), bool), np.zeros(len(heads), np.uint8)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        mark = heads[live] + k
        to = _pair(t, cps[letter[live]], cps[marks[mark]])
        joins = (to > 0) & ((highest[live] == 0) | (highest[live] < order[mark]))
        cps[letter[live[joins]]] = to[joins]
        kept[marks[mark[joins]]] = False
        highest[live[~joins]] = order[mark[~joins]]
    return keep(cps, offsets, kept)


def _composed_letters(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul syllables from jamo, and the few other letters that compose with the letter before them."""
    jamo = np.flatnonzero((cps >= L_BASE) & (cps < 0x1200))
    if len(jamo):
        cps, first, kept = cps.copy(), row_starts(len(cps), offsets), np.ones(len(cps), bool)
        inner = jamo[~first[jamo]]
        v = inner[(cps[inner] >= V_BASE) & (cps[inner] < V_BASE + V_COUNT) & (cps[inner - 1] >= L_BASE) & (cps[inner - 1] < L_BASE + L_COUNT)]
        cps[v - 1] = S_BASE + ((cps[v - 1] - L_BASE) * V_COUNT + (cps[v] - V_BASE)) * T_COUNT
        kept[v] = False
        x = inner[(cps[inner] > T_BASE) & (cps[inner] < T_BASE + T_COUNT)]
        before = np.where(kept[x - 1], x - 1, x - 2)
        open_syllable = (cps[before] >= S_BASE) & (cps[before] < S_BASE + S_COUNT) & ((cps[before] - S_BASE) % T_COUNT == 0)
        x, before = x[open_syllable], before[open_syllable]
        cps[before] += cps[x] - T_BASE
        kept[x] = False
        cps[jamo] = t.lone_jamo[cps[jamo]]
        cps, offsets = keep(cps, offsets, kept)
    while (at := np.flatnonzero(t.second[cps])).size:
        at = at[~row_starts(len(cps), offsets)[at]]
        to = _pair(t, cps[at - 1], cps[at])
        at, to = at[to > 0], to[to > 0]
        lone = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, bool)
        if not lone.any():
            break
        cps, kept = cps.copy(), np.ones(len(cps), bool)
        cps[at[lone] - 1] = to[lone]
        kept[at[lone]] = False
        cps, offsets = keep(cps, offsets, kept)
    return cps, offsets


def canonical(cps: np.ndarray, offsets: np.ndarray, alike: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The rows in the one form; rows of white space or nothing visible come out empty. alike: from `look_alikes`."""
    t = tables(alike)
    cps, offsets = _expanded(t, cps, offsets)
    cps, offsets = _collapsed(cps, offsets)
    cps, offsets = _composed_marks(t, cps, offsets)
    return _composed_letters(t, cps, offsets)


@lru_cache(1)
def lower_alnum() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter of each code point, and whether it is a letter or digit."""
    n = sys.maxunicode + 1
    lower, alnum = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    for cp in range(0x32000):
        c = chr(cp)
        alnum[cp] = c.isalnum()
        if len(low := c.lower()) == 1:
            lower[cp] = ord(low)
    return lower, alnum


def letters_and_digits(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical rows in lower case, reduced to letters and digits."""
    lower, alnum = lower_alnum()
    return keep(lower[cps], offsets, alnum[cps])
