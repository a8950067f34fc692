import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm.canonical import WHITE_SPACE, canonical
from docmill.llm.codepoints import plain, slices, to_codepoints, to_strings
from docmill.llm.columns import reduced, rewritten

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("abÉé가각각ｶﾞ１ＡАоΡ​­ \n　①²ﬁ㎡̣́·ㆍ‐-\U0001f4c4"), max_size=12)), max_size=8)


def form(texts):
    return rewritten(pa.array(texts, pa.string()), canonical).to_pylist()


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_round_trip(texts):
    column = plain(pa.array(texts, pa.string()))
    assert to_strings(*to_codepoints(column)).to_pylist() == [x or "" for x in texts]


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_rows_do_not_touch(texts):
    assert form(texts) == [form([x])[0] for x in texts]


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_form_is_stable_and_composed(texts):
    once = form(texts)
    assert form(once) == once
    assert all(x is None or unicodedata.is_normalized("NFC", x) for x in once)


@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cc", "Cf"]), max_size=20))
@settings(max_examples=200, deadline=None)
def test_compositions_are_one(text):
    assert form([unicodedata.normalize("NFD", text)]) == form([unicodedata.normalize("NFC", text)])


def test_prints_alike():
    same = [("ＡＢ１２", "AB12"), ("가각힣", unicodedata.normalize("NFD", "가각힣")), ("a​b­﻿", "ab"), ("РАУ аеох", "PAY aeox"), ("ﬁne", "fine"), ("㎡", "m²"), ("℃", "°C"), ("金", "金"), ("a‑b", "a-b"), ("가ㆍ나", "가·나"), ("가･나", "가·나"), (" a　\n b ", "a b"), ("ｶﾞ", "ガ"), ("ẹ́", "ẹ́")]
    for a, b in same:
        assert form([a]) == form([b]), (a, b)


def test_prints_differently():
    for a, b in [("A", "a"), ("①", "1"), ("m²", "m2"), ("a b", "ab"), ("é", "e"), ("½", "1/2"), ("ㄱㅏ", "가"), ("—", "-")]:
        assert form([a]) != form([b]), (a, b)


def test_blank_null_and_long():
    assert form([None, "", " \n​", WHITE_SPACE]) == [None, "", "", ""]
    long = "가나 " * 700_000
    assert form([long, "x"]) == [long.strip(), "x"]
    column = plain(pa.array([long, "x", long]))
    assert list(slices(column)) == [(0, 1), (1, 2), (2, 3)] or [hi for _, hi in slices(column)][-1] == 3
    assert rewritten(pa.array([], pa.string()), canonical).to_pylist() == []


def test_reduced():
    assert rewritten(pa.array(["Ａ-b, 가1!", None]), reduced).to_pylist() == ["ab가1", None]
