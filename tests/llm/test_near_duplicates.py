import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from docmill.llm.columns import rewritten, without_space
from docmill.llm import near_duplicates as m
from docmill.llm.near_duplicates import MISS, all_pairs, groups, missed, near_duplicates, plan
from docmill.llm.queries import p2_found


def brute(rows, threshold):
    forms = rewritten(pa.array([t for _, t in rows], pa.string()), without_space).to_pylist()
    sets = [(i, f, {f[k : k + 5] for k in range(len(f) - 4)}) for (i, _), f in zip(rows, forms, strict=True) if f]
    return {
        (min(a, b), max(a, b))
        for x, (a, fa, sa) in enumerate(sets)
        for b, fb, sb in sets[x + 1 :]
        if fa == fb or (sa and sb and len(sa & sb) >= threshold * len(sa | sb))
    }


def found(spark, rows, threshold, exact=False):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id bigint, text string, t string")
    got = [(r.id_a, r.id_b) for r in all_pairs(near_duplicates({"x": (df, "id", "text")}, threshold, exact)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["새로운"], [words[k], "추가"]])
    return " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "가나다라마" for b in "바사아자차" for c in "카타파하고"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(25)]
    rows = [(i, edited(rng.choice(texts), rng.randrange(0, 12), rng)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "가나"), (204, "가 나"), (205, "다라"), (206, rows[0][1]), (207, rows[0][1])]
    for threshold in (0.7, 0.8):
        assert found(spark, rows, threshold) == found(spark, rows, threshold, exact=True) == brute(rows, threshold)


def test_exact_at_low_threshold(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("ab", k=rng.randrange(3, 30)))) for i in range(150)]
    for threshold in (0.3, 0.5, 1.0):
        assert found(spark, rows, threshold, exact=True) == brute(rows, threshold)


def test_hot_lists_are_salted(spark, monkeypatch):
    """A family of texts that all share most of their runs; the lists are found by the sample and spread."""
    rng = random.Random(6)
    base = " ".join(rng.choices(["가나다", "라마바", "사아자", "차카타", "파하고"], k=80))
    rows = [(i, f"{base} {''.join(rng.choices('거너더러머버', k=8))}") for i in range(300)] + [(1000 + i, "".join(rng.choices("구누두루무부", k=60))) for i in range(50)]
    want = brute(rows, 0.7)
    assert len(want) > 40_000 and found(spark, rows, 0.7) == want
    monkeypatch.setattr(m, "HOT_SAMPLE", 0)  # nothing is found to be hot
    assert found(spark, rows, 0.7) == want


def test_an_id_with_several_texts(spark):
    a, b = "첫째 글은 이렇게 길게 쓰여 있어야 한다 " * 3, "둘째 글은 저렇게 다르게 쓰여 있어야만 한다 " * 3
    assert found(spark, [(1, a), (2, a), (2, b), (3, b + "끝")], 0.7) == {(1, 2), (2, 3)}
    assert found(spark, [(1, a), (1, b), (2, a), (3, b + "끝")], 0.7) == {(1, 2), (1, 3)}
    assert found(spark, [(1, a), (1, b), (2, a), (2, b + "끝")], 0.7) == {(1, 2)}


def test_many_copies_and_empty(spark):
    text = "같은 글이 아주 여러 번 나온다 " * 5
    rows = [(i, text) for i in range(40)] + [(100, text + "끝")]
    assert found(spark, rows, 0.7) == brute(rows, 0.7)
    assert found(spark, [], 0.7) == set()
    assert found(spark, [(1, None)], 0.7) == set()


def test_plan_keeps_its_miss():
    for threshold in (0.7, 0.8, 0.9):
        for n in (0, 10, 10**6, 10**9, 10**12):
            p = plan(threshold, n)
            assert missed(p, threshold) <= MISS and p.minimum == p.least * p.width >= 8


def test_query_against_brute_force(spark, data):
    got = {(r.tbl, r.id_a, r.id_b) for r in p2_found(spark, data).collect()}
    sections = [(r["section_uid"], r["text"]) for r in pq.read_table(f"{data}/rfp_sections.parquet").to_pylist()]
    chunks = {r["embedding_idx"]: r["text"] for r in pq.read_table(f"{data}/answer.parquet").to_pylist() if r["text"] is not None}
    want = {("rfp_sections", *p) for p in brute(sections, 0.7)} | {("answer", *p) for p in brute(sorted(chunks.items()), 0.7)}
    assert got == want
    assert re.search("sections", str(want))


def test_groups(spark):
    base = "그룹에 드는 글은 서로 거의 같아야 하고 다른 글과는 달라야 한다 " * 4
    rows = [(5, base), (3, base + "하나"), (9, base), (4, "전혀 다른 글이 여기에 홀로 있다"), (6, None), (7, " ")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = sorted((r.id, r.group_id, r.n_links) for r in groups(near_duplicates({"x": (df, "id", "text")}, 0.7)).collect())
    assert got == [(3, 3, 1), (4, 4, 0), (5, 3, 1), (9, 3, 1)]


def test_repeated_rows(spark):
    a = "같은 행이 두 번 들어와도 한 번만 나와야 하는 글이다 " * 3
    rows = [(1, a), (1, a), (2, a), (2, a), (3, a + "끝"), (3, a + "끝")]
    assert found(spark, rows, 0.7) == {(1, 2), (1, 3), (2, 3)}
