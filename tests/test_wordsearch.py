"""Searches by words, topics and matches: small tables against the SQL, and how much they write."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from docmill import queries, retrieval_queries
from docmill.functions import text
from docmill.operators import wordsearch

WORDS = "철도의 신호는 예산으로 일정 보안이 도면 감리에서 정산을 ABC abc 26일 서버 점검한다 화면 대장 좌표로 지침 교재 시험 기록".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ties, texts twice, none, blank; documents without an id, without sections, matched surely, nearly and not at all."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [say(rng.integers(1, 30)) for _ in range(300)] + ["철도 신호 예산"] * 40 + [None, "", "KBC 점검한다 26", "철도신호예산 ABCabc", "a" * 60 + "abc"]
    sections = [(i, None if i % 17 == 0 else f"d{i % 9}", t) for i, t in enumerate(texts)]
    asked = [(100, "철도 신호 예산은 26일"), (200, "한강청 점검 보안"), (300, "없는낱말뿐"), (400, "한강청 발매기 운영 서버 좌표"), (500, "가람청"), (600, ""), (700, None), (800, "abc ABC abc 철도"), (900, "둘째 발매기 도면 26")]
    docs = [("d1", "한강청", "발매기 운영", "한강청 발매기 운영"), ("d2", None, "둘째 발매기", "도면"), ("gone", "가람청", None, None), (None, "한강청", "지침", "x"), ("d3", "철도 신호 예산 대장", "일정", "서버 화면")]
    tables = {
        "prompt_injection_ko": (asked, "item_id bigint, text string"),
        "rfp_sections": (sections, "section_uid bigint, doc_id string, text string"),
        "rfp_documents": ([(*d, None) for d in docs], "doc_id string, agency string, project string, title string, project_aliases array<string>"),
    }
    at = tmp_path_factory.mktemp("words")
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["search_pipeline", "verify_evidence", "search_supporting"])
def test_writes_no_pairs(spark, folder, monkeypatch, name):
    sizes, stage = {}, retrieval_queries.staged

    def counted(df, n="stage"):
        out = stage(df, n)
        sizes[n] = out.count()
        return out

    monkeypatch.setattr(retrieval_queries, "staged", counted)
    assert not difference(queries.queries()[name](spark, folder), connect(folder), queries.oracle_sql()[name])
    assert max(sizes.values()) < 500, sizes  # seven queries meet 345 sections in up to three stages


def test_blocks_and_slices_change_nothing(spark, folder, monkeypatch):
    asked = spark.read.parquet(f"{folder}/prompt_injection_ko.parquet").where("text is not null").select("item_id", text.tokens("text").alias("tk"))
    asked = asked.withColumn("topics", F.array_distinct("tk"))
    found = spark.createDataFrame([(100, "d1", 0.95), (100, "d2", 0.75), (200, "gone", 0.9), (800, "d3", 0.3)], "item_id bigint, doc_id string, confidence double")
    sections = spark.read.parquet(f"{folder}/rfp_sections.parquet")

    def run(**more):
        near = wordsearch.word_search(asked, "item_id", "tk", "topics", sections, "doc_id", "section_uid", "text", found, 8, **more).collect()
        groups = {(r.item_id, r.among) for r in near}
        return {g: sorted((-r.score, r.section_uid) for r in near if (r.item_id, r.among) == g)[:8] for g in groups}

    whole = run()
    assert {(100, "strict"), (100, "reduced"), (100, "whole"), (800, "whole")} <= set(whole) and not {(200, "strict"), (800, "reduced"), (300, "whole")} & set(whole)
    monkeypatch.setattr(wordsearch, "QUERY_SLICE", 2)
    monkeypatch.setattr(wordsearch, "ROW_SLICE", 7)
    monkeypatch.setattr(wordsearch, "PAIRS", 3)
    assert run(block=2) == whole


def test_stems_are_those_of_tokens(spark):
    words = [*WORDS, *(w + p for w in ("철도", "가", "운영") for p in text.PARTICLES), *text.STOPWORDS, "RFP", "으로으로", "나에서도"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.tokens("w").alias("t")).collect()
    assert {r.w: "".join(r.t) for r in got} == {w: wordsearch.stem_of(w) for w in words}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """One text many times, as a boilerplate section is, a few others; rows in no order."""
    texts = ["철도 신호 예산 서버"] * 3000 + ["철도 신호", "예산 서버 점검한다 지침", "철도 신호 예산 서버 좌표로"]
    tables = {
        "prompt_injection_ko": ([(100, "철도 신호 예산은"), (200, "서버 점검"), (300, "한강청 철도")], "item_id bigint, text string"),
        "rfp_sections": ([(i * 7919 % 3041, "d1" if i % 2 else None, t) for i, t in enumerate(texts)], "section_uid bigint, doc_id string, text string"),
        "rfp_documents": ([("d1", "한강청", "발매기 운영", "도면", None)], "doc_id string, agency string, project string, title string, project_aliases array<string>"),
    }
    at = tmp_path_factory.mktemp("copies")
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["verify_evidence", "search_supporting"])
def test_equal_scores_are_not_all_written(spark, copies, monkeypatch, name):
    sizes, stage = {}, wordsearch.staged

    def counted(df, n="stage"):
        out = stage(df, n)
        sizes[n] = out.count()
        return out

    monkeypatch.setattr(wordsearch, "staged", counted)
    assert not difference(queries.queries()[name](spark, copies), connect(copies), queries.oracle_sql()[name])
    assert sizes["candidates"] < 3000, sizes  # three queries, in one case at three stages, of 3003 sections


def test_texts_are_read_once_for_many_queries(spark, folder, monkeypatch):
    passes, features = [], wordsearch._features
    monkeypatch.setattr(wordsearch, "_features", lambda shared: passes.append(1) or features(shared))
    asked = spark.range(9000).selectExpr("id as item_id", "array(concat('w', id), '철도') as tk", "array('철도') as topics")
    found = spark.createDataFrame([], "item_id bigint, doc_id string, confidence double")
    few = spark.read.parquet(f"{folder}/rfp_sections.parquet").where("section_uid < 5")
    assert wordsearch.word_search(asked, "item_id", "tk", "topics", few, "doc_id", "section_uid", "text", found, 8).count()
    assert len(passes) == 1


def test_features_keep_few_spellings(monkeypatch):
    """The same features where what is known of spellings is let go after every few tokens."""

    class Shared:
        value = ({"철도": 0, "신호": 1, "abc": 2}, {"철도": 0, "ab": 1, "k": 2})

    texts = ["철도 철도의 신호", "", "ABC abc 그리고 있다", "KBC 철도", "신호를 x1 x2 x3 철도신호", "..."]
    batch = pa.RecordBatch.from_pydict({"row": list(range(6)), "doc": ["d"] * 6, "text": texts})
    sets = lambda b: [[x.as_py() if k < 3 else sorted(np.frombuffer(x.as_py(), np.int32).tolist()) for x in b.column(k)] for k in (0, 1, 2, 3, 4, 5)]
    joined = lambda parts: [sum(columns, []) for columns in zip(*map(sets, parts), strict=True)]
    whole = joined(wordsearch._features(Shared)(iter([batch])))
    assert whole[2:] == [[5, 0, 5, 2, 5, 0], [[0, 1], [], [2], [0], [1], []], [[1, 2], [], [2], [1], [1], []], [[0], [], [1], [0, 2], [0], []]]
    most = []
    forget = wordsearch._Spellings.forget
    monkeypatch.setattr(wordsearch._Spellings, "forget", lambda self: most.append(len(self)) or forget(self))
    monkeypatch.setattr(wordsearch, "TOKENS", 2)
    monkeypatch.setattr(wordsearch, "KEPT", 2)
    assert joined(wordsearch._features(Shared)(iter([batch]))) == whole
    assert len(most) > 2 and max(most) < 9  # of 13


def test_tasks_give_memory_back(monkeypatch):
    class Shared:
        value = ({"철도": 0}, {"철도": 0})

    given = []
    monkeypatch.setattr(wordsearch, "_given_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"row": [1], "doc": ["d"], "text": ["철도"]})
    assert [b.num_rows for b in wordsearch._features(Shared)(iter([batch]))] == [1] and given == [1]


@pytest.fixture(scope="module")
def unnumbered(spark, folder, tmp_path_factory):
    """The tables of `folder` with more queries, of numbers that are no hundreds; some differ only in what no section holds, or in what they match."""
    asked = [(1, "철도 신호 예산은 77881"), (2, "77882 철도 신호의 예산"), (3, "철도 신호 예산 26"), (-7, "77883 예산 신호 철도"), (100, "철도 신호 예산은 26일"), (101, "한강청 점검 보안"), (102, "가람청 점검 보안"), (103, None), (104, "철도 철도 신호"), (105, "둘째 발매기 도면 77884"), (106, "둘째 발매기 도면 77885"), (107, ""), (108, "철도 신호 예산 철도의")]
    at = tmp_path_factory.mktemp("unnumbered")
    spark.createDataFrame(asked, "item_id bigint, text string").repartition(3).write.parquet(f"{at}/prompt_injection_ko.parquet")
    for name in ("rfp_sections", "rfp_documents"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_every_query_gets_its_verdicts(spark, unnumbered):
    found = queries.queries()["verify_evidence"](spark, unnumbered)
    assert not difference(found, connect(unnumbered), queries.oracle_sql()["verify_evidence"])
    assert {r.item_id for r in found.select("item_id").distinct().collect()} == {1, 2, 3, -7, 100, 101, 102, 104, 105, 106, 108}


def test_spoken_holds_every_part(monkeypatch):
    """Stems of all tokens, and in some stretch each part of up to the longest topic's letters, also where stretches are cut or let go."""
    texts = ["철도의 신호는", "abcdefghijklmnopqrstuvwxyz0123456789", "\u212aBC 가나다라마바사아자차카타파하", "...", ""]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for kept in (wordsearch.KEPT, 0):
        monkeypatch.setattr(wordsearch, "KEPT", kept)
        for longest in (1, 2, 5, 40):
            rows = [r for b in wordsearch._spoken(longest)(iter([batch])) for r in b.to_pylist()]
            assert {r["x"] for r in rows if r["stem"]} == {"철도", "신호", texts[1], "bc", wordsearch.stem_of("가나다라마바사아자차카타파하")}
            stretches = {r["x"] for r in rows if not r["stem"]}
            assert max(map(len, stretches)) <= 2 * longest
            for whole in ("철도의", "신호는", texts[1], "kbc", "가나다라마바사아자차카타파하"):
                parts = {whole[i : i + n] for n in range(1, longest + 1) for i in range(len(whole) - n + 1)}
                assert all(any(p in x for x in stretches) for p in parts)
