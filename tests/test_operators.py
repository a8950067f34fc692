import difflib
import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from docmill.functions import text
from docmill.operators import dialogue, evaluation, ingest, layout, matching, quality, ranking, retrieval, statistics
from docmill.plans.presets import make_plan, stages


def test_top_k_with_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.choice([0.1, 0.5, 0.5, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, s double")
    got = {(r.g, r.i, r.rank) for r in ranking.top_k(df, ["g"], [F.col("s").desc_nulls_last(), F.col("i").asc()], 4, "i").collect()}
    groups = defaultdict(list)
    for g, i, s in rows:
        groups[g].append((-(s if s is not None else -1), i))
    assert got == {(g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:4])}


def test_balanced_top_k_gives_each_target_its_share(spark):
    rows = [("q", "a", i, 1.0 - i / 100) for i in range(10)] + [("q", "b", 50, 0.01), ("q", "c", 60, 0.02)]
    df = spark.createDataFrame(rows, "q string, t string, i int, s double")
    got = [(r.t, r.i) for r in ranking.balanced_top_k(df, ["q"], "t", ["a", "b"], "s", "i", 4).orderBy("rank").collect()]
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 50)]


def test_rerank_keeps_the_tail(spark):
    df = spark.createDataFrame([("q", i, 1.0 - i / 10, float(i)) for i in range(6)], "q string, i int, s double, x double")
    out = ranking.reranked(df, ["q"], "s", "i", F.col("x"), 3).orderBy("rank").collect()
    assert [r.i for r in out] == [2, 1, 0, 3, 4, 5]


def test_bm25_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, rng.choices("abcdef", k=rng.randrange(0, 8)) or None) for i in range(40)]
    asked = [(1, ["a", "a", "f"]), (2, ["zz"]), (3, [])]
    got = retrieval.bm25(spark.createDataFrame(docs, "d int, t array<string>"), "d", "t", spark.createDataFrame(asked, "q int, w array<string>"), "q", "w", 5)
    n, avg = len(docs), sum(len(t or []) for _, t in docs) / len(docs)
    want = set()
    for q, words in asked:
        scored = []
        for d, t in docs:
            s = 0.0
            for w in set(words):
                df, tf = sum(w in (x or []) for _, x in docs), (t or []).count(w)
                if tf:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
            if s:
                scored.append((-round(s, 6), d))
        want |= {(q, d, k + 1) for k, (_, d) in enumerate(sorted(scored)[:5])}
    assert {(r.q, r.d, r.rank) for r in got.collect()} == want


def test_dense_top_k_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(98, [0.0] * 8), (99, None)]
    df = spark.createDataFrame(v, "k bigint, v array<double>").repartition(5)
    asked = df.where("k % 5 = 0").select(F.col("k").alias("q"), F.col("v").alias("w"))
    m = np.array([x for _, x in v[:60]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = {(q, int(k), r + 1) for q in range(0, 60, 5) for r, k in enumerate(np.lexsort((np.arange(60), -np.round(m @ m[q], 6)))[:3])}
    for block in (4096, 5):
        got = {(r.q, r.k, r.rank) for r in retrieval.dense_top_k(df, "k", "v", asked, "q", "w", 3, block).collect()}
        assert got == want
    assert retrieval.dense_top_k(df, "k", "v", asked.limit(0), "q", "w", 3).count() == 0


def test_filter_falls_back_to_all(spark):
    df = spark.createDataFrame([("d1", "a", "p"), ("d2", "b", "q")], "doc_id string, agency string, project string")
    assert [r.doc_id for r in retrieval.filtered_or_all(df, ["d2"], ["a"]).collect()] == ["d2"]
    assert retrieval.filtered_or_all(df, None, ["a"], ["q"]).count() == 2
    assert [r.fallback_used for r in retrieval.filtered_or_all(df, ["none"]).collect()] == [True, True]


def test_hard_negatives(spark):
    rows = [(1, f"d{i % 4}", "d0", i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "q int, d string, own string, rank int")
    a = [tuple(r) for r in retrieval.hard_negatives(df, "q", "d", "own", 3, 12, 4).collect()]
    assert len(a) == 4 and all(3 <= r[3] <= 12 and r[1] != "d0" for r in a)
    assert sorted(a) == sorted(tuple(r) for r in retrieval.hard_negatives(df.repartition(4), "q", "d", "own", 3, 12, 4).collect())


def test_average_ranks_and_spearman(spark):
    rows = [("g", float(x), float(y)) for x, y in [(1, 2), (2, 2), (2, 3), (4, 1), (9, 9)]] + [("one", 1.0, 2.0), ("h", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = sorted((r.v, r.k, r.rank) for r in statistics.average_ranks(df.where("g = 'g'"), [], "x", "rank").collect())
    assert got == [(1.0, 1, 1.0), (2.0, 2, 2.5), (4.0, 1, 4.0), (9.0, 1, 5.0)]
    rho = {r.g: r.rho for r in statistics.spearman(df, ["g"], "x", "y").collect()}
    assert abs(rho["g"] - float(np.corrcoef([1, 2.5, 2.5, 4, 5], [2.5, 2.5, 4, 1, 5])[0, 1])) < 1e-5 and rho["one"] is None


def test_skyline_keeps_equal_rows(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, c double, g double")
    want = {i for i, c, g in rows if not any(c2 <= c and g2 >= g and (c2 < c or g2 > g) for _, c2, g2 in rows)}
    assert {r.i for r in statistics.skyline(df, "c", "g", 4).collect()} == want
    assert statistics.skyline(df.limit(0), "c", "g").count() == 0


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(10, 2, 400)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)] + [("flat", i, 3.0) for i in range(1000, 1050)] + [("g", 9999, None)], "g string, i int, v double")
    a = {r.g: tuple(r) for r in statistics.bootstrap_mean(df, ["g"], "i", "v").collect()}
    assert a["flat"][1:] == (50, 3.0, 3.0, 3.0)
    half = 1.96 * values.std() / 20
    assert a["g"][1] == 400 and abs(a["g"][3] - (values.mean() - half)) < 0.06 and abs(a["g"][4] - (values.mean() + half)) < 0.06
    assert a == {r.g: tuple(r) for r in statistics.bootstrap_mean(df.repartition(7), ["g"], "i", "v").collect()}
    assert statistics.bootstrap_mean(df.limit(0), ["g"], "i", "v").count() == 0


def test_kappa_edges(spark):
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert statistics.kappa(same, "x", "y").first().kappa == 1.0
    rows = [("a", "a")] * 4 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", None)]
    assert abs(statistics.kappa(spark.createDataFrame(rows, "x string, y string"), "x", "y").first().kappa - 0.571429) < 1e-6


def test_ranking_metrics(spark):
    rows = [(["a", "b", "c"], ["c"], 0.0, 1 / 3, 0.5), (["a"], ["a"], 1.0, 1.0, 1.0), (["a"], ["z"], 0.0, 0.0, 0.0), (["a"], [], None, None, None), ([], ["a"], 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "r array<string>, g array<string>, rec double, mrr0 double, nd double")
    for r in evaluation.ranking_metrics(df, "r", "g", (1,)).collect():
        assert (r.recall_at_1, r.mrr, r.ndcg_at_10) == (r.rec, r.mrr0, r.nd)


def test_failures(spark):
    kinds = "answerable boolean, accuracy double, abstained boolean, ev array<string>, ex array<string>, term boolean, qt string, n int, al double, want string"
    rows = [
        (False, None, False, ["d"], [], False, "single_doc", 1, None, "verifier_false_negative"),
        (False, None, True, [], [], False, "single_doc", 1, None, None),
        (True, 1.0, False, ["d"], ["d"], True, "single_doc", 1, 1.0, None),
        (True, 0.0, True, ["d"], ["d"], True, "single_doc", 1, 1.0, "verifier_false_positive"),
        (True, 0.0, False, ["x"], ["d"], True, "single_doc", 1, 1.0, "retrieval_miss"),
        (True, 0.0, False, ["d"], ["d"], True, "comparison", 1, 1.0, "planner_under_decomposition"),
        (True, 0.0, False, ["d"], ["d"], True, "single_doc", 1, 0.2, "generator_hallucination"),
        (True, None, False, ["d"], ["d"], True, "single_doc", 1, None, "unknown"),
    ]
    c = F.col
    df = spark.createDataFrame(rows, kinds)
    got = df.select(evaluation.failure_category(c("answerable"), c("accuracy"), c("abstained"), c("ev"), c("ex"), c("term"), c("qt"), c("n"), c("al")).alias("got"), "want")
    assert [tuple(r) for r in got.collect() if r.got != r.want] == []


def test_suffixed_ids_avoid_taken_ones(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "b")]
    out = ingest.suffixed_ids(spark.createDataFrame(rows, "i int, d string"), "d", ["i"])
    assert {r.i: r.unique_id for r in out.collect()} == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4", 5: "b"}


def test_new_rows_is_idempotent(spark):
    known = spark.createDataFrame([("a", 1)], "qid string, x int")
    more = spark.createDataFrame([("a", 2, True), ("b", 3, True), ("c", 4, False)], "qid string, x int, ok boolean")
    once = ingest.new_rows(known, more, "qid", F.col("ok"))
    assert sorted(r.qid for r in once.collect()) == ["a", "b"]
    assert ingest.new_rows(once.select("qid", "x"), more, "qid", F.col("ok")).count() == 2


def test_resolved_files_prefer_the_exact_name(spark):
    import unicodedata

    nfd = unicodedata.normalize("NFD", "공고.pdf")
    files = spark.createDataFrame([(f"/x/{nfd}",), ("/y/공고.pdf",), ("/z/other.pdf",)], "path string")
    rows = spark.createDataFrame([(1, "공고.pdf"), (2, "없음.pdf")], "i int, name string")
    assert {r.i: r.source_file for r in ingest.resolved_files(rows, "name", files, "path").collect()} == {1: "/y/공고.pdf", 2: None}


def test_layout(spark):
    text = "# - 하나\n\n# - 둘\n# - 셋\n본문\n# - 넷"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert layout.demoted_headings(df, "k", "t").first().text == "- 하나\n\n- 둘\n- 셋\n본문\n# - 넷"
    blocks = spark.createDataFrame([("d", 0, "text", "앞"), ("d", 1, "heading", "제목"), ("d", 2, "text", "가"), ("d", 3, "text", "나")], "doc string, at int, kind string, body string")
    got = sorted((r.section_no, r.heading, r.text) for r in layout.sections_of_blocks(blocks, "doc", "at", "kind", "body").collect())
    assert got == [(0, None, "앞"), (1, "제목", "가\n나")]
    table = spark.createDataFrame([(1, "a | b\nc | d\n본문\ne | f")], "k int, t string")
    assert [tuple(r) for r in layout.table_candidates(table, "k", "t").collect()] == [(1, 1, 2, 2)]
    assert [tuple(r) for r in layout.field_candidates(spark.createDataFrame([(1, "예산: 3억\n끝")], "k int, t string"), "k", "t").collect()] == [(1, 0, "예산", "3억")]


def test_numbered_sections(spark):
    docs = spark.createDataFrame([("d", [("머리", "글 "), ("빈", " "), (None, "둘")])], "doc string, s array<struct<heading string, text string>>")
    got = [(r.section_id, r.heading, r.text) for r in layout.numbered_sections(docs, "doc", "s").collect()]
    assert got == [("d::section-001", "머리", "글"), ("d::section-003", "section-3", "둘")]


def test_chain_depth_with_cycle_and_orphan(spark):
    rows = [(i, i - 1 if i else None) for i in range(30)] + [(100, 101), (101, 100), (200, 999)]
    got = {r.k: r.depth for r in dialogue.chain_depth(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()}
    assert got == {i: min(i, 16) for i in range(30)} | {100: 16, 101: 16, 200: 0}


def test_references(spark):
    rows = [("c", 1, "알파 기관 예산", "알파"), ("c", 2, "그 기관 일정은", None), ("c", 3, "다른 질문", None), ("c", 4, "해당 사업", None)]
    out = dialogue.resolved_references(spark.createDataFrame(rows, "c string, n int, t string, e string"), ["c"], ["n"], "t", "e")
    assert {r.n: r.resolved_entity for r in out.collect()} == {1: "알파", 2: "알파", 3: None, 4: "알파"}


def test_matching(spark):
    docs = spark.createDataFrame([("시나브로관리소", "공원 수목 통합 정보화"), ("가나", None)], "agency string, project string")
    targets = matching.metadata_targets(docs)
    asked = spark.createDataFrame([(1, "시나브로 관리소의 일정"), (2, "공원 수목 예산"), (3, "가나 예산"), (4, None), (5, "시나부로관리소")], "q int, t string")
    got = {(r.q, r.value): (r.confidence, r.match_type) for r in matching.metadata_matches(asked, "q", "t", targets).collect()}
    assert got == {(1, "시나브로관리소"): (1.0, "compact_contains"), (2, "공원 수목 통합 정보화"): (0.795, "partial_tokens"), (3, "가나"): (1.0, "compact_contains")}
    fuzzy = {(r.q, r.value): r.confidence for r in matching.fuzzy_matches(asked, "q", "t", targets).collect()}
    assert fuzzy[5, "시나브로관리소"] == 0.84
    assert matching.at_stage(matching.metadata_matches(asked, "q", "t", targets), "strict").count() == 2


def test_longest_prefix_of_many_lengths(spark):
    prices = spark.createDataFrame([("a" * n, n) for n in range(1, 401)] + [(None, -1)], "prefix string, price int")
    rows = spark.createDataFrame([(n, "a" * n + "b") for n in (0, 1, 137, 256, 257, 399, 400, 450)] + [(-1, None), (-2, "")], "k int, t string")
    got = {r.k: r.price for r in matching.longest_prefix(rows, F.col("t"), prices, "prefix").collect()}
    assert got == {n: min(n, 400) or None for n in (0, 1, 137, 256, 257, 399, 400, 450)} | {-1: None, -2: None}
    assert [r.price for r in matching.longest_prefix(rows, F.col("t"), prices.limit(0), "prefix").collect()] == [None] * 10


def test_cascade(spark):
    docs = [("기관가람", "철도 신호 구축 사업", ["철도신호통합", "신호 망"]), ("LH 공사", "구축 사업", None), ("한강", "발매기 운영", ["발"]), (" ", "철도 신호 구축 사업", ["KX"])]
    d = spark.createDataFrame(docs, "agency string, project string, project_aliases array<string>")
    asked = [(1, "철도신호통합의 예산"), (2, "망 신호는"), (3, "kx?"), (4, "lh의 일정"), (5, "가람은"), (6, "철도와 신호"), (7, "발매기"), (8, "구축 사업"), (9, "신호"), (10, None), (11, "철도 신호 구축 사업")]
    got = matching.cascade_matches(spark.createDataFrame(asked, "q int, t string"), "q", "t", d, ("agency", "project"), {"project": "project_aliases"})
    rail = "철도 신호 구축 사업"
    assert {(r.q, r.value): (r.confidence, r.match_type) for r in got.collect()} == {
        (1, rail): (0.92, "explicit_alias"), (2, rail): (0.92, "explicit_alias"), (3, rail): (0.92, "explicit_alias"), (4, "LH 공사"): (0.78, "abbreviation"),
        (5, "기관가람"): (0.78, "abbreviation"), (6, rail): (0.89, "partial_tokens"), (7, "발매기 운영"): (0.92, "explicit_alias"), (8, "구축 사업"): (1.0, "compact_contains"),
        (11, rail): (1.0, "compact_contains"), (11, "구축 사업"): (1.0, "compact_contains"),
    }
    plain = matching.cascade_matches(spark.createDataFrame(asked, "q int, t string"), "q", "t", d, ("agency", "project"))
    assert {(r.q, r.value): r.confidence for r in plain.collect() if r.q in (1, 3, 7)} == {(7, "발매기 운영"): 0.72}


def test_cascade_sends_out_values_never_queries(spark, monkeypatch):
    docs = [(f"기관{i}청", f"철도 신호 구축 {i}", [f"망 신호{i}"]) for i in range(300)]
    d = spark.createDataFrame(docs, "agency string, project string, project_aliases array<string>")
    asked = spark.range(8).select("id", F.concat(F.lit("철도의 신호"), F.col("id"), F.lit("청 망")).alias("t"))
    run = lambda: matching.cascade_matches(asked, "id", "t", d, ("agency", "project"), {"project": "project_aliases"})
    sent = run()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 0)
    shuffled = run()
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    rows = sorted(map(tuple, sent.collect()))
    assert rows == sorted(map(tuple, shuffled.collect())) and {r[4] for r in rows} == {"abbreviation", "explicit_alias", "partial_tokens"}


def likest(t, q):
    """Every phrase of about as many tokens against the whole value."""
    sizes = range(max(1, len(t) - 1), min(len(q), len(t) + 1) + 1) if t and q else ()
    return max((difflib.SequenceMatcher(None, "".join(t), "".join(q[i : i + n])).ratio() for n in sizes for i in range(len(q) - n + 1)), default=0.0)


def against_all_pairs(asked, targets):
    qs = [(r.q, r.w) for r in asked.select("q", text.tokens("t").alias("w")).collect()]
    return {(q, t.field, t.value): round(min(0.84, s), 3) for q, w in qs for t in targets.collect() if (s := likest(t.tokens, w)) >= matching.REDUCED}


def test_fuzzy_values_that_share_few_pairs(spark):
    targets = matching.metadata_targets(spark.createDataFrame([("서울시청", "가나다라"), ("가나다라마", "하루"), ("ab12", "ab12 통합 통합")], "agency string, project string"))
    asked = spark.createDataFrame([(1, "서울구청"), (2, "가나마라"), (3, "가다나라마"), (4, "하루 종일"), (5, "통합 통합"), (6, None), (7, ""), (8, "a1b2 통합")], "q int, t string")
    got = {(r.q, r.field, r.value): r.confidence for r in matching.fuzzy_matches(asked, "q", "t", targets).collect()}
    assert got == against_all_pairs(asked, targets)
    assert got[1, "agency", "서울시청"] == got[2, "project", "가나다라"] == 0.75
    assert got[3, "agency", "가나다라마"] == 0.8 and got[4, "project", "하루"] == 0.84


def test_fuzzy_against_all_pairs(spark, data):
    targets = matching.metadata_targets(spark.read.parquet(f"{data}/rfp_documents.parquet"))
    asked = spark.read.parquet(f"{data}/prompt_injection_ko.parquet").selectExpr("item_id AS q", "text AS t")
    rng = random.Random(8)
    near = []
    for i, (v,) in enumerate(targets.select("value").collect()):
        x = list(v)
        for _ in range(rng.randrange(1, 3)):
            x[rng.randrange(len(x))] = rng.choice("시청관리 ")
        near.append((f"near{i}", "".join(x)))
    for rows in (asked, spark.createDataFrame(near, "q string, t string")):
        got = [((r.q, r.field, r.value), r.confidence) for r in matching.fuzzy_matches(rows, "q", "t", targets).collect()]
        assert len(got) == len(dict(got)) and dict(got) == against_all_pairs(rows, targets)


def test_contaminated(spark):
    held = spark.createDataFrame([("공원 수목 예산은 얼마인가",), (None,)], "t string")
    asked = spark.createDataFrame([(1, "공원 수목  예산은 얼마인가"), (2, "공원 수목 예산은 얼마인가요"), (3, "전혀 다른 질문입니다"), (4, " "), (5, None)], "q int, t string")
    got = {r.q: r.similarity for r in quality.contaminated(asked, "q", "t", held, "t").collect()}
    assert got == {1: 1.0, 2: 0.9, 4: 1.0, 5: 1.0}


def test_plans():
    assert make_plan("full", "comparison", ("a", "b", "c")).top_k == 11
    assert make_plan("naive_baseline", "single_doc", attempt=2).top_k == 8
    assert stages(frozenset("a"), frozenset("ab")) == ("strict", "reduced", "relaxed")
    assert stages(frozenset("a"), frozenset("a")) == ("strict", "relaxed")
    assert stages(frozenset(), frozenset()) == ("relaxed",)


def test_contaminated_against_brute_force(spark):
    rng = random.Random(9)
    held = ["".join(rng.choices("가나다라", k=30)) for _ in range(15)]
    asked = []
    for i in range(150):
        x = list(rng.choice(held))
        for _ in range(rng.randrange(0, 5)):
            x[rng.randrange(len(x))] = rng.choice("가나다라마")
        asked.append((i, "".join(x)))
    grams = lambda x: {x[k : k + 3] for k in range(len(x) - 2)}
    best = {i: max(len(grams(x) & grams(h)) / len(grams(x) | grams(h)) for h in held) for i, x in asked}
    got = quality.contaminated(spark.createDataFrame(asked, "q int, t string"), "q", "t", spark.createDataFrame([(h,) for h in held], "t string"), "t")
    assert {r.q: r.similarity for r in got.collect()} == {i: round(s, 6) for i, s in best.items() if s >= 0.7}
