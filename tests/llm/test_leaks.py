import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from docmill.llm.columns import reduced, rewritten
from docmill.llm.leaks import K, RUN, hashes, leaked, longest_run, winnowed
from docmill.llm.queries import p6_found


def points(x):
    return np.frombuffer(x.encode("utf-32-le"), np.uint32)


def brute(docs, items):
    form = lambda rows: [(i, t) for (i, _), t in zip(rows, rewritten(pa.array([t for _, t in rows], pa.string()), reduced).to_pylist(), strict=True) if t]
    grams = {}
    for i, t in form(items):
        for k in range(len(t) - RUN + 1):
            grams.setdefault(t[k : k + RUN], set()).add(i)
    return {(d, i) for d, t in form(docs) for k in range(len(t) - RUN + 1) for i in grams.get(t[k : k + RUN], ())}


def test_every_shared_run_is_kept():
    rng = random.Random(3)
    for _ in range(200):
        shared = "".join(rng.choices("ab가", k=RUN))
        a = "".join(rng.choices("xyz", k=rng.randrange(50))) + shared + "".join(rng.choices("xyz", k=rng.randrange(50)))
        b = "".join(rng.choices("uvw", k=rng.randrange(50))) + shared + "".join(rng.choices("uvw", k=rng.randrange(50)))
        kept = [set(winnowed(points(x), np.array([0, len(x)]), K, RUN - K + 1)[0].tolist()) for x in (a, b)]
        assert kept[0] & kept[1]
        assert longest_run(points(a), points(b), K, RUN) == RUN


def test_single_texts_of_all_short_lengths():
    rng, window = random.Random(4), RUN - K + 1
    for n in range(61):
        x = points("".join(rng.choices("abcdefgh가나다", k=n)))
        h = hashes(x, K)
        least = {min(h[i : i + window].tolist()) for i in range(n - RUN + 1)}
        for offsets in ([0, n], [0, 0, n, n]):
            kept, ends = winnowed(x, np.array(offsets), K, window)
            assert set(kept.tolist()) == least and len(ends) == len(offsets) and ends[-1] == len(kept)


def test_tables_of_one_short_text(spark):
    for n in (21, 27, 28, 30):
        d = spark.createDataFrame([(1, "abcdefghij" * 3)], "doc_id int, text string").selectExpr("doc_id", f"substr(text, 1, {n}) AS text")
        got = leaked(d, "doc_id", "text", d.selectExpr("doc_id AS item_id", "text"), "item_id", "text").collect()
        assert [tuple(r) for r in got] == [(1, 1, n)] * (n >= RUN)


def longest_brute(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_longest_run_is_the_longest():
    rng = random.Random(7)
    for n in range(300):
        letters = rng.choice(["ab", "a", "abc가", "abcdefghij"])
        piece = "".join(rng.choices(letters, k=rng.randrange(1, 25)))
        a, b = ("".join(rng.choices(letters, k=rng.randrange(60))) + piece * rng.randrange(1, 6) + "".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(2))
        want = longest_brute(a, b)
        for block in (1 << 16, 8):
            assert longest_run(points(a), points(b), 4, 6, block) == (want if want >= 6 else 0), (n, a, b)


def test_a_repeated_letter_costs_little():
    import tracemalloc

    b = points("a" * 300)
    for a in ("a" * 1_000_000, "ab" * 500_000, "a" * 200 + "b" + "a" * 1_000_000):
        tracemalloc.start()
        assert longest_run(points(a), b, K, RUN) == (0 if a[1] == "b" else 300)
        assert tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
    assert longest_run(points("ab" * 500_000), points("ba" * 150), K, RUN) == 300


def test_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, "".join(rng.choices("가나다라마바사 .", k=90))) for i in range(20)] + [(90, None), (91, ""), (92, "짧다")]
    docs = []
    for d in range(200):
        text = "".join(rng.choices("abcdefgh ", k=rng.randrange(200)))
        if rng.random() < 0.5:
            _, t = rng.choice(items[:20])
            a = rng.randrange(0, 60)
            text = text[:50] + t[a : a + rng.randrange(25, 45)].replace(" ", "　\n") + text[50:]
        docs.append((d, text))
    docs += [(300, None), (301, ""), (302, items[0][1] * 300), (303, "a" * 3000)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, item int, h string")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc int")
    got = [(r.doc_id, r.item_id) for r in leaked(d, "doc_id", "text", q, "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    assert leaked(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert leaked(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0


def test_query(spark, data):
    read = lambda t, k: [(r[k], r["text"]) for r in pq.read_table(f"{data}/{t}.parquet").to_pylist()]
    got = {(r.doc_id, r.item_id) for r in p6_found(spark, data).collect()}
    assert got == brute(read("documents", "doc_id"), read("eval_items", "item_id"))
