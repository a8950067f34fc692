import random

from docmill.llm.canonical import WHITE_SPACE
from docmill.llm.queries import p3_found
from docmill.llm.split import ENDS, FULL, LINE_BREAKS, split_sections


def sentences(t, limit):
    spans, start, i = [], None, 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] in WHITE_SPACE:
            j += 1
        if j > i:
            if start is not None and (j == len(t) or t[i - 1] in ENDS or set(t[i:j]) & set(LINE_BREAKS)):
                spans.append((start, i))
                start = None
            i = j
        else:
            start = i if start is None else start
            i += 1
    spans += [(start, len(t))] if start is not None else []
    parts = []
    for s, e in spans:
        while e - s > limit:
            at = next((q for q in range(s + limit, s, -1) if t[q] in WHITE_SPACE), None)
            a = b = s + limit if at is None else at
            if at is not None:
                while t[a - 1] in WHITE_SPACE:
                    a -= 1
                while t[b] in WHITE_SPACE:
                    b += 1
            parts.append((s, a))
            s = b
        parts.append((s, e))
    return parts


def greedy(t, limit, overlap=1):
    parts, out, i = sentences(t, limit), [], 0
    while i < len(parts):
        j = i
        while j + 1 < len(parts) and parts[j + 1][1] - parts[i][0] <= limit:
            j += 1
        out.append((parts[i][0], parts[j][1]))
        if j + 1 == len(parts):
            break
        i = next(s for s in range(max(i + 1, j + 1 - overlap), j + 2) if s > j or parts[j + 1][1] - parts[s][0] <= limit)
    return out


def run(spark, texts, limit, **more):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "k bigint, text string, start_pos int")
    out = {}
    for r in split_sections(df, "k", "text", limit, **more).orderBy("k", "chunk_seq_in_section").collect():
        out.setdefault(r.k, []).append((r.start_pos, r.end_pos))
        assert r.chunk_seq_in_section == len(out[r.k]) <= r.total_chunks_in_section
        if more.get("with_text"):
            assert r.text == texts[r.k][r.start_pos : r.end_pos]
    return out


def test_against_greedy(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab가. \n!?　 \U0001f4c4", k=rng.randrange(0, 120))) for _ in range(400)]
    texts += [None, "", " " * 40, "x" * 95, "가" * 20 + " " + "나" * 20, "a. " * 60, "끝\n" * 50]
    for limit in (5, 13, 40):
        for overlap in (0, 1, 3):
            want = {i: greedy(t, limit, overlap) for i, t in enumerate(texts) if t and greedy(t, limit, overlap)}
            assert run(spark, texts, limit, overlap=overlap, costs=FULL, with_text=True) == want


def test_short_texts_are_one_piece(spark):
    assert run(spark, ["한 문장이다. 또 한 문장이다.", " 가 ", "", None, " \n"], 520) == {0: [(0, 17)], 1: [(1, 2)]}


def cheapest(t, limit, overlap, size=10.0, sentence=1.0, within=20.0):
    """The least cost of all ways to cut a text, by trying every one."""
    parts = sentences(t, limit)

    def end_cost(j):
        between = t[parts[j][1] : parts[j + 1][0]]
        if set(between) & set(LINE_BREAKS):
            return 0.0
        return sentence if between and t[parts[j][1] - 1] in ENDS else within

    def ways(i):
        j = i
        while j < len(parts) and parts[j][1] - parts[i][0] <= limit:
            if j + 1 == len(parts):
                yield 0.0, [(parts[i][0], parts[j][1])]
                break
            nxt = next(s for s in range(max(i + 1, j + 1 - overlap), j + 2) if s > j or parts[j + 1][1] - parts[s][0] <= limit)
            own = end_cost(j) + size * (1 - (parts[j][1] - parts[i][0]) / limit) ** 2
            for cost, rest in ways(nxt):
                yield own + cost, [(parts[i][0], parts[j][1]), *rest]
            j += 1

    return list(ways(0))


def test_no_way_is_cheaper(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab가. \n", weights=[5, 5, 5, 3, 4, 1], k=rng.randrange(10, 45))).strip() or "a" for _ in range(60)]
    for overlap in (0, 2):
        got = run(spark, texts, 14, overlap=overlap)
        for i, t in enumerate(texts):
            every = cheapest(t, 14, overlap)
            assert next(c for c, w in every if w == got[i]) <= min(c for c, _ in every) + 1e-9


def test_balanced_pieces(spark):
    text = "".join(f"문장 번호 {i:02d}이다. " for i in range(40))
    greedy_sizes = [b - a for a, b in run(spark, [text], 100, overlap=0, costs=FULL)[0]]
    even = run(spark, [text], 100, overlap=0)[0]
    sizes = [b - a for a, b in even]
    assert max(sizes) <= 100 and len(sizes) <= len(greedy_sizes) + 1
    assert even[0][0] == 0 and all(b <= c for (_, b), (c, _) in zip(even, even[1:], strict=False))


def test_query(spark, data):
    import pyarrow.parquet as pq

    got = {}
    for r in p3_found(spark, data).collect():
        got.setdefault(r.section_uid, []).append((r.chunk_seq_in_section, r.start_pos, r.end_pos))
    want = {}
    for r in pq.read_table(f"{data}/rfp_sections.parquet").to_pylist():
        if r["text"] and len(r["text"]) > 520 and r["text"].strip():
            want[r["section_uid"]] = [(k + 1, a, b) for k, (a, b) in enumerate(greedy(r["text"], 520))]
    assert {k: sorted(v) for k, v in got.items()} == want
