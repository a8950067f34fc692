import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docmill.llm.codepoints import plain
from docmill.llm.language import LABELS, WITHIN, _pieces, document_languages, fit, label_code, language_segments, mislabelled_segments, piece_scores, segments, viterbi
from docmill.llm.queries import p7_found

LANGS = tuple(LABELS)


def samples(data):
    return [(r["lang"], r["text"]) for r in pq.read_table(f"{data}/lang_samples.parquet").to_pylist()]


def test_held_out_accuracy(data):
    rows = samples(data)
    order = np.random.default_rng(1).permutation(len(rows))
    train, test = ([rows[i] for i in part] for part in (order[::2], order[1::2]))
    s = segments(fit(train), plain(pa.array([t for _, t in test])))
    assert sorted(s.row) == list(range(len(test)))
    right = np.mean([LANGS[c] == test[r][0] for r, c in zip(s.row, s.code, strict=True)])
    assert right >= 0.97 and s.confidence.min() > 0.3


def test_confidence_is_calibrated(data):
    """Expected calibration error over ten bins, on pieces of one word to sixteen from samples that the model hasn't seen."""
    rows = samples(data)
    order = np.random.default_rng(3).permutation(len(rows))
    train, test = ([rows[i] for i in part] for part in (order[::2], order[1::2]))
    model = fit(train)
    for pieces in (_pieces(test), [p for p in _pieces(test) if p[0] in ("en", "de", "fr", "es")]):
        scores, true = piece_scores(model, pieces)
        share = np.exp((scores - scores.max(axis=1, keepdims=True)) / model.temperature)
        share /= share.sum(axis=1, keepdims=True)
        sure, hit = share.max(axis=1), share.argmax(axis=1) == true
        bins = np.minimum((sure * 10).astype(int), 9)
        ece = sum(abs(sure[bins == b].mean() - hit[bins == b].mean()) * (bins == b).mean() for b in set(bins))
        assert ece <= 0.05 and sure.min() < 0.7 < hit.mean(), (ece, sure.min(), hit.mean())


def test_mixed_lines(data):
    by = {}
    for lang, text in samples(data):
        by.setdefault(lang, []).append(text)
    model = fit(samples(data))
    mixed = "\n".join([by["ko"][0], by["ko"][1], "12 / 34", by["en"][0], "---", by["ko"][2]])
    s = segments(model, plain(pa.array([mixed, "", "123 !", None, by["ja"][0]])))
    assert [(int(r), int(n), LANGS[c]) for r, n, c in zip(s.row, s.number, s.code, strict=True)] == [(0, 1, "ko"), (0, 2, "en"), (0, 3, "ko"), (4, 1, "ja")]
    assert [mixed[a:b].strip() for a, b in zip(s.start[1:2], s.end[1:2], strict=True)] == [by["en"][0]]


def test_two_languages_in_one_line(data):
    model = fit(samples(data))
    ko, en, zh = "예산 집행 내역을 점검하고 기록한다.", "The supplier must deliver all documents before the end of the month.", "投标人应当在规定期限内提交全部文件。"
    for parts in ((("ko", ko), ("en", en)), (("en", en), ("ko", ko)), (("ko", ko), ("zh", zh), ("ko", ko))):
        text = " ".join(t for _, t in parts)
        s = segments(model, plain(pa.array([text])), WITHIN)
        assert [model.langs[c] for c in s.code] == [x for x, _ in parts]
        assert [text[a:b].strip() for a, b in zip(s.start, s.end, strict=True)] == [t for _, t in parts]
        assert (s.confidence > 0.9).all()
    # A few foreign words do not make a segment.
    assert [model.langs[c] for c in segments(model, plain(pa.array(["본 사업은 RFP 절차에 따라 AI 기반 시스템을 구축한다."])), WITHIN).code] == ["ko"]


def test_a_line_that_tells_nothing_belongs_to_its_neighbours(data):
    model = fit(samples(data))
    ko = "예산 집행 내역을 점검하고 기록한다."
    s = segments(model, plain(pa.array([f"{ko}\n\n14,566 / 75.8 \U00020bb7\U0002123d\n{ko}", f"{ko} \U00020bb7", "\U00020bb7", f"{ko}\nשלום"])))
    assert [(int(r), model.langs[c]) for r, c in zip(s.row, s.code, strict=True) if r != 2] == [(0, "ko"), (1, "ko"), (3, "ko")]
    assert [model.langs[c] for c in s.code[s.row == 2]][0] in ("ja", "zh")


def test_languages_come_from_the_samples(data):
    more = [("ru", "Поставщик обязан представить все документы в срок"), ("ru", "Настоящий договор вступает в силу со дня подписания"), ("it", "Il fornitore deve consegnare tutti i documenti entro la fine del mese"), ("it", "Il presente contratto entra in vigore dalla data della firma")]
    model = fit([x for x in samples(data) if x[0] in ("ko", "en")] + more * 3)
    assert model.langs == ("ko", "en", "it", "ru")
    s = segments(model, plain(pa.array(["Договор составлен в двух экземплярах", "Tutti i documenti del contratto", "제안서는 기한 안에 내야 한다", "All documents of the contract"])))
    assert [model.langs[c] for c in s.code] == ["ru", "it", "ko", "en"]


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(2)
    scores = -rng.random((5, len(LANGS))) * 6
    cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    best = max(product(range(3), repeat=5), key=cost)
    narrow = scores.copy()
    narrow[:, 3:] = -1e9
    assert tuple(viterbi(narrow, np.zeros(5, int))) == best
    switch = rng.random(5) * 4
    cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - sum(switch[i] for i in range(1, 5) if p[i] != p[i - 1])
    assert tuple(viterbi(narrow, np.zeros(5, int), switch)) == max(product(range(3), repeat=5), key=cost)


def test_viterbi_of_many_documents():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(30), rng.integers(1, 9, 30))
    scores = -rng.random((len(doc), 4)) * 5
    alone = np.concatenate([viterbi(scores[doc == d], doc[doc == d]) for d in range(30)])
    assert (viterbi(scores, doc) == alone).all()


def test_labels(spark):
    right = {"KO": "ko", "ko-KR": "ko", "ko_KR": "ko", "kor": "ko", "Korean": "ko", " en ": "en", "zh-Hans": "zh", "zh-Hans-CN": "zh", "fre": "fr", "ger": "de", "JAPANESE": "ja"}
    wrong = ["", " ", "und", "xx", "mul", "unknown", "N/A", "koren", None]
    rows = [(k, v) for k, v in right.items()] + [(k, None) for k in wrong]
    df = spark.createDataFrame(rows, "label string, want string")
    assert df.where(~label_code(F.col("label")).eqNullSafe(F.col("want"))).count() == 0


def test_operator(spark, data):
    docs = spark.createDataFrame(
        [(1, samples(data)[0][1], samples(data)[0][0], 1), (2, None, "ko", 1), (3, "", None, 1), (4, "12 34", None, 1), (5, "예산 집행 내역을 점검하고 기록한다.", "en", 1), (5, "예산 집행 내역을 점검하고 기록한다.", "en", 1)],
        "doc_id bigint, text string, lang string, seg_no int",
    )
    s = spark.createDataFrame(samples(data), "lang string, text string")
    every = language_segments(docs, "doc_id", "text", s)
    assert sorted(r.doc_id for r in every.collect()) == [1, 5, 5] and every.where("confidence <= 0 or confidence > 1").count() == 0
    got = sorted(tuple(r) for r in mislabelled_segments(docs, "doc_id", "text", "lang", s).collect())
    assert got == [(5, 1, "ko"), (5, 1, "ko")]
    per = {r.doc_id: r for r in document_languages(docs, "doc_id", "text", s).collect()}
    assert set(per) == {1, 5} and per[5].lang == "ko" and 0.9 < per[5].confidence <= 1 and per[5].n_segments == 1
    assert mislabelled_segments(docs.limit(0), "doc_id", "text", "lang", s).count() == 0
    assert mislabelled_segments(docs, "doc_id", "text", "lang", s.limit(0)).count() == 2


def test_query(spark, data):
    df = p7_found(spark, data)
    assert df.dtypes == [("doc_id", "bigint"), ("seg_no", "int"), ("lang", "string")]
    rows = df.collect()
    assert rows and len({(r.doc_id, r.seg_no) for r in rows}) == len(rows)
