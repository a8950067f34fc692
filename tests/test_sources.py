import json

import pytest

from docmill.sources import readers, writers


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"agency": "기관", "sections": [{"heading": "h", "text": "본문"}, {"heading": "x", "text": " "}]}), encoding="utf-8")
    (tmp_path / "b.md").write_text("# 제목\r\n내용", encoding="utf-8")
    (tmp_path / "README.md").write_text("no", encoding="utf-8")
    (tmp_path / "empty.txt").write_text(" ", encoding="utf-8")
    rows = {r.doc_id: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].title == "a" and [s.text for s in rows["a"].sections] == ["본문"]
    assert rows["b"].title == "제목" and rows["b"].sections[0].heading == "본문"


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    head = ",".join(readers.REQUIRED)
    path.write_text("﻿" + head + '\nN1,사업,기관,pdf,a.pdf,"두 줄\n글"\n', encoding="utf-8")
    row = readers.read_manifest(spark, str(path)).first()
    assert row["공고 번호"] == "N1" and row["텍스트"] == "두 줄\n글"
    path.write_text("공고 번호\nN1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="사업명"):
        readers.read_manifest(spark, str(path))


def test_files_cases_history(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"1")
    assert [r.key for r in readers.list_files(spark, str(tmp_path), "*.pdf").collect()] == ["x.pdf"]
    cases = tmp_path / "c.jsonl"
    cases.write_text('{"qid": "1", "parent_qid": " "}\n{"qid": "2", "parent_qid": "1"}\n', encoding="utf-8")
    assert {r.qid: r.parent_qid for r in readers.read_cases(spark, str(cases)).collect()} == {"1": None, "2": "1"}
    cases.write_text('{"qid": "1"}\n{"qid": "1"}\n', encoding="utf-8")
    with pytest.raises(ValueError, match="1"):
        readers.read_cases(spark, str(cases))
    (tmp_path / "h").mkdir()
    (tmp_path / "h/2026-01.json").write_text('{"accuracy": 0.5, "note": "x"}', encoding="utf-8")
    assert [tuple(r) for r in readers.read_history(spark, str(tmp_path / "h/*.json")).collect()] == [("2026-01", "accuracy", 0.5)]


def test_index_round_trip_and_traces(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "r")], "id int, ids array<string>, run string")
    writers.write_index(f"{tmp_path}/i", df, df, df, {"model": "hashing"})
    back = readers.read_index(spark, f"{tmp_path}/i")
    assert back["chunks"].count() == 1 and back["index_info"].first().info["schema_version"] == "2"
    writers.write_traces(df, f"{tmp_path}/t", "run", ("ids",))
    assert spark.read.json(f"{tmp_path}/t").first().ids == ["<redacted>"] * 2
    writers.write_index(f"{tmp_path}/e", df, df, df.limit(0), {})
    with pytest.raises(ValueError, match="no chunks"):
        readers.read_index(spark, f"{tmp_path}/e")
    assert writers.forbidden_columns(df, {"ids"}) == ["ids"] and writers.public(df.withColumnRenamed("run", "_run")).columns == ["id", "ids"]
