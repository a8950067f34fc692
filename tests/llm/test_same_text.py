import random
import unicodedata

from docmill.llm.queries import p1_found
from docmill.llm.same_text import canonical_rows, same_print_pairs

KINDS = "id bigint, text string, tbl string, form string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], KINDS)


def test_pairs(spark):
    random.seed(5)
    base = ["가나 다라", "Data Mart é", "ABC", "abc", "①", "1"]
    turn = [lambda x: x, lambda x: unicodedata.normalize("NFD", x), lambda x: x.replace(" ", "　"), lambda x: x + "​"]
    rows = [(i, random.choice(turn)(random.choice(base))) for i in range(60)] + [(60, None), (61, ""), (62, " "), (63, "​")]
    fold = lambda x: unicodedata.normalize("NFC", x.replace("　", " ").replace("​", "").strip()) if x else ""
    want = {(i, j) for i, a in rows for j, b in rows if i < j and fold(a) and fold(a) == fold(b) and a != b}
    got = [(r.id_a, r.id_b) for r in same_print_pairs({"t": (table(spark, rows), "id", "text")}).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tables_stay_apart_and_empty(spark):
    one, two = table(spark, [(1, "가"), (2, "가")]), table(spark, [(1, unicodedata.normalize("NFD", "가"))])
    assert same_print_pairs({"a": (one, "id", "text"), "b": (two, "id", "text")}).count() == 0
    assert same_print_pairs({"a": (table(spark, []), "id", "text")}).count() == 0
    rows = canonical_rows({"a": (one, "id", "text"), "b": (two, "id", "text")}).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 1, "가"), ("a", 2, "가"), ("b", 1, "가")]


def test_query(spark, data):
    df = p1_found(spark, data)
    assert df.dtypes == [("tbl", "string"), ("id_a", "bigint"), ("id_b", "bigint")]
    assert all(r.id_a < r.id_b for r in df.collect())


def test_repeated_rows(spark):
    rows = table(spark, [(1, "가"), (1, "가"), (2, unicodedata.normalize("NFD", "가")), (2, unicodedata.normalize("NFD", "가"))])
    assert [tuple(r) for r in same_print_pairs({"t": (rows, "id", "text")}).collect()] == [("t", 1, 2)]
