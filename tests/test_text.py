import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.functions.filenames import _name
from cairnlight.functions.vectors import inner_product, l2_normalised


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_chunks_cover_the_text_and_count_as_the_ceiling(spark):
    texts = [(1, "a" * 500), (2, "x"), (3, ""), (4, None), (5, " \t\n"), (6, "é😀 b " * 400), (7, "w " * 1000), (7, "w " * 1000)]
    df = spark.createDataFrame(texts, "id int, t string")
    got = T.chunked(df.distinct(), ["id"], "t").orderBy("id", "chunk_ord").collect()
    for i, t in dict(texts).items():
        norm = " ".join((t or "").split())
        mine = [r.chunk for r in got if r.id == i]
        assert len(mine) == math.ceil(len(norm) / 450)
        assert "".join(c if k == 0 else c[50:] for k, c in enumerate(mine)) == norm


def test_corrected_mode_drops_the_contained_tail(spark):
    df = spark.createDataFrame([(1, "a" * 500), (2, "a" * 501), (3, "b" * 20)], "id int, t string")
    n = {r.id: r["count"] for r in T.chunked(df, ["id"], "t", mode="corrected").groupBy("id").count().collect()}
    assert n == {1: 1, 2: 2, 3: 1}


def test_every_whitespace_is_one_space(spark):
    odd = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    df = spark.createDataFrame([(odd + "a" + odd + "b" + odd,)], "t string")
    assert rows(df.select(T.normalised(F.col("t")))) == [("a b",)]


def test_three_verdict_grammars(spark):
    df = spark.createDataFrame([("1",), ("0",), ("Grade: 1",), ("10",), ("",), (None,), (" 1.",)], "r string")
    got = rows(df.select(*[T.verdict(F.col("r"), g) for g in "abc"]))
    assert got == [(1, 1, 1), (0, 0, 0), (0, 1, 1), (1, 1, 0), (0, 0, 0), (0, 0, 0), (1, 1, 1)]


def test_triples_from_json(spark):
    texts = ['[["a","b","c"],["x"],7,["d",1,"e"]]', '```json\n[["a","b","c"]]\n```', "[", "", None, '{"a":1}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [r[0] for r in df.select(T.json_triples(F.col("j"))).collect()]
    assert got == [[["a", "b", "c"], ["d", "1", "e"]], [["a", "b", "c"]], [], [], [], []]


def test_answer_matching_and_ratios(spark):
    df = spark.createDataFrame([("The Mean rate", "so the mean rate was"), ("alpha beta gamma", "gamma and alpha"), ("to", "x"), (None, "x"), ("", "")], "a string, t string")
    assert [r[0] for r in df.select(T.answer_in_text(F.col("a"), F.col("t"))).collect()] == [True, True, False, False, False]
    df = spark.createDataFrame([("12ab",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.numeric_ratio(F.col("s"))).collect()] == [0.5, 0.0, 0.0]


def test_question_predicates(spark):
    qs = [("What is shown in the chart?", True, False), ("How many guests joined the workshop?", False, True), ("How many joined the 1998 Oslo workshop?", False, False), ("Is it illustrated?", False, False)]
    df = spark.createDataFrame(qs, "q string, l boolean, o boolean")
    assert rows(df.select(T.leaks_modality(F.col("q")), T.has_orphan_reference(F.col("q")))) == [(q[1], q[2]) for q in qs]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=140))
def test_file_names_are_safe(title):
    n = _name(title)
    assert n.isascii() and n and len(n) <= 107 and not set(n) & set("<>:\"/\\|?*,()'[] ")


def test_file_names_by_example():
    assert _name("AC/DC") == "AC_DC" and _name("Who? (album)") == "Who_album" and _name("///") == "untitled"
    assert _name("Beyoncé").startswith("Beyonce_") and _name("Beyonce") == "Beyonce" and _name(None) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(l2_normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert rows(df.select(inner_product(F.col("v"), F.col("v")))) == [(25.0,), (0.0,)]


def test_fingerprint_changes_with_any_row_and_not_with_order(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "n string, s int")
    one = T.fingerprint(a, "n", "s").first()
    assert one == T.fingerprint(a.orderBy(F.desc("n")).repartition(3), "n", "s").first()
    assert one.fingerprint != T.fingerprint(a.withColumn("s", F.col("s") + 1), "n", "s").first().fingerprint
    assert T.fingerprint(a.limit(0), "n", "s").first().rows in (0, None)
