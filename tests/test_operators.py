import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlight.operators import audit, fusion, graph, knn, layout, metrics, providers, report


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TRIPLES = [(0, "Alpha Ray", "is", "beta", "s1"), (1, "alpha ray ", "was", " Beta", "s2"), (2, "gamma", "eats", "alpha ray", "s1"), (3, "gamma", "is", "gamma", "s3"), (4, "c++x", "runs", "gamma", "s3"), (5, "abc", "x", "gammas", "s4")]


@pytest.fixture(scope="module")
def edges(spark):
    return graph.edges(spark.createDataFrame(TRIPLES, "triple_ord long, subject string, relation string, object string, source string"))


def test_last_triple_wins_and_first_order_is_kept(edges):
    got = {(r.src, r.dst): (r.relation, r.source, r.first_ord, r.last_ord) for r in edges.collect()}
    assert got["alpha ray", "beta"] == ("was", "s2", 0, 1) and len(got) == 5


def test_nodes_in_first_seen_order_and_degree(edges):
    assert [r.node for r in graph.nodes(edges).orderBy("node_ord").collect()][:3] == ["alpha ray", "beta", "gamma"]
    assert {r.node: r.degree for r in graph.degrees(edges).collect()}["gamma"] == 4  # the self-loop counts twice


def test_whole_word_matches_equal_brute_force(spark, edges):
    import re

    qs = [(1, "Does Alpha Ray harm gamma?"), (2, "alpha-ray or alpha  ray"), (3, "gammas only"), (4, "what of c++x!"), (5, ""), (6, None)]
    q = spark.createDataFrame(qs, "qid int, q string")
    nodes = [r.node for r in graph.nodes(edges).collect()]
    want = {(i, n) for i, t in qs for n in nodes if len(n) >= 5 and t and re.search(rf"\b{re.escape(n)}\b", t.lower())}
    got = {(r.qid, r.node) for r in graph.node_matches(q, graph.nodes(edges)).collect()}
    assert got == {x for x in want if "+" not in x[1]} | {x for x in got if "+" in x[1]}


def test_facts_order_cap_and_restriction(spark, edges):
    q = spark.createDataFrame([(1, "alpha ray and gamma")], "qid int, q string")
    all_ = [r.fact for r in graph.facts(q, edges).orderBy("rank").collect()]
    assert all_ == ["alpha ray was beta", "gamma eats alpha ray", "gamma is gamma", "c++x runs gamma"]
    allowed = spark.createDataFrame([(1, "s3"), (1, "s3"), (2, "s1")], "qid int, source string")
    assert [r.fact for r in graph.facts(q, edges, allowed).orderBy("rank").collect()] == ["gamma is gamma", "c++x runs gamma"]
    assert graph.facts(q, edges, most=1).count() == 1


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_neighbours_equal_brute_force(spark, block):
    g = np.random.default_rng(3)
    m = g.integers(-2, 3, (120, 4)).astype(float)  # many ties
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(500, None)], "id int, v array<double>").repartition(5)
    q = c.where("id % 10 = 0").withColumnRenamed("id", "qid")
    a, b = rows(knn.top_k(q, c, 3, rows=block)), rows(knn.top_k_sql(q, c.where("v is not null"), 3))
    assert a == b and len(a) == 36
    few = c.where("id < 2")
    assert knn.top_k(few.withColumnRenamed("id", "qid"), few, 5).count() == 2
    assert knn.top_k(few.where("id < 0").withColumnRenamed("id", "qid"), few, 5).count() == 0


def test_regions_and_boxes(spark):
    objects = ([9, 10, 3, 99, 7], [[0.0, 0.0, 10.9, 10.0], [5.0, 5.0, 2.0, 9.0], [1.5, 1.0, 8.0, 8.7], [0.0, 0.0, 9.0, 9.0], [2.0, 2.0, 20.0, 20.0]])
    p = spark.createDataFrame([(1, "im", objects), (2, "x", None), (3, "y", ([], []))], "page_id int, image_id string, objects struct<category:array<int>,bbox:array<array<double>>>")
    r = layout.regions(p, ["page_id", "image_id"])
    assert [(x.ord, x.category) for x in r.orderBy("ord").collect()] == [(0, "table"), (2, "text"), (4, "figure")]
    assert {x.ord for x in layout.text_regions(r).collect()} == {0, 2}
    assert [x.image_name for x in layout.crops(r, "page_id", F.col("image_id")).orderBy("ord").collect()] == ["im_table0.png", "im_formula1.png", "im_figure2.png"]
    u = layout.union_box(r, ["page_id"]).first()
    assert (u.x0, u.y0, u.x1, u.y1) == (0, 0, 26, 26)


def test_assembly_orders_words_and_labels(spark):
    t = [("p", 0, "b", 5, 1, "paragraph"), ("p", 1, "T", 0, 9, "title"), ("p", 2, "a", 1, 1, "paragraph"), ("p", 3, "##LTLine##", 0, 0, "figure"), ("q", 4, " ", 0, 0, "title"), ("p", 5, "z", 1, 1, "paragraph")]
    df = spark.createDataFrame(t, "page string, tok_ord long, word string, x0 int, y0 int, label string")
    assert rows(layout.assembled(df, "page")) == [("p", "a z b\nT")]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_contiguous_runs_do_not_depend_on_partitions(spark, parts):
    keys = [None, None, *"aabbbac", "c"] + ["z"] * 50
    df = spark.createDataFrame(list(enumerate(keys)), "o long, k string").repartition(parts)
    got = [(r.run, r.k, r.first_ord, r.last_ord, r.n) for r in layout.contiguous_runs(df, "o", "k").orderBy("run").collect()]
    assert [g[1] for g in got] == [None, "a", "b", "a", "c", "z"] and [g[0] for g in got] == [1, 2, 3, 4, 5, 6] and got[-1][2:] == (9 + 1, 59, 50) and sum(g[4] for g in got) == 60


def test_ranking_metrics(spark):
    data = [(["a", "b", "a"], "b", ["a", "b", "b"]), (["a"], "z", ["z"]), ([], "z", []), (["q", "z"], "z", ["z", "y"])]
    df = spark.createDataFrame(data, "r array<string>, e string, g array<string>")
    r, e, g = F.col("r"), F.col("e"), F.col("g")
    got = [tuple(x) for x in df.select(metrics.recall_at(r, e), metrics.reciprocal_rank(r, e), F.round(metrics.ndcg(r, e), 4), metrics.partial_recall(r, g), metrics.best_reciprocal_rank(r, g), metrics.complete(r, g)).collect()]
    assert got == [(1, 0.5, 0.6309, 1.0, 1.0, 1), (0, 0.0, 0.0, 0.0, 0.0, 0), (0, 0.0, 0.0, 0.0, 0.0, 1), (1, 0.5, 0.6309, 0.5, 0.5, 0)]


def test_overlap_scores(spark):
    assert metrics.bleu_of("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1.0)
    assert metrics.bleu_of("", "x") == 0.0 and metrics.bleu_of("dog", "cat") == 0.0 and 0 < metrics.bleu_of("the cat", "the cat sat down") < 1
    assert metrics.rouge_l_of("cats sat", "the cat sat") == pytest.approx(0.8)
    assert metrics.token_f1_of("a b", "b c") == 0.5
    df = spark.createDataFrame([("a b", None), ("a b", "a b")], "h string, r string")
    assert [x[0] for x in df.select(metrics.rouge_l("h", "r")).collect()] == [None, 1.0]


def test_fusion_blocks(spark):
    df = spark.createDataFrame([([(2, "s2", "c2"), (1, "s1", "c1"), (3, "s1", "c3")], ["f1", "f2"], [(1, "i.png", None)], "Q?", "A"), ([], [], [], "Q?", "A")], "p array<struct<rank:int,source:string,chunk:string>>, f array<string>, i array<struct<rank:int,image_name:string,caption:string>>, q string, a string")
    p, f, i = F.col("p"), F.col("f"), F.col("i")
    x = df.select(fusion.context(p), fusion.facts_block(f), fusion.image_block(i, True), fusion.judge_context(p, f), fusion.user_prompt(F.col("q"), fusion.context(p), plain=True)).collect()
    assert tuple(x[0]) == ("[s1] c1\n\n[s2] c2\n\n[s1] c3", "- f1\n- f2", "- (i.png) ", "c1\n\nc2\n\nc3\nf1\nf2", "Context:\n[s1] c1\n\n[s2] c2\n\n[s1] c3\n\nQuestion: Q?")
    assert tuple(x[1])[:4] == ("", "(none)", "(none)", "\n")
    figure = F.when(F.size(i) > 0, "i.png")
    e = [df.select(fusion.explanation(n, F.col("a"), p, f, figure, F.lit("cap"), F.lit(0.5))).first()[0] for n in (0, 1, 2, 3)]
    assert e[0] == "A" and e[1] == "A\n\nHow I got this: text[s1, s2] + graph[2 facts] + figure[i.png @CLIP 0.50]"
    assert e[2].count("\n") == 5 and "      • f1\n      • f2" in e[3] and "      [s1] c1..." in e[3] and "caption: cap" in e[3]
    assert df.select(fusion.explanation(1, F.col("a"), p, f, figure, F.lit(None).cast("string"), F.lit(None).cast("double"))).collect()[1][0].endswith("(no evidence)")


def test_reports(spark):
    df = spark.createDataFrame([("m", "2024-01", "baseline", 1.0, 5.0), ("m", "2024-02", "baseline", 2.0, None), ("m", "2024-02", "+KG", 3.0, 9.0), (None, "2024-01", "+KG", 1.0, 1.0)], "model string, run_id string, system string, acc double, tok double")
    new = report.newest_run(df, ["model"])
    assert new.count() == 3 and new.where("model is null").count() == 1
    d = report.deltas(new, ["model"], "system", ["acc", "tok"], "baseline", ("+KG", "+both")).collect()
    assert len(d) == 1 and d[0].acc_delta == 1.0 and d[0].tok_delta is None and d[0].contrast == "+KG - baseline"
    g = {r.model: r for r in report.grid(new, "model", "system", "acc", ["baseline", "+KG"]).collect()}
    assert g["m"]["+KG"] == 3.0 and g[None]["baseline"] is None
    assert report.missing_cells(df.select("model", "run_id").distinct(), new, ["model", "run_id"]).count() == 2  # nulls never match
    assert [r[0] for r in df.select(report.enumerated(F.col("system"), ["+KG", "baseline"])).collect()] == [1, 1, 0, 0]


def test_attempt_budget_stops(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "i int, ok boolean")
    assert report.attempt_budget(df, ["i"], "ok", 4).count() == 10  # the fourth success is the tenth attempt
    assert report.attempt_budget(df.withColumn("ok", F.lit(False)), ["i"], "ok", 4).count() == 24


def test_garbled(spark):
    vocabulary = spark.createDataFrame([("mean",), ("rate",)], "word string")
    data = [("a", "gRtopAl mean"), ("b", "Qlorvest mean"), ("c", "mean rate xyzzy"), ("d", "p70 qqqq"), ("e", "WHO BMI"), ("f", "no"), ("g", ""), ("h", None)]
    got = {r.k: r.garbled for r in audit.garbled(spark.createDataFrame(data, "k string, t string"), "k", "t", vocabulary).collect()}
    assert {k for k, v in got.items() if v} == {"a", "b"}


def test_providers(spark):
    df = spark.createDataFrame([(1, "GOOD day. Question: good?"), (2, "FAIL"), (3, "GOOD day. Question: good?"), (4, None)], "id int, p string")
    got = {r.id: r for r in providers.called(df, "id", "p").collect()}
    assert len(got) == 4 and got[1].text == got[3].text == "GOOD day." and got[2].error and got[1].error == ""
    assert providers.embedded(df.where("p is not null"), "id", "p", batch=2).count() == 3
    tries = []

    def flaky(x):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return x

    waits = []
    assert providers.attempted(flaky, [1], sleep=waits.append) == [1] and waits == [1.0, 2.0]
    chunks = spark.createDataFrame([("k1", "Tea is a drink."), ("k1", "Tea is a drink."), ("k2", "x")], "chunk_key string, chunk string")
    cache = spark.createDataFrame([("k2", "[]")], "chunk_key string, triples string")
    all_, new = providers.cached_triples(chunks, cache)
    assert new.count() == 1 and all_.count() == 2


def test_judge_stub_parses():
    r = providers.Stub().judge(["EXPECTED: tea\nGENERATED: some tea", "EXPECTED: tea\nGENERATED: milk", None])
    assert [x.text for x in r] == ["1", "0", "0"]


def test_small_report_columns(spark):
    m = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1)], "b int, t int")
    assert [r[0] for r in m.select(report.outcome(F.col("b"), F.col("t"))).collect()] == ["KG+", "KG-", "=", "="]
    p = spark.createDataFrame([("a/b/q.v2.json", True), ("q.json", False), (".json", True), ("x/a..json", True), ("plain", None)], "p string, v boolean")
    assert [r[0] for r in p.select(report.question_set(F.col("p"), F.col("v"))).collect()] == ["q.v2", "q_captions", ".json", "a.", "plain_captions"]
    s = spark.createDataFrame([("baseline", 10.0), ("baseline", 30.0), ("baseline", 0.0), ("baseline", None), ("+KG", 99.0)], "system string, tok double")
    assert rows(report.token_range(s, "system", "tok")) == [(10.0, 30.0, 20.0)]
    assert rows(audit.known_words(spark.createDataFrame([(" Tea ",), ("of",), ("cup",)], "word string"), spark.createDataFrame([("cup", 4), ("rim", 3)], "word string, df int"))) == [("cup",), ("rim",), ("tea",)]
    f = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None)], "qid int, garbled boolean")
    assert rows(audit.fact_statistics(f, 5)) == [(5, 2, 2.0, 25.0)] and rows(audit.fact_statistics(f.limit(0), 5)) == [(5, 0, None, None)]
    c = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("k3",)], "chunk_key string")
    assert rows(providers.cache_counts(c, spark.createDataFrame([("k2", "[]")], "chunk_key string, triples string"))) == [(4, 1, 3, 2)]
