import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import ablation, audit, fusion, ingest, metrics, providers
from cairnlight.sources import readers, sinks


@pytest.mark.parametrize(("word", "want"), [w.split(":") for w in "caresses:caress ponies:poni ties:tie cats:cat feed:feed agreed:agre plastered:plaster motoring:motor conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit valency:valenc digitizer:digit conformably:conform radically:radic differently:differ analogously:analog vietnamization:vietnam operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formality:formal sensitivity:sensit sensibility:sensibl triplicate:triplic formative:form formalize:formal electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ angularity:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controlling:control rolling:roll at:at".split()])
def test_stems(word, want):
    assert metrics.stem(word) == want


def test_greedy_match_by_hand(spark):
    pairs = spark.createDataFrame([(1, "tea cup", "tea mug"), (2, "tea", "rain"), (3, "", "x"), (4, None, "x")], "pair int, hypothesis string, reference string")
    tokens = spark.createDataFrame([("tea", [1.0, 0.0]), ("cup", [0.0, 1.0]), ("mug", [0.6, 0.8])], "token string, v array<double>")
    got = {r.pair: (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in metrics.greedy_match(pairs, tokens).collect()}
    assert got == {1: (0.9, 0.9, 0.9), 2: (0.0, 0.0, 0.0)}


def test_skips_levels_and_estimates(spark):
    replies = ['```json\n{"q": "Why?", "answer": "so"}\n```', '{"q": "SKIP", "answer": "SKIP"}', "no", '{"q": "only"}', None, "[1]"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [x[0] and tuple(x[0]) for x in df.select(T.authored(F.col("r"))).collect()] == [("Why?", "so"), None, None, None, None, None]
    assert [fusion.parsed_level(x) for x in ("0", "3", "x", None, "")] == [0, 3, 2, 2, 2]
    e = spark.createDataFrame([("one two  three",), ("",), (None,)], "t string")
    assert [tuple(x) for x in e.select(T.estimated_tokens(F.col("t")), T.estimated_tokens(F.col("t"), "words")).collect()] == [(3, 3), (0, 0), (None, None)]


def test_bottleneck(spark):
    rows = [(True, True, True)] * 2 + [(True, True, False)] * 6 + [(True, False, True)] + [(False, True, True)]
    f = audit.bottleneck(audit.funnel(spark.createDataFrame(rows, "a boolean, b boolean, c boolean"), ["a", "b", "c"]), ("a", "b", "c")).first()
    assert (f.a, f.b, f.c, f.verdict) == (9, 8, 2, "retrieval") and abs(f.retrieve_rate - 0.25) < 1e-9
    none = audit.bottleneck(audit.funnel(spark.createDataFrame([], "a boolean, b boolean, c boolean"), ["a", "b", "c"]), ("a", "b", "c")).first()
    assert none.verdict == "extraction" and none.extract_rate == 0.0


# --- providers -------------------------------------------------------------------------------


def test_requests_drop_images_and_never_raise(spark):
    class Counting(providers.Stub):
        """A provider of the process that counts its calls and fails on some requests."""

        def call(self, requests):
            if len(requests) > 1 and any("BAD" in r.user for r in requests):
                raise OSError("one of these is bad")
            if "BAD" in requests[0].user:
                raise OSError("bad")
            return super().call(requests)

    rows = [(1, "sees", "s", "GOOD day. Question: good?", [b"x", b"y"]), (2, "blind", "s", "GOOD day. Question: good?", [b"x"]), (3, "sees", "s", "GOOD day. Question: good?", [b"x", b"y"]), (4, "sees", "s", "BAD", None)]
    df = spark.createDataFrame(rows, "id int, model string, system string, user string, images array<binary>")
    got = {r.id: r for r in providers.requested(df, "id", {"sees": True, "blind": False}, Counting()).collect()}
    assert got[1].in_tok - got[2].in_tok == 2000 and got[3].text == got[1].text == "GOOD day." and "OSError" in got[4].error and len(got) == 4


def test_batches_fall_back_to_single_calls():
    seen = []

    def call(xs):
        seen.append(len(xs))
        if "bad" in xs:
            raise ValueError("no")
        return [providers.Result(x, "m", 1, 1, 0.0, 0.0, "") for x in xs]

    got = providers.batched(call, ["a", "bad", "b", "c"], batch=3, attempts=2, sleep=lambda s: None)
    assert [r.text for r in got] == ["a", "", "b", "c"] and got[1].error == "ValueError: no" and seen[0] == 3 and seen[-1] == 1


def test_clients_and_fallback():
    made = []
    c = providers.Clients({"a": lambda k: made.append(k) or k}, {"a": "key", "b": ""})
    assert c.of("a") == c.of("a") == "key" and made == ["key"]
    with pytest.raises(KeyError):
        c.of("b")
    ok = lambda n: providers.Result("x", n, 0, 0, 0.0, 0.0, "" if n == "second" else "down")
    assert providers.first_responding(["first", "second"], ok) == "second"
    with pytest.raises(RuntimeError):
        providers.first_responding(["first"], ok)
    assert providers.encoded(b"abc")


def test_images_and_texts_share_a_space(spark):
    df = spark.createDataFrame([(1, bytearray(b"tea")), (2, None)], "id int, content binary")
    t = spark.createDataFrame([(1, "tea")], "id int, t string")
    a = {r.id: list(r.v) for r in providers.imaged(df, "id", "content").collect()}
    b = providers.imaged(t, "id", "t", method="embed_for_images").first()
    assert a[1] == list(b.v) and len(a) == 2


def test_authors_reject_and_stop(spark):
    pages = [(1, "Tea is a drink."), (2, "no sentence"), (3, "Chart is a picture."), (4, "Coal is a fuel."), (5, None)]
    df = spark.createDataFrame(pages, "id int, t string")
    got = {r.id: (r.q, r.rejected) for r in providers.authored(df, "id", "t").collect()}
    assert got == {1: ("What is Tea?", None), 2: (None, "unreadable"), 3: ("What is Chart?", "leak"), 4: ("What is Coal?", None)} | {5: (None, "unreadable")}
    assert [r.id for r in providers.authored(df, "id", "t", target=1).collect()] == [1]


# --- ingest ----------------------------------------------------------------------------------


def test_doclaynet(spark):
    box = lambda x: [float(x), 0.0, 50.0, 40.0]
    pages = spark.createDataFrame([(1, "law", ([10, 7, 11], [box(1), box(2), box(3)])), (2, "art", ([10], [box(1)])), (3, "law", None), (4, "law", ([10], [box(9)]))], "page_id int, doc_category string, objects struct<category:array<int>,bbox:array<array<double>>>")
    got = ingest.doclaynet(pages, category="law")
    assert {r.page_id: r.text for r in got.texts.collect()} == {1: "Text 1 0 51 40\nTitle 3 0 53 40", 4: "Text 9 0 59 40"}
    assert [tuple(r) for r in got.crops.select("image_name", "caption").collect()] == [("1_figure0.png", "A picture called 1_figure0.png.")]
    assert tuple(got.counts.first()) == (3, 2, 1, 0)
    assert {r.page_id for r in ingest.doclaynet(pages, limit=2).texts.collect()} == {1, 2}
    assert ingest.doclaynet(pages, smoke=True).crops.first().caption == ingest.SMOKE
    assert ingest.doclaynet(pages.limit(0)).texts.count() == 0


def test_failing_captions_are_placeholders(spark):
    crops = spark.createDataFrame([("a.png",), ("FAIL.png",)], "image_name string")
    assert {r.image_name: r.caption for r in ingest.captioned(crops, "image_name").collect()} == {"a.png": "A picture called a.png.", "FAIL.png": ingest.FAILED}


def test_publaynet_resumes(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for k in ("p1", "p2", "p3"):
            data = json.dumps({"annotations": [{"category_id": 1, "bbox": [0.0, 0.0, 9.0, 9.0]}, {"category_id": 5, "bbox": [1.0, 2.0, 30.0, 40.0]}, {"category_id": 3, "bbox": [1.0, 2.0, 1.0, 40.0]}]}).encode()
            m = tarfile.TarInfo(f"{k}.json")
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    samples = readers.tar_samples(spark, [str(tmp_path / "s.tar")])
    done = spark.createDataFrame([("p1",)], "key string")
    got = ingest.publaynet(samples, done, limit=1)
    assert [tuple(r) for r in got.texts.collect()] == [("p2", "text 0 0 9 9")] and [r.image_name for r in got.crops.collect()] == ["p2_figure0.png"]
    sinks.append_missing(got.texts, str(tmp_path / "progress"), "key")
    assert ingest.publaynet(samples, done).texts.count() == 2


def test_docbank(spark):
    t = [("p", 0, "T", 0, 0, 5, 5, "title"), ("p", 1, "b", 5, 9, 8, 12, "paragraph"), ("p", 2, "##LTLine##", 10, 20, 40, 60, "figure"), ("p", 3, "x", 30, 50, 80, 90, "figure"), ("q", 4, "y", 0, 0, 9, 9, "date")]
    df = spark.createDataFrame(t, "page string, tok_ord long, word string, x0 int, y0 int, x1 int, y1 int, label string")
    got = ingest.docbank(df)
    assert {r.page: r.text for r in got.texts.collect()} == {"p": "T\nb", "q": "y"}
    assert [(r.image_name, r.x0, r.y1) for r in got.crops.collect()] == [("p_figure0.png", 6, 94)] and got.counts.first().pages == 2


def test_hotpotqa(spark):
    rows = [("q1", "a?", "x", "bridge", None, (["A", "B"], [["one "], ["two"]]), (["A", "B"],)), ("q2", "b?", "y", "bridge", "hard", (["A"], [["new"]]), (["A"],)), ("q3", "c?", "z", "comparison", "easy", (["B", "C"], [["b"], [" "]]), (["B", "C"],))]
    df = spark.createDataFrame(rows, "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>")
    pool, kept, short = ingest.hotpotqa(df, each=2)
    assert {r.file: r.text for r in pool.collect()} == {"A.txt": "new", "B.txt": "b"}
    assert [(r.id, r.level, r.gold) for r in kept.collect()] == [("q1", "unknown", ["A.txt", "B.txt"])]
    assert [tuple(r) for r in short.collect()] == [("bridge", 1, 1, 1)]


# --- the four-way comparison -----------------------------------------------------------------

QUESTIONS = "question_id int, q string, answer string, expected array<string>, is_image boolean, passages array<struct<rank:int,source:string,chunk:string>>, facts array<string>, images array<struct<rank:int,image_name:string,caption:string>>, image_ranked array<string>"


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(1, "What is tea?", "a drink", ["s1"], False, [(1, "s1", "Tea is a drink."), (2, "s2", "Coal is a fuel.")], ["tea is hot"], [(1, "f.png", "a cup")], ["f.png"]), (2, "What colour?", "red", ["f.png"], True, [(1, "s2", "No colour.")], [], [(1, "f.png", "a red cup")], ["f.png"])]
    return spark.createDataFrame(rows, QUESTIONS)


def test_systems_and_routing():
    assert ablation.chosen(["+both", "baseline"]) == ["baseline", "+both"] and len(ablation.chosen()) == 4
    with pytest.raises(ValueError, match="unknown"):
        ablation.chosen(["+all"])


def test_every_question_under_every_system_and_model(questions):
    plan = ablation.planned(questions, {"sees": True, "blind": False})
    got = {(r.question_id, r.system, r.model): r for r in plan.collect()}
    assert len(got) == 16
    assert {k[1:]: r.delivery for k, r in got.items() if k[0] == 2} == {("baseline", "sees"): "none", ("baseline", "blind"): "none", ("+KG", "sees"): "none", ("+KG", "blind"): "none", ("+multimodal", "sees"): "pixels", ("+multimodal", "blind"): "caption", ("+both", "sees"): "pixels", ("+both", "blind"): "caption"}
    assert got[1, "+both", "sees"].delivery == "caption" and "- (f.png) a cup" in got[1, "+both", "sees"].prompt and "a red cup" not in got[2, "+both", "sees"].prompt
    assert got[1, "baseline", "sees"].prompt.startswith("Context:\n[s1] Tea") and "hot" not in got[1, "+multimodal", "sees"].prompt and "- tea is hot" in got[1, "+KG", "sees"].prompt
    assert got[2, "+multimodal", "sees"].instruction == fusion.INSTRUCTIONS["text+pixels"] and got[2, "+both", "blind"].instruction == fusion.INSTRUCTIONS["all+captions"]
    assert got[2, "baseline", "sees"].ranked == [] and got[2, "+both", "sees"].ranked == ["f.png"] and got[1, "+both", "sees"].ranked == ["s1", "s2"]
    assert got[1, "+both", "sees"].evidence == "Tea is a drink.\n\nCoal is a fuel.\ntea is hot\na cup"


def test_comparison_and_summary(questions):
    rows = ablation.compared(ablation.planned(questions, {"m": True}, ["+KG", "baseline"]))
    got = {(r.question_id, r.system): r for r in rows.collect()}
    assert len(got) == 4 and got[1, "baseline"].answer_correct == 1 and got[2, "baseline"].answer_correct == 0 and got[1, "+KG"].recall == 1.0 and got[2, "+KG"].complete == 0
    s = ablation.summarised(rows).orderBy("place").collect()
    assert [r.system for r in s] == ["baseline", "+KG"] and s[0].questions == 2 and s[0].answer_correct == 0.5


def test_asking_one_question(questions):
    r = ablation.asked(questions.where("question_id = 1"), "+both", "m", level=1).first()
    assert r.reply.endswith("How I got this: text[s1, s2] + graph[1 facts] + figure[f.png @CLIP 0.00]") and "drink" in r.reply
    assert ablation.asked(questions.where("question_id = 1"), "baseline", "m", level=0).first().reply.count("\n") == 0
