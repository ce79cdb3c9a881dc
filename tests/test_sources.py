import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnlight.operators import layout
from cairnlight.sources import readers, sinks
from cairnlight.streaming import pages as streams


def docx(path, paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text("eins\nzwei é", encoding="utf-8")
    (tmp_path / "c.csv").write_text("k,v\n1,x\n2,\n", encoding="utf-8")
    docx(tmp_path / "d.DOCX", ["one", " ", "two"])
    got = {r.source: r.text for r in readers.any_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "eins\nzwei é", "c.csv": "k: 1 | v: x\nk: 2 | v: ", "d.DOCX": "one\ntwo"}
    assert readers.text_files(spark, str(tmp_path)).select("source", "text").collect() == [("a.txt", "eins\nzwei é")]
    s = readers.file_texts(readers.csv_sentences(spark, str(tmp_path / "c.csv"))).first()
    assert s.text == "k: 1 | v: x\nk: 2 | v: None"
    (tmp_path / "e.pdf").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported"):
        readers.any_files(spark, str(tmp_path)).collect()


def test_tar_shards_and_publaynet(spark, tmp_path):
    ann = {"annotations": [{"category_id": 5, "bbox": [1.6, 2.0, 3.7, 4.0]}]}
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for name, data in (("p1.png", b"img"), ("p1.json", json.dumps(ann).encode())):
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    samples = readers.tar_samples(spark, [str(tmp_path / "s.tar")])
    assert {(r.key, r.ext) for r in samples.collect()} == {("p1", "png"), ("p1", "json")}
    r = readers.publaynet_regions(samples).first()
    assert (r.key, r.category_id, r.x0, r.x1, r.y1) == ("p1", 5, 1, 5, 6)
    assert readers.tar_samples(spark, [str(tmp_path / "s.tar")], limit=0).count() == 0 and readers.tar_samples(spark, [str(tmp_path / "s.tar")], limit=1).count() == 2
    for n in ("x-0000.tar", "x-0001.tar", "x-0003.tar"):
        (tmp_path / "shards").mkdir(exist_ok=True)
        (tmp_path / "shards" / n).write_bytes(b"")
    assert [x.rpartition("/")[2] for x in readers.shards(spark, str(tmp_path / "shards"))] == ["x-0000.tar", "x-0001.tar"] and len(readers.shards(spark, str(tmp_path / "shards"), first=1)) == 1
    with pytest.raises(FileNotFoundError):
        readers.shards(spark, str(tmp_path / "none"))
    assert readers.contiguous_shards([0, 1, 3]) == [0, 1]
    with pytest.raises(FileNotFoundError):
        readers.contiguous_shards([1])


def test_docbank_and_hotpot(spark):
    t = spark.createDataFrame([(b"img", 0, "w", [[1, 2, 3, 4]], "title")], "image binary, tok_ord long, token string, bounding_box array<array<int>>, label string")
    r = readers.docbank_tokens(t).first()
    assert len(r.page) == 16 and (r.x0, r.y1) == (1, 4)
    assert layout.assembled(readers.docbank_tokens(t), "page").first().text == "w"
    h = spark.createDataFrame([("q", (["A", "B"], [["x ", ""], ["y", "z"]]), (["A", "B", "A"],)), ("r", (["A"], [["x"]]), (["A", "A"],))], "id string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>")
    assert [r.paragraph for r in readers.hotpot_paragraphs(h).orderBy("id", "ord").collect()] == ["x", "y z", "x"]
    files = spark.createDataFrame([("A", "a.txt"), ("B", "b.txt")], "title string, file string")
    assert [(r.id, r.gold) for r in readers.gold_questions(h, files).collect()] == [("q", ["a.txt", "b.txt"])]


def test_questions_captions_summaries(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"q": "a", "source": "x.txt", "answer": "1"}, {"q": "b", "source": ["x.txt", "y.png"], "answer": "2", "type": "multihop", "level": "hard"}]))
    got = readers.questions(spark, str(tmp_path / "q.json")).orderBy("q").collect()
    assert [(r.sources, r.type, r.level, r.is_multi) for r in got] == [(["x.txt"], "text", "unknown", False), (["x.txt", "y.png"], "multihop", "hard", True)]
    assert [r.qid for r in got] == [0, 1] and readers.questions(spark, str(tmp_path / "q.json"), limit=1).first().q == "a"
    (tmp_path / "captions.json").write_text(json.dumps({"i.png": "A plot"}))
    assert [tuple(r) for r in readers.captions(spark, str(tmp_path / "captions.json")).collect()] == [("i.png", "A plot")]
    assert readers.first_existing(spark, [str(tmp_path / "none.json")], str(tmp_path), "captions.json").endswith("captions.json")
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "summary_1.csv").write_text("run_id,question_set,model,system,acc\nr,q,m,baseline,0.5\n")
    (runs / "summary_2.csv").write_text("run_id,question_set,model,system,acc,new\nr,q,m,+KG,x,1\n")
    (runs / "summary_FAILED_3.csv").write_text("run_id,question_set,model,system\nr,q,m,x\n")
    (runs / "summary_multimodal_4.csv").write_text("run_id,system\nr,x\n")
    s = readers.summaries(spark, str(runs))
    assert {(r._source, r.acc, r.new) for r in s.collect()} == {("summary_1.csv", "0.5", None), ("summary_2.csv", "x", "1")}


def test_pools(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x" * 10), ("b.txt", "x" * 3)], "source string, text string")
    assert [r.page_id for r in readers.page_pool(df, 5, 1).collect()] == ["a"]
    for n in ("p_text0.png", "p_table1.png", "p_table0.png"):
        (tmp_path / n).write_bytes(b"1")
    pool = readers.crop_pool(spark, str(tmp_path), 3)
    assert [r.image_name for r in readers.preferred_crops(pool).orderBy("image_name").collect()] == ["p_table0.png", "p_table1.png"]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("a", "old", 1, "law"), ("a", "new", 2, "law"), ("b", " ", 1, "law"), ("c", None, 1, "law")], "source string, text string, ord int, cat string")
    sinks.write_corpus(pages, str(tmp_path / "c"), "cat")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [("a", "[doc_category: law]\nnew")]
    items = spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2)], "key string, v int")
    out = str(tmp_path / "p")
    assert sinks.append_missing(items, out, "key").count() >= 0
    sinks.append_missing(items, out, "key")
    assert spark.read.parquet(out).count() == 2
    sinks.write_csv(items, str(tmp_path / "csv"), ["v", "absent"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["v", "absent"]
    runs = spark.createDataFrame([("r1", ""), ("r1", "x"), ("r2", None)], "run_id string, error string")
    sinks.write_runs(runs, str(tmp_path / "r"))
    assert {(r.run_id, str(r.quarantined).lower()) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("r1", "true"), ("r2", "false")}
    at = sinks.write_index(items, str(tmp_path / "i"), "abc")
    sinks.write_index(items.limit(1), str(tmp_path / "i"), "abc")
    assert spark.read.parquet(at).count() == 3
    sinks.write_items(items, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert readers.existing_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    built = []
    make = lambda: built.append(1) or items
    assert sinks.index_or_build(spark, str(tmp_path / "x"), "f1", make).count() == 3 and sinks.index_or_build(spark, str(tmp_path / "x"), "f1", make).count() == 3 and built == [1]
    crops = spark.createDataFrame([("a.png", bytearray(b"1")), ("a.png", bytearray(b"1"))], "image_name string, content binary")
    sinks.write_crops(crops, str(tmp_path / "crops"))
    assert spark.read.parquet(str(tmp_path / "crops")).count() == 1


def test_streams_without_growing_state(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(12)], "o long, t string").select("o", F.to_timestamp("t").alias("t"))
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df.unionByName(df).repartition(3).write.parquet(src)
    streams.drained_new(streams.stream(spark, src, df), out, ck, ["o"])
    df.write.mode("append").parquet(src)
    streams.drained_new(streams.stream(spark, src, df), out, ck, ["o"])
    assert spark.read.parquet(out).count() == 12
    streams.drained_within(streams.stream(spark, src, df), "t", "1 minute", out + "2", ck + "2", ["o"])
    assert spark.read.parquet(out + "2").count() == 12


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i // 3 % 2]) for i in range(12)], "o long, k string")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df.repartition(3).write.parquet(src)
    streams.drained(streams.stream(spark, src, df), out, ck, ["o"])
    streams.drained(streams.stream(spark, src, df), out, ck, ["o"])
    assert spark.read.parquet(out).count() == 12
    df.withColumn("o", F.col("o") + 6).write.mode("append").parquet(src)
    streams.drained(streams.stream(spark, src, df), out, ck, ["o"])
    assert spark.read.parquet(out).count() == 18
    a = [tuple(r) for r in streams.streamed_runs(spark, src, df.limit(0), "o", "k").orderBy("run").collect()]
    b = [tuple(r) for r in layout.contiguous_runs(spark.read.parquet(src).dropDuplicates(["o"]), "o", "k").orderBy("run").collect()]
    assert len(a) == len(b)
