"""Readers: every source becomes a DataFrame with an explicit schema."""

from __future__ import annotations

import io
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.text import row_sentence

DOCUMENTS = "source string, text string, size long, mtime timestamp"
SUMMARY_KEYS = ("run_id", "question_set", "question_type", "model", "vendor", "access", "n_questions", "system")


def _meta(df: DataFrame, text: Column) -> DataFrame:
    return df.select(F.col("_metadata.file_name").alias("source"), text.alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"))


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per file, UTF-8, whole text; the source is the file name with its extension."""
    return _meta(spark.read.option("pathGlobFilter", glob).text(path, wholetext=True), F.col("value"))


def _paragraphs(content: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))
    return "\n".join(t for t in texts if t.strip())


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank paragraphs of every .docx, joined by line breaks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"source": f["source"], "text": [_paragraphs(c) for c in f["content"]], "size": f["size"], "mtime": f["mtime"]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.col("_metadata.file_name").alias("source"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).mapInPandas(run, DOCUMENTS)


def csv_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(source, row sentence) of CSV files with a header; join the rows of a file with file_texts()."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("_metadata.file_name").alias("source"), F.monotonically_increasing_id().alias("ord"), row_sentence(rows.columns).alias("text"))


def file_texts(sentences: DataFrame) -> DataFrame:
    """Row sentences back to one text per file; a file is one small table."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return sentences.groupBy("source").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def any_files(spark: SparkSession, path: str) -> DataFrame:
    """All loadable files by their extension, whatever its case; another extension raises when read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("source"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for name, c in zip(f["source"], f["content"]):
                ext = name.lower().rpartition(".")[2]
                if ext == "txt":
                    texts.append(c.decode("utf-8"))
                elif ext == "docx":
                    texts.append(_paragraphs(c))
                elif ext == "csv":
                    rows = pd.read_csv(io.BytesIO(c), dtype=str, keep_default_na=False)
                    texts.append("\n".join(" | ".join(f"{k}: {v}" for k, v in zip(rows.columns, r)) for r in rows.to_numpy()))
                else:
                    raise ValueError(f"unsupported file type: {name}")
            yield pd.DataFrame({"source": f["source"], "text": texts, "size": f["size"], "mtime": f["mtime"]})

    return files.mapInPandas(run, DOCUMENTS)


def tar_samples(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """(key, name, ext, content) of the members of tar shards; shards are read in parallel, each as a stream from
    its file system, so a task holds one batch of members; limit keeps that many samples (keys), by name."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["path"]:
                with pyarrow.fs.FileSystem.from_uri(p if "://" in p else os.path.abspath(p))[0].open_input_stream(p.partition("://")[2] or os.path.abspath(p)) as source, tarfile.open(fileobj=source, mode="r|") as tar:
                    rows = []
                    for m in tar:
                        if m.isfile():
                            rows.append((m.name.rpartition("/")[2].partition(".")[0], m.name, m.name.partition(".")[2], tar.extractfile(m).read()))
                        if len(rows) == 64:
                            yield pd.DataFrame(rows, columns=["key", "name", "ext", "content"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["key", "name", "ext", "content"])

    out = files.mapInPandas(run, "key string, name string, ext string, content binary")
    return out if limit is None else out.join(out.select("key").distinct().orderBy("key").limit(limit), "key", "left_semi")


def shards(spark: SparkSession, folder: str, pattern: str = "*.tar", first: int | None = None) -> list[str]:
    """The shards of a folder in order of their names, up to the first whose number is missing; at most `first`; none is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = sorted(str(s.getPath()) for s in p.getFileSystem(conf).globStatus(p) or [])
    numbers = [int(re.sub(r"\D", "", x.rpartition("/")[2]) or -1) for x in found]
    kept = [x for i, (x, n) in enumerate(zip(found, numbers)) if n == numbers[0] + i][:first]
    if not kept:
        raise FileNotFoundError(f"no shard in {folder}")
    return kept


def contiguous_shards(found: list[int], most: int = 12) -> list[int]:
    """Shard numbers from 0 up to the first that is missing; none is an error."""
    out = []
    for i in range(most):
        if i not in found:
            break
        out.append(i)
    if not out:
        raise FileNotFoundError("no shard found")
    return out


def publaynet_regions(samples: DataFrame) -> DataFrame:
    """(key, ord, category_id, x0, y0, x1, y1) from the .json members of a tar stream."""
    schema = "annotations array<struct<category_id:int, bbox:array<double>>>"
    a = samples.where("ext = 'json'").select("key", F.posexplode(F.from_json(F.decode("content", "UTF-8"), schema)["annotations"]).alias("ord", "a"))
    b = F.col("a.bbox")
    return a.select("key", "ord", "a.category_id", b[0].cast("int").alias("x0"), b[1].cast("int").alias("y0"), (b[0] + b[2]).cast("int").alias("x1"), (b[1] + b[3]).cast("int").alias("y1"))


def docbank_tokens(rows: DataFrame) -> DataFrame:
    """Token rows with the page key (16 hex digits of the image's MD5) and unnested boxes."""
    b = F.col("bounding_box")[0] if isinstance(rows.schema["bounding_box"].dataType.elementType, T.ArrayType) else F.col("bounding_box")
    return rows.select(F.substring(F.md5("image"), 1, 16).alias("page"), "tok_ord", F.col("token").alias("word"), *[b[i].cast("int").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "label")


def hotpot_paragraphs(rows: DataFrame) -> DataFrame:
    """(id, ord, title, paragraph): sentences trimmed, blank ones dropped, joined by a space."""
    z = F.posexplode(F.arrays_zip(F.col("context.title").alias("t"), F.col("context.sentences").alias("s")))
    return rows.select("id", z.alias("ord", "z")).select("id", "ord", F.col("z.t").alias("title"), F.array_join(F.filter(F.transform("z.s", lambda x: F.trim(x)), lambda x: x != ""), " ").alias("paragraph"))


def gold_questions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, gold): the files of a question's supporting titles, distinct and sorted, where two or more are known.

    files has title and file. Paragraphs of dropped questions stay in the pool.
    """
    titles = rows.select("id", F.explode(F.array_distinct("supporting_facts.title")).alias("title"))
    gold = titles.join(files, "title").groupBy("id").agg(F.sort_array(F.collect_set("file")).alias("gold"))
    return gold.where(F.size("gold") >= 2)


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(qid, q, sources, answer, type, level, is_multi) of JSON arrays whose source is a string or a list; qid is
    the place in the file (files in order of their names), limit keeps the first ones."""
    schema = "array<struct<q:string,source:string,answer:string,type:string,level:string>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.posexplode(F.from_json("value", schema)).alias("pos", "x"))
    sizes = files.groupBy("f").agg(F.count("*").alias("n"))  # one row a file
    before = sizes.select("f", (F.sum("n").over(Window.orderBy("f")) - F.col("n")).alias("before"))
    raw = files.join(before, "f").select((F.col("before") + F.col("pos")).alias("qid"), "x.*")
    raw = raw if limit is None else raw.where(F.col("qid") < limit)
    many = F.col("source").startswith("[")
    return raw.select("qid", "q", F.when(many, F.from_json("source", "array<string>")).otherwise(F.array("source")).alias("sources"), "answer", F.coalesce("type", F.lit("text")).alias("type"), F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce(many, F.lit(False)).alias("is_multi"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, caption) of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("image_name", "caption"))


def summaries(spark: SparkSession, path: str, failed: bool = False) -> DataFrame:
    """Summary CSVs of all runs with their file as _source, by name over differing headers;
    quarantined runs and files without the key columns are left out."""
    fs = spark.read.format("binaryFile").option("pathGlobFilter", "summary_*.csv").load(path).select(F.col("_metadata.file_name").alias("n"), F.col("_metadata.file_path").alias("p")).orderBy("n").collect()  # one name per run
    out = None
    for f in fs:
        if f.n.startswith("summary_FAILED") and not failed:
            continue
        d = spark.read.csv(f.p, header=True)
        if not {"run_id", "question_set", "model", "system"} <= set(d.columns):
            continue
        d = d.withColumn("_source", F.lit(f.n))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*SUMMARY_KEYS, "_source")]))


def first_existing(spark: SparkSession, candidates: list[str], root: str, name: str) -> str | None:
    """The first of fixed candidates that exists, else the first file of that name below root."""
    jvm = spark.sparkContext._jvm
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return c
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select(F.min("_metadata.file_path")).first()
    return found[0]


def page_pool(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(page_id, text, place-order key) of pages long enough, without '.txt', in seeded order."""
    kept = texts.where(F.length(F.trim("text")) >= least)
    return kept.select(F.regexp_replace("source", r"\.txt$", "").alias("page_id"), "text", F.md5(F.concat(F.lit(f"{seed}:"), "source")).alias("place"))


def crop_pool(spark: SparkSession, path: str, seed: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select(F.col("_metadata.file_name").alias("image_name"), "content").withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), "image_name")))


def preferred_crops(pool: DataFrame, n: int = 2) -> DataFrame:
    """n crops by name: figures if there are any, else tables, else any."""
    rank = F.when(F.contains("image_name", F.lit("figure")), 0).when(F.contains("image_name", F.lit("table")), 1).otherwise(2)
    ranked = pool.withColumn("kind", rank)
    least = ranked.agg(F.min("kind").alias("kind"))
    return ranked.join(F.broadcast(least), "kind").orderBy("image_name").limit(n).drop("kind")  # one row


def existing_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of earlier results (progress, items, caches), empty where there is none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
