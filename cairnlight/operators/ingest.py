"""Ingest of the four layout and question data sets: regions to page texts, crops with captions, gold questions.

Each composite returns frames; the sinks write them. Pictures and their readings come from a
provider (ocr and caption of bytes); where a page has no picture bytes the provider gets the
key of the crop, which is all the stub looks at. Limits count kept pages, in page order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.filenames import canonical_title, safe_name
from cairnlight.operators import layout, providers, report
from cairnlight.session import stored
from cairnlight.sources import readers

SMOKE, FAILED = "(caption skipped in smoke mode)", "(caption failed)"  # fixed values: what stands for a caption


class Ingested(NamedTuple):
    texts: DataFrame  # page, text: the corpus
    crops: DataFrame  # page, image_name, caption, x0, y0, x1, y1
    counts: DataFrame  # one row


def recognised(regions: DataFrame, key: str, provider: providers.Stub | None = None) -> DataFrame:
    """regions with `reading`: the text of each crop, trimmed; empty ones are dropped."""
    p = provider or providers.Stub()
    schema = T.StructType([*regions.schema.fields, T.StructField("reading", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(reading=[t.strip() for t in providers.attempted(p.ocr, f[key].tolist())])

    return regions.mapInPandas(run, schema).where("reading <> ''")


def captioned(crops: DataFrame, key: str, provider: providers.Stub | None = None, smoke: bool = False) -> DataFrame:
    """crops with `caption`; in smoke mode and where the provider fails a fixed text stands for it."""
    if smoke:
        return crops.withColumn("caption", F.lit(SMOKE))
    p = provider or providers.Stub()
    schema = T.StructType([*crops.schema.fields, T.StructField("caption", T.StringType())])

    def one(image: str) -> str:
        try:
            return providers.attempted(p.caption, [image], attempts=1)[0].strip()
        except Exception:  # noqa: BLE001
            return FAILED

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                said = [c.strip() for c in p.caption(f[key].tolist())]
            except Exception:  # noqa: BLE001 - one bad picture must not cost the batch
                said = [one(x) for x in f[key]]
            yield f.assign(caption=said)

    return crops.mapInPandas(run, schema)


def page_texts(read: DataFrame, page: str) -> DataFrame:
    """(page, text): the readings of a page's regions (a bounded number) joined in annotation order."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "reading")))
    return read.groupBy(page).agg(F.array_join(F.transform(lines, lambda x: x["reading"]), "\n").alias("text"))


def counters(pages: DataFrame, texts: DataFrame, crops: DataFrame) -> DataFrame:
    """One row: pages seen, pages with a text, crops and captions that failed."""
    one = pages.agg(F.count("*").alias("pages"))
    two = texts.agg(F.count("*").alias("kept"))
    three = crops.agg(F.count("*").alias("crops"), F.count_if(F.col("caption") == FAILED).alias("failed"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))  # one row each


def _from_regions(pages: DataFrame, region: DataFrame, page: str, provider, smoke: bool) -> Ingested:  # noqa: ANN001
    keyed = lambda r, name: r.withColumn("picture", F.concat_ws(" ", name, "x0", "y0", "x1", "y1"))
    texts = page_texts(recognised(keyed(layout.text_regions(region), F.col("label")), "picture", provider), page)
    cropped = layout.crops(region, page, F.col(page).cast("string"))
    crops = captioned(cropped.select(page, "ord", "image_name", "x0", "y0", "x1", "y1"), "image_name", provider, smoke)
    texts, crops = stored(texts, "texts"), stored(crops, "crops")
    return Ingested(texts, crops, counters(pages, texts, crops))


def doclaynet(pages: DataFrame, page: str = "page_id", category: str | None = None, limit: int | None = None, provider: providers.Stub | None = None, smoke: bool = False) -> Ingested:
    """Rows with parallel lists of labels and boxes; only those of one doc_category, up to `limit` kept pages."""
    kept = pages if category is None else pages.where(F.col("doc_category") == category)
    if limit is not None:
        kept = kept.orderBy(page).limit(limit)
    return _from_regions(kept, layout.regions(kept, [page]), page, provider, smoke)


def publaynet(samples: DataFrame, done: DataFrame | None = None, limit: int | None = None, provider: providers.Stub | None = None, smoke: bool = False) -> Ingested:
    """Members of tar shards; pages in `done` (key) are skipped before the limit counts, so a run resumes."""
    keys = samples.where("ext = 'json'").select("key").distinct()
    if done is not None:
        keys = keys.join(done.select("key"), "key", "left_anti")
    if limit is not None:
        keys = keys.orderBy("key").limit(limit)
    r = readers.publaynet_regions(samples.join(keys, "key", "left_semi"))
    category = layout.lookup(layout.PUBLAYNET, F.col("category_id"))
    kept = (F.col("x1") - F.col("x0") >= layout.LEAST_SIDE) & (F.col("y1") - F.col("y0") >= layout.LEAST_SIDE) & category.isNotNull()
    region = r.where(kept).select("key", "ord", category.alias("label"), F.when(category == "list", "text").otherwise(category).alias("category"), "x0", "y0", "x1", "y1")
    return _from_regions(keys, region, "key", provider, smoke)


def docbank(tokens: DataFrame, page: str = "page", provider: providers.Stub | None = None, smoke: bool = False) -> Ingested:
    """Token rows (page, tok_ord, word, box, label): texts by label, one crop a figure or table run of the page."""
    texts = layout.assembled(tokens, page)
    kind = layout.lookup(layout.DOCBANK, F.col("label"))
    pictures = tokens.where(kind.isin(*layout.IMAGE)).withColumn("kind", kind)
    boxes = layout.union_box(pictures, [page, "kind"])
    crops = captioned(boxes.withColumn("image_name", F.concat(F.col(page).cast("string"), F.lit("_"), "kind", F.lit("0.png"))).drop("kind"), "image_name", provider, smoke)
    texts, crops = stored(texts, "texts"), stored(crops, "crops")
    return Ingested(texts, crops, counters(tokens.select(page).distinct(), texts, crops))


def hotpotqa(rows: DataFrame, each: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows has id, question, answer, type, level, context and supporting_facts. Returns the pool (file, text) in
    which the last paragraph of a file wins; the questions with two or more gold files, `each` of every type in
    seeded order; and (type, found, kept, short): how many are missing to that."""
    paragraphs = readers.hotpot_paragraphs(rows).withColumn("title", canonical_title("title"))
    named = stored(paragraphs.where("paragraph <> ''").select("id", "ord", "title", "paragraph", F.concat(safe_name("title"), F.lit(".txt")).alias("file")), "paragraphs")
    pool = named.groupBy("file").agg(F.max_by("paragraph", F.struct("id", "ord")).alias("text"))
    gold = readers.gold_questions(rows, named.select("title", "file").distinct())
    found = rows.join(gold, "id").select("id", "question", "answer", "type", F.coalesce("level", F.lit("unknown")).alias("level"), "gold", report.seeded(seed, F.col("id")).alias("o"))
    kept = report.stratified(found, "type", ["o"], each).drop("o")
    short = found.groupBy("type").agg(F.count("*").alias("found")).select("type", "found", F.least("found", F.lit(each)).alias("kept"), F.greatest(F.lit(each) - F.col("found"), F.lit(0)).alias("short"))
    return pool, kept, short


def unused(candidates: DataFrame, asked: DataFrame, page: str, order: list) -> DataFrame:
    """One candidate a page, the first in order, on pages that no earlier question uses."""
    w = Window.partitionBy(page).orderBy(*order)
    return candidates.join(asked.select(page).distinct(), page, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
