"""Page layout: regions, boxes, crops, page assembly and contiguous runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.session import stored

# Labels of the three layout data sets and what they feed.
PUBLAYNET = {1: "text", 2: "title", 3: "list", 4: "table", 5: "figure"}
DOCLAYNET = {1: "Caption", 2: "Footnote", 3: "Formula", 4: "List-item", 5: "Page-footer", 6: "Page-header", 7: "Picture", 8: "Section-header", 9: "Table", 10: "Text", 11: "Title"}
FUNCTION = {"Picture": "figure", "Section-header": "title", "Table": "table", "Title": "title"}  # all other DocLayNet labels are text
DOCBANK = {"abstract": "text", "author": "text", "caption": "text", "date": "text", "equation": "text", "figure": "figure", "footer": "text", "list": "text", "paragraph": "text", "reference": "text", "section": "title", "table": "table", "title": "title"}
TEXT, IMAGE, ALSO_IMAGE = ("text", "title", "table"), ("figure", "table"), ("Formula",)
ROWS = 2_000_000  # rows of a run partition
PLACEHOLDER = "##LTLine##"
MARGIN, LEAST_SIDE, LEAST_CROP = 4, 4, 8


def lookup(values: dict, key: Column) -> Column:
    """A small literal map; unknown keys give null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def regions(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., ord, label, category, x0, y0, x1, y1) of the known, non-degenerate boxes of parallel lists."""
    zipped = F.posexplode(F.arrays_zip(F.col("objects.category").alias("c"), F.col("objects.bbox").alias("b")))
    r = pages.where("objects is not null").select(*keys, zipped.alias("ord", "o")).select(*keys, "ord", lookup(DOCLAYNET, F.col("o.c")).alias("label"), F.col("o.b").alias("b"))
    x, y, w, h = (F.col("b")[i] for i in range(4))
    r = r.where(F.col("label").isNotNull() & (F.size("b") == 4) & (w >= LEAST_SIDE) & (h >= LEAST_SIDE))
    return r.select(*keys, "ord", "label", F.coalesce(lookup(FUNCTION, F.col("label")), F.lit("text")).alias("category"), x.cast("int").alias("x0"), y.cast("int").alias("y0"), (x + w).cast("int").alias("x1"), (y + h).cast("int").alias("y1"))


def text_regions(region: DataFrame) -> DataFrame:
    return region.where(F.col("category").isin(*TEXT))


def crops(region: DataFrame, page: str, name: Column) -> DataFrame:
    """Image regions with their file name: one running number over all categories of a page."""
    images = region.where(F.col("category").isin(*IMAGE) | F.col("label").isin(*ALSO_IMAGE))
    n = F.row_number().over(Window.partitionBy(page).orderBy("ord")) - 1
    kind = F.when(F.col("label").isin(*ALSO_IMAGE), F.lower("label")).otherwise(F.col("category"))
    return images.withColumn("image_name", F.concat(name, F.lit("_"), kind, n.cast("string"), F.lit(".png")))


def union_box(boxes: DataFrame, keys: list[str], width: Column | None = None, height: Column | None = None) -> DataFrame:
    """The box around all boxes of a key with a margin, inside the page; boxes too small to crop are dropped."""
    low = lambda c: F.greatest(F.lit(0), F.min(c) - MARGIN)
    high = lambda c, most: F.max(c) + MARGIN if most is None else F.least(F.max(c) + MARGIN, F.max(most))
    u = boxes.groupBy(*keys).agg(low("x0").alias("x0"), low("y0").alias("y0"), high("x1", width).alias("x1"), high("y1", height).alias("y1"))
    return u.where((F.col("x1") - F.col("x0") >= LEAST_CROP) & (F.col("y1") - F.col("y0") >= LEAST_CROP))


def assembled(tokens: DataFrame, page: str) -> DataFrame:
    """(page, text) of token rows (page, tok_ord, word, x0, y0, label): words of a label in reading
    order, labels in order of first appearance; pages without a word give no row. A page's tokens are bounded."""
    kept = tokens.where(lookup(DOCBANK, F.col("label")).isin(*TEXT) & (F.col("word") != PLACEHOLDER) & (F.trim("word") != ""))
    first = tokens.groupBy(page, "label").agg(F.min("tok_ord").alias("first"))
    per_label = kept.groupBy(page, "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "tok_ord", "word"))), lambda t: t["word"]), " ").alias("text"))
    lines = per_label.join(first, [page, "label"])
    return lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda t: t["text"]), "\n").alias("text"))


def contiguous_runs(rows: DataFrame, order: str, key: str) -> DataFrame:
    """(run, key, first_ord, last_ord, n): stretches of equal keys along a global order.

    The order is range-partitioned, runs are numbered inside each partition, and only the
    first and last key of every partition meet on one task to stitch runs across borders.
    """
    kept = rows.select(F.col(order).alias("o"), F.col(key).alias("k"))
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism, kept.count() // ROWS)
    r = stored(kept.repartitionByRange(parts, "o").withColumn("p", F.spark_partition_id()), "runs")
    w = Window.partitionBy("p").orderBy("o")
    before = F.lag("k").over(w)
    marked = r.withColumn("new", F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col("k").eqNullSafe(before)).cast("int"))).withColumn("local", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = marked.groupBy("p", "local").agg(F.first("k").alias("k"), F.min("o").alias("first_ord"), F.max("o").alias("last_ord"), F.count("*").alias("n"))
    ends = local.groupBy("p").agg(F.min_by("k", "local").alias("k0"), F.max_by("k", "local").alias("k1"), F.max("local").alias("runs"))  # one row per partition
    at = Window.orderBy("p")
    ends = ends.withColumn("starts", F.when(F.lag("p").over(at).isNull(), 1).otherwise((~F.col("k0").eqNullSafe(F.lag("k1").over(at))).cast("int")))
    ends = ends.withColumn("offset", F.sum(F.col("starts") + F.col("runs")).over(at.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs"))
    named = local.join(ends.select("p", "offset"), "p").withColumn("run", F.col("offset") + F.col("local"))
    return named.groupBy("run").agg(F.first("k").alias(key), F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.sum("n").alias("n"))
