"""Writers. All are idempotent per key or per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.sources.readers import existing_or_empty


def write_corpus(pages: DataFrame, path: str, category: str | None = None) -> None:
    """(source, text) of non-empty pages; of equal sources the last (by ord, where there is one) wins.

    category names a column that is put in front as '[doc_category: X]'.
    """
    p = pages.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    text = F.concat(F.lit("[doc_category: "), F.col(category), F.lit("]\n"), F.col("text")) if category else F.col("text")
    last = F.max_by(text, "ord") if "ord" in p.columns else F.max(text)
    p.groupBy("source").agg(last.alias("text")).write.mode("overwrite").parquet(path)


def append_missing(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the table does not hold yet (progress, captions, caches); returns them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = existing_or_empty(rows.sparkSession, path, schema)
    new = rows.dropDuplicates([key]).join(done.select(key), key, "left_anti").select(*rows.columns)
    new.write.mode("append").parquet(path)
    return new


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with these columns; others are ignored, absent ones stay empty. For summaries, which are small."""
    have = set(rows.columns)
    rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_runs(detail: DataFrame, path: str, run: str = "run_id", error: str = "error") -> None:
    """Rows partitioned by whether any call of their run failed."""
    bad = detail.groupBy(run).agg(F.bool_or(F.coalesce(F.col(error) != "", F.lit(False))).alias("quarantined"))
    detail.join(bad, run).write.mode("overwrite").partitionBy("quarantined").parquet(path)


def write_items(items: DataFrame, path: str) -> None:
    items.write.mode("append").json(path)


def write_index(vectors: DataFrame, path: str, fingerprint: str) -> str:
    """Vectors under their corpus fingerprint; an existing folder of it is left as it is."""
    out = f"{path}/fp={fingerprint}"
    vectors.write.mode("ignore").parquet(out)
    return out


def index_or_build(spark, path: str, fingerprint: str, build) -> DataFrame:  # noqa: ANN001
    """The vectors under a fingerprint if they are there and readable, else what build() gives, written first."""
    out = f"{path}/fp={fingerprint}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_crops(crops: DataFrame, path: str) -> None:
    """(image_name, content) of the crops, one row each, partitioned by nothing: a picture is a binary cell."""
    crops.select("image_name", "content").dropDuplicates(["image_name"]).write.mode("append").parquet(path)
