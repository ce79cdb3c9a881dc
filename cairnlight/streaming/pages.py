"""Incremental ingest: the same operators over a file stream, resumable from a checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.operators.layout import contiguous_runs
from cairnlight.session import shared_folder
from cairnlight.sources.readers import existing_or_empty


def stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained_within(source: DataFrame, ts: str, late: str, out: str, checkpoint: str, keys: list[str]) -> None:
    """As drained(), for sources with an event time: keys are remembered only as long as rows may be late, so the
    state is bounded; a repeated key later than that is written again."""
    kept = source.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    q = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def drained_new(source: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """As drained() without any state: every batch is held against the keys that the sink holds (an anti join), so
    it also survives the loss of the checkpoint."""

    def batch(df: DataFrame, _: int) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        done = existing_or_empty(df.sparkSession, out, schema)
        df.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti").write.mode("append").parquet(out)

    q = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drained(source: DataFrame, out: str, checkpoint: str, keys: list[str], batch=None) -> None:  # noqa: ANN001
    """Process what is there and stop: rows whose keys were seen before (in this run or an
    earlier one with the same checkpoint) are skipped; the sink is written exactly once per batch."""
    kept = source.dropDuplicates(keys)
    if batch is None:
        q = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = kept.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def resumed(spark: SparkSession, path: str, like: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The distinct rows of a folder by way of a stream; no state grows with the input."""
    base = f"{shared_folder(spark)}/stream-{label}-{uuid.uuid4().hex}"
    drained_new(stream(spark, path, like), f"{base}/out", f"{base}/checkpoint", keys)
    return spark.read.schema(like.schema).parquet(f"{base}/out")


def streamed_runs(spark: SparkSession, path: str, like: DataFrame, order: str, key: str) -> DataFrame:
    """Contiguous runs of a streamed input: rows arrive in any order, so runs are cut once the
    available input has been drained; the last run is open until more input or the end closes it."""
    return contiguous_runs(resumed(spark, path, like.select(order, key), [order], "runs"), order, key)


def event_windows(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per event-time window with a watermark; the same call serves batch and stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
