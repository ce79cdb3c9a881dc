"""Session defaults, shared scratch space and small plan helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "cairnlight", cores: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    """Local session with the defaults that the operators assume."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it.

    Only where that setting is absent on a local master (tests, a laptop) a local folder is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"cairnlight-{sc.applicationId}")
    sc.setCheckpointDir(own)
    return own


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage, survives the loss of an executor, keeps columnar pruning and
    real size statistics for the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """The size of the files of a frame made by stored(), asked of the file system: no file is listed here."""
    spark = df.sparkSession
    path = getattr(df, "_stored_at", None)
    if path is None:
        raise ValueError("not a stored frame")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def broadcast_if_small(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """A stored frame marked for broadcast if its files are at most that large; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if stored_bytes(df) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a frame that is read in fewer splits than there are cores.

    A no-op for large inputs; keeps Python stages of small inputs parallel. The planner's own estimate of
    the input's size decides, then the number of its files; no list of them is fetched, nothing is run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    jvm = spark.sparkContext._jvm
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df if size >= split * cores or not 0 < len(df._jdf.inputFiles()) < cores else df.repartition(cores)
