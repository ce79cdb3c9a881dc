"""Percentiles of very large numeric columns that can be combined.

Method: SQL cumulative frequencies. Values are reduced to counts per (group, value) - the
mergeable state, one table per day or file - which are range-sorted; totals per partition
are added as offsets to window running sums, and the first value whose cumulative count
reaches the target rank is the percentile. No task ever holds a whole group.

Error: with rel_error = 0 the results are exact order statistics. With rel_error = e > 0 all
values whose logarithms fall into the same step of log(1+e) share one count, which bounds
the table by the range of the values instead of their number; `low` and `high` enclose the
exact percentile and high/low <= 1+e. A rank r target is ceil(p*n), at least 1.

Null and NaN values are not counted; a null group is a group of its own. An empty table
gives no rows. Duplicated rows count as often as they occur unless the caller removes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.session import stored

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def frequencies(df: DataFrame, group: list[str], value: str, rel_error: float = 0.0) -> DataFrame:
    """(group..., bin, low, high, n): counts of equal or nearly equal values; partial sums combine map-side."""
    v = F.col(value).cast("double")
    v = F.when(v == 0, F.lit(0.0)).otherwise(v)  # -0.0 and 0.0 are one value
    kept = df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(g) for g in group], v.alias("_v"))
    if rel_error > 0:
        step = F.floor(F.log(F.abs("_v")) / math.log1p(rel_error)).cast("double")
        key = F.when(F.col("_v") == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.signum("_v"), F.signum("_v") * step))
        return kept.withColumn("bin", key).groupBy(*group, "bin").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))
    return kept.groupBy(*group, "_v").agg(F.count("*").alias("n")).select(*group, F.array("_v").alias("bin"), F.col("_v").alias("low"), F.col("_v").alias("high"), "n")


def combine(parts: DataFrame, group: list[str]) -> DataFrame:
    """Sum frequency tables of several days or files (unioned, or one table with extra key columns)."""
    return parts.groupBy(*group, "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def cumulative(freq: DataFrame, group: list[str]) -> DataFrame:
    """(group..., low, high, n, upto, size): how many values of the group reach up to each value, and its size.

    freq is written once to the shared folder in range-sorted form, because the partition a
    row falls into is sampled and must not change between the two reads.
    """
    parts = max(2, freq.sparkSession.sparkContext.defaultParallelism)
    ranged = stored(freq.repartitionByRange(parts, *[F.col(g).asc_nulls_first() for g in group], F.col("low")).withColumn("part", F.spark_partition_id()), "frequencies")
    each = ranged.groupBy("part", *group).agg(F.sum("n").alias("total"))  # at most parts x groups rows
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    each = each.select("part", *group, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"), F.sum("total").over(whole).alias("size"))
    same = [F.col("r.part") == F.col("e.part"), *[F.col(f"r.{g}").eqNullSafe(F.col(f"e.{g}")) for g in group]]
    joined = ranged.alias("r").join(each.alias("e"), same).select("r.part", *[f"r.{g}" for g in group], "low", "high", "r.n", "offset", "size")
    running = Window.partitionBy("part", *group).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*group, "low", "high", "n", (F.col("offset") + F.sum("n").over(running)).alias("upto"), "size")


def percentiles(freq: DataFrame, group: list[str], probs: tuple[float, ...] = PROBS) -> DataFrame:
    """(group..., prob, n, low, high): the bounds of each percentile; low = high where exact."""
    upto = cumulative(freq, group)

    def reached(p: Column) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(p * F.col("size")))
        return (rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n"))

    hits = upto.withColumn("prob", F.explode(F.filter(F.array(*[F.lit(float(p)) for p in probs]), reached)))
    return hits.select(*group, "prob", F.col("size").alias("n"), "low", "high")

